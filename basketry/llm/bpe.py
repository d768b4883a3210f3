"""Byte-level BPE over whole batches of text: speculate greedily, verify by arrays, merge what fails.

1. *Split.* Texts are cut into words as by the public pattern of the vocabulary, on an array of code
   points instead of by a regular expression.
2. *Deduplicate.* Equal words of a batch get one number (a 64-bit polynomial hash; words longer than
   ``LONG`` are never merged), and words met before are taken from a bounded cache.
3. *Speculate.* Greedy longest match in the vocabulary's trie proposes tokens for all new words at once.
4. *Verify.* Every adjacent pair of proposed tokens is tested by array operations: a proposal is right
   if no merge across a boundary would have come before the merges that built its two sides.
5. *Merge.* Only words with a failing pair undergo exact merging.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LONG = 256
CHUNK = 1_000_000
CACHE_WORDS = 1_000_000

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 3, 0, 255
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Table:
    """int64 -> int32 map in arrays, looked up for many keys at once; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        rest = np.arange(len(keys))
        at = self._slot(keys)
        while len(rest):
            free = self.keys[at] < 0
            first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)[1]
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]] = keys[rest[first]], values[rest[first]]
            keep = np.ones(len(rest), bool)
            keep[first] = False
            rest, at = rest[keep], (at[keep] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_BASE)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out


class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary file."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocabulary = byte_letters(), model["vocab"]
        self.of_byte = np.zeros(256, np.int32)
        spelled = {}
        for text, token in vocabulary.items():
            raw = bytes(letters[c] for c in text)
            spelled[token] = raw
            if len(raw) == 1:
                self.of_byte[raw[0]] = token
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        whole = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        size = max(vocabulary.values()) + 1
        # order[t]: when t is built; bytes come first
        self.order = np.full(size, -1, np.int64)
        self.order[whole] = np.arange(len(merges))
        self.left, self.right = np.arange(size), np.arange(size)
        self.left[whole], self.right[whole] = left, right
        self.sound = len(np.unique(whole)) == len(whole)
        self.pairs = _Table(left * size + right, whole.astype(np.int32))
        self.ranks = {(a, b): (k, w) for k, (a, b, w) in enumerate(zip(left.tolist(), right.tolist(), whole.tolist()))}
        self.size = size
        nodes, keys, values, ends = {b"": 0}, [], [], [-1]
        for token, raw in spelled.items():
            at = 0
            for k in range(1, len(raw) + 1):
                part = raw[:k]
                after = nodes.get(part)
                if after is None:
                    after = nodes[part] = len(ends)
                    ends.append(-1)
                    keys.append(at * 256 + raw[k - 1])
                    values.append(after)
                at = after
            ends[at] = token
        self.ends = np.array(ends, np.int32)
        self.trie = _Table(np.array(keys, np.int64), np.array(values, np.int32))
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.kinds[WHITE_SPACE] = SPACE
        self.powers = self.inverses = np.zeros(0, np.uint64)
        self._forget()

    # -- words ---------------------------------------------------------------------------------

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.store, self.store_end = np.zeros(1 << 16, np.int32), 0
        self.word_at, self.word_len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def classify(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kinds[codes]
        new = np.flatnonzero(kinds == UNKNOWN)
        if len(new):
            for code in set(codes[new].tolist()):
                sort = unicodedata.category(chr(code))[0]
                self.kinds[code] = LETTER if sort == "L" else NUMBER if sort == "N" else OTHER
            kinds = self.kinds[codes]
        return kinds

    def split(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """First positions of all words; ``begins`` are the first positions of the texts (none empty)."""
        n, kinds = len(codes), self.classify(codes)
        head = np.zeros(n + 1, bool)
        head[begins] = True
        head[n] = True
        start = head[:n].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        # white space before something else: its last character stands alone, or joins what follows if a space
        after = np.flatnonzero((kinds[1:] != SPACE) & (kinds[:-1] == SPACE) & ~head[1:n]) + 1
        start[after - 1] = True
        start[after[codes[after - 1] == 32]] = False
        # contractions
        quote = np.flatnonzero((codes == 39) & start)
        if len(quote):
            one = np.where(head[quote + 1], 0, codes[np.minimum(quote + 1, n - 1)])
            two = np.where((one == 0) | head[np.minimum(quote + 2, n)], 0, codes[np.minimum(quote + 2, n - 1)])
            size = np.where(np.isin(one, (115, 116, 109, 100)), 2, 0)
            size = np.where(((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)), 3, size)
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            ends = quote + size
            start[ends[ends < n]] = True
        return np.flatnonzero(start)

    def _hash(self, codes: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(codes)
        if len(self.powers) < n:
            size = max(n, CHUNK)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
                self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
            return (sums[ends] - sums[at]) * self.inverses[at]

    # -- tokens of words -----------------------------------------------------------------------

    def _greedy(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left for all words at once: tokens and how many each word has."""
        words, heads, tokens = [], [], []
        pos, start = at.copy(), at.copy()
        node, best, best_at = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int32), at.copy()
        live = np.arange(len(at))
        while len(live):
            inside = pos < ends[live]
            step = np.full(len(live), -1, np.int64)
            step[inside] = self.trie.get(node[inside] * 256 + data[pos[inside]])
            stop = step < 0
            go = ~stop
            pos[go] += 1
            node[go] = step[go]
            end = self.ends[np.where(go, step, 0)]
            hit = go & (end >= 0)
            best[hit], best_at[hit] = end[hit], pos[hit]
            if stop.any():
                words.append(live[stop])
                heads.append(start[stop])
                tokens.append(best[stop])
                pos[stop] = start[stop] = best_at[stop]
                node[stop] = 0
                keep = ~(stop & (pos >= ends[live]))
                if not keep.all():
                    live, pos, start, node, best, best_at = (x[keep] for x in (live, pos, start, node, best, best_at))
        words, heads, tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, heads, tokens))
        sort = np.argsort(heads, kind="stable")
        return tokens[sort].astype(np.int64), np.bincount(words, minlength=len(at))

    def _compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether exact merging leaves each pair of neighbours apart.

        Undo the two tokens' merges from the latest back; at each moment the two parts that touch must
        not have a merge that would have come before the one undone last.
        """
        right = np.ones(len(one), bool)
        open_, a, b = np.arange(len(one)), one.copy(), two.copy()
        limit = np.full(len(one), np.iinfo(np.int64).max)
        while len(open_):
            merged = self.pairs.get(a * self.size + b)
            when = np.where(merged >= 0, self.order[merged], np.iinfo(np.int64).max)
            bad = (merged >= 0) & (when < limit)
            right[open_[bad]] = False
            # the later of the two is undone; of equals the right one, as merging goes from the left.
            # what is left of a pair's left token may merge up to and not with the undone moment,
            # what is right of it up to and with it
            from_left = self.order[a] > self.order[b]
            later = np.where(from_left, self.order[a], self.order[b])
            more = ~bad & (later >= 0)
            limit = np.where(from_left, later, later + 1)
            a, b = np.where(from_left, self.right[a], a), np.where(from_left, b, self.left[b])
            open_, a, b, limit = open_[more], a[more], b[more], limit[more]
        return right

    def merge(self, raw: bytes) -> list[int]:
        """Exact merging of one word."""
        parts = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        ranks = self.ranks
        if len(parts) < 40:
            while len(parts) > 1:
                best = min((ranks[p][0], k) if (p := (parts[k], parts[k + 1])) in ranks else (1 << 60, k) for k in range(len(parts) - 1))
                if best[0] == 1 << 60:
                    break
                k = best[1]
                parts[k : k + 2] = [ranks[parts[k], parts[k + 1]][1]]
            return parts
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(r[0], k, r[1], parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (r := ranks.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, whole, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j < 0 or parts[j] != b:
                continue
            parts[k], parts[j] = whole, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
                if r := ranks.get((whole, parts[after[j]])):
                    heapq.heappush(heap, (r[0], k, r[1], whole, parts[after[j]]))
            if before[k] >= 0 and (r := ranks.get((parts[before[k]], whole))):
                heapq.heappush(heap, (r[0], before[k], r[1], parts[before[k]], whole))
        return [p for p in parts if p >= 0]

    def words(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words, one after the other, and how many each has."""
        sizes = np.array([len(r) for r in raws], np.int64)
        data = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        short = np.flatnonzero(sizes <= LONG)
        parts: list = [None] * len(raws)
        counts = np.zeros(len(raws), np.int64)
        tokens, n = self._greedy(data, ends[short] - sizes[short], ends[short])
        counts[short] = n
        firsts = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(short)), n)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.zeros(len(short), bool)
        bad[owner[pair[~self._compatible(tokens[pair], tokens[pair + 1])]]] = True
        if not self.sound:
            bad[:] = True
        redo = [*short[bad].tolist(), *np.flatnonzero(sizes > LONG).tolist()]
        if not redo:
            return tokens, counts
        for k in redo:
            parts[k] = np.array(self.merge(raws[k]), np.int64)
            counts[k] = len(parts[k])
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        good = short[~bad]
        if len(good):
            lengths = counts[good]
            inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[np.repeat(at[good], lengths) + inner] = tokens[np.repeat(firsts[~bad], lengths) + inner]
        for k in redo:
            out[at[k] : at[k] + counts[k]] = parts[k]
        return out, counts

    def _slots(self, keys: np.ndarray, texts: list[str], codes: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the cache has the words; new ones are encoded and added. ``keys`` below zero are not kept."""
        known = self.known
        slots = np.array([known.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(slots < 0)
        if not len(new):
            return slots
        text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") if texts is None else texts
        raws = [text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(at[new].tolist(), ends[new].tolist())]
        tokens, counts = self.words(raws)
        first, end = len(known), self.store_end + len(tokens)
        while end > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.store_end : end] = tokens
        while first + len(new) > len(self.word_at):
            self.word_at, self.word_len = np.concatenate([self.word_at, self.word_at]), np.concatenate([self.word_len, self.word_len])
        slots[new] = numbers = np.arange(first, first + len(new))
        self.word_at[numbers] = self.store_end + np.cumsum(counts) - counts
        self.word_len[numbers] = counts
        self.store_end = end
        known.update(zip(keys[new].tolist(), numbers.tolist()))
        return slots

    def _chunk(self, texts: list[str], counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (none empty), one after the other, and how many each has."""
        text = "".join(texts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        at = self.split(codes, begins)
        ends = np.append(at[1:], len(codes))
        length = ends - at
        keys = self._hash(codes, at, ends) ^ (length.astype(np.uint64) << np.uint64(48))
        long = np.flatnonzero(length > LONG)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHE_WORDS:
            self._forget()
        slots = self._slots(unique, text, codes, at[first], ends[first])[inverse]
        n = self.word_len[slots].astype(np.int64)
        begin = self.word_at[slots]
        extra, extra_n = np.zeros(0, np.int32), []
        if len(long):  # a hash is not trusted for long words
            found = [np.array(self.merge(text[a:b].encode("utf-8", "surrogatepass")), np.int32) for a, b in zip(at[long].tolist(), ends[long].tolist())]
            extra, extra_n = np.concatenate(found), np.array([len(f) for f in found])
            n[long] = extra_n
            begin[long] = self.store_end + np.cumsum(extra_n) - extra_n
        sums = np.concatenate([[0], np.cumsum(n)])
        word = np.searchsorted(at, np.append(begins, len(codes)))
        per_text = np.diff(sums[word])
        if counts_only:
            return np.zeros(0, np.int32), per_text
        pool = np.concatenate([self.store[: self.store_end], extra]) if len(long) else self.store
        return pool[np.repeat(begin - sums[:-1], n) + np.arange(sums[-1])], per_text

    def encode(self, texts: list[str | None], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has; null and empty texts have none."""
        counts = np.zeros(len(texts), np.int64)
        ids, part, index, size = [], [], [], 0
        for k in range(len(texts) + 1):
            text = texts[k] if k < len(texts) else None
            if part and (k == len(texts) or size + len(text or "") > CHUNK):
                found, n = self._chunk(part, counts_only)
                ids.append(found)
                counts[index] = n
                part, index, size = [], [], 0
            if text:
                part.append(text)
                index.append(k)
                size += len(text)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), counts
