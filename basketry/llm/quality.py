"""Problem 9: text statistics per document, and what share of it is prose, by a Gaussian mixture.

A document is read as blocks: runs of lines that are not blank and start alike (page lines with ``+``, ``-`` or a
space; lines with ``#``; lines with ``@``; others). Every block gets counts, from which the document's statistics
and the blocks' features follow. A Gaussian mixture is fitted to the standardised features of all blocks of all
documents by expectation-maximisation; its components get kinds from inspected examples and labelled documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, spread
from .tokens import _pieces, _texts

COUNTS = ["chars", "letters", "digits", "symbols", "words", "common", "odd_words", "ends", "lines", "ended_lines", "new_lines", "upper", "cjk", "new_chars", "top", "total"]
CHUNK = 1_000_000
MAX_LABELS = 20_000

_SENTENCE_END, _OPEN = "..?!。！？…", "\"'”»)」』"


class Kinds:
    """Properties of code points, looked up once per code point and worker."""

    def __init__(self, common: Sequence[str]) -> None:
        self.kind = np.full(0x110000, 255, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        words = [w for w in {w.lower() for w in common if w}]
        self.cjk_common = sorted({ord(c) for w in words for c in w if 0x3040 <= ord(c) <= 0x9FFF})
        self.common = np.unique(np.array([_hash_word(w) for w in words if not any(0x3040 <= ord(c) <= 0x9FFF for c in w)] or [0], np.uint64))

    #: kinds: 0 space, 1 lower letter, 2 upper letter, 3 other letter (CJK), 4 digit, 5 plain punctuation, 6 symbol, 7 mark, 8 unprintable
    def of(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kind[codes]
        new = np.flatnonzero(kinds == 255)
        if len(new):
            for code in set(codes[new].tolist()):
                c = chr(code)
                sort = unicodedata.category(c)
                if c.isspace():
                    kind = 0
                elif 0x3040 <= code <= 0x30FF or 0x3400 <= code <= 0x9FFF or sort == "Lo":
                    kind = 3
                elif sort in ("Lu", "Lt"):
                    kind = 2
                elif sort[0] == "L":
                    kind = 1
                elif sort[0] == "N":
                    kind = 4
                elif sort[0] == "M":
                    kind = 7
                elif c in ".,?!'’-。、！？¿¡…“”„«»\"":
                    kind = 5
                elif sort[0] == "C" or c == "�":
                    kind = 8
                else:
                    kind = 6
                self.kind[code] = kind
                low = c.lower()
                self.lower[code] = ord(low) if len(low) == 1 else code
            kinds = self.kind[codes]
        return kinds


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, _BASE, np.uint64)]), dtype=np.uint64)
_INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, pow(int(_BASE), -1, 1 << 64), np.uint64)]), dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        _INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(int(_BASE), -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    return _POWERS, _INVERSES


def _hash_word(word: str) -> int:
    value = 0
    for k, c in enumerate(word):
        value = (value + (ord(c) + 1) * pow(int(_BASE), k, 1 << 64)) % (1 << 64)
    return value


def block_counts(texts: Sequence[str], kinds: Kinds) -> tuple[np.ndarray, np.ndarray]:
    """``(text of each block, counts of each block)``; texts without a non-blank line have no block."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    begins = np.cumsum(sizes) - sizes
    kind = kinds.of(codes)
    # lines
    breaks = (codes == 10) | ((codes == 13) & ~np.append(codes[1:] == 10, False))
    head = np.zeros(n + 1, bool)
    head[begins[sizes > 0]] = True
    starts = head[:n].copy()
    starts[1:] |= breaks[:-1]
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], n)

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, at, dtype=np.int64)

    solid = kind != 0
    full = per_line(solid)
    letter = (kind >= 1) & (kind <= 3)
    # words: runs of letters, marks and apostrophes that start with a letter; CJK letters are counted by character
    cjk = kind == 3
    alpha = (kind == 1) | (kind == 2) | (kind == 7)
    before = np.append(False, alpha[:-1]) & ~head[:n]
    first = np.flatnonzero(alpha & ~before)
    last = np.flatnonzero(alpha & ~np.append(alpha[1:] & ~head[1:n], False)) + 1
    powers, inverses = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((kinds.lower[codes].astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        word_hash = (sums[last] - sums[first]) * inverses[first]
        line_hash = (sums[ends] - sums[at]) * inverses[at]
    spot = np.minimum(np.searchsorted(kinds.common, word_hash), len(kinds.common) - 1)
    common = kinds.common[spot] == word_hash
    line_of = np.searchsorted(at, first, "right") - 1
    # odd words: joined to a digit, an underscore or another symbol, or with a capital after a small letter
    near = (kind == 4) | (kind == 6) | (kind == 8)
    odd = near[np.maximum(first - 1, 0)] & (first > at[line_of]) | near[np.minimum(last, n - 1)] & (last < n)
    hump = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
    if len(hump) and len(first):
        odd[np.maximum(np.searchsorted(first, hump, "right") - 1, 0)] = True
    count = len(at)
    words = np.bincount(line_of, minlength=count)
    end = np.isin(codes, [ord(c) for c in _SENTENCE_END])
    after = np.append(codes[1:], 10)
    closing = end & ((np.append(kind[1:], 0) == 0) | np.isin(after, [ord(c) for c in _OPEN]) | (codes > 0x2FFF))
    # each line's last solid character
    solid_at = np.flatnonzero(solid)
    final = solid_at[np.maximum(np.searchsorted(solid_at, ends) - 1, 0)] if len(solid_at) else np.zeros(count, np.int64)
    ended = (full > 0) & np.isin(codes[final] if n else codes, [ord(c) for c in _SENTENCE_END + ",;:\"”»"])
    doc = np.searchsorted(begins, at, "right") - 1
    lead = np.where(codes[at] == 45, 43, codes[at])
    lead = np.where((lead == 43) | (lead == 32) | (lead == 9) | (lead == 92), 43, np.where((lead == 35) | (lead == 64), lead, 0))
    # lines seen before in the same text
    both = line_hash ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) 
    order = np.argsort(both, kind="stable")
    fresh = np.ones(count, bool)
    fresh[order[1:]] = both[order[1:]] != both[order[:-1]]
    # the most frequent character of a line stands for runs of one sign
    same = np.append(False, codes[1:] == codes[:-1]) & solid
    columns = [
        full, per_line(letter), per_line(kind == 4), per_line((kind == 6) | (kind == 8)), words + per_line(cjk) // 2,
        np.bincount(line_of[common], minlength=count) + per_line(cjk & np.isin(codes, kinds.cjk_common)) // 2,
        np.bincount(line_of[odd], minlength=count), per_line(closing), (full > 0).astype(np.int64), ended.astype(np.int64),
        (fresh & (full > 0)).astype(np.int64), per_line(kind == 2), per_line(cjk), np.where(fresh, full, 0), per_line(same), ends - at,
    ]
    keep = np.flatnonzero(full > 0)
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros((0, len(COUNTS)), np.int64)
    table = np.stack(columns, 1)[keep]
    new = np.ones(len(keep), bool)
    new[1:] = (doc[keep[1:]] != doc[keep[:-1]]) | (keep[1:] != keep[:-1] + 1) | (lead[keep[1:]] != lead[keep[:-1]])
    blocks = np.flatnonzero(new)
    return doc[keep[blocks]], np.add.reduceat(table, blocks, axis=0)


def features(counts: np.ndarray) -> np.ndarray:
    """What the mixture sees of a block."""
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    some = lambda x: np.maximum(x, 1.0)
    sentences = c["ends"] / some(c["chars"])
    cjk = c["cjk"] / some(c["letters"])
    return np.stack(
        [
            np.sqrt(c["common"] / some(c["words"])),
            np.sqrt(c["symbols"] / some(c["chars"])),
            np.sqrt(c["digits"] / some(c["chars"])),
            np.sqrt(np.minimum(sentences, 0.05)),
            np.log1p(c["words"] / some(c["lines"])),
            np.log(np.clip((c["letters"] - c["cjk"]) / some(c["words"] - c["cjk"] // 2), 1, 12)) * (1 - cjk) + 1.5 * cjk,
            np.sqrt(c["odd_words"] / some(c["words"])),
            c["new_chars"] / some(c["chars"]),
            cjk,
        ],
        1,
    )


#: Inspected examples, in the manner of the corpus: a few blocks of each kind. Components of the mixture start
#: from them, and each component gets the kind of the examples it answers for.
EXAMPLES = [
    ("prose", "The reader checks the window twice when the file is large, and the old value is kept until then. It was not what we wanted.\nIf the log is empty, then nothing is written. We now look at the date first, so that the table doesn't grow."),
    ("prose", "This was changed because the parser lost a record at the end of each page. \"It works,\" said the report, and it was right about that."),
    ("prose", "Si el fichero está vacío, el lector no guarda nada. ¿Por qué se repite la regla? Porque nadie lo había mirado en la revisión.\nAhora se ordena la tabla antes de que la cola cierra."),
    ("prose", "Der Leser prüft das Fenster, wenn die Datei leer ist. Das war nicht zu erwarten, aber es ist auch nach dem Neustart so.\nFür die Tabelle fehlt noch der Schlüssel."),
    ("prose", "Es ist nicht klar, ob der Speicher auch nach dem Neustart leer bleibt. Vor dieser Änderung wurde die Übersicht nie gelöscht, und das fiel erst spät auf.\nDas war so: die Prüfung zählt das Maß, wenn der Zeiger fehlerhaft ist."),
    ("prose", "Avant, le fichier était lu deux fois ; c'est réglé. On ne sait pas encore si la règle est gardée, mais les tests passent.\nIl faut que le lecteur soit vérifié avant la fin."),
    ("prose", "Мы убрали файл, потому что буфер теряет его дважды. Если список ещё не готов, то ключ не нужно проверять.\nЭто изменение не трогает отчёт, но теперь всё работает быстрее."),
    ("prose_cjk", "この変更で表は古い値を失うことがなくなります。まだ記録が残っていますが、索引には影響しません。"),
    ("prose_cjk", "読み込み部の前に値を確認する必要がありました。処理の順番を変えましたので、問題はありません。"),
    ("code", "+    for item in sorted(level_seq):\n+        merge_edge.append((item_rank, emit_window))\n     if splitRead is not None and seq_count > 17:\n-        return pruneScan[scanFit]"),
    ("code", " \tif (!p->read_item)\n-\t\treturn -28;\n+static int item_fit(struct scan_read *p, size_t n)\n+#define prune_edge 0x013a\n }"),
    ("code", "diff --git a/lag/scan.c b/lag/scan.c\nindex c4119c7..5b4507c 100644"),
    ("code", " rank_split: 278\n+load_emit = [\"read_emit\", \"prune_load\"]\n   - readLevel\n-[item_split.count_load]"),
    ("header", "commit 24453928037eb977fab6c560dacffdb026ddcda\nAuthor: Dana Example <dana.example@mail.example>\nDate:   2024-01-17 04:56:25 +0000"),
    ("header", "From: Dana Example <dana.example@mail.example>\nDate: 2024-02-21 15:07:04 +0000\nSubject: [PATCH] Fix stale cache"),
    ("header", "# HG changeset patch\n# User Dana Example <dana.example@mail.example>\n# Node bc3c29e130fd782f40821daeebb1fb562b45aacc"),
    ("subject", "Rework nested table"),
    ("subject", "chore(rule): sort record"),
    ("list", "queue\nthreshold\ncallback\nretry loop\nrule list\nbuffer\nrelease note\nsession"),
    ("list", "1. close log message\n2. rebuild graph\n3. copy tree\n4. keep log message"),
    ("list", "  * shared merge step, long lock;\n  * long page, wrong session;\n  * broken lock, wrong worker;"),
    ("words", "merge step slow threshold callback basket shared default value redundant odd graph keeps odd slow shared queue needs record reader parser"),
    ("words", "still of which than every because to no had at the into now it more when are so with is by before this a there was that"),
    ("words", "nur ist auch die der nach wenn jede es sich an für so nicht vor oder war bei ein und wie aber den noch dem"),
    ("words", "за для была но бы из без и уже только когда все по если то с перед как так от же в мы каждый или к"),
    ("words", "から まで した この の こと に が ます する ない と です も は で ので その を"),
    ("table", "| case | before | after | note |\n|---|---:|---:|---|\n| queue | 30.09 | 63.28 | quiet |\n| graph | 75.63 | 37.24 | unused |"),
    ("table", " rule/seq/item.c              |   58 ++++++----\n count/window.js             |   15 ++\n node/prune.toml              |   36 +-----------"),
    ("table", " -3.278  -1.719   6.111\n  1.442   3.056   5.914\n  5.402  -0.913  -4.730"),
    ("table", "2025-03-23 22:02:52,228 WARN item_edge t=318ms\n2025-01-02 00:45:30,498 INFO lag_scan t=11ms"),
    ("junk", "ovpq394 7re0brfjpb ty;2~7caz~11g 89old~;xnou3/spi djjiv2s  xc 7 qpe62kw 1p71h/,0n  b1 7~;78"),
    ("junk", "-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x-x"),
    ("junk", "zA@Sx2|A797j`R~`}1CrF5uI6H^Tr9PIP5hGfbEi@y9ixNZQIGgV(yo2~>^&QG6w(p\nz4n~z;#hl5dF9reSgN!AOEEgB1Nc+6Ug;U|D7KXVI@lA>9G5@MaM?!WE^*G6lq+jX<"),
    ("repeated", "Synchronise with upstream.\nSynchronise with upstream.\nSynchronise with upstream.\nSynchronise with upstream.\nSynchronise with upstream."),
]


class Mixture:
    """A Gaussian mixture with diagonal covariances over standardised features."""

    rounds, move = 0, float("inf")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, centres: np.ndarray, spreads: np.ndarray) -> None:
        self.mean, self.scale, self.weights, self.centres, self.spreads = mean, scale, weights, centres, spreads

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the components' shares, and its standardised features."""
        z = (x - self.mean) / self.scale
        inverse = 1 / self.spreads
        log = np.log(self.weights) - 0.5 * (np.log(self.spreads).sum(1) + (self.centres**2 * inverse).sum(1)) + z @ (self.centres * inverse).T - 0.5 * (z**2) @ inverse.T
        log -= log.max(1, keepdims=True)
        r = np.exp(log)
        return r / r.sum(1, keepdims=True), z

    def sums(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sufficient statistics of rows: per component weight, weighted sums and sums of squares."""
        r, z = self.responsibilities(x)
        r *= weight[:, None]
        return np.concatenate([r.sum(0)[:, None], r.T @ z, r.T @ z**2], 1)

    def step(self, sums: np.ndarray, floor: float) -> float:
        """The maximisation; gives the largest move of a centre."""
        n, d = np.maximum(sums[:, 0], 1e-9), self.centres.shape[1]
        centres = sums[:, 1 : d + 1] / n[:, None]
        alive = sums[:, 0] > 1e-6 * sums[:, 0].sum()
        move = np.abs(centres - self.centres)[alive].max()
        self.centres = np.where(alive[:, None], centres, self.centres)
        self.spreads = np.where(alive[:, None], np.maximum(sums[:, d + 1 :] / n[:, None] - centres**2, floor), self.spreads)
        self.weights = np.maximum(sums[:, 0] / sums[:, 0].sum(), 1e-6)
        return float(move)

    @classmethod
    def start(cls, mean: np.ndarray, scale: np.ndarray, examples: np.ndarray) -> Mixture:
        k = len(examples)
        return cls(mean, scale, np.full(k, 1 / k), (examples - mean) / scale, np.full((k, len(mean)), 0.3))


def start_examples(kinds: Kinds) -> tuple[list[str], np.ndarray]:
    """Kinds and features of the examples' blocks."""
    doc, counts = block_counts([text for _, text in EXAMPLES], kinds)
    return [EXAMPLES[d][0] for d in doc], features(counts)


_KINDS: dict[tuple, Kinds] = {}


def _kinds(common: tuple[str, ...]) -> Kinds:
    if common not in _KINDS:
        _KINDS[common] = Kinds(common)
    return _KINDS[common]


def common_list(words: DataFrame, column: str = "word", most: int = 50_000) -> tuple[str, ...]:
    """The common words as a tuple, for tasks; a table of more than ``most`` is refused, not cut."""
    rows = words.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    return tuple(sorted(r[0] for r in rows))


def document_blocks(frame: DataFrame, common: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size bigint, counts array<int>)``: every row's text length and the counts of its blocks, one after
    the other. Null, empty and blank texts have an empty array. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds(common)
        for batch in batches:
            for part in _pieces(batch, 4 << 20):
                texts = [t or "" for t in _texts(part.column(1))]
                doc, counts = block_counts(texts, kinds)
                per = np.bincount(doc, minlength=len(texts)) * len(COUNTS)
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), lists], names=["key", "size", "counts"])

    fields = [T.StructField("key", frame.schema[key].dataType), T.StructField("size", T.LongType()), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    rows = spread(frame.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, T.StructType(fields))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all blocks of a batch, and the row of each block."""
    offsets = column.offsets.to_numpy()
    table = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, len(COUNTS))
    return table, np.repeat(np.arange(len(column)), np.diff(offsets) // len(COUNTS))


def _gather(blocks: DataFrame, fold, size: int) -> np.ndarray:
    """Sum over all blocks of ``fold(counts)``, a vector of ``size``. A task gives one vector as rows of (place, value);
    they are summed in the JVM, so ``size`` rows come to the driver whatever the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            table = _matrix(batch.column(0))[0]
            for at in range(0, len(table), 20_000):
                total += fold(table[at : at + 20_000])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for row in blocks.select("counts").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[row["k"]] = row["v"]
    return out


_WEIGHT = COUNTS.index("total")


def fit_mixture(blocks: DataFrame, common: tuple[str, ...], rounds: int = 30, floor: float = 0.02, settled: float = 0.05) -> tuple[Mixture, list[str]]:
    """The mixture over all blocks, each weighing as many as its characters, and each component's kind.

    Rounds end when no centre moves by ``settled`` standard deviations any more; ``model.rounds`` and ``model.move``
    say after how many that was and how far the last one moved a centre.
    """
    kinds, examples = start_examples(_kinds(common))
    d = examples.shape[1]

    def moments(table: np.ndarray) -> np.ndarray:
        x, w = features(table), table[:, _WEIGHT].astype(float)
        return np.concatenate([[w.sum()], w @ x, w @ x**2])

    m = _gather(blocks, moments, 2 * d + 1)
    n = max(m[0], 1.0)
    mean = m[1 : d + 1] / n
    scale = np.sqrt(np.maximum(m[d + 1 :] / n - mean**2, 1e-4))
    model = Mixture.start(mean, scale, examples)
    if m[0] > 0:
        for model.rounds in range(1, rounds + 1):
            sums = _gather(blocks, lambda t: model.sums(features(t), t[:, _WEIGHT].astype(float)).ravel(), len(kinds) * (2 * d + 1))
            model.move = model.step(sums.reshape(len(kinds), -1), floor)
            if model.move < settled:
                break
    # a component is of the kind of the examples that it answers for, or else of the one it began with
    votes, _ = model.responsibilities(examples)
    names = []
    for k, own in enumerate(kinds):
        tally: dict[str, float] = {}
        for e, kind in enumerate(kinds):
            tally[kind] = tally.get(kind, 0.0) + votes[e, k]
        best = max(sorted(tally), key=tally.get)
        names.append(best if tally[best] > 0.5 else own)
    return model, names


def _shares(blocks: DataFrame, model: Mixture) -> DataFrame:
    """``(key, size, total array<bigint>, parts array<double>)``: a row's summed counts, and its characters by component."""
    k = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                piece = batch.slice(at, 2_000)
                table, row = _matrix(piece.column(2))
                total, parts = np.zeros((piece.num_rows, len(COUNTS)), np.int64), np.zeros((piece.num_rows, k))
                if len(table):
                    firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    total[row[firsts]] = np.add.reduceat(table.astype(np.int64), firsts, axis=0)
                    r = model.responsibilities(features(table))[0] * table[:, _WEIGHT : _WEIGHT + 1]
                    parts[row[firsts]] = np.add.reduceat(r, firsts, axis=0)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (total, parts)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *lists], names=["key", "size", "total", "parts"])

    fields = [blocks.schema["key"], blocks.schema["size"], *T._parse_datatype_string("total array<bigint>, parts array<double>").fields]
    return blocks.select("key", "size", "counts").mapInArrow(run, T.StructType(fields))


def _adjust(names: list[str], parts: np.ndarray, sizes: np.ndarray, prose: np.ndarray) -> list[bool]:
    """Which components are prose: those of that kind, after changes that leave fewer labelled documents wrong."""
    flags = np.array([n.startswith("prose") for n in names])
    share = parts / np.maximum(sizes, 1)[:, None]
    wrong = lambda f: int(((share[:, f].sum(1) >= 0.5) != prose).sum())
    best = wrong(flags) if len(parts) else 0
    while best:
        tries = []
        for k in range(len(flags)):
            changed = flags.copy()
            changed[k] = ~changed[k]
            tries.append((wrong(changed), k))
        least, k = min(tries)
        if least >= best - 1:  # a change for a single document would only fit the sample
            break
        flags[k], best = ~flags[k], least
    return flags.tolist()


def document_quality(documents: DataFrame, common_words: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per document: statistics of its text, its share of prose and its prevailing kind.

    Columns: ``key, n_chars, words, mean_word_length, symbol_ratio, digit_ratio, upper_ratio, odd_word_share,
    common_word_share, ended_line_share, repeated_share, sentence_ends, lines, prose_share, kind``. Ratios are by
    non-blank characters, words or lines and null where there are none; null, empty and blank texts have zero
    counts, a null ``prose_share`` and kind ``blank``. Rows of equal key stay apart. Whole texts are read, in two
    passes over the documents' blocks per result (counts once, stored; then the mixture's rounds over the counts).

    ``labels`` (key, label) serve to correct the kinds of the components; at most ``max_labels`` rows of them are
    used, those of the smallest hashes of their keys.
    """
    common = common_list(common_words)
    blocks = cut(document_blocks(documents, common, key, text))
    model, names = fit_mixture(blocks, common)
    shares = _shares(blocks, model)
    parts, sizes, prose = np.zeros((0, len(names))), np.zeros(0), np.zeros(0, bool)
    if labels is not None:
        few = labels.where(F.col("label").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), "label").orderBy(F.xxhash64("key"), "key", "label").limit(max_labels)
        known = _shares(blocks.join(F.broadcast(few.select("key").distinct()), "key", "left_semi"), model).join(F.broadcast(few), "key").select("size", "parts", "label").collect()
        if known:
            parts, sizes, prose = np.array([r["parts"] for r in known]), np.array([r["size"] for r in known]), np.array([r["label"] == "prose" for r in known])
    flags = _adjust(names, parts, sizes, prose)
    c = {name: F.element_at("total", k + 1) for k, name in enumerate(COUNTS)}
    ratio = lambda a, b: F.when(b > 0, a / b)
    add = lambda which: F.aggregate(F.array(*[F.element_at("parts", k + 1) for k in which]), F.lit(0.0), lambda s, x: s + x) if which else F.lit(0.0)
    prose_chars = add([k for k, f in enumerate(flags) if f])
    plain = {n if not n.startswith("prose") else "other" for k, n in enumerate(names) if not flags[k]}
    mass = [F.struct(prose_chars.alias("m"), F.lit("prose").alias("k"))]
    mass += [F.struct(add([k for k, n in enumerate(names) if not flags[k] and (n if not n.startswith("prose") else "other") == kind]).alias("m"), F.lit(kind).alias("k")) for kind in sorted(plain)]
    return shares.select(
        F.col("key").alias(key), F.col("size").alias("n_chars"), c["words"].alias("words"),
        ratio(c["letters"], c["words"]).alias("mean_word_length"), ratio(c["symbols"], c["chars"]).alias("symbol_ratio"),
        ratio(c["digits"], c["chars"]).alias("digit_ratio"), ratio(c["upper"], c["letters"]).alias("upper_ratio"),
        ratio(c["odd_words"], c["words"]).alias("odd_word_share"), ratio(c["common"], c["words"]).alias("common_word_share"),
        ratio(c["ended_lines"], c["lines"]).alias("ended_line_share"), ratio(c["chars"] - c["new_chars"], c["chars"]).alias("repeated_share"),
        c["ends"].alias("sentence_ends"), c["lines"].alias("lines"),
        F.when(c["chars"] > 0, prose_chars / F.col("size")).alias("prose_share"),
        F.when(c["chars"] > 0, F.array_max(F.array(*mass))["k"]).otherwise("blank").alias("kind"),
    )


def components(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(component, kind, weight, rounds, last_move)`` of the fitted mixture: what it found, and how it settled."""
    common = common_list(common_words)
    model, names = fit_mixture(cut(document_blocks(documents, common, key, text)), common)
    rows = [(k, n, float(w), model.rounds, float(model.move)) for k, (n, w) in enumerate(zip(names, model.weights))]
    return documents.sparkSession.createDataFrame(rows, "component int, kind string, weight double, rounds int, last_move double")


def unnatural(documents: DataFrame, common_words: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(doc_id)`` of the documents with non-blank text of which less than half the characters are prose."""
    return document_quality(documents, common_words, labels).where("prose_share < 0.5").select("doc_id")
