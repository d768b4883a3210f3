"""Frequent itemsets in two passes: what is frequent somewhere is counted everywhere.

The partition principle: an itemset that reaches a share of all transactions reaches it in at least one part of
them. Equal transactions are merged first where many are equal. The rows are dealt once into parts of near-equal
size, none smaller than :data:`MIN_PART` rows unless its whole group is, so that little is frequent in a part by
chance. Pass 1 mines each part on bit vectors (or vectors of degrees or utilities); pass 2 counts the union of what
was found over all parts and keeps what reaches the threshold exactly. A group that is one part is exact after
pass 1. Candidates are a table: tasks hold at most :data:`BLOCK` of them at a time, block after block. Both passes
only send sums of candidates to the shuffle. Groups (windows, classes, data sets, permutations) are mined side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, cut_counted, discard

#: Rows of a part: about CHUNK at most, MIN_PART at least where the cores want more parts than that gives.
CHUNK, MIN_PART = 50_000, 10_000
#: Candidates that a task holds at a time.
BLOCK = 200_000
#: Groups whose sizes are sent to every task; of more, they are joined by shuffle.
SMALL_GROUPS = 100_000
ONE = "-"


def min_count(share: float, total: int) -> int:
    """The least whole number of transactions that is ``share`` of ``total``."""
    return max(1, math.ceil(share * total - 1e-9))


def check_share(share: float, name: str = "min_supp", zero: bool = False) -> None:
    if not ((0 <= share if zero else 0 < share) and share <= 1):
        raise ValueError(f"{name} must lie in {'[' if zero else '('}0, 1]")


class _Chunk:
    """Some transactions as columns: where each item stands, its values, and how often each transaction is there."""

    def __init__(self, items: pa.Array, values: pa.Array | None = None, weights: np.ndarray | None = None) -> None:
        offsets = items.offsets.to_numpy()
        flat = items.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.n = len(items)
        self.where = np.repeat(np.arange(self.n), np.diff(offsets))
        coded = flat.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy()
        self.number = None
        if values is not None:
            at = values.offsets.to_numpy()
            self.number = values.values.to_numpy()[at[0] : at[-1]]
        self.weights = None if weights is None or (weights == 1).all() else weights.astype(float)
        self.total = float(self.n if self.weights is None else self.weights.sum())
        self.order = np.argsort(self.code, kind="stable")
        self.bounds = np.searchsorted(self.code[self.order], np.arange(len(self.names) + 1))
        self.place = {name: k for k, name in enumerate(self.names)}
        self._worth: np.ndarray | None = None

    def per_item(self, value: np.ndarray | None = None) -> np.ndarray:
        """Sums over each item's rows of ``value`` (1 without), by code."""
        if self.weights is not None:
            value = self.weights[self.where] if value is None else value * self.weights[self.where]
        return np.bincount(self.code, value, len(self.names)).astype(float)

    @property
    def worth(self) -> np.ndarray:
        """Each transaction's sum of values."""
        if self._worth is None:
            self._worth = np.bincount(self.where, self.number, self.n)
        return self._worth

    def rows(self, name: str) -> np.ndarray:
        k = self.place.get(name)
        return np.zeros(0, np.int64) if k is None else self.order[self.bounds[k] : self.bounds[k + 1]]


class Payload:
    """What is kept of an item in a chunk, how two are joined, and what is summed of it: here, membership."""

    #: sums per itemset
    width = 1

    def names(self, chunk: _Chunk) -> list[str]:
        return chunk.names

    def vector(self, chunk: _Chunk, name: str):
        bits = np.zeros(chunk.n, bool)
        bits[chunk.where[chunk.rows(name)]] = True
        return bits if chunk.weights is not None else np.packbits(np.pad(bits, (0, -chunk.n % 64))).view(np.uint64)

    def join(self, a, b):
        return a & b

    def sums(self, v, chunk: _Chunk) -> np.ndarray:
        return np.array([float(np.bitwise_count(v).sum()) if chunk.weights is None else chunk.weights[v].sum()])

    def bound(self, chunk: _Chunk) -> np.ndarray:
        """Per name, what no itemset with it exceeds in the measure of :meth:`value`."""
        return chunk.per_item()

    def value(self, sums: np.ndarray) -> float:
        return sums[0]

    def base(self, chunk: _Chunk) -> float:
        return chunk.total

    def reaches(self, value, share, base):
        return value >= np.ceil(share * base - 1e-9)


NEGATION = "~"


class Literals(Payload):
    """Membership of items and absence of named ones: absent items take no place in the rows."""

    def __init__(self, negated: Sequence[str]) -> None:
        self.negated = sorted(negated)
        self._absent = {NEGATION + i: i for i in self.negated}

    def names(self, chunk):
        return chunk.names + [n for n in self._absent if n not in chunk.place]

    def vector(self, chunk, name):
        if name not in self._absent or name in chunk.place:
            return super().vector(chunk, name)
        bits = np.ones(chunk.n, bool)
        bits[chunk.where[chunk.rows(self._absent[name])]] = False
        return bits if chunk.weights is not None else np.packbits(np.pad(bits, (0, -chunk.n % 64))).view(np.uint64)

    def bound(self, chunk):
        there = chunk.per_item()
        return np.concatenate([there, [chunk.total - (there[chunk.place[i]] if i in chunk.place else 0) for n, i in self._absent.items() if n not in chunk.place]])


class Degrees(Payload):
    """Fuzzy items: the smallest degree of each transaction, counted at each alpha level (1 first)."""

    def __init__(self, levels: int) -> None:
        self.width = levels
        self.alphas = np.arange(1, levels + 1) / levels

    def vector(self, chunk, name):
        out, at = np.zeros(chunk.n), chunk.rows(name)
        out[chunk.where[at]] = chunk.number[at]  # an item stands in a transaction once
        return out

    def join(self, a, b):
        return np.minimum(a, b)

    def sums(self, v, chunk):
        above = np.bincount(np.searchsorted(self.alphas, v, "right"), chunk.weights, self.width + 1)[1:]
        return np.cumsum(above[::-1]).astype(float)

    def value(self, sums):
        return sums.sum() / self.width

    def reaches(self, value, share, base):
        return value >= share * base - 1e-9


class FuzzyLiterals(Degrees):
    """Fuzzy items and complements level by level: at level ``a`` the item ``~x`` holds where ``x`` does not reach ``a``.

    Of a set, each transaction keeps the smallest degree of its items and the largest of those it denies.
    """

    def __init__(self, levels: int, negated: Sequence[str]) -> None:
        super().__init__(levels)
        self._absent = {NEGATION + i: i for i in sorted(negated)}

    def names(self, chunk):
        return chunk.names + [n for n in self._absent if n not in chunk.place]

    def vector(self, chunk, name):
        if name in self._absent and name not in chunk.place:
            return np.stack([np.ones(chunk.n), super().vector(chunk, self._absent[name])])
        return np.stack([super().vector(chunk, name), np.full(chunk.n, -1.0)])

    def join(self, a, b):
        return np.stack([np.minimum(a[0], b[0]), np.maximum(a[1], b[1])])

    def sums(self, v, chunk):
        reached, denied = (np.searchsorted(self.alphas, x, "right") for x in v)
        some = np.flatnonzero(reached > denied)
        w = None if chunk.weights is None else chunk.weights[some]
        change = np.bincount(denied[some], w, self.width + 1).astype(float) - np.bincount(reached[some], w, self.width + 1)
        return np.cumsum(change)[: self.width][::-1]

    def bound(self, chunk):
        return np.full(len(self.names(chunk)), chunk.total)


class Utilities(Payload):
    """Items with a utility: sums of the itemset's utility, of its transactions' whole utility, and their number."""

    width = 3

    def vector(self, chunk, name):
        out, at = np.full(chunk.n, np.nan), chunk.rows(name)
        out[chunk.where[at]] = chunk.number[at]
        return out

    def join(self, a, b):
        return a + b

    def sums(self, v, chunk):
        there = np.flatnonzero(~np.isnan(v))
        w = 1.0 if chunk.weights is None else chunk.weights[there]
        return np.array([(v[there] * w).sum(), (chunk.worth[there] * w).sum(), len(there) if chunk.weights is None else w.sum()])

    def bound(self, chunk):
        return chunk.per_item(chunk.worth[chunk.where])

    def value(self, sums):
        return sums[1]

    def base(self, chunk):
        return float((chunk.worth if chunk.weights is None else chunk.worth * chunk.weights).sum())

    def reaches(self, value, share, base):
        return value >= share * base - 1e-9 * max(1.0, abs(share * base))


def _mine(chunk: _Chunk, payload: Payload, share: float, max_len: int | None, item_share: dict[str, float], forbid: dict[str, set]) -> Iterator[tuple[tuple[str, ...], np.ndarray]]:
    """Itemsets that reach their threshold within a chunk, and their sums, depth first."""
    base = payload.base(chunk)

    def good(sums, items) -> bool:
        least = max([item_share.get(i, share) for i in items]) if item_share else share
        return payload.reaches(payload.value(sums), least, base)

    # a cheap bound before vectors are made: most items of a large vocabulary end here
    names = payload.names(chunk)
    shares = np.array([item_share.get(i, share) for i in names]) if item_share else share
    first = []
    for name in sorted(names[k] for k in np.flatnonzero(payload.bound(chunk) >= shares * base * (1 - 1e-9) - 1e-9)):
        vector = payload.vector(chunk, name)
        sums = payload.sums(vector, chunk)
        if good(sums, (name,)):
            first.append((name, vector, sums, vector))
    stack = [((), first)]
    while stack:
        prefix, tail = stack.pop()
        for k, (name, vector, sums, _) in enumerate(tail):
            itemset = (*prefix, name)
            yield itemset, sums
            if max_len is not None and len(itemset) >= max_len:
                continue
            longer = []
            barred = forbid.get(name, ())
            for other, _, _, own in tail[k + 1 :]:
                if other in barred:
                    continue
                both = payload.join(vector, own)
                sums = payload.sums(both, chunk)
                if good(sums, (*itemset, other)):
                    longer.append((other, both, sums, own))
            if longer:
                stack.append((itemset, longer))


def _sums(chunk: _Chunk, payload: Payload, itemsets: Sequence[tuple[str, ...]]) -> np.ndarray:
    """Exact sums of sorted itemsets, vectors of common beginnings made once."""
    out = np.zeros((len(itemsets), payload.width))
    path: list[tuple[str, object]] = []
    cache: dict[str, object] = {}
    for k, itemset in enumerate(itemsets):
        same = 0
        while same < min(len(path), len(itemset)) and path[same][0] == itemset[same]:
            same += 1
        del path[same:]
        for name in itemset[same:]:
            if name not in cache:
                cache[name] = payload.vector(chunk, name)
            path.append((name, payload.join(path[-1][1], cache[name]) if path else cache[name]))
        out[k] = payload.sums(path[-1][1], chunk)
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Chunk]]:
    """``(group, part)`` from rows ``(g, part, items[, values], w)`` that stand part after part."""
    held: list[pa.RecordBatch] = []
    last = None

    def flush():
        table = pa.Table.from_batches(held)
        column = lambda name: table.column(name).combine_chunks()
        return last[0], _Chunk(column("items"), column("values") if "values" in table.column_names else None, column("w").to_numpy())

    for batch in batches:
        if not batch.num_rows:
            continue
        group, part = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        turns = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *turns], [*turns, batch.num_rows]):
            key = (batch.column(0)[int(a)].as_py(), int(part[a]))
            if held and key != last:
                yield flush()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def _sized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Chunk]:
    """Chunks of some ``size`` rows from rows of items; for counting, where the rest may be short."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield _Chunk(pa.Table.from_batches(held).column(0).combine_chunks())
            held = []
    if sum(b.num_rows for b in held):
        yield _Chunk(pa.Table.from_batches(held).column(0).combine_chunks())


def _batch(group: str, itemsets: Sequence[tuple[str, ...]], sums: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array([group] * len(itemsets)), pa.array(itemsets, pa.list_(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=["g", "itemset", "sums"])


_FOUND = "g string, itemset array<string>, sums array<double>"


def _blocks(candidates: DataFrame, count: int) -> Iterator[dict[str, list[tuple[str, ...]]]]:
    """A table of ``count`` distinct (g, itemset), in blocks of about BLOCK rows, each by group and sorted."""
    blocks = max(1, math.ceil(count / BLOCK))
    for b in range(blocks):
        part = candidates if blocks == 1 else candidates.where(F.pmod(F.xxhash64("g", "itemset"), F.lit(blocks)) == b)
        held: dict[str, list[tuple[str, ...]]] = {}
        for row in part.select("g", "itemset").toLocalIterator():
            held.setdefault(row["g"], []).append(tuple(row["itemset"]))
        for found in held.values():
            found.sort()
        yield held


def mine(
    frame: DataFrame,
    min_supp: float,
    items: str = "items",
    values: str | None = None,
    group: str | None = None,
    max_len: int | None = None,
    payload: Payload | None = None,
    item_share: dict[str, float] | None = None,
    forbid: dict[str, set] | None = None,
    chunk: int = CHUNK,
    least_part: int = MIN_PART,
    stored: bool = False,
) -> DataFrame:
    """``([group,] itemset, size, sums array<double>, n)`` of the itemsets that reach ``min_supp``.

    ``frame`` has one row per transaction: an array of distinct item names, an array of values beside it for
    degrees and utilities, and an optional group, mined by itself. Empty transactions count in ``n``. It is stored
    first, unless it is read from a stored table already (``stored``).
    """
    payload = payload or Payload()
    forbid, item_share = forbid or {}, item_share or {}
    listed = F.coalesce(F.col(items), F.array().cast("array<string>"))
    columns = {"g": F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit(ONE), "items": listed if values else F.array_sort(listed)}
    if values:
        columns["values"] = F.coalesce(F.col(values), F.array().cast("array<double>"))
    rows = frame.select(*[c.alias(n) for n, c in columns.items()])
    rows = rows if stored else cut(rows)
    held_back = [] if stored else [rows]
    content = list(columns)[1:]
    worth = F.sum(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)) if values else F.lit(0.0)
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), worth.alias("base"), F.approx_count_distinct(F.xxhash64(*content)).alias("d"))
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if group:
        sizes = cut(sizes)
        extent = sizes.agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.count(F.lit(1)).alias("groups")).first()
    else:
        extent = sizes.withColumn("groups", F.lit(1)).first()
    if extent is None or not extent["n"]:
        out = frame.sparkSession.createDataFrame([], T._parse_datatype_string("g string, itemset array<string>, size int, sums array<double>, n bigint"))
        return out.drop("g") if not group else out.withColumnRenamed("g", group)
    # merge equal transactions where that halves them at least
    merged = 2 * extent["d"] < extent["n"]
    if merged:
        rows, mark = rows.groupBy("g", *content).agg(F.count(F.lit(1)).alias("w")), F.xxhash64(*content)
    else:
        rows, mark = rows.withColumn("w", F.lit(1).cast("bigint")), F.xxhash64(F.monotonically_increasing_id())
    few, width = min(least_part, chunk), math.ceil(cores / extent["groups"])
    if not group:
        have = extent["d" if merged else "n"]
        total = max(1, min(have // few, max(width, have // chunk)))
        rows = rows.withColumn("part", F.pmod(mark, F.lit(total)).cast("int")).repartitionById(total, F.col("part"))
    else:
        have = F.col("d" if merged else "n")
        sizes = sizes.withColumn("parts", F.greatest(F.lit(1), F.least(F.floor(have / few), F.greatest(F.lit(width), F.floor(have / chunk)))).cast("int"))
        total = sizes.agg(F.sum("parts")).first()[0]
        side = sizes.select("g", "parts")
        rows = rows.join(F.broadcast(side) if extent["groups"] <= SMALL_GROUPS else side, "g").withColumn("part", F.pmod(mark, "parts").cast("int"))
        tasks = max(1, min(total, max(2 * cores, math.ceil(extent["d" if merged else "n"] / chunk))))
        rows = rows.repartitionById(tasks, F.pmod(F.xxhash64("g") + F.col("part"), F.lit(tasks)).cast("int")).sortWithinPartitions("g", "part")
    rows = rows.select("g", "part", *content, "w")
    single = total == extent["groups"]
    if not single:
        rows = cut(rows, whole_files=True)

    def first(batches):
        for name, one in _parts(batches):
            held, sums = [], []
            for itemset, s in _mine(one, payload, min_supp, max_len, item_share, forbid):
                held.append(itemset)
                sums.append(s)
                if len(held) == 50_000:
                    yield _batch(name, held, np.array(sums))
                    held, sums = [], []
            if held:
                yield _batch(name, held, np.array(sums))

    found = rows.mapInArrow(first, _FOUND)
    if not single:
        candidates, count = cut_counted(found.select("g", "itemset").distinct())
        counted = []
        for held in _blocks(candidates, count):

            def second(batches, held=held):
                for name, one in _parts(batches):
                    wanted = held.get(name, [])
                    if wanted:
                        sums = _sums(one, payload, wanted)
                        hit = np.flatnonzero(sums.any(1))
                        yield _batch(name, [wanted[k] for k in hit], sums[hit])

            part = rows.mapInArrow(second, _FOUND).groupBy("g", "itemset").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(payload.width)]).alias("sums"))
            counted.append(part if count <= BLOCK else cut(part))
        found = counted[0]
        for part in counted[1:]:
            found = found.unionByName(part)
    if group:
        side = sizes.select("g", "n", "base")
        full = found.join(F.broadcast(side) if extent["groups"] <= SMALL_GROUPS else side, "g")
    else:
        full = found.withColumns({"n": F.lit(extent["n"]).cast("bigint"), "base": F.lit(float(extent["base"] or 0.0))})
    full = full.withColumn("size", F.size("itemset"))
    least = F.lit(float(min_supp))
    if item_share:
        table = F.create_map(*[x for k, v in item_share.items() for x in (F.lit(k), F.lit(float(v)))])
        least = F.array_max(F.transform("itemset", lambda i: F.coalesce(table[i], F.lit(float(min_supp)))))
    if isinstance(payload, Degrees):
        good = F.aggregate("sums", F.lit(0.0), lambda s, x: s + x) / payload.width >= least * F.col("n") - 1e-9
    elif isinstance(payload, Utilities):
        good = F.col("sums")[0] >= least * F.col("base") - 1e-9 * F.greatest(F.lit(1.0), least * F.col("base"))
    else:
        good = F.col("sums")[0] >= F.ceil(least * F.col("n") - 1e-9)
    out = cut(full.where(good).select("g", "itemset", "size", "sums", "n"))
    for table in [*held_back, *([] if single else [rows, candidates])]:
        discard(table)
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def to_baskets(long: DataFrame, tid: str = "tid", item: str = "item") -> DataFrame:
    """``(tid, items)`` from rows of one item each; null items count for nothing but their transaction."""
    return long.groupBy(F.col(tid).alias("tid")).agg(F.array_sort(F.collect_set(item)).alias("items"))


def _counted(found: DataFrame, *extra: str) -> DataFrame:
    count = F.col("sums")[0].cast("bigint")
    return found.select(*extra, "itemset", "size", count.alias("count"), (count / F.col("n")).alias("support"))


def frequent_itemsets(baskets: DataFrame, min_supp: float, max_len: int | None = None, items: str = "items", group: str | None = None, stored: bool = False) -> DataFrame:
    """``([group,] itemset, size, count, support)`` of all itemsets in at least ``min_supp`` of the baskets.

    ``baskets`` has one row per basket; items are de-duplicated, nulls dropped; empty and null baskets count.
    """
    check_share(min_supp)
    clean = baskets.withColumn(items, F.array_distinct(F.array_compact(F.coalesce(F.col(items), F.array().cast("array<string>")))))
    return _counted(mine(clean, min_supp, items, group=group, max_len=max_len, stored=stored), *([group] if group else []))


def fpgrowth(baskets: DataFrame, min_supp: float, items: str = "items") -> DataFrame:
    """The same result by Spark's own pattern-growth miner, its threshold set between whole counts."""
    from pyspark.ml.fpm import FPGrowth

    check_share(min_supp)
    clean = baskets.select(F.array_distinct(F.array_compact(F.coalesce(F.col(items), F.array().cast("array<string>")))).alias("items"))
    total = clean.count()
    if not total:
        return clean.sparkSession.createDataFrame([], "itemset array<string>, size int, count bigint, support double")
    model = FPGrowth(itemsCol="items", minSupport=(min_count(min_supp, total) - 0.5) / total).fit(clean)
    return model.freqItemsets.select(F.array_sort("items").alias("itemset"), F.size("items").alias("size"), F.col("freq").alias("count"), (F.col("freq") / total).alias("support"))


def join_candidates(frequent: DataFrame) -> DataFrame:
    """``(itemset)`` one longer than those of ``frequent``, all of one size: two that agree in all but the last
    item are joined, and a candidate stays if every subset one shorter is frequent."""
    head = F.slice("itemset", 1, F.size("itemset") - 1)
    a = frequent.select(head.alias("head"), "itemset")
    b = frequent.select(head.alias("head"), F.element_at("itemset", -1).alias("last"))
    joined = a.join(b, "head").where(F.col("last") > F.element_at("itemset", -1)).select(F.concat("itemset", F.array("last")).alias("itemset"))
    there = _subsets(joined).join(frequent.select(F.col("itemset").alias("subset")), "subset", "left_semi")
    return there.groupBy("itemset").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == F.size("itemset")).select("itemset")


def apriori(long: DataFrame, min_supp: float, total: int, tid: str = "tid", item: str = "item", max_len: int | None = None, drop_rare: bool = True) -> DataFrame:
    """The same result level by level: frequent itemsets are joined to candidates, and those counted over the baskets.

    The baskets are stored once (``drop_rare`` leaves infrequent items out of them, as the variant with
    transaction lists does); a level is one pass over them, in which only the candidates' counts are shuffled.
    """
    check_share(min_supp)
    least = min_count(min_supp, total)
    rows = long.where(F.col(item).isNotNull()).select(F.col(tid).alias("tid"), F.col(item).alias("item"))
    if drop_rare:  # rows need not be distinct yet: an item with too few rows has too few baskets
        often = rows.groupBy("item").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("item")
        rows = rows.join(often, "item", "left_semi")
    baskets = cut(to_baskets(rows).select("items"))
    level, frequent = cut_counted(baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least).select(F.array("item").alias("itemset"), "count"))
    levels, size = [], 1
    while frequent:
        levels.append(level)
        if max_len is not None and size >= max_len:
            break
        level, frequent = cut_counted(count_table(baskets, join_candidates(level)).where(F.col("count") >= least))
        size += 1
    discard(baskets)
    if not levels:
        return long.sparkSession.createDataFrame([], "itemset array<string>, size int, count bigint, support double")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("itemset", F.size("itemset").alias("size"), "count", (F.col("count") / total).alias("support"))


def eclat(long: DataFrame, min_supp: float, total: int, tid: str = "tid", item: str = "item") -> DataFrame:
    """Frequent itemsets on vertical bit vectors, from the long layout; ``total`` may exceed the transactions there."""
    baskets = to_baskets(long, tid, item)
    there = baskets.count()
    if total < there:
        raise ValueError("total is less than the number of transactions")
    found = mine(baskets, min_supp * total / max(there, 1) if there else min_supp)
    least = min_count(min_supp, total)
    count = F.col("sums")[0].cast("bigint")
    return found.where(count >= least).select("itemset", "size", count.alias("count"), (count / total).alias("support"))


def _subsets(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Immediate proper subsets of itemsets: ``(keys, itemset, subset)``."""
    places = F.sequence(F.lit(1), F.size("itemset"))
    less = F.transform(places, lambda k: F.filter("itemset", lambda x, i: i + 1 != k))
    return found.where(F.size("itemset") > 1).select(*keys, "*", F.explode(less).alias("subset"))


def closed_itemsets(found: DataFrame, value: str = "support", tolerance: float = 1e-12) -> DataFrame:
    """Itemsets without a superset of the same support (on all levels, if ``value`` is an array)."""
    kind = dict(found.dtypes)[value]
    above = _subsets(found.select("itemset", F.col(value).alias("above"))).select(F.col("subset").alias("itemset"), "above")
    both = found.join(above, "itemset")
    if kind.startswith("array"):
        same = F.forall(F.zip_with(value, "above", lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    else:
        same = F.abs(F.col(value) - F.col("above")) <= tolerance
    return found.join(both.where(same).select("itemset"), "itemset", "left_anti").select(*found.columns)


def maximal_itemsets(found: DataFrame) -> DataFrame:
    """Itemsets without any superset in the table."""
    return found.join(_subsets(found.select("itemset")).select(F.col("subset").alias("itemset")), "itemset", "left_anti").select(*found.columns)


def support_from_closed(wanted: DataFrame, closed: DataFrame, value: str = "support") -> DataFrame:
    """``(itemset, value)``: the largest support of the closed supersets, null without one.

    Pairs share a first item, so the comparison is an equi-join before the test for containment.
    """
    every = closed.select(F.col("itemset").alias("whole"), F.explode("itemset").alias("first"), F.col(value).alias("v"))
    asked = wanted.select("itemset", F.element_at("itemset", 1).alias("first")).distinct()
    hit = asked.join(every, "first").where(F.size(F.array_except("itemset", "whole")) == 0)
    best = hit.groupBy("itemset").agg(F.max("v").alias(value))
    return asked.select("itemset").join(best, "itemset", "left")


def top_k_itemsets(baskets: DataFrame, k: int, min_len: int = 1, max_len: int | None = None, min_supp: float = 0.0, items: str = "items") -> DataFrame:
    """The ``k`` itemsets of the largest support (then fewer items, then names), by falling thresholds."""
    if k < 1 or min_len < 1 or (max_len is not None and max_len < min_len):
        raise ValueError("k and min_len must be positive and max_len not below min_len")
    check_share(min_supp, zero=True)
    total = baskets.count()
    share = max(min_supp, 0.5)
    while True:
        found = frequent_itemsets(baskets, max(share, 1 / max(total, 1)), max_len, items).where(F.col("size") >= min_len)
        if total == 0 or share <= max(min_supp, 1 / total) or found.count() >= k:
            return found.orderBy(F.desc("count"), "size", "itemset").limit(k)
        share = max(min_supp, 1 / total, share / 2)


def iter_itemsets_by_support(baskets: DataFrame, min_supp: float = 0.0, items: str = "items") -> Iterator:
    """Itemsets best first, mined further only as far as they are asked for."""
    done, total, share = 0, baskets.count(), 0.5
    while total:
        share = max(share, min_supp, 1 / total)
        found = frequent_itemsets(baskets, share, items=items).orderBy(F.desc("count"), "size", "itemset")
        rows = found.offset(done).toLocalIterator()
        for row in rows:
            done += 1
            yield row
        if share <= max(min_supp, 1 / total):
            return
        share /= 2


def minimal_rare_itemsets(baskets: DataFrame, max_supp: float, min_supp: float = 0.0, least: int = 1, min_len: int = 1, max_len: int | None = None, items: str = "items") -> DataFrame:
    """Itemsets below ``max_supp`` all of whose proper subsets reach it, in at least ``least`` baskets.

    Candidates are the single items and the joins of frequent itemsets; they are counted in one pass.
    """
    check_share(max_supp, "max_supp")
    total = baskets.count()
    frequent_count = min_count(max_supp, total) if total else 1
    least = max(least, 1, min_count(min_supp, total) if min_supp > 0 else 1)
    clean = cut(baskets.select(F.array_distinct(F.array_compact(F.coalesce(F.col(items), F.array().cast("array<string>")))).alias("items")))
    found = frequent_itemsets(clean, max_supp, None if max_len is None else max(1, max_len - 1))
    singles = clean.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") < frequent_count)
    pairs = count_table(clean, join_candidates(found).join(found, "itemset", "left_anti")).where(F.col("count") < frequent_count)
    single = singles.select(F.array("item").alias("itemset"), "count")
    out = single.unionByName(pairs).where((F.col("count") >= least) & (F.size("itemset") >= min_len))
    if max_len is not None:
        out = out.where(F.size("itemset") <= max_len)
    return out.select("itemset", F.size("itemset").alias("size"), "count", (F.col("count") / F.lit(total)).alias("support"))


def count_table(baskets: DataFrame, wanted: DataFrame, items: str = "items") -> DataFrame:
    """``(itemset, count)`` of the distinct itemsets of a table over baskets of distinct items, zero counts left out.

    Tasks hold a block of the itemsets at a time; each block is one pass over the baskets.
    """
    table, count = cut_counted(wanted.select(F.lit(ONE).alias("g"), F.array_sort("itemset").alias("itemset")).distinct())
    rows = baskets.select(F.coalesce(F.col(items), F.array().cast("array<string>")).alias("items"))
    out = None
    for held in _blocks(table, count):
        part = _counts(rows, held.get(ONE, []))
        part = part if count <= BLOCK else cut(part)
        out = part if out is None else out.unionByName(part)
    discard(table)
    return out


def _counts(rows: DataFrame, wanted: Sequence[tuple[str, ...]]) -> DataFrame:
    def run(batches):
        for one in _sized(batches, CHUNK):
            sums = _sums(one, Payload(), wanted)[:, 0].astype(np.int64) if wanted else np.zeros(0, np.int64)
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([wanted[k] for k in hit], pa.list_(pa.string())), pa.array(sums[hit])], names=["itemset", "count"])

    return rows.mapInArrow(run, "itemset array<string>, count bigint").groupBy("itemset").agg(F.sum("count").alias("count"))


def count_itemsets(baskets: DataFrame, wanted: Sequence[tuple[str, ...]], items: str = "items") -> DataFrame:
    """``(itemset, count)`` of a few given itemsets over baskets of distinct items, zero counts left out."""
    return _counts(baskets.select(F.coalesce(F.col(items), F.array().cast("array<string>")).alias("items")), sorted(wanted))


def utility_table(quantities: DataFrame, profits: DataFrame | None = None, tid: str = "tid", item: str = "item", qty: str = "qty", profit: str = "profit") -> DataFrame:
    """``(tid, item, utility)``: quantity times profit (1 without profits), nulls as 0, zero rows dropped.

    Negative quantities or profits, and items without a profit, are errors.
    """
    rows = quantities.select(F.col(tid).alias("tid"), F.col(item).alias("item"), F.coalesce(F.col(qty).cast("double"), F.lit(0.0)).alias("qty"))
    rows = rows.withColumn("qty", F.when(F.col("qty") < 0, F.raise_error(F.lit("quantities must not be negative"))).otherwise(F.col("qty")))
    if profits is None:
        return rows.groupBy("tid", "item").agg(F.sum("qty").alias("utility")).where("utility > 0")
    side = profits.select(F.col(item).alias("item"), F.col(profit).cast("double").alias("profit"))
    both = rows.where("qty > 0").join(side, "item", "left")
    checked = F.when(F.col("profit").isNull(), F.raise_error(F.concat(F.lit("no profit for "), F.col("item")))).when(F.col("profit") < 0, F.raise_error(F.lit("profits must not be negative"))).otherwise(F.col("profit"))
    return both.select("tid", "item", (F.col("qty") * checked).alias("utility")).groupBy("tid", "item").agg(F.sum("utility").alias("utility")).where("utility > 0")


def high_utility_itemsets(utilities: DataFrame, min_utility: float = 0.1, absolute: bool = False, min_len: int = 1, max_len: int | None = None) -> DataFrame:
    """``(itemset, size, utility, count, support)`` of itemsets whose utility reaches a share of all utility.

    The utility of whole transactions bounds that of their itemsets, so it prunes both within and across chunks.
    """
    rows = cut(utilities.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("item", "utility"))).alias("s")).select(F.col("s.item").alias("items"), F.col("s.utility").alias("utilities")))
    whole = rows.agg(F.sum(F.aggregate("utilities", F.lit(0.0), lambda s, x: s + x))).first()[0] or 0.0
    share = min_utility / whole if absolute and whole else min_utility
    found = mine(rows, share, "items", "utilities", max_len=max_len, payload=Utilities())
    return found.where(F.col("size") >= min_len).select("itemset", "size", F.col("sums")[0].alias("utility"), F.col("sums")[2].cast("bigint").alias("count"), (F.col("sums")[2] / F.col("n")).alias("support"))


class Mean(Degrees):
    """Fuzzy items by scalar cardinality: sums of joint degrees under a t-norm."""

    def __init__(self, tnorm: str = "min") -> None:
        if tnorm not in ("min", "product"):
            raise ValueError("tnorm must be min or product")
        self.width, self.tnorm = 1, tnorm

    def join(self, a, b):
        return np.minimum(a, b) if self.tnorm == "min" else a * b

    def sums(self, v, chunk):
        return np.array([v.sum() if chunk.weights is None else v @ chunk.weights])
