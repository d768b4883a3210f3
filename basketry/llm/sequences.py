"""Problem 4: orders of events that many sequences contain, with gaps, level by level."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_name
from ..session import cut

Pattern = tuple[str, ...]

#: Moments that are gathered into a row at most: longer sequences are matched in pieces of time.
PIECE = 20_000


def candidates(frequent: set[Pattern]) -> list[Pattern]:
    """Longer patterns from frequent ones: two that overlap in all but one step are joined, and a pattern is
    pruned if leaving out any one step gives an infrequent one."""
    by_head: dict[Pattern, list[Pattern]] = {}
    for p in frequent:
        by_head.setdefault(p[:-1], []).append(p)
    joined = (p + q[-1:] for p in frequent for q in by_head.get(p[1:], ()))
    return sorted(c for c in joined if all(c[:k] + c[k + 1 :] in frequent for k in range(len(c))))


def hash_tree(patterns: list[Pattern]) -> dict:
    """Patterns as nested dictionaries by step; the key None holds a pattern's number."""
    tree: dict = {}
    for number, pattern in enumerate(patterns):
        node = tree
        for step in pattern:
            node = node.setdefault(step, {})
        node[None] = number
    return tree


def places(moments: list[list[str]]) -> dict[str, list[int]]:
    """At which moments each state is there."""
    where: dict[str, list[int]] = {}
    for at, states in enumerate(moments):
        for state in states:
            where.setdefault(state, []).append(at)
    return where


def contained(moments: list[list[str]], tree: dict) -> Iterator[int]:
    """Numbers of the patterns of a tree whose steps occur at strictly later and later moments."""
    return (number for number, _ in advance(places(moments), [(tree, -1)]))


def advance(where: dict[str, list[int]], begun: list[tuple[dict, int]]) -> Iterator[tuple[int, int]]:
    """Patterns that end within these moments, from nodes of a tree that were reached before (at moment -1) or within
    them; the earliest match of each step is taken. The node of each reached step is appended to ``begun``."""
    at = 0
    while at < len(begun):
        node, last = begun[at]
        at += 1
        for step, after in node.items():
            if step is None:
                yield after, last
                continue
            there = where.get(step)
            if there and (k := bisect_right(there, last)) < len(there):
                begun.append((after, there[k]))


def frequent_orders(events: DataFrame, keys: list[str], time: str, state: str, share: float, max_len: int | None = None, piece: int = PIECE) -> DataFrame:
    """``(pattern array<string>, length, support, sequences)`` of all orders in at least ``share`` of the sequences.

    A sequence is the set of rows of equal ``keys``, ordered by ``time``; states of the same moment have no
    order among them; a row given twice counts once. Rows with a null among keys, time and state are left
    out. Steps must be at strictly later moments; other states may stand between. An empty table gives no rows.

    The number of candidates depends on the threshold, not on the table: they are joined and pruned on the
    driver, broadcast as a hash tree of at most :data:`MAX_CANDIDATES` patterns, and counted in one pass over the
    sequences per level. The sequences are built and stored once, without states that are not frequent by
    themselves; of a sequence of more than ``piece`` moments no more than that is ever in one row: its pieces are
    matched with the same tree side by side, and their results composed.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    rows = events.dropna(subset=[*keys, time, state]).select(*keys, F.col(time).alias("t"), F.col(state).alias("s"))
    # moments first: the states of an instant, so that all that follows is by moment; then pieces of a key in time
    moments = rows.groupBy(*keys, "t").agg(F.array_sort(F.collect_set("s")).alias("states"))
    moments = cut(moments)
    total = moments.select(*keys).distinct().count()
    spark = events.sparkSession
    out = "pattern array<string>, length int, support bigint, sequences bigint"
    if not total:
        return spark.createDataFrame([], out)
    least = max(1, math.ceil(share * total - 1e-9))
    singles = moments.select(*keys, F.explode("states").alias("s")).distinct()
    counts = {(r["s"],): r["n"] for r in singles.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}
    found = dict(counts)
    if counts:
        known = [p[0] for p in counts]
        kept = moments.withColumn("states", F.filter("states", lambda x: x.isin(known))).where(F.size("states") > 0)
        short, pieces = _laid_out(kept, keys, piece)
        has_pieces = not pieces.isEmpty()
        level, length = set(counts), 1
        while level and (max_len is None or length < max_len):
            new = sorted(a + b for a in level for b in level) if length == 1 else candidates(level)
            if not new:
                break
            tree = spark.sparkContext.broadcast(_bounded(hash_tree(new), len(new)))
            seen = Counter({r["number"]: r["n"] for r in short.mapInArrow(_count(tree), "number int, n bigint").groupBy("number").agg(F.sum("n").alias("n")).collect()})
            if has_pieces:
                seen.update({r["number"]: r["n"] for r in _count_pieces(pieces, tree).collect()})
            counts = {new[k]: n for k, n in seen.items() if n >= least}
            found |= counts
            level, length = set(counts), length + 1
            tree.unpersist()
    return spark.createDataFrame([(list(p), len(p), n, total) for p, n in sorted(found.items())], out)


#: Candidates of a level that are sent to the tasks as one tree.
MAX_CANDIDATES = 1_000_000


def _bounded(tree: dict, count: int) -> dict:
    if count > MAX_CANDIDATES:
        raise ValueError(f"{count} candidates of one length: raise the share")
    return tree


def _laid_out(moments: DataFrame, keys: list[str], piece: int) -> tuple[DataFrame, DataFrame]:
    """``(moments)`` of the sequences of at most ``piece`` moments, and ``(key, first, moments)`` of the pieces of longer ones.

    A piece is a stretch of time, halved until it has few enough moments. Nothing but moments of one piece is ever
    gathered into a row.
    """
    sizes = moments.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("t").alias("first"), F.max("t").alias("last"))
    sized = moments.join(sizes, keys)
    gather = F.transform(F.array_sort(F.collect_list(F.struct("t", "states"))), lambda x: x["states"]).alias("moments")
    short = cut(sized.where(F.col("size") <= piece).groupBy(*keys).agg(gather).select("moments"))
    long = sized.where(F.col("size") > piece)
    # moments are distinct instants, so a stretch of `piece` microseconds has no more than `piece` of them; begin
    # with even stretches and halve those that are still too full
    micros = F.unix_micros("t") - F.unix_micros("first")
    span = F.greatest(F.unix_micros("last") - F.unix_micros("first") + 1, F.lit(1))
    width = F.greatest(F.floor(span / F.ceil(2 * F.col("size") / piece)), F.lit(1)).cast("bigint")
    open_ = cut(long.select(F.struct(*keys).alias("key"), "t", "states", (F.floor(micros / width) * width).cast("bigint").alias("from"), width.alias("width"), micros.alias("at")))
    done = []
    while not open_.isEmpty():
        full = open_.groupBy("key", "from").agg(F.count(F.lit(1)).alias("n"))
        both = open_.join(full, ["key", "from"])
        done.append(cut(both.where(F.col("n") <= piece).groupBy("key", "from").agg(gather)))
        half = F.greatest(F.floor(F.col("width") / 2), F.lit(1)).cast("bigint")
        rest = both.where(F.col("n") > piece).withColumn("width", half).withColumn("from", F.col("from") + (F.floor((F.col("at") - F.col("from")) / half) * half).cast("bigint"))
        open_ = cut(rest.select("key", "t", "states", "from", "width", "at"))
    if not done:
        return short, open_.groupBy("key", "from").agg(gather)
    pieces = done[0]
    for more in done[1:]:
        pieces = pieces.unionByName(more)
    return short, pieces


def _count(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for moments in batch.column(0).slice(at, 500).to_pylist():
                    seen.update(contained(moments, tree.value))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int32()), pa.array(seen.values(), pa.int64())], names=["number", "n"])

    return run


def _nodes(tree: dict) -> list[dict]:
    """The nodes of a tree, the root first."""
    out = [tree]
    for node in out:
        out.extend(after for step, after in node.items() if step is not None)
    return out


def _count_pieces(pieces: DataFrame, tree) -> DataFrame:
    """Counts over long sequences: each piece, by itself, gives for every node of the tree the nodes that are reached
    from it within the piece; these maps, small whatever the piece, are then composed in the order of time."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = _nodes(tree.value)
        number = {id(node): k for k, node in enumerate(nodes)}
        for batch in batches:
            for row in range(batch.num_rows):
                where, maps = places(batch.column(2)[row].as_py()), []
                for node in nodes:
                    begun = [(node, -1)]
                    for _ in advance(where, begun):
                        pass
                    maps.append([number[id(after)] for after, _ in begun])
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([maps], pa.list_(pa.list_(pa.int32())))], names=["key", "from", "maps"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = _nodes(tree.value)
        seen: Counter = Counter()
        key, state = None, set()
        end = lambda: seen.update(nodes[k][None] for k in state if None in nodes[k])
        for batch in batches:
            for row in range(batch.num_rows):
                own, maps = batch.column(0)[row].as_py(), batch.column(2)[row].as_py()
                if own != key:
                    end()
                    key, state = own, {0}
                state = {after for k in state for after in maps[k]}
        end()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int32()), pa.array(seen.values(), pa.int64())], names=["number", "n"])

    key = pieces.schema["key"].dataType.simpleString()
    maps = pieces.select("key", "from", "moments").mapInArrow(steps, f"key {key}, `from` bigint, maps array<array<int>>")
    ordered = maps.repartition("key").sortWithinPartitions("key", "from")
    return ordered.mapInArrow(compose, "number int, n bigint").groupBy("number").agg(F.sum("n").alias("n"))


def sensor_events(sensors: DataFrame) -> DataFrame:
    """``(house, day, time, state)`` of the rows that problem 4 speaks of; a missing day is the date of the time."""
    digits = F.regexp_replace("day", "[^0-9]", "")
    day = F.when(F.length(digits) == 8, digits).otherwise(F.date_format("time", "yyyyMMdd"))
    rows = sensors.select(clean_name(F.col("house")).alias("house"), day.alias("day"), "time", clean_name(F.col("state")).alias("state"))
    return rows.where((F.col("time") >= F.lit("2020-01-01 00:00:00 UTC").cast("timestamp")) & F.col("house").isNotNull() & F.col("state").isNotNull())


def state_orders(sensors: DataFrame, share: float = 0.1, min_len: int = 3) -> DataFrame:
    """``(pattern, support, sequences)``, the steps joined by ``>``, of orders of ``min_len`` or more states."""
    found = frequent_orders(sensor_events(sensors), ["house", "day"], "time", "state", share)
    return found.where(F.col("length") >= min_len).select(F.array_join("pattern", ">").alias("pattern"), "support", "sequences")
