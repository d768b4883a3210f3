"""Problem 8: documents into containers of fixed capacity, by patterns fitted to the histogram of sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

#: Patterns of three documents are enumerated over at most this many sizes, the most frequent ones; the
#: rest of the histogram is packed as residue, so no document depends on it.
TRIPLE_SIZES = 700


def enumerate_patterns(counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns of one, two and three documents that fill a container exactly, as arrays of sizes."""
    there = np.flatnonzero(counts > 0)
    out = [np.array([[capacity]])] if counts[capacity] else []
    two = there[(there <= capacity // 2)]
    two = two[counts[capacity - two] > 0]
    out.append(np.stack([two, capacity - two], 1))
    most = np.sort(there[np.argsort(-counts[there], kind="stable")[:TRIPLE_SIZES]])
    a, b = np.meshgrid(most, most, indexing="ij")
    c = capacity - a - b
    fits = (a <= b) & (b <= c)
    fits[fits] = counts[c[fits]] > 0
    out.append(np.stack([a[fits], b[fits], c[fits]], 1))
    return [p for p in out if len(p)]


def fit_repeats(patterns: list[np.ndarray], counts: np.ndarray, rounds: int = 300) -> list[np.ndarray]:
    """Non-negative least squares by accelerated projected gradient: repeats of each pattern.

    Minimises the weighted squared distance between the documents used and the histogram; short sizes
    weigh less, as they fill the room that is left over.
    """
    capacity = len(counts) - 1
    goal = counts.astype(float)
    weight = np.where(np.arange(len(counts)) < capacity // 16, 0.1, 1.0)
    used = np.zeros(len(counts))
    for p in patterns:
        used += np.bincount(p.ravel(), minlength=len(counts))
    # the largest eigenvalue is at most the largest row sum of A'WA
    step = 1.0 / max((used[p] * weight[p]).sum(1).max() for p in patterns)
    x = [np.zeros(len(p)) for p in patterns]
    y, t = [v.copy() for v in x], 1.0
    # diagonal scaling: each pattern moves by its own bound
    steps = [np.maximum(step, 1.0 / np.maximum(1.0, (used[p] * weight[p]).sum(1))) for p in patterns]
    for _ in range(rounds):
        now = np.zeros(len(counts))
        for p, v in zip(patterns, y):
            for k in range(p.shape[1]):
                now += np.bincount(p[:, k], v, len(counts))
        off = weight * (now - goal)
        new = [np.maximum(0.0, v - s * off[p].sum(1)) for p, v, s in zip(patterns, y, steps)]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = [n + (t - 1) / t_new * (n - o) for n, o in zip(new, x)]
        x, t = new, t_new
    return x


def pack_histogram(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """``(repeats, sizes)`` of a whole packing of ``counts[size]`` pieces, sizes 1..capacity."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[int, list[int]]] = []
    patterns = enumerate_patterns(left, capacity)
    if patterns:
        ranked = []
        for p, x in zip(patterns, fit_repeats(patterns, left)):
            many = np.flatnonzero(x >= 0.5)
            ranked += zip(np.rint(x[many]).astype(int).tolist(), p[many].tolist())
        ranked.sort(key=lambda r: (-r[0], r[1]))
        for repeats, sizes in ranked:
            need = np.bincount(sizes, minlength=capacity + 1)
            at = np.flatnonzero(need)
            repeats = min(repeats, int((left[at] // need[at]).min()))
            if repeats > 0:
                left[at] -= repeats * need[at]
                plan.append((repeats, sizes))
    # residue: the largest piece first, then again and again the largest that fits
    while (there := np.flatnonzero(left)).size:
        room, sizes = capacity, []
        need: dict[int, int] = {}
        while room:
            k = int(np.searchsorted(there, room, "right")) - 1
            while k >= 0 and left[there[k]] - need.get(int(there[k]), 0) <= 0:
                k -= 1
            if k < 0:
                break
            size = int(there[k])
            sizes.append(size)
            need[size] = need.get(size, 0) + 1
            room -= size
        repeats = min(int(left[s]) // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= repeats * n
        plan.append((repeats, sizes))
    return plan


def pack(frame: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = 2048) -> DataFrame:
    """``(container bigint, key, piece int, tokens bigint)``: every piece in one container.

    A row of at most ``capacity`` tokens is one piece, a longer one consecutive pieces of ``capacity`` and
    the rest; rows of null or no size are in none. Repeated and null keys are packed row by row. Containers
    are numbered from 0 without gaps; an empty table gives no rows.

    The driver sees only the histogram of sizes, of ``capacity`` numbers whatever the data. Rows get their
    number within a size from counters per task and offsets per task and size, so neither a hot size nor the
    whole table passes through one task; the plan's ranges then give each row its container.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = frame.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")).where("size > 0")
    last = F.ceil(F.col("size") / capacity).cast("int") - 1
    pieces = sized.select("key", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "key", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece").cast("bigint") * capacity).alias("tokens")
    )
    kind = frame.schema[key].dataType

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column(2).to_numpy()
            order = np.argsort(n, kind="stable")
            ordered = n[order]
            firsts = np.searchsorted(ordered, ordered)
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - firsts
            rank += seen[n]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(rank)], names=["key", "piece", "tokens", "part", "rank"])

    fields = [T.StructField("key", kind), T.StructField("piece", T.IntegerType()), T.StructField("tokens", T.LongType())]
    numbered = cut(pieces.mapInArrow(number, T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])))
    by_part = numbered.groupBy("part", "tokens").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("tokens").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["tokens"]] = row["n"]
    plan, first = pack_histogram(counts, capacity), 0
    begin, lows, repeats_of, container_of = np.zeros(capacity + 1, np.int64), [], [], []
    for repeats, sizes in plan:
        for one in sorted(set(sizes)):
            lows.append((one, int(begin[one])))
            repeats_of.append(repeats)
            container_of.append(first)
            begin[one] += repeats * sizes.count(one)
        first += repeats
    order = sorted(range(len(lows)), key=lows.__getitem__)
    table = np.array([[*lows[k], repeats_of[k], container_of[k]] for k in order], np.int64).reshape(-1, 4)
    starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            container = np.empty(len(n), np.int64)
            for one in np.unique(n):
                rows, ranges = np.flatnonzero(n == one), table[starts[one] : starts[one + 1]]
                hit = ranges[np.searchsorted(ranges[:, 1], rank[rows], "right") - 1]
                container[rows] = hit[:, 3] + (rank[rows] - hit[:, 1]) % hit[:, 2]
            yield pa.RecordBatch.from_arrays([pa.array(container), *batch.columns[:3]], names=["container", "key", "piece", "tokens"])

    before = F.sum("n").over(Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("part", "tokens", F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = numbered.join(offsets, ["part", "tokens"]).select("key", "piece", "tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    return ranked.mapInArrow(place, T.StructType([T.StructField("container", T.LongType()), *fields])).withColumnRenamed("key", key)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(containers, tokens, fill)`` of a packing; fill is null without containers."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    done = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
    return done.withColumn("fill", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)))
