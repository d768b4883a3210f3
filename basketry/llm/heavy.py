"""Problem 3: the most frequent values of a column with hundreds of millions of distinct ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_names
from ..session import cut, discard

#: Fixed odd multipliers of the sketch's rows.
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class CountMin:
    """Count-min sketch with conservative update, for arrays of hashes.

    In a batch every distinct hash raises its cells to its own estimate plus its weight and no further,
    so a cell is never below the true count of any value that it serves.
    """

    def __init__(self, width_bits: int = 16, depth: int = 4) -> None:
        self.shift, self.mixers = np.uint64(64 - width_bits), MIXERS[:depth]
        self.cells = np.zeros((depth, 1 << width_bits), np.int64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = hashes.view(np.uint64) ^ (hashes.view(np.uint64) >> np.uint64(29))
            return ((x * self.mixers[:, None]) >> self.shift).astype(np.int64)

    def add(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Adds distinct hashes, gives their new estimates."""
        slots = self._slots(hashes)
        now = np.min([row[s] for row, s in zip(self.cells, slots)], axis=0) + weights
        for row, s in zip(self.cells, slots):
            np.maximum.at(row, s, now)
        return now


class Heap:
    """The values of the largest estimates, at most ``size``; knows the largest estimate it let go."""

    def __init__(self, size: int) -> None:
        self.size, self.kept, self.lost = size, {}, 0

    def offer(self, hashes: np.ndarray, estimates: np.ndarray, values: pa.Array) -> None:
        worth = np.flatnonzero(estimates > self.lost)
        if len(worth) > self.size:
            order = worth[np.argsort(-estimates[worth], kind="stable")]
            self.lost = max(self.lost, int(estimates[order[self.size]]))
            worth = order[: self.size]
        names = values.take(pa.array(worth)).to_pylist()
        for h, e, v in zip(hashes[worth].tolist(), estimates[worth].tolist(), names):
            self.kept[h] = (e, v)
        if len(self.kept) > self.size:
            ranked = sorted(self.kept.items(), key=lambda kv: -kv[1][0])
            self.lost = max(self.lost, ranked[self.size][1][0])
            self.kept = dict(ranked[: self.size])


def _combine(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Counts of values within a task, in bounded memory: a table of counts is handed on when it is full."""
    held, size = [], 0
    def flush():
        table = pa.concat_tables(held).group_by("value").aggregate([("n", "sum")])
        return pa.table({"value": table["value"], "n": table["n_sum"]})
    for batch in batches:
        counts = pc.value_counts(pc.list_flatten(batch.column(0)) if pa.types.is_list(batch.column(0).type) else batch.column(0))
        held.append(pa.table({"value": counts.field("values").cast(pa.string()), "n": counts.field("counts")}))
        size += len(counts)
        if size > most:
            held = [flush()]
            size = held[0].num_rows
            if size > most // 2:
                yield from held[0].to_batches(max_chunksize=50_000)
                held, size = [], 0
    if held:
        yield from flush().to_batches(max_chunksize=50_000)


def heavy_hitters(values: DataFrame, share: float, width_bits: int = 16, depth: int = 4, heap: int | None = None, buffer: int = 500_000) -> DataFrame:
    """``(value, estimate, error, total)``: every value of at least ``share`` of all occurrences, and perhaps more.

    ``values`` has one column, a string or an array of strings; nulls are ignored, ties kept, an empty table
    gives no rows. ``estimate`` never falls below the true count and exceeds it by at most ``error`` with
    probability 1 - 2^-depth. Values are counted within each task first, so a value of a third of all rows
    travels as a few rows; then each hash partition of values runs its own sketch and bounded heap. The
    partitions hold different values, so their heaps are merged by union. If a heap had to let go of an
    estimate at or above the threshold, all is run again with a larger heap and a wider sketch: nothing is lost to the bound.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    size = heap or max(256, math.ceil(2 / share))
    name = values.columns[0]
    counted = values.select(F.col(name).alias("value")).mapInArrow(lambda b: _combine(b, buffer), "value string, n bigint")
    streams = counted.where("value is not null").withColumn("h", F.xxhash64("value")).repartition("value")
    while True:
        found = cut(streams.mapInArrow(_sketch(width_bits, depth, size), "value string, estimate bigint, error bigint, total bigint, lost bigint"))
        totals = found.where("value is null").agg(F.sum("total").alias("t"), F.max("lost").alias("l")).first()
        total, lost = totals["t"] or 0, totals["l"] or 0
        least = max(1, math.ceil(share * total - 1e-9))
        if lost < least:
            return found.where((F.col("value").isNotNull()) & (F.col("estimate") >= least)).select("value", "estimate", "error", F.lit(total).cast("bigint").alias("total"))
        discard(found)
        size, width_bits = 4 * size, min(width_bits + 2, 24)


def _sketch(width_bits: int, depth: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, heap, total = CountMin(width_bits, depth), Heap(size), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, n = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            weights = np.bincount(inverse, n).astype(np.int64)
            total += int(weights.sum())
            heap.offer(unique, sketch.add(unique, weights), batch.column(0).take(pa.array(first)))
        error = math.ceil(2 * total / (1 << width_bits))
        rows = [(v, e, error, total, heap.lost) for e, v in heap.kept.values()]
        if total:
            rows.append((None, 0, error, total, heap.lost))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["value", "estimate", "error", "total", "lost"])

    return run


def baskets_of(frame: DataFrame, basket: str = "tid", items: str = "items") -> DataFrame:
    """``(b, names)``: one row per basket id with its distinct non-void names; rows without an id are left out."""
    rows = frame.where(F.col(basket).isNotNull()).select(F.col(basket).alias("b"), clean_names(F.col(items)).alias("names"))
    return rows.where(F.size("names") > 0).groupBy("b").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))


def frequent_items(frame: DataFrame, share: float = 0.005, basket: str = "tid", items: str = "items") -> DataFrame:
    """``(item, estimate, occurrences, total)``: items in at least ``share`` of all (basket, item) occurrences.

    The candidates come from :func:`heavy_hitters`; their number is at most the heaps' size, whatever the
    data; the exact count that follows shuffles only them.
    """
    found = heavy_hitters(baskets_of(frame, basket, items).select("names"), share)
    rows = frame.where(F.col(basket).isNotNull()).select(F.col(basket).alias("b"), F.explode(clean_names(F.col(items))).alias("value"))
    exact = rows.join(found.select("value"), "value", "left_semi").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("occurrences"))
    both = exact.join(found, "value")
    return both.where(F.col("occurrences") >= F.ceil(F.lit(share) * F.col("total") - 1e-9)).select(F.col("value").alias("item"), "estimate", "occurrences", "total")
