"""Problem 2: percentiles per group by mergeable summaries of rank intervals with a tracked error."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

#: Tuples that a summary keeps after compression. Each of the three compressions (task, day, all days)
#: adds at most 1 / (2 * TUPLES) of the rows to the rank error: 0.4 % of rank in all.
TUPLES = 400


class Summary:
    """Values with bounds ``low <= rank <= high`` (1-based) among ``n`` rows; the first and last are exact."""

    __slots__ = ("n", "values", "low", "high")

    def __init__(self, n: int, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.values, self.low, self.high = n, values, low, high

    @classmethod
    def of_sorted(cls, values: np.ndarray) -> Summary:
        ranks = np.arange(1, len(values) + 1)
        return cls(len(values), values, ranks, ranks)

    @property
    def exact(self) -> bool:
        return len(self.values) == self.n

    @property
    def error(self) -> float:
        """No rank is off by more rows than this when the nearest kept tuple answers for it."""
        return 0.0 if self.exact else float((self.high[1:] - self.low[:-1]).max()) / 2

    def compress(self, tuples: int = TUPLES) -> Summary:
        if len(self.values) <= 2 * tuples:
            return self
        middle = (self.low + self.high) / 2
        at = np.searchsorted(middle, np.linspace(1, self.n, tuples + 1))
        at = np.unique(np.concatenate([[0], np.minimum(at, len(middle) - 1), [len(middle) - 1]]))
        return Summary(self.n, self.values[at], self.low[at], self.high[at])

    @staticmethod
    def merge(parts: Sequence[Summary]) -> Summary:
        parts = [p for p in parts if p.n]
        if len(parts) == 1:
            return parts[0]
        if all(p.exact for p in parts):
            return Summary.of_sorted(np.sort(np.concatenate([p.values for p in parts])))
        low, high = [p.low.copy() for p in parts], [p.high.copy() for p in parts]
        for s, one in enumerate(parts):
            for t, other in enumerate(parts):
                if s != t:  # equal values stand in the order of the parts
                    at = np.searchsorted(other.values, one.values, "right" if t < s else "left")
                    low[s] += np.concatenate([[0], other.low])[at]
                    high[s] += np.concatenate([other.high - 1, [other.n]])[at]
        values = np.concatenate([p.values for p in parts])
        order = np.argsort(values, kind="stable")
        return Summary(sum(p.n for p in parts), values[order], np.concatenate(low)[order], np.concatenate(high)[order])

    def bounds(self, share: float) -> tuple[float, float, float, float]:
        """Bounds of the percentile by linear interpolation, equal if the summary can tell it exactly, and
        of the order statistics on its two sides."""
        at = (self.n - 1) * share
        k = int(at)
        part = at - k
        lows, highs = [], []
        for rank in (k + 1, min(k + 2, self.n)):
            lows.append(self.values[np.searchsorted(self.high, rank, "right") - 1])
            highs.append(self.values[np.searchsorted(self.low, rank, "left")])
        return lows[0] + (lows[1] - lows[0]) * part, highs[0] + (highs[1] - highs[0]) * part, lows[0], highs[1]


def _schema(frame: DataFrame, keys: Sequence[str]) -> T.StructType:
    extra = "n bigint, error double, values array<double>, low array<bigint>, high array<bigint>"
    return T.StructType([*(frame.schema[k] for k in keys), *T._parse_datatype_string(extra).fields])


def _lists(arrays: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def _batch(keys: list[pa.Array], names: Sequence[str], made: Sequence[Summary]) -> pa.RecordBatch:
    columns = [pa.array([s.n for s in made], pa.int64()), pa.array([s.error for s in made], pa.float64()), _lists([s.values for s in made], pa.float64()), _lists([s.low for s in made], pa.int64()), _lists([s.high for s in made], pa.int64())]
    return pa.RecordBatch.from_arrays([*keys, *columns], names=[*names, "n", "error", "values", "low", "high"])


def summarise(frame: DataFrame, keys: Sequence[str], value: str, tuples: int = TUPLES, buffer: int = 300_000) -> DataFrame:
    """Summaries of ``value`` by ``keys``, one or more per key and task, without a shuffle.

    Nulls and NaN of ``value`` are left out; null keys form a group; columns not named are not read.
    """
    keys = list(keys)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        code = np.zeros(table.num_rows, np.int64)
        for k in range(len(keys)):
            column = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            code = code * len(column.dictionary) + column.indices.to_numpy()
            code = np.unique(code, return_inverse=True)[1]
        value_ = table.column(len(keys)).to_numpy()
        order = np.lexsort((value_, code))
        code, value_ = code[order], value_[order]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        made = [Summary.of_sorted(v).compress(tuples) for v in np.split(value_, at[1:])]
        rows = pa.array(order[at])
        return _batch([table.column(k).combine_chunks().take(rows) for k in range(len(keys))], keys, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= buffer:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    rows = frame.select(*keys, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.mapInArrow(run, _schema(frame, keys))


def merge_summaries(summaries: DataFrame, keys: Sequence[str], tuples: int = TUPLES) -> DataFrame:
    """One summary per key from any number of them (other tasks, days, runs), as a stream over sorted keys.

    A key's summaries are folded a few at a time, so a task holds a bounded number of tuples. For keys with
    very many summaries call it twice, first with a finer key (a day, a salt).
    """
    keys = list(keys)

    def fold(parts: list[Summary]) -> Summary:
        return Summary.merge(parts).compress(tuples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held, done, out = None, [], 0, [], []
        for batch in batches:
            table = [c.to_pylist() for c in batch.columns[: len(keys)]]
            n = batch.column(len(keys)).to_pylist()
            values, low, high = (batch.column(len(keys) + k) for k in (2, 3, 4))
            offsets = values.offsets.to_numpy()
            values, low, high = (x.values.to_numpy() for x in (values, low, high))
            for k in range(batch.num_rows):
                now = tuple(c[k] for c in table)
                if now != key and parts:
                    done.append(key)
                    out.append(fold(parts))
                    parts, held = [], 0
                    if len(out) >= 2000:
                        yield pack(done, out)
                        done, out = [], []
                key = now
                a, b = offsets[k], offsets[k + 1]
                parts.append(Summary(n[k], values[a:b], low[a:b], high[a:b]))
                held += b - a
                if len(parts) >= 16 and held > 20 * tuples:
                    # folded without loss here; what is kept stays within 2 * tuples only at the end of the key
                    parts = [Summary.merge(parts).compress(8 * tuples)]
                    held = len(parts[0].values)
        if parts:
            done.append(key)
            out.append(fold(parts))
        if out:
            yield pack(done, out)

    kinds = [T.StructType([summaries.schema[k]]) for k in keys]

    def pack(done: list[tuple], made: list[Summary]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        columns = [pa.array([d[k] for d in done], to_arrow_schema(kinds[k]).field(0).type) for k in range(len(keys))]
        return _batch(columns, keys, made)

    columns = [*keys, "n", "error", "values", "low", "high"]
    streams = summaries.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return streams.mapInArrow(run, _schema(summaries, keys))


def quantile_bounds(summaries: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``(keys, share, n, error, lower, upper, least, most)``: bounds of each percentile, equal where it is exact.

    ``least`` and ``most`` bound the order statistics between which the percentile is interpolated.
    """
    keys, shares = list(keys), [float(s) for s in shares]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, error = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1).to_numpy()
            values, low, high = (batch.column(len(keys) + k) for k in (2, 3, 4))
            offsets = values.offsets.to_numpy()
            values, low, high = (x.values.to_numpy() for x in (values, low, high))
            got = []
            for k in range(batch.num_rows):
                a, b = offsets[k], offsets[k + 1]
                one = Summary(int(n[k]), values[a:b], low[a:b], high[a:b])
                got += [one.bounds(s) for s in shares]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), len(shares)))
            both = np.array(got, float).reshape(-1, 4)
            columns = [*(batch.column(k).take(rows) for k in range(len(keys))), pa.array(shares * batch.num_rows, pa.float64()), pa.array(np.repeat(n, len(shares))), pa.array(np.repeat(error, len(shares))), *(pa.array(both[:, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "share", "n", "error", "lower", "upper", "least", "most"])

    extra = T._parse_datatype_string("share double, n bigint, error double, lower double, upper double, least double, most double").fields
    return summaries.select(*keys, "n", "error", "values", "low", "high").mapInArrow(run, T.StructType([*(summaries.schema[k] for k in keys), *extra]))


def member_values(summaries: DataFrame, rules: DataFrame) -> DataFrame:
    """``(summary_id, stat, day, value)``: valid confidence and lift of each summary's existing rules, each rule once."""
    one = rules.where(F.col("rule_id").isNotNull()).groupBy("rule_id").agg(F.min("mined_day").alias("day"), F.min("confidence").alias("confidence"), F.min("lift").alias("lift"))
    members = summaries.where(F.col("summary_id").isNotNull()).select("summary_id", F.explode(F.array_distinct("members")).alias("rule_id")).where("rule_id is not null")
    both = members.join(one, "rule_id").select("summary_id", "day", F.explode(F.array(F.struct(F.lit("confidence").alias("stat"), F.col("confidence").alias("value")), F.struct(F.lit("lift").alias("stat"), F.col("lift").alias("value")))).alias("s"))
    value = F.col("s.value")
    valid = value.isNotNull() & ~F.isnan(value) & (value >= 0) & F.when(F.col("s.stat") == "confidence", value <= 1).otherwise(value < float("inf"))
    return both.where(valid).select("summary_id", F.col("s.stat").alias("stat"), "day", value.alias("value"))


def daily_summaries(values: DataFrame) -> DataFrame:
    """Summaries per summary, statistic and day: what days hand to one another."""
    keys = ["summary_id", "stat", "day"]
    return merge_summaries(summarise(values, keys, "value"), keys)


def member_percentiles(summaries: DataFrame, rules: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(summary_id, stat, share, n, error, lower, upper)`` over all days, merged from the days' summaries.

    Null members, repeated members and rules that do not exist count for nothing; a summary without valid
    members has no row; empty tables give none.
    """
    keys = ["summary_id", "stat"]
    return quantile_bounds(merge_summaries(daily_summaries(member_values(summaries, rules)), keys), keys, shares)


STATED = [(f"{stat}_q{q}", stat, q / 100) for stat in ("confidence", "lift") for q in (25, 50, 75)]


def misstated(summaries: DataFrame, rules: DataFrame, slack: float = 0.05) -> DataFrame:
    """``(summary_id, stat)``: stated quantiles below the (q-5)th or above the (q+5)th percentile of the members.

    The summaries decide all cases outside their error; the few that lie within it are decided by the exact
    order statistics, looked for only among the values between the bounds that the summaries give.
    """
    shares = sorted({round(q + d, 6) for _, _, q in STATED for d in (-slack, slack)})
    bounds = cut(member_percentiles(summaries, rules, shares))
    claims = summaries.where(F.col("summary_id").isNotNull()).select("summary_id", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(stat).alias("stat"), F.lit(q).alias("q"), F.col(name).cast("double").alias("stated")) for name, stat, q in STATED])).alias("c")).select("summary_id", "c.*").where(F.col("stated").isNotNull())
    side = lambda d, tag: bounds.select("summary_id", "stat", F.round(F.col("share") - d, 6).alias("q"), "share", "n", F.col("lower").alias(f"{tag}_lower"), F.col("upper").alias(f"{tag}_upper"), F.col("least").alias(f"{tag}_least"), F.col("most").alias(f"{tag}_most"))
    below, above = side(-slack, "a"), side(slack, "b").drop("share", "n")
    held = cut(claims.join(below, ["summary_id", "stat", "q"]).join(above, ["summary_id", "stat", "q"]))
    sure = (F.col("stated") < F.col("a_lower")) | (F.col("stated") > F.col("b_upper"))
    fine = (F.col("stated") >= F.col("a_upper")) & (F.col("stated") <= F.col("b_lower"))
    found = held.where(sure).select("summary_id", F.col("name").alias("stat"))
    open_ = held.where(~sure & ~fine)
    if open_.isEmpty():
        return found.distinct()
    # exact: rows below each bound are counted, rows between the bounds ranked
    asked = open_.select("summary_id", "stat", "name", "stated", "n", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.round(F.col("q") - slack, 6).alias("share"), F.col("a_least").alias("least"), F.col("a_most").alias("most")), F.struct(F.lit("b").alias("side"), F.round(F.col("q") + slack, 6).alias("share"), F.col("b_least").alias("least"), F.col("b_most").alias("most")))).alias("s")).select("summary_id", "stat", "name", "stated", "n", "s.*")
    asked = cut(asked.withColumn("at", (F.col("n") - 1) * F.col("share")))
    few = reduce(lambda a, b: a.join(b, ["summary_id", "stat"], "left_semi"), [member_values(summaries, rules), asked.select("summary_id", "stat").distinct()])
    near = few.join(asked, ["summary_id", "stat"]).where(F.col("value") <= F.col("most"))
    who = ["summary_id", "stat", "name", "side"]
    tally = near.withColumn("value", F.when(F.col("value") < F.col("least"), F.lit(None).cast("double")).otherwise(F.col("value"))).groupBy(*who, "stated", "at", "value").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*who).orderBy(F.col("value").asc_nulls_first()))
    ranks = tally.withColumn("upto", upto).where(F.col("value").isNotNull())
    pick = lambda shift: F.min(F.when(F.col("upto") >= F.floor("at") + 1 + shift, F.col("value")))
    exact = ranks.groupBy(*who, "stated", "at").agg(pick(0).alias("one"), pick(1).alias("two"))
    value = F.col("one") + (F.coalesce("two", "one") - F.col("one")) * (F.col("at") - F.floor("at"))
    wrong = exact.where(F.when(F.col("side") == "a", F.col("stated") < value).otherwise(F.col("stated") > value))
    return found.unionByName(wrong.select("summary_id", F.col("name").alias("stat"))).distinct()
