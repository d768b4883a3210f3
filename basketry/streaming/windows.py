"""Streams: itemsets and rules over the last batches, kept up by per-batch counts, and rule drift as rows arrive."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_names
from ..operators import itemsets as I
from ..operators.rules import association_rules
from ..operators.temporal import crisp_rule_miner, rule_drift
from ..session import cut, cut_counted, discard, scratch_dir


class Fraction:
    """A support threshold of whole numbers; counts are compared by cross products, exactly."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the threshold must lie in (0, 1]")
        self.num, self.den = num, den

    def min_count(self, total: int) -> int:
        return max(1, -(-self.num * total // self.den))


class StateFolder:
    """Tables and a small record that names them, in a shared folder: what a new process goes on with.

    Tables are written before the record that names them, and records are numbered; the last whole one counts.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(conf)
        self._io = jvm.org.apache.commons.io.IOUtils
        found = self._files.globStatus(self._path(f"{self.folder}/state-*.json"))
        self.number = max([int(f.getPath().getName()[6:-5]) for f in found or []], default=0)

    def load(self) -> dict | None:
        if not self.number:
            return None
        stream = self._files.open(self._path(f"{self.folder}/state-{self.number}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def save(self, record: dict) -> None:
        """Written under another name and renamed, so that a record is there as a whole or not at all."""
        self.number += 1
        draft = self._path(f"{self.folder}/draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        stream.write(bytearray(json.dumps(record), "utf-8"))
        stream.close()
        self._files.rename(draft, self._path(f"{self.folder}/state-{self.number}.json"))
        if self.number > 2:
            self.delete(f"state-{self.number - 2}.json")

    def write(self, name: str, frame: DataFrame) -> tuple[str, int]:
        """The name, and the number of rows written."""
        seen = Observation()
        frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return name, seen.get["n"]

    def read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def delete(self, name: str) -> None:
        self._files.delete(self._path(f"{self.folder}/{name}"), True)


_ROWS, _COUNTS = "items array<string>", "itemset array<string>, count bigint, mined boolean"


class BatchWindow:
    """Frequent itemsets over the last ``intervals`` batches.

    Each batch is mined once, on arrival, at the window's own threshold, and its counts are kept with it. What is
    frequent in a window is frequent in one of its batches, so the union of the batches' itemsets are all
    candidates. A slide adds the counts of the new batch and leaves out those of the oldest; only candidates that
    a kept batch has not counted yet are counted there, once. The result equals mining the whole window.

    Baskets, counts and what has been added are tables in ``folder`` (one of its own in the scratch folder if none
    is named). A window on the same folder, in this process or another one, goes on where the last one stopped.
    """

    def __init__(self, min_supp: Fraction | float, intervals: int, folder: str | None = None) -> None:
        if intervals < 1:
            raise ValueError("intervals must be positive")
        self.share = min_supp if isinstance(min_supp, Fraction) else None
        self.min_supp = min_supp.num / min_supp.den if isinstance(min_supp, Fraction) else min_supp
        self.intervals, self.folder, self.state = intervals, folder, None
        self.batches: list[dict] = []  # of each batch its number, its size and the names of its tables
        self.last = -1
        if folder and SparkSession.getActiveSession():
            self._open(SparkSession.getActiveSession())

    def _open(self, spark: SparkSession) -> None:
        if self.state is None:
            self.folder = self.folder or f"{scratch_dir(spark)}/window-{uuid.uuid4().hex}"
            self.state = StateFolder(spark, self.folder)
            known = self.state.load()
            if known:
                self.batches, self.last = known["batches"], known["last"]

    def _save(self) -> None:
        self.state.save({"batches": self.batches, "last": self.last})

    @property
    def total(self) -> int:
        return sum(b["n"] for b in self.batches)

    def least(self) -> int:
        return self.share.min_count(self.total) if self.share else I.min_count(self.min_supp, max(self.total, 1))

    def add(self, baskets: DataFrame, batch: int | None = None) -> bool:
        """A new batch of ``(items)`` arrives; the oldest leaves if the window is full. A batch whose number was added
        before (by this process or an earlier one) is not added again."""
        self._open(baskets.sparkSession)
        number = self.last + 1 if batch is None else batch
        if number <= self.last:
            return False
        rows, n = self.state.write(f"rows-{number}", baskets.select(clean_names(F.col("items")).alias("items")))
        counts = []
        if n:
            found = I.frequent_itemsets(self.state.read([rows], _ROWS), self.min_supp, stored=True)
            counts = [self.state.write(f"counts-{number}", found.select("itemset", "count", F.lit(True).alias("mined")))[0]]
            discard(found)
        gone = self.batches[: max(0, len(self.batches) + 1 - self.intervals)]
        self.batches = [*self.batches[len(gone) :], {"batch": number, "n": n, "rows": rows, "counts": counts}]
        self.last = number
        self._save()
        for old in gone:
            for name in [old["rows"], *old["counts"]]:
                self.state.delete(name)
        return True

    @property
    def full(self) -> bool:
        return len(self.batches) == self.intervals

    def itemsets(self, spark: SparkSession | None = None) -> DataFrame:
        """``(itemset, size, count, support)`` of the window."""
        if spark is not None:
            self._open(spark)
        counts = lambda b: self.state.read(b["counts"], _COUNTS)
        every = self.state.read([n for b in self.batches for n in b["counts"]], _COUNTS)
        candidates = cut(every.where("mined").select("itemset").distinct())
        changed = False
        for b in self.batches:
            if not b["n"]:
                continue
            new, missing = cut_counted(candidates.join(counts(b).select("itemset"), "itemset", "left_anti"))
            if missing:
                seen = I.count_table(self.state.read([b["rows"]], _ROWS), new)
                full = new.join(seen, "itemset", "left").select("itemset", F.coalesce("count", F.lit(0)).alias("count"), F.lit(False).alias("mined"))
                b["counts"] = [*b["counts"], self.state.write(f"counts-{b['batch']}-{self.last}", full)[0]]
                changed = True
            discard(new)
        if changed:
            self._save()
        every = self.state.read([n for b in self.batches for n in b["counts"]], _COUNTS)
        summed = every.join(candidates, "itemset", "left_semi").groupBy("itemset").agg(F.sum("count").alias("count")).where(F.col("count") >= self.least())
        return cut(summed.select("itemset", F.size("itemset").alias("size"), "count", (F.col("count") / F.lit(max(self.total, 1))).alias("support")))

    def rules(self, spark: SparkSession | None = None, metric: str = "confidence", min_threshold: float = 0.7) -> DataFrame:
        return association_rules(self.itemsets(spark), metric, min_threshold)


def read_basket_stream(spark: SparkSession, path: str, sep: str = " ", **options) -> DataFrame:
    """``(items)`` of the lines of files that arrive in a folder."""
    lines = spark.readStream.options(**options).text(path)
    return lines.select(clean_names(F.split("value", "\\Q" + sep + "\\E")).alias("items")).where(F.size("items") > 0)


def run_basket_stream(stream: DataFrame, window: BatchWindow, on_slide: Callable[[int, DataFrame, DataFrame | None], None], min_conf: float | None = None, checkpoint: str | None = None, available_now: bool = False, seconds: int = 5):
    """Start a query that slides ``window`` with each micro-batch and hands its itemsets (and rules) on.

    A batch that the engine sends again after a failure is not added twice, also by a new process: the window's
    folder (beside ``checkpoint`` unless the window names one) knows what was added. ``on_slide`` is called again
    for the last batch, as it may not have come that far.
    """
    if checkpoint and window.folder is None:
        window.folder = f"{checkpoint.rstrip('/')}-window"

    def step(frame: DataFrame, batch: int) -> None:
        new = window.add(frame, batch)
        if window.full and (new or batch == window.last):
            on_slide(batch, window.itemsets(), window.rules(min_threshold=min_conf) if min_conf is not None else None)

    writer = stream.writeStream.foreachBatch(step)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def mine_batches(batches: DataFrame, min_supp: Fraction | float, intervals: int, sep: str = " "):
    """``(batch, itemsets)`` of each full window over ``(batch, value)`` rows, as for files of a folder."""
    window = BatchWindow(min_supp, intervals)
    for k in sorted(r["batch"] for r in batches.select("batch").distinct().collect()):
        part = batches.where(F.col("batch") == k).select(clean_names(F.split("value", "\\Q" + sep + "\\E")).alias("items")).where(F.size("items") > 0)
        window.add(part)
        if window.full:
            yield k, window.itemsets(batches.sparkSession)


class RuleDriftMonitor:
    """Rules of each window as rows arrive: complete windows only, by rows or by duration, and their drift.

    ``update`` takes ``(pos, items)`` or ``(ts, items)`` frames in order; rows that no later window needs are let
    go of. ``history`` keeps the last so many windows' rules, and no table of older ones. With ``folder`` all that
    is kept is there, and a monitor on the same folder goes on where the last one stopped.
    """

    def __init__(self, width: int | timedelta, step: int | timedelta | None = None, min_supp: float = 0.1, metric: str = "confidence", min_threshold: float = 0.8, miner: Callable[[DataFrame, str], DataFrame] | None = None, min_rows: int = 2, history: int | None = None, folder: str | None = None) -> None:
        self.width, self.step, self.min_rows, self.history = width, step or width, min_rows, history
        self.miner = miner or crisp_rule_miner(min_supp, metric, min_threshold)
        self.by_rows = not isinstance(width, timedelta)
        self.buffer: DataFrame | None = None
        self.next = 0 if self.by_rows else None
        self.last, self.batch = None, -1
        self.n_windows, self.frames = 0, []  # tables of rules and the last window of each
        self.folder, self.state = folder, None
        if folder and SparkSession.getActiveSession():
            self._open(SparkSession.getActiveSession())

    def _open(self, spark: SparkSession) -> None:
        if self.state is None:
            self.folder = self.folder or f"{scratch_dir(spark)}/drift-{uuid.uuid4().hex}"
            self.state = StateFolder(spark, self.folder)
            known = self.state.load()
            if known:
                self.next, self.last, self.batch, self.n_windows = (known[k] for k in ("next", "last", "batch", "n_windows"))
                self._rules_schema = known["schema"]
                self.frames = [(self.state.read([name], self._rules_schema), name, end) for name, end in known["frames"]]
                self.buffer = self.state.read([known["buffer"]], "at bigint, items array<string>")
                self._buffer_name = known["buffer"]

    _rules_schema, _buffer_name = None, None

    def _value(self, x) -> int:
        return int(x.total_seconds() * 1_000_000) if isinstance(x, timedelta) else int(x)

    def update(self, rows: DataFrame, batch: int | None = None) -> DataFrame | None:
        """Rules of the windows that these rows complete, or None."""
        self._open(rows.sparkSession)
        at = F.col("pos").cast("bigint") if self.by_rows else F.unix_micros("ts")
        new = rows.select(at.alias("at"), "items")
        low, high = new.agg(F.min("at"), F.max("at")).first()
        if low is None:
            return None
        if self.last is not None and low < self.last:
            raise ValueError("rows must arrive in order")
        self.last = high
        if self.next is None:
            self.next = low
        width, step = self._value(self.width), self._value(self.step)
        buffer = cut(new if self.buffer is None else self.buffer.unionByName(new))
        end = high + 1 if self.by_rows else high
        first = self.next
        ready = max(0, (end - first - width) // step + 1) if end - first >= width else 0
        made = None
        if ready:
            k_low = F.greatest(F.lit(0), F.ceil((F.col("at") - first - (width - 1)) / step).cast("bigint"))
            k_high = F.least(F.floor((F.col("at") - first) / step).cast("bigint"), F.lit(ready - 1))
            tagged = buffer.where(F.col("at") >= first).withColumn("k", F.explode(F.when(k_high >= k_low, F.sequence(k_low, k_high)).otherwise(F.array().cast("array<bigint>"))))
            tagged = cut(tagged)
            big = [r["k"] for r in tagged.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.min_rows).orderBy("k").collect()]  # one row per new window
            if big:
                numbers = rows.sparkSession.createDataFrame([(k, self.n_windows + i) for i, k in enumerate(big)], "k bigint, window int")
                made = cut(self.miner(tagged.join(F.broadcast(numbers), "k").drop("k"), "window").withColumn("window", F.col("window").cast("int")))
                self.n_windows += len(big)
                self._rules_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
                name, _ = self.state.write(f"rules-{self.n_windows}", made)
                discard(made)
                made = self.state.read([name], self._rules_schema)
                self.frames.append((made, name, self.n_windows - 1))
            self.next = first + ready * step
        old, self._buffer_name = self._buffer_name, self.state.write(f"buffer-{self.state.number + 1}", buffer.where(F.col("at") >= self.next))[0]
        self.buffer = self.state.read([self._buffer_name], "at bigint, items array<string>")
        discard(buffer)
        gone = [f for f in self.frames if self.history is not None and f[2] < self.n_windows - self.history]
        self.frames = [f for f in self.frames if f not in gone]
        self.batch = self.batch + 1 if batch is None else batch
        self.state.save({"next": self.next, "last": self.last, "batch": self.batch, "n_windows": self.n_windows, "schema": self._rules_schema, "buffer": self._buffer_name, "frames": [f[1:] for f in self.frames]})
        for name in [f[1] for f in gone] + ([old] if old else []):
            self.state.delete(name)
        return made

    @property
    def buffered_rows(self) -> int:
        return 0 if self.buffer is None else self.buffer.count()

    @property
    def rules_(self) -> DataFrame | None:
        if not self.frames:
            return None
        out = self.state.read([name for _, name, _ in self.frames], self._rules_schema)
        return out if self.history is None else out.where(F.col("window") >= self.n_windows - self.history)

    def drift(self, measure: str = "confidence", stable_fraction: float = 0.8) -> DataFrame | None:
        rules = self.rules_
        if rules is None:
            return None
        first = max(0, self.n_windows - self.history) if self.history else 0
        return rule_drift(rules.withColumn("window", F.col("window") - first), self.n_windows - first, measure, stable_fraction)

    def latest_changes(self, measure: str = "confidence", tolerance: float = 0.05) -> DataFrame | None:
        """The last two windows compared."""
        from ..operators.temporal import compare_rule_sets

        rules = self.rules_
        if rules is None or self.n_windows < 2:
            return None
        return compare_rule_sets(rules.where(F.col("window") == self.n_windows - 2), rules.where(F.col("window") == self.n_windows - 1), measure, tolerance)

    def run(self, stream: DataFrame, on_rules: Callable[[int, DataFrame], None], checkpoint: str | None = None, available_now: bool = False):
        """Feed the monitor from a stream; each micro-batch that completes windows hands their rules on."""
        if checkpoint and self.folder is None:
            self.folder = f"{checkpoint.rstrip('/')}-drift"

        def step(frame: DataFrame, batch: int) -> None:
            self._open(frame.sparkSession)
            if batch > self.batch:
                made = self.update(frame, batch)
                if made is not None:
                    on_rules(batch, made)

        writer = stream.writeStream.foreachBatch(step)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
