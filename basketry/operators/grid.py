"""Irregular readings onto a regular grid, gaps filled by a low-rank factorisation."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import clean_name
from ..session import cut


def regular_grid(
    readings: DataFrame,
    source: str,
    time: str,
    value: str,
    step: int = 3600,
    longest_gap: int = 480,
    rank: int = 6,
    iterations: int = 6,
    ridge: float = 0.05,
    seed: int = 11,
    support: int = 3,
) -> DataFrame:
    """``(source, slot bigint, value, readings, status, gap)``: one row per source and period of ``step`` seconds.

    ``slot`` is the period's start in seconds since 1970; rows run from a source's first period with a reading
    to its last. ``status`` is ``observed`` (value is the mean of the readings, exactly), ``filled`` (value from
    the factorisation), ``unsupported`` (no value: the source or the period has fewer than ``support`` observed
    cells, so that its factors would rest on less than that) or
    ``out`` (in a run of ``longest_gap`` or more empty periods; no value). ``gap`` is the length of the run of
    empty periods, 0 where observed. Rows with a null source, time or value (or NaN) are left out; a row given
    twice changes no observed mean only if its source gives it once: repeated (source, time, value) rows count
    once. An empty table gives no rows.

    The factorisation is alternating least squares over the source-by-period matrix of what exceeds the source's
    and the period's mean, run in blocks over the cluster. The grid between two readings is unfolded from the
    pair, so no source's series is ever collected in one row or task.
    """
    rows = readings.select(F.col(source).alias("source"), F.col(time).alias("t"), F.col(value).cast("double").alias("v")).where(F.col("source").isNotNull() & F.col("t").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")).distinct()
    slot = (F.floor(F.unix_micros("t") / (step * 1_000_000)) * step).alias("slot")
    cells = cut(rows.groupBy("source", slot).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("readings")))
    after = F.lead("slot").over(Window.partitionBy("source").orderBy("slot"))
    runs = cells.select("source", "slot", after.alias("next")).withColumn("gap", ((F.col("next") - F.col("slot")) / step - 1).cast("bigint")).where("gap > 0")
    model = _factors(cells, rank, iterations, ridge, seed)
    holes = runs.select("source", "gap", F.explode(F.sequence(F.col("slot") + step, F.col("next") - step, F.lit(step).cast("bigint"))).alias("slot"))
    if model is None:
        filled = holes.withColumn("v", F.lit(None).cast("double"))
    else:
        filled = _estimate(holes, model, support).select("source", "gap", "slot", "v")
    empty = filled.select(
        "source", "slot", F.when(F.col("gap") < longest_gap, F.col("v")).alias("v"), F.lit(0).cast("bigint").alias("readings"),
        F.when(F.col("gap") >= longest_gap, "out").when(F.col("v").isNull(), "unsupported").otherwise("filled").alias("status"), "gap",
    )
    seen = cells.select("source", "slot", "v", "readings", F.lit("observed").alias("status"), F.lit(0).cast("bigint").alias("gap"))
    return seen.unionByName(empty).select(F.col("source").alias(source), "slot", F.col("v").alias(value), "readings", "status", "gap")


def _estimate(cells: DataFrame, model: tuple[DataFrame, DataFrame], support: int) -> DataFrame:
    """``cells`` (``source, slot``, others) with ``v``, the model's value, null below the support."""
    people, periods = model
    dot = F.aggregate(F.zip_with("p", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    enough = (F.col("source_cells") >= support) & (F.col("slot_cells") >= support)
    return cells.join(people, "source", "left").join(periods, "slot", "left").withColumn("v", F.when(enough, F.col("base") + F.col("lift") + dot)).drop("base", "lift", "p", "q", "source_cells", "slot_cells")


def holdout_error(readings: DataFrame, source: str, time: str, value: str, step: int = 3600, share: int = 10, rank: int = 6, iterations: int = 6, ridge: float = 0.05, seed: int = 11, support: int = 3) -> DataFrame:
    """One row ``(cells, supported, rmse_filled, rmse_source_mean)``: every ``share``-th observed cell (by a hash) is
    kept from the fit and compared with what the factorisation fills in, and with the source's mean of the others.
    No cells give nulls."""
    rows = readings.select(F.col(source).alias("source"), F.col(time).alias("t"), F.col(value).cast("double").alias("v")).dropna().where(~F.isnan("v")).distinct()
    slot = (F.floor(F.unix_micros("t") / (step * 1_000_000)) * step).alias("slot")
    cells = cut(rows.groupBy("source", slot).agg(F.avg("v").alias("v")).withColumn("out", F.pmod(F.xxhash64("source", "slot", F.lit(seed)), F.lit(share)) == 0))
    known, kept = cells.where("not out").drop("out"), cells.where("out").select("source", "slot", F.col("v").alias("real"))
    model = _factors(known, rank, iterations, ridge, seed)
    if model is None:
        tried = kept.withColumns({"v": F.lit(None).cast("double"), "mean": F.lit(None).cast("double")})
    else:
        tried = _estimate(kept.join(model[0].select("source", F.col("base").alias("mean")), "source"), model, support)
    rmse = lambda c: F.sqrt(F.avg(F.when(F.col("v").isNotNull(), F.pow(F.col(c) - F.col("real"), 2))))
    return tried.agg(F.count(F.lit(1)).alias("cells"), F.count("v").alias("supported"), rmse("v").alias("rmse_filled"), rmse("mean").alias("rmse_source_mean"))


def _factors(cells: DataFrame, rank: int, iterations: int, ridge: float, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """Per source ``(base, source_cells, p)`` and per period ``(lift, slot_cells, q)``, or None for an empty table."""
    base = cells.groupBy("source").agg(F.avg("v").alias("base"), F.count(F.lit(1)).alias("source_cells"))
    off = cells.join(base, "source").select("source", "slot", (F.col("v") - F.col("base")).alias("d"))
    lift = off.groupBy("slot").agg(F.avg("d").alias("lift"), F.count(F.lit(1)).alias("slot_cells"))
    # block-wise factorisation wants small integers: numbers within partitions, made unique by offsets
    people, periods = _numbered(base, "user"), _numbered(lift, "item")
    ratings = cut(off.join(people, "source").join(periods, "slot").select("user", "item", (F.col("d") - F.col("lift")).cast("float").alias("rating")))
    if ratings.isEmpty():
        return None
    fitted = ALS(rank=rank, maxIter=iterations, regParam=ridge, userCol="user", itemCol="item", ratingCol="rating", seed=seed, checkpointInterval=-1, intermediateStorageLevel="MEMORY_AND_DISK", finalStorageLevel="MEMORY_AND_DISK").fit(ratings)
    users = cut(people.join(fitted.userFactors.select(F.col("id").alias("user"), F.col("features").alias("p")), "user").select("source", "base", "source_cells", "p"))
    items = cut(periods.join(fitted.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("q")), "item").select("slot", "lift", "slot_cells", "q"))
    return users, items


def _numbered(frame: DataFrame, name: str) -> DataFrame:
    """Numbers 0, 1, ... per row as ints: the place within its part, after the rows of earlier parts."""
    parts = cut(frame.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = parts.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return parts.withColumn("part", part).join(F.broadcast(before), "part").withColumn(name, (place + F.col("before")).cast("int")).drop("part", "at")


def temperature_readings(sensors: DataFrame) -> DataFrame:
    """``(house, time, temp)`` of the readings of problem 6: -60 to 70 degrees, from 2020 on."""
    rows = sensors.select(clean_name(F.col("house")).alias("house"), "time", F.col("temp").alias("temp"))
    return rows.where((F.col("time") >= F.lit("2020-01-01 00:00:00 UTC").cast("timestamp")) & F.col("temp").between(-60, 70))


def hourly_temperatures(sensors: DataFrame) -> DataFrame:
    """The grid of problem 6: one row per house and hour."""
    return regular_grid(temperature_readings(sensors), "house", "time", "temp")


def missing_hours(sensors: DataFrame) -> DataFrame:
    """``(house, slot)``: the hours that the grid has filled, or left marked; houses out of service are left out."""
    return hourly_temperatures(sensors).where("status in ('filled', 'unsupported')").select("house", "slot")
