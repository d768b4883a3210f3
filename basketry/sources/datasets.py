"""Small packaged data and seeded generators with planted patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HAN = ["I1 I2 I5", "I2 I4", "I2 I3", "I1 I2 I4", "I1 I3", "I2 I3", "I1 I3", "I1 I2 I3 I5", "I1 I2 I3"]
_WEATHER = """sunny hot high false no
sunny hot high true no
overcast hot high false yes
rainy mild high false yes
rainy cool normal false yes
rainy cool normal true no
overcast cool normal true yes
sunny mild high false no
sunny cool normal false yes
rainy mild normal false yes
sunny mild normal true yes
overcast mild high true yes
overcast hot normal false yes
rainy mild high true no"""
_PROFITS = {"a": 5, "b": 2, "c": 1, "d": 2, "e": 3, "f": 1, "g": 1}
_SALES = ["a1 c1 d1", "a2 c6 e2 g5", "a1 b2 c1 d6 e1 f5", "b4 c3 d3 f1", "b2 c2 e1 g2"]
_ROUTINES = ["wake;kitchen,coffee;door", "wake;bathroom;kitchen,coffee;door", "wake;kitchen;tv", "wake;bathroom;kitchen,coffee", "kitchen;tv;sleep", "wake;coffee;door;tv"]


def list_datasets() -> list[str]:
    return ["han", "routines", "sales", "weather"]


def load_dataset(spark: SparkSession, name: str) -> DataFrame:
    if name == "han":
        return spark.createDataFrame([(k, b.split()) for k, b in enumerate(_HAN)], "tid bigint, items array<string>")
    if name == "weather":
        return spark.createDataFrame([(k, *r.split()) for k, r in enumerate(_WEATHER.split("\n"))], "tid bigint, outlook string, temperature string, humidity string, windy string, play string")
    if name == "sales":
        return spark.createDataFrame([(k, x[0], float(x[1:]), float(_PROFITS[x[0]])) for k, r in enumerate(_SALES) for x in r.split()], "tid bigint, item string, qty double, profit double")
    if name == "routines":
        return spark.createDataFrame([(k, [e.split(",") for e in r.split(";")]) for k, r in enumerate(_ROUTINES)], "sid bigint, elements array<array<string>>")
    raise ValueError(f"unknown data set {name!r}; there are {list_datasets()}")


def make_transactions(spark: SparkSession, n: int = 1000, items: int = 100, length: int = 8, seed: int = 0) -> DataFrame:
    """``(tid, items)``: about ``length`` items by a power law; a tenth of the baskets hold the pattern i0, i1, i2."""
    draws = F.array(*[F.concat(F.lit("i"), F.floor(F.pow(F.rand(seed + 7 * k), 2.0) * items).cast("string")) for k in range(length)])
    planted = F.when(F.rand(seed + 1) < 0.1, F.array(*map(F.lit, ["i0", "i1", "i2"]))).otherwise(F.array().cast("array<string>"))
    return spark.range(n).select(F.col("id").alias("tid"), F.array_sort(F.array_distinct(F.concat(draws, planted))).alias("items"))


def make_sequences(spark: SparkSession, n: int = 1000, items: int = 20, length: int = 6, seed: int = 0) -> DataFrame:
    """``(sid, elements)``: single items; a third of the sequences hold s0 before s1 before s2."""
    draws = F.array(*[F.array(F.concat(F.lit("s"), F.floor(F.rand(seed + 11 * k) * items).cast("string"))) for k in range(length)])
    planted = F.when(F.rand(seed + 1) < 1 / 3, F.array(*[F.array(F.lit(f"s{k}")) for k in range(3)])).otherwise(F.array().cast("array<array<string>>"))
    return spark.range(n).select(F.col("id").alias("sid"), F.concat(planted, draws).alias("elements"))


def make_quantities(spark: SparkSession, n: int = 1000, items: int = 30, length: int = 5, seed: int = 0) -> DataFrame:
    """``(tid, item, qty, profit)``."""
    rows = make_transactions(spark, n, items, length, seed).select("tid", F.explode("items").alias("item"))
    return rows.select("tid", "item", F.floor(1 + F.rand(seed + 3) * 9).cast("double").alias("qty"), (1 + F.pmod(F.xxhash64("item"), F.lit(20))).cast("double").alias("profit"))


def make_labeled_items(spark: SparkSession, n: int = 1000, items: int = 10, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """``(case, items, label)``: class ``yes`` where i0 and i1 meet, up to noise."""
    drawn = spark.range(n).select(F.col("id").alias("case"), F.array_compact(F.array(*[F.when(F.rand(seed + k) < 0.5, F.lit(f"i{k}")) for k in range(items)])).alias("items"))
    rule = F.array_contains("items", "i0") & F.array_contains("items", "i1")
    return drawn.select("case", "items", F.when(rule != (F.rand(seed + 101) < noise), "yes").otherwise("no").alias("label"))
