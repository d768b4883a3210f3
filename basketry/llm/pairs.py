"""Problem 1: how often items stand in the same basket, and how far that exceeds chance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_names
from ..session import cut

#: Sides of the item table up to this many rows are broadcast (about 10 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Baskets of more items are cut into blocks of this size, and the pairs of blocks spread over the cluster.
BLOCK = 256


def cooccurrence(
    frame: DataFrame,
    basket: str = "tid",
    items: str = "items",
    min_count: int = 1,
    min_share: float = 0.0,
    min_lift: float | None = None,
) -> DataFrame:
    """``(item_a, item_b, pair_count, count_a, count_b, baskets, lift, pmi)``, smaller name first.

    All rows with the same basket id are one basket, its items the distinct non-void names (stripped of
    white space). Baskets without items count in ``baskets``; rows without a basket id are ignored; items
    repeated in a basket count once; extra columns are not read. An empty table gives no rows. ``pmi`` is
    the base-2 logarithm of ``lift``. No pair that reaches the thresholds is missed.

    Plan: (1) an upper bound of each item's baskets, counted map-side, drops items that cannot reach the
    threshold; (2) one shuffle by basket of small integer ids; (3) ordered pairs, with (a, a) for the item's
    own count, go through one partial aggregation, so pairs and marginals need a single pass. Baskets above
    ``BLOCK`` items are cut into blocks whose pairs of blocks are spread, so no task holds a basket's pairs.
    """
    rows = frame.where(F.col(basket).isNotNull()).select(F.col(basket).alias("b"), clean_names(F.col(items)).alias("names"))
    total = frame.where(F.col(basket).isNotNull()).select(F.col(basket).alias("b")).distinct().count()
    least = max(1, min_count, math.ceil(min_share * total - 1e-9))
    # rows of a basket that came again can only raise this count, so the bound is safe
    known = rows.select(F.explode("names").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    known = cut(known.select("item", F.monotonically_increasing_id().alias("id")))
    small = known.count() <= BROADCAST_ROWS
    long = rows.select("b", F.explode("names").alias("item")).join(F.broadcast(known) if small else known, "item")
    baskets = long.groupBy("b").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    pairs = _pairs(baskets.where(F.size("ids") <= BLOCK).select("ids")).unionByName(_block_pairs(baskets.where(F.size("ids") > BLOCK).select("ids")))
    counts = cut(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    single = counts.where("x = y").select(F.col("x").alias("id"), "n").join(F.broadcast(known) if small else known, "id")
    hint = F.broadcast if small else (lambda side: side)
    a = hint(single.select(F.col("id").alias("x"), F.col("item").alias("one"), F.col("n").alias("n_one")))
    b = hint(single.select(F.col("id").alias("y"), F.col("item").alias("two"), F.col("n").alias("n_two")))
    swap = F.col("one") > F.col("two")
    lift = F.col("n").cast("double") * F.lit(float(total)) / (F.col("n_one").cast("double") * F.col("n_two").cast("double"))
    out = counts.where("x <> y").join(a, "x").join(b, "y").select(
        F.when(swap, F.col("two")).otherwise(F.col("one")).alias("item_a"),
        F.when(swap, F.col("one")).otherwise(F.col("two")).alias("item_b"),
        F.col("n").alias("pair_count"),
        F.when(swap, F.col("n_two")).otherwise(F.col("n_one")).alias("count_a"),
        F.when(swap, F.col("n_one")).otherwise(F.col("n_two")).alias("count_b"),
        F.lit(total).cast("bigint").alias("baskets"),
        lift.alias("lift"),
        F.log2(lift).alias("pmi"),
    )
    return out if min_lift is None else out.where(F.col("lift") >= min_lift)


def _pairs(frame: DataFrame) -> DataFrame:
    """All (x, y) with x <= y of each row's sorted array ``ids``."""
    one = frame.select("ids", F.posexplode("ids").alias("k", "x"))
    return one.select("x", F.explode(F.slice("ids", F.col("k") + 1, F.size("ids"))).alias("y"))


def _block_pairs(frame: DataFrame) -> DataFrame:
    """The same for long arrays, by pairs of blocks that are spread over the cluster first."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / BLOCK).cast("int")), lambda k: F.slice("ids", k * BLOCK + 1, BLOCK))
    cutup = frame.select(blocks.alias("blocks"))
    first = cutup.select("blocks", F.posexplode("blocks").alias("i", "left"))
    both = first.select("i", "left", F.posexplode("blocks").alias("j", "right")).where("j >= i").repartition(F.rand(7))
    inner = _pairs(both.where("i = j").select(F.col("left").alias("ids")))
    cross = both.where("i < j").select(F.explode("left").alias("x"), "right").select("x", F.explode("right").alias("y"))
    return inner.unionByName(cross)
