"""Positions of rows in a global order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def number_rows(frame: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """``frame`` with positions 0, 1, ... by ``order``: a range-partitioned sort, then offsets per part.

    Only the parts' row counts (as many as partitions) pass through one task. Ties keep an order of their own
    unless ``order`` is total.
    """
    parts = cut(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = parts.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, place + F.col("_before"))
    return out.drop("_part", "_at", "_before")
