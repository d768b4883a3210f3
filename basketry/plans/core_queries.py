"""The queries of the core, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import BLANKS
from ..operators import grid, hierarchy
from . import reference_queries, transaction_queries

_STRIP = " || ".join(f"chr({ord(c)})" for c in BLANKS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p5_found(spark, sf_dir):
    return hierarchy.hierarchy(_table(spark, sf_dir, "taxonomy"), paths=False).select("item", "root", "depth")


def p5_paths(spark, sf_dir):
    return hierarchy.hierarchy(_table(spark, sf_dir, "taxonomy"), every=True).withColumn("path", F.array_join("path", "|"))


def p5_descendants(spark, sf_dir):
    return hierarchy.descendants(_table(spark, sf_dir, "taxonomy"))


def p6_found(spark, sf_dir):
    return grid.missing_hours(_table(spark, sf_dir, "sensors"))


def p6_grid(spark, sf_dir):
    return grid.hourly_temperatures(_table(spark, sf_dir, "sensors"))


def p6_filled(spark, sf_dir):
    """Hours that the factorisation has filled, by source: their number, and how far its values lie from the source's mean."""
    grid_rows = grid.hourly_temperatures(_table(spark, sf_dir, "sensors"))
    return grid_rows.groupBy("house").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("observed", "filled", "unsupported", "out")])


def p6_holdout(spark, sf_dir):
    """Error of the factorisation on observed cells that it has not seen, against that of the source's mean."""
    return grid.holdout_error(grid.temperature_readings(_table(spark, sf_dir, "sensors")), "house", "time", "temp")


_P5 = f"""WITH RECURSIVE link AS (SELECT DISTINCT trim(child, {_STRIP}) AS child, trim(parent, {_STRIP}) AS parent FROM taxonomy WHERE trim(child, {_STRIP}) <> '' AND trim(parent, {_STRIP}) <> ''),
     items AS (SELECT trim(child, {_STRIP}) AS item FROM taxonomy WHERE trim(child, {_STRIP}) <> '' UNION SELECT parent FROM link),
     below AS (SELECT parent AS item, child AS down FROM link UNION SELECT below.item, link.child FROM below JOIN link ON link.parent = below.down),
     ring AS (SELECT a.item, least(a.item, min(b.down)) AS ring FROM below a JOIN below b ON b.item = a.item JOIN below c ON c.item = b.down AND c.down = a.item WHERE a.item = a.down GROUP BY a.item),
     hung AS (SELECT item FROM ring UNION SELECT down FROM below JOIN ring USING (item)),
     top AS (SELECT item FROM items WHERE item NOT IN (SELECT child FROM link)),
     zero AS (SELECT down AS item, below.item AS root FROM below JOIN top USING (item) WHERE down IN (SELECT item FROM hung)
              UNION SELECT down, ring FROM below JOIN ring USING (item) UNION SELECT item, ring FROM ring)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_paths, p5_descendants, p6_found, p6_grid, p6_filled, p6_holdout)} | reference_queries.QUERIES | transaction_queries.QUERIES
ORACLE: dict[str, str] = reference_queries.ORACLE | transaction_queries.ORACLE | {
    "p6_found": f"""WITH cell AS (SELECT DISTINCT trim(house, {_STRIP}) AS house, CAST(floor(epoch(time) / 3600) AS BIGINT) * 3600 AS slot
                   FROM sensors WHERE time >= TIMESTAMPTZ '2020-01-01 00:00:00+00' AND temp BETWEEN -60 AND 70 AND trim(house, {_STRIP}) <> ''),
     run AS (SELECT house, slot, lead(slot) OVER (PARTITION BY house ORDER BY slot) AS nxt FROM cell)
     SELECT house, unnest(range(slot + 3600, nxt, 3600)) AS slot FROM run WHERE nxt - slot > 3600 AND (nxt - slot) / 3600 - 1 < 480""",
    "p5_found": f"""{_P5}, way AS (SELECT item, item AS root, 1::BIGINT AS depth FROM top UNION SELECT link.child, root, depth + 1 FROM way JOIN link ON link.parent = way.item WHERE link.child NOT IN (SELECT item FROM hung))
     SELECT item, root, max(depth) AS depth FROM way GROUP BY item, root UNION ALL SELECT item, root, 0 FROM zero""",
    "p5_paths": f"""{_P5}, way AS (SELECT item, item AS root, 1::BIGINT AS depth, item AS path FROM top UNION ALL SELECT link.child, root, depth + 1, path || '|' || link.child FROM way JOIN link ON link.parent = way.item WHERE link.child NOT IN (SELECT item FROM hung))
     SELECT item, root, max(depth) OVER (PARTITION BY item, root) AS depth, false AS on_ring, path FROM way UNION ALL SELECT item, root, 0, item IN (SELECT item FROM ring), NULL FROM zero""",
    "p5_descendants": f"""WITH RECURSIVE link AS (SELECT DISTINCT trim(child, {_STRIP}) AS child, trim(parent, {_STRIP}) AS parent FROM taxonomy WHERE trim(child, {_STRIP}) <> '' AND trim(parent, {_STRIP}) <> ''),
     below AS (SELECT parent AS item, child AS descendant FROM link UNION SELECT below.item, link.child FROM below JOIN link ON link.parent = below.descendant)
     SELECT item, descendant FROM below""",
}
