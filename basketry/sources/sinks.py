"""Writing results: sorted tables, CSV, JSON, and synthetic files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(frame: DataFrame, sep: str = ", ") -> DataFrame:
    """Arrays as joined text, for formats without arrays."""
    return frame.select(*[F.array_join(F.transform(f.name, lambda x: x.cast("string")), sep).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in frame.schema])


def emit(frame: DataFrame, sort_by: str | None = None, top: int | None = None, format: str = "table", path: str | None = None) -> str | None:
    """Sort by a measure, keep the best, and show (``table``) or write (``csv``, ``json``, ``parquet``)."""
    if sort_by:
        if sort_by not in frame.columns:
            raise ValueError(f"no column {sort_by!r}")
        rest = [c for c in frame.columns if c in ("antecedents", "consequents", "itemset", "item")]
        frame = frame.orderBy(F.desc(sort_by), *rest)
    if top is not None:
        frame = frame.limit(top)
    if path:
        out = flat(frame) if format in ("csv", "table") else frame
        writer = out.write.mode("overwrite")
        {"csv": lambda: writer.option("header", True).csv(path), "table": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[format]()
        return None
    rows = flat(frame).toPandas() if format != "json" else frame.toPandas()
    return rows.to_csv(index=False) if format == "csv" else rows.to_json(orient="records", default_handler=list) if format == "json" else rows.to_string(index=False)
