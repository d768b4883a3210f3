"""Reading baskets, fuzzy transactions, sequences, sensors, taxonomies, profits and rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import clean_names, stripped
from ..operators.order import number_rows
from ..operators.series import calendar_items, discretize, items_of


def basket_items(frame: DataFrame, column: str, sep: str | None = None) -> Column:
    """Sorted distinct names of an array column, or of a text column split at ``sep``; null gives an empty basket."""
    kind = frame.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return F.array_sort(clean_names(F.transform(F.col(column), lambda x: x.cast("string"))))
    if isinstance(kind, T.StringType) and sep:
        return F.array_sort(clean_names(F.split(F.col(column), _literal(sep))))
    raise ValueError(f"column {column!r} must be an array, or a text with a separator")


def _literal(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def transactions_from_dataframe(frame: DataFrame, column: str = "items", sep: str | None = None) -> DataFrame:
    return frame.withColumn("items", basket_items(frame, column, sep))


def fuzzy_transactions_from_dataframe(frame: DataFrame, items: str, degrees: str | None = None) -> DataFrame:
    """``items, degrees`` from an array of ``(item, degree)`` structs, or from two arrays of equal length per row."""
    kind = frame.schema[items].dataType
    if degrees is None:
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and len(kind.elementType) == 2):
            raise ValueError(f"column {items!r} must be an array of (item, degree)")
        a, b = kind.elementType.names
        s = F.coalesce(F.col(items), F.array().cast(kind))
        return frame.withColumns({"degrees": F.transform(s, lambda x: x[b].cast("double")), "items": F.transform(s, lambda x: x[a].cast("string"))})
    checked = F.when(F.size(items) != F.size(degrees), F.raise_error(F.lit("items and degrees differ in length"))).otherwise(F.col(degrees).cast("array<double>"))
    return frame.withColumns({"degrees": F.coalesce(checked, F.array().cast("array<double>")), "items": F.coalesce(F.col(items).cast("array<string>"), F.array().cast("array<string>"))})


def read_transactions(spark: SparkSession, path: str, format: str = "parquet", column: str = "items", sep: str | None = None, degrees_column: str | None = None, fuzzy: bool = False, **options) -> DataFrame:
    reader = spark.read.format(format).options(**({"header": "true"} if format == "csv" else {}) | options)
    frame = reader.load(path)
    return fuzzy_transactions_from_dataframe(frame, column, degrees_column) if fuzzy else transactions_from_dataframe(frame, column, sep)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value)`` of stripped lines that are not empty."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("value")).where(F.length("value") > 0)


def read_baskets(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(tid, items)`` of a text file with one basket per line."""
    return transactions_from_dataframe(read_lines(spark, path), "value", sep).select(F.monotonically_increasing_id().alias("tid"), "items")


def read_sequences(spark: SparkSession, path: str, element_sep: str = ";", item_sep: str = ",") -> DataFrame:
    """``(sid, elements)`` of a text file with one sequence per line."""
    elements = F.transform(F.split("value", _literal(element_sep)), lambda e: F.array_sort(clean_names(F.split(e, _literal(item_sep)))))
    return read_lines(spark, path).select(F.monotonically_increasing_id().alias("sid"), F.filter(elements, lambda e: F.size(e) > 0).alias("elements"))


def sensor_items(frame: DataFrame, time: str, n_symbols: int = 3, method: str = "quantile", calendar: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``(pos, ts, items)``: 0/1 columns are events, other numbers are symbols, texts ``column=value``."""
    names = [c for c in (columns or frame.columns) if c != time]
    numeric = [c for c in names if isinstance(frame.schema[c].dataType, T.NumericType)]
    spans = frame.agg(*[F.count_if(~F.col(c).isin(0, 1)).alias(c) for c in numeric]).first() if numeric else {}
    events = [c for c in numeric if not spans[c]]
    table = discretize(frame, [c for c in numeric if c not in events], n_symbols, method).withColumns({c: F.col(c) == 1 for c in events}) if numeric else frame
    items = items_of(table, names)
    if calendar:
        items = F.concat(items, calendar_items(F.col(time).cast("timestamp"), calendar))
    return number_rows(table.select(F.col(time).cast("timestamp").alias("ts"), items.alias("items")), ["ts"]).select("pos", "ts", "items")


def read_sensors(spark: SparkSession, path: str, time: str, **options) -> DataFrame:
    return sensor_items(spark.read.csv(path, header=True, inferSchema=True), time, **options)


def read_pairs(spark: SparkSession, path: str, columns: Sequence[str] = ("child", "parent")) -> DataFrame:
    return spark.read.csv(path, header=True).select(*[stripped(F.col(c)).alias(c) for c in columns])


def read_profits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("item string, profit double").csv(path, header=True)


def read_rules(spark: SparkSession, path: str, sep: str = ";", item_sep: str = ",") -> DataFrame:
    """Rules from text columns ``antecedents, consequents`` and numeric measures."""
    frame = spark.read.csv(path, header=True, sep=sep, inferSchema=True)
    side = lambda c: F.array_sort(clean_names(F.split(F.col(c).cast("string"), _literal(item_sep)))).alias(c)
    return frame.select(side("antecedents"), side("consequents"), *[c for c in frame.columns if c not in ("antecedents", "consequents")])


def read_item_measures(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, inferSchema=True)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, value)``: each file of a folder is one interval, numbered in order of its name."""
    from pyspark.sql.window import Window

    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    files = lines.select("file").distinct().withColumn("batch", F.row_number().over(Window.orderBy("file")) - 1)
    return lines.join(F.broadcast(files), "file").select("batch", "value")
