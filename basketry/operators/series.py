"""Time series as items: symbols, calendar items, lags and rolling windows."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.membership import default_labels

LAG = r"^(.*)@lag(\d+)$"


def lagged(item: str, lag: int) -> str:
    return f"{item}@lag{lag}" if lag else item


def split_lag(item: str) -> tuple[str, int]:
    """Base name and lag; a suffix that is no number is no lag."""
    base, at, lag = item.rpartition("@lag")
    return (base, int(lag)) if at and lag.isdecimal() else (item, 0)


def item_variable(item: str) -> str:
    return split_lag(item)[0].split("=", 1)[0]


def lag_of(item: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(item, LAG, 2), F.lit("")).cast("int"), F.lit(0))


def base_of(item: Column) -> Column:
    return F.when(item.rlike(LAG), F.regexp_extract(item, LAG, 1)).otherwise(item)


def variable_of(item: Column) -> Column:
    return F.element_at(F.split(base_of(item), "=", 2), 1)


def cut_points(frame: DataFrame, column: str, n_symbols: int = 3, method: str = "quantile") -> list[float]:
    """Inner borders of ``n_symbols`` classes, distinct and rising."""
    if n_symbols < 2:
        raise ValueError("n_symbols must be >= 2")
    rows = frame.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    if method == "quantile":
        found = rows.agg(F.percentile("x", F.array(*[F.lit(k / n_symbols) for k in range(1, n_symbols)]))).first()[0] or []
    elif method == "uniform":
        low, high = rows.agg(F.min("x"), F.max("x")).first()
        found = [] if low is None else [low + (high - low) * k / n_symbols for k in range(1, n_symbols)]
    elif method == "sax":
        mean, dev = rows.agg(F.avg("x"), F.stddev_pop("x")).first()
        found = [] if mean is None else [mean + dev * NormalDist().inv_cdf(k / n_symbols) for k in range(1, n_symbols)]
    else:
        raise ValueError(f"unknown method {method!r}")
    return [float(x) for x in found]


def symbol(x: Column, points: Sequence[float], labels: Sequence[str] | None = None, n_symbols: int | None = None) -> Column:
    """Label of the class of ``x``: classes include their lower border; null and NaN give null."""
    n = n_symbols or len(points) + 1
    names = list(labels) if labels else default_labels(n)
    if len(names) != n:
        raise ValueError(f"{n} labels are needed")
    steps = [F.when(x >= p, 1).otherwise(0) for p in points]
    at = sum(steps[1:], steps[0]) if steps else F.lit(0)
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.get(F.array(*map(F.lit, names)), at))


def symbolize(frame: DataFrame, column: str, n_symbols: int = 3, method: str = "quantile", labels: Sequence[str] | None = None, out: str | None = None) -> DataFrame:
    return frame.withColumn(out or column, symbol(F.col(column).cast("double"), cut_points(frame, column, n_symbols, method), labels, n_symbols))


def discretize(frame: DataFrame, columns: Sequence[str] | None = None, n_symbols: int = 3, method: str = "quantile") -> DataFrame:
    """Numeric columns (all by default) replaced by their symbols."""
    names = list(columns) if columns is not None else [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType)]
    points = {c: cut_points(frame, c, n_symbols, method) for c in names}
    return frame.withColumns({c: symbol(F.col(c).cast("double"), p, None, n_symbols) for c, p in points.items()})


def items_of(frame: DataFrame, columns: Sequence[str], sep: str = "=") -> Column:
    """Array of a row's items: ``column=value`` of texts and numbers, the name of true booleans."""
    parts = []
    for c in columns:
        if isinstance(frame.schema[c].dataType, T.BooleanType):
            parts.append(F.when(F.col(c), F.lit(c)))
        else:
            parts.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(c + sep), F.col(c).cast("string"))))
    return F.array_compact(F.array(*parts))


def to_items(frame: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, sep: str = "=") -> DataFrame:
    """``(keys, items)``."""
    names = list(columns) if columns is not None else [c for c in frame.columns if c not in keys]
    return frame.select(*keys, items_of(frame, names, sep).alias("items"))


def check_item_names(frame: DataFrame, items: str = "items", bad: str = "-") -> None:
    """Opt-in: refuse names that formats with separators could not carry."""
    found = frame.select(F.explode(items).alias("i")).where(F.contains("i", F.lit(bad))).limit(1).collect()
    if found:
        raise ValueError(f"item {found[0]['i']!r} contains {bad!r}")


PARTS = ("hour", "weekday", "daytype", "month", "part_of_day")


def calendar_items(time: Column, parts: Sequence[str] = ("hour", "weekday")) -> Column:
    """Array of ``hour=7``, ``weekday=0`` (Monday), ``daytype=weekend``, ``month=3``, ``part_of_day=night``."""
    wrong = [p for p in parts if p not in PARTS]
    if wrong:
        raise ValueError(f"unknown calendar parts: {wrong}")
    values = {
        "hour": F.hour(time).cast("string"), "weekday": F.weekday(time).cast("string"), "daytype": F.when(F.weekday(time) >= 5, "weekend").otherwise("workday"),
        "month": F.month(time).cast("string"), "part_of_day": F.get(F.array(*map(F.lit, ["night", "morning", "afternoon", "evening"])), F.floor(F.hour(time) / 6).cast("int")),
    }
    return F.when(time.isNotNull(), F.array(*[F.concat(F.lit(p + "="), values[p]) for p in parts])).otherwise(F.array().cast("array<string>"))


def lag_items(rows: DataFrame, lags: Sequence[int], pos: str = "pos", items: str = "items", series: str | None = None, drop_incomplete: bool = True) -> DataFrame:
    """Rows with the items of earlier rows as ``item@lagk``; positions are whole numbers without gaps.

    Every row hands its items on to the rows it is a lag of: one shuffle by position, no window over a series.
    Rows without full history are dropped (the first ``max(lags)`` of each series) or kept.
    """
    lags = sorted(set(lags))
    if not lags or lags[0] < 1:
        raise ValueError("lags must be positive")
    keys = [series] if series else []
    ahead = F.explode(F.array(*map(F.lit, [0, *lags])))
    sent = rows.select(*keys, F.col(pos), F.col(items), ahead.alias("_lag")).select(
        *keys, (F.col(pos) + F.col("_lag")).alias(pos), (F.col("_lag") == 0).alias("_own"),
        F.transform(items, lambda i: F.when(F.col("_lag") == 0, i).otherwise(F.concat(i, F.lit("@lag"), F.col("_lag").cast("string")))).alias(items),
    )
    out = sent.groupBy(*keys, pos).agg(F.array_sort(F.flatten(F.collect_list(items))).alias(items), F.max("_own").alias("_own"), F.count(F.lit(1)).alias("_n")).where("_own")
    if drop_incomplete:
        out = out.where(F.col("_n") == len(lags) + 1)
    rest = [c for c in rows.columns if c not in (*keys, pos, items)]
    out = out.drop("_own", "_n")
    return out.join(rows.select(*keys, pos, *rest), [*keys, pos]) if rest else out


def window_items(frame: DataFrame, columns: Sequence[str], width: int, step: int = 1, how: str = "any", pos: str = "pos", series: str | None = None) -> DataFrame:
    """Rolling any, all or mean over ``width`` rows, one row per ``step``, labelled by its last position.

    Rows go to the windows that hold them, so windows are grouped and not framed over a whole series.
    """
    if width < 1 or step < 1 or how not in ("any", "all", "mean"):
        raise ValueError("width and step must be positive, how any, all or mean")
    keys = [series] if series else []
    # windows end at positions width-1, width-1+step, ...
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - (width - 1)) / step))
    last = F.floor(F.col(pos) / step)
    ends = F.when(last >= first, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    rows = frame.select(*keys, F.explode(ends).alias("_w"), *columns)
    numeric = lambda c: F.col(c).cast("double")
    fold = {"any": lambda c: F.max(numeric(c)) > 0, "all": lambda c: F.min(numeric(c)) > 0, "mean": lambda c: F.avg(numeric(c))}[how]
    out = rows.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_n"), *[fold(c).alias(c) for c in columns]).where(F.col("_n") == width)
    return out.select(*keys, (F.col("_w") * step + width - 1).alias(pos), *columns)


def as_transactions(frame: DataFrame, columns: Sequence[str]) -> Column:
    """Array of the names of true (or non-zero) columns."""
    return F.array_compact(F.array(*[F.when(F.col(c).cast("double") > 0, F.lit(c)) for c in columns]))
