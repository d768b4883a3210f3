"""Rules across time: lagged antecedents, profiles, windows of rules and their drift."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import itemsets as I
from .fuzzy import fuzzy_itemsets
from .rules import association_rules, fuzzy_association_rules
from .series import base_of, lag_items, lag_of, variable_of

#: Ordered as drift reports show them.
STATUSES = ["stable", "emerging", "vanishing", "intermittent"]


def _structure(targets: Sequence[str] | None, require_lagged_antecedent: bool, same_time_antecedent: bool, exclude_persistence: bool) -> Column:
    a, c = F.col("antecedents"), F.col("consequents")
    keep = F.forall(c, lambda i: lag_of(i) == 0)
    if targets is not None:
        wanted = list(targets)
        keep &= F.forall(c, lambda i: i.isin(wanted) | variable_of(i).isin(wanted))
    if require_lagged_antecedent:
        keep &= F.exists(a, lambda i: lag_of(i) > 0)
    if not same_time_antecedent:
        keep &= F.forall(a, lambda i: lag_of(i) > 0)
    if exclude_persistence:
        keep &= ~F.exists(a, lambda i: (lag_of(i) > 0) & F.array_contains(F.transform(c, variable_of), variable_of(i)))
    return keep


def _with_lags(rules: DataFrame) -> DataFrame:
    lags = F.array_sort(F.array_distinct(F.filter(F.transform("antecedents", lag_of), lambda k: k > 0)))
    return rules.withColumn("lags", lags).withColumn("max_lag", F.coalesce(F.array_max("lags"), F.lit(0)))


def lag_set(max_lag: int, lags: Sequence[int] | None) -> list[int]:
    chosen = sorted(set(lags)) if lags is not None else list(range(1, max_lag + 1))
    if max_lag < 1 or not chosen or chosen[0] < 1 or chosen[-1] > max_lag:
        raise ValueError("lags must lie in 1..max_lag")
    return chosen


def temporal_association_rules(rows: DataFrame, max_lag: int, min_supp: float, metric: str = "confidence", min_threshold: float = 0.8, lags: Sequence[int] | None = None, targets: Sequence[str] | None = None, require_lagged_antecedent: bool = True, same_time_antecedent: bool = True, exclude_persistence: bool = False, pos: str = "pos", items: str = "items", series: str | None = None) -> DataFrame:
    """Rules from items now and up to ``max_lag`` steps ago to items now, with ``lags`` and ``max_lag``.

    Supports are shares of the rows with full history (all rows but the first ``max(lags)``).
    """
    found = I.frequent_itemsets(lag_items(rows, lag_set(max_lag, lags), pos, items, series), min_supp, None, items)
    rules = association_rules(found, metric, min_threshold)
    return _with_lags(rules.where(_structure(targets, require_lagged_antecedent, same_time_antecedent, exclude_persistence)))


def lag_degrees(rows: DataFrame, lags: Sequence[int], pos: str = "pos", items: str = "items", degrees: str = "degrees", series: str | None = None) -> DataFrame:
    keys = [series] if series else []
    sent = rows.select(*keys, pos, items, degrees, F.explode(F.array(*map(F.lit, [0, *lags]))).alias("_lag")).select(
        *keys, (F.col(pos) + F.col("_lag")).alias(pos), (F.col("_lag") == 0).alias("_own"), F.col(degrees),
        F.transform(items, lambda i: F.when(F.col("_lag") == 0, i).otherwise(F.concat(i, F.lit("@lag"), F.col("_lag").cast("string")))).alias(items),
    )
    pairs = sent.withColumn("_s", F.struct(items, degrees))
    out = pairs.groupBy(*keys, pos).agg(F.collect_list("_s").alias("_s"), F.max("_own").alias("_own"), F.count(F.lit(1)).alias("_n")).where(F.col("_own") & (F.col("_n") == len(lags) + 1))
    return out.select(*keys, pos, F.flatten(F.col(f"_s.{items}")).alias(items), F.flatten(F.col(f"_s.{degrees}")).alias(degrees))


def fuzzy_temporal_association_rules(rows: DataFrame, max_lag: int, min_supp: float, num_alpha: int = 10, metric: str = "FConf", min_threshold: float = 0.8, lags: Sequence[int] | None = None, targets: Sequence[str] | None = None, require_lagged_antecedent: bool = True, same_time_antecedent: bool = True, exclude_persistence: bool = False, measures: Sequence[str] = (), pos: str = "pos", items: str = "items", degrees: str = "degrees", series: str | None = None) -> DataFrame:
    found = fuzzy_itemsets(lag_degrees(rows, lag_set(max_lag, lags), pos, items, degrees, series), min_supp, num_alpha, items, degrees)
    rules = fuzzy_association_rules(found, metric, min_threshold, measures)
    return _with_lags(rules.where(_structure(targets, require_lagged_antecedent, same_time_antecedent, exclude_persistence)))


def format_lagged_item(item: Column) -> Column:
    return F.when(lag_of(item) > 0, F.concat(base_of(item), F.lit(" (t-"), lag_of(item).cast("string"), F.lit(")"))).otherwise(item)


def rule_profile(rows: DataFrame, antecedent: Sequence[str], consequent: Sequence[str], by: Column, pos: str = "pos", items: str = "items", series: str | None = None) -> DataFrame:
    """``(group, n, antecedent_count, joint_count, support, confidence, lift)``; null where undefined."""
    from .series import split_lag

    lags = sorted({k for i in (*antecedent, *consequent) if (k := split_lag(i)[1])})
    keys = [series] if series else []
    tagged = rows.withColumn("_group", by)
    table = lag_items(tagged.select(*keys, pos, items, "_group"), lags, pos, items, series) if lags else tagged
    has = lambda side: F.size(F.array_except(F.array(*map(F.lit, side)), items)) == 0
    a, c = has(antecedent), has(consequent)
    out = table.groupBy(F.col("_group").alias("group")).agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("antecedent_count"), F.count_if(a & c).alias("joint_count"), F.count_if(c).alias("_c"))
    conf = F.when(F.col("antecedent_count") > 0, F.col("joint_count") / F.col("antecedent_count"))
    return out.select("group", "n", "antecedent_count", "joint_count", (F.col("joint_count") / F.col("n")).alias("support"), conf.alias("confidence"), F.when(F.col("_c") > 0, conf / (F.col("_c") / F.col("n"))).alias("lift"))


# -- windows ---------------------------------------------------------------------------------------


def assign_windows(rows: DataFrame, width: int | timedelta, step: int | timedelta | None = None, pos: str = "pos", time: str = "ts") -> DataFrame:
    """Rows with ``window``: by rows only whole windows; by duration from the first time on, the last may be partial."""
    step = width if step is None else step
    if isinstance(width, timedelta):
        w, s = int(width.total_seconds() * 1_000_000), int(step.total_seconds() * 1_000_000)
        start = rows.agg(F.min(F.unix_micros(time))).first()[0]
        at, last = F.unix_micros(time) - F.lit(start or 0), None
    else:
        w, s = int(width), int(step)
        at = F.col(pos).cast("bigint")
        n = (rows.agg(F.max(pos)).first()[0])
        last = ((n + 1 if n is not None else 0) - w) // s
    if w < 1 or s < 1:
        raise ValueError("width and step must be positive")
    low = F.greatest(F.lit(0), F.ceil((at - (w - 1)) / s).cast("bigint"))
    high = F.floor(at / s).cast("bigint")
    if last is not None:
        high = F.least(high, F.lit(last))
    return rows.withColumn("window", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))


def crisp_rule_miner(min_supp: float = 0.1, metric: str = "confidence", min_threshold: float = 0.8, max_len: int | None = None, items: str = "items") -> Callable[[DataFrame, str], DataFrame]:
    """``miner(frame, group) -> rules`` that mines all groups in one plan."""
    return lambda frame, group: association_rules(I.frequent_itemsets(frame, min_supp, max_len, items, group), metric, min_threshold, keys=[group])


def fuzzy_rule_miner(min_supp: float = 0.1, num_alpha: int = 10, metric: str = "FConf", min_threshold: float = 0.8, measures: Sequence[str] = (), items: str = "items", degrees: str = "degrees") -> Callable[[DataFrame, str], DataFrame]:
    return lambda frame, group: fuzzy_association_rules(fuzzy_itemsets(frame, min_supp, num_alpha, items, degrees, group), metric, min_threshold, measures, [group])


def window_table(rows: DataFrame, width, step=None, min_rows: int = 2, pos: str = "pos", time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """``(rows with window numbers, windows(window, rows, start, end))`` of windows with enough rows, renumbered."""
    from pyspark.sql.window import Window

    tagged = I.cut(assign_windows(rows, width, step, pos, time))
    sizes = tagged.groupBy("window").agg(F.count(F.lit(1)).alias("rows"), F.min(pos).alias("start"), F.max(pos).alias("end")).where(F.col("rows") >= min_rows)
    # one row per window: their number is that of windows, not of rows
    ranked = sizes.withColumn("number", F.row_number().over(Window.orderBy("window")) - 1)
    out = tagged.join(F.broadcast(ranked.select("window", "number")), "window").drop("window").withColumnRenamed("number", "window")
    return out, ranked.select(F.col("number").alias("window"), "rows", "start", "end")


def window_rules(rows: DataFrame, width, step=None, min_supp: float = 0.1, metric: str = "confidence", min_threshold: float = 0.8, miner: Callable[[DataFrame, str], DataFrame] | None = None, min_rows: int = 2, pos: str = "pos", time: str = "ts") -> tuple[DataFrame, int]:
    """Rules of every window, with ``window``, and the number of windows; all windows are mined in one plan."""
    tagged, windows = window_table(rows, width, step, min_rows, pos, time)
    miner = miner or crisp_rule_miner(min_supp, metric, min_threshold)
    return miner(tagged, "window").withColumn("window", F.col("window").cast("int")), windows.count()


def rule_drift(windowed: DataFrame, n_windows: int, measure: str = "confidence", stable_fraction: float = 0.8) -> DataFrame:
    """One row per rule: in how many windows, first and last, the measure's mean, extremes and slope, and a status.

    Windows without any rule count, so their number is given and not taken from the rules.
    """
    w, x = F.col("window"), F.col(measure)
    out = windowed.groupBy("antecedents", "consequents").agg(F.count_distinct(w).alias("windows"), F.min(w).alias("first_window"), F.max(w).alias("last_window"), F.avg(x).alias(f"mean_{measure}"), F.min(x).alias(f"min_{measure}"), F.max(x).alias(f"max_{measure}"), F.regr_slope(x, w.cast("double")).alias("slope"))
    first, last = F.col("first_window") == 0, F.col("last_window") == n_windows - 1
    share = F.col("windows") / n_windows
    status = F.when(first & last, F.when(share >= stable_fraction, "stable").otherwise("intermittent")).when(last, "emerging").when(first, "vanishing").otherwise("intermittent")
    return out.select("antecedents", "consequents", "windows", share.alias("persistence"), "first_window", "last_window", f"mean_{measure}", f"min_{measure}", f"max_{measure}", F.when(F.col("windows") >= 3, F.col("slope")).alias("slope"), status.alias("status"))


def compare_rule_sets(before: DataFrame, after: DataFrame, measure: str = "confidence", tolerance: float = 0.05) -> DataFrame:
    """Full outer join of two rule tables: ``measure_before, measure_after, delta, status``."""
    keys = ["antecedents", "consequents"]
    both = before.select(*keys, F.col(measure).alias(f"{measure}_before")).join(after.select(*keys, F.col(measure).alias(f"{measure}_after")), keys, "full_outer")
    was, now = F.col(f"{measure}_before"), F.col(f"{measure}_after")
    status = F.when(was.isNull(), "new").when(now.isNull(), "lost").when(F.abs(now - was) > tolerance, "changed").otherwise("stable")
    return both.select(*keys, was, now, (now - was).alias("delta"), status.alias("status"))
