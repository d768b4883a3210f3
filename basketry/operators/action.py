"""Rules at work on rows of items: violations, anomalies, forecasts, next events and explanations.

Rows are ``(pos, items)`` with positions 0, 1, ... without gaps; antecedents may hold lagged items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, sized
from .sequences import ELEMENTS, clean_elements
from .series import lag_items, lag_of, split_lag


def rule_text(antecedents: str = "antecedents", consequents: str = "consequents") -> Column:
    """``a, b => c``."""
    side = lambda c: F.array_join(F.array_sort(F.col(c)), ", ")
    return F.concat(side(antecedents), F.lit(" => "), side(consequents))


def require_columns(frame: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _lags(rules: DataFrame) -> list[int]:
    """Distinct lags of the rules, a handful whatever their number."""
    both = rules.select(F.explode(F.concat("antecedents", "consequents")).alias("i")).select(lag_of(F.col("i")).alias("k")).where("k > 0").distinct()
    return sorted(r["k"] for r in both.collect())


def numbered_rules(rules: DataFrame) -> DataFrame:
    require_columns(rules, "antecedents", "consequents")
    if "rule" in rules.columns:
        return rules
    return cut(rules.withColumn("rule", F.monotonically_increasing_id()))


def with_history(rows: DataFrame, lags: Sequence[int], pos: str = "pos", items: str = "items") -> DataFrame:
    """Rows with lagged items beside their own; rows of missing history stay."""
    return lag_items(rows.select(pos, items), lags, pos, items, drop_incomplete=False) if lags else rows.select(pos, items)


def fired(rows: DataFrame, rules: DataFrame, pos: str = "pos", items: str = "items", antecedent: str = "antecedents") -> DataFrame:
    """Pairs of rows and rules whose antecedent holds, joined on the antecedent's first item; an empty one always holds.

    A rule that asks for more history than a row has does not fire.
    """
    table = with_history(rows, _lags(rules), pos, items)
    long = table.select(pos, items, F.explode(items).alias("lead"))
    some = rules.where(F.size(antecedent) > 0).withColumn("lead", F.element_at(antecedent, 1))
    reach = F.coalesce(F.array_max(F.transform(F.concat("antecedents", "consequents"), lag_of)), F.lit(0))
    hit = long.join(sized(some), "lead").where((F.size(F.array_except(antecedent, items)) == 0) & (F.col(pos) >= reach)).drop("lead")
    none = rules.where(F.size(antecedent) == 0)
    return hit.unionByName(table.crossJoin(F.broadcast(none)).select(*hit.columns))


def _holds(side: str, items: str = "items") -> Column:
    return F.size(F.array_except(side, items)) == 0


def rule_violations(rows: DataFrame, rules: DataFrame, pos: str = "pos", items: str = "items") -> DataFrame:
    """``(pos, rule, antecedents, consequents)`` where a rule's antecedent holds and its consequent does not."""
    return fired(rows, numbered_rules(rules), pos, items).where(~_holds("consequents", items)).select(pos, "rule", "antecedents", "consequents")


def anomaly_scores(rows: DataFrame, rules: DataFrame, weight: str = "surprise", floor: float = 1e-3, pos: str = "pos", items: str = "items") -> DataFrame:
    """``(pos, score, violations, applicable)`` for every row; surprise is -log2 of how unlikely a violation was."""
    if weight not in ("surprise", "confidence", "count"):
        raise ValueError("weight must be surprise, confidence or count")
    conf = F.col("confidence")
    value = {"surprise": -F.log2(F.greatest(1 - conf, F.lit(floor))), "confidence": conf, "count": F.lit(1.0)}[weight]
    hit = fired(rows, numbered_rules(rules), pos, items).withColumn("broken", ~_holds("consequents", items))
    sums = hit.groupBy(pos).agg(F.sum(F.when(F.col("broken"), value).otherwise(0.0)).alias("score"), F.count_if("broken").alias("violations"), F.count(F.lit(1)).alias("applicable"))
    return rows.select(pos).join(sums, pos, "left").fillna({"score": 0.0, "violations": 0, "applicable": 0})


def detect_anomalies(rows: DataFrame, rules: DataFrame, min_score: float = 0.0, top: int | None = None, weight: str = "surprise", floor: float = 1e-3, pos: str = "pos", items: str = "items") -> DataFrame:
    """Rows above a score with the texts of the rules they break, the worst first."""
    rules = numbered_rules(rules)
    scores = anomaly_scores(rows, rules, weight, floor, pos, items).where((F.col("violations") > 0) & (F.col("score") > min_score))
    texts = rule_violations(rows, rules, pos, items).groupBy(pos).agg(F.array_sort(F.collect_set(rule_text())).alias("rules"))
    out = scores.join(texts, pos).orderBy(F.desc("score"), pos)
    return out.limit(top) if top else out


def _combined(combine: str) -> Column:
    if combine not in ("max", "noisy_or"):
        raise ValueError("combine must be max or noisy_or")
    return F.max("confidence") if combine == "max" else 1 - F.product(1 - F.col("confidence"))


def _usable(rules: DataFrame, past_only: bool) -> DataFrame:
    keep = F.forall("consequents", lambda i: lag_of(i) == 0)
    if past_only:
        keep &= F.forall("antecedents", lambda i: lag_of(i) > 0)
    return rules.where(keep)


def rule_scores(rows: DataFrame, rules: DataFrame, combine: str = "max", past_only: bool = True, pos: str = "pos", items: str = "items") -> DataFrame:
    """``(pos, item, score)``: with what confidence the rules that fire predict each item; others score 0."""
    require_columns(rules, "antecedents", "consequents", "confidence")
    hit = fired(rows, numbered_rules(_usable(rules, past_only)), pos, items)
    return hit.select(pos, F.explode("consequents").alias("item"), "confidence").groupBy(pos, "item").agg(_combined(combine).alias("score"))


def forecast_next(rows: DataFrame, rules: DataFrame, combine: str = "max", pos: str = "pos", items: str = "items") -> DataFrame:
    """``(item, score)`` of the row after the last one, the best first."""
    last = rows.agg(F.max(pos)).first()[0]
    if last is None:
        return rows.sparkSession.createDataFrame([], "item string, score double")
    lags = _lags(rules)
    recent = rows.where(F.col(pos) > last - max(lags, default=0)).select(pos, items)
    more = recent.limit(0).unionByName(rows.sparkSession.range(1).select(F.lit(last + 1).cast(dict(rows.dtypes)[pos]).alias(pos), F.array().cast("array<string>").alias(items)))
    scores = rule_scores(recent.unionByName(more), rules, combine, True, pos, items).where(F.col(pos) == last + 1)
    return scores.where("score > 0").select("item", "score").orderBy(F.desc("score"), "item")


def evaluate_forecast(rows: DataFrame, rules: DataFrame, threshold: float = 0.5, combine: str = "max", past_only: bool = True, pos: str = "pos", items: str = "items") -> DataFrame:
    """``(item, n, positives, predicted, hits, precision, recall, f1, base_rate)``; rows without full history are left out."""
    usable = cut(_usable(rules, past_only))
    start = max(_lags(usable), default=0)
    first = rows.agg(F.min(pos)).first()[0] or 0
    part = rows.where(F.col(pos) >= first + start)
    n = part.count()
    names = usable.select(F.explode("consequents").alias("item")).distinct()
    scores = rule_scores(rows, usable, combine, past_only, pos, items).where((F.col(pos) >= first + start) & (F.col("score") >= threshold)).select(pos, "item", F.lit(1).alias("guess"))
    actual = part.select(pos, F.explode(F.array_distinct(items)).alias("item")).join(sized(names), "item", "left_semi").select(pos, "item", F.lit(1).alias("real"))
    both = scores.join(actual, [pos, "item"], "full_outer").groupBy("item").agg(F.count("real").alias("positives"), F.count("guess").alias("predicted"), F.count_if(F.col("real").isNotNull() & F.col("guess").isNotNull()).alias("hits"))
    out = names.join(both, "item", "left").fillna(0, ["positives", "predicted", "hits"])
    precision, recall = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")), F.when(F.col("positives") > 0, F.col("hits") / F.col("positives"))
    f1 = F.when(precision.isNotNull() & recall.isNotNull(), F.when(F.col("hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0))
    return out.select("item", F.lit(n).cast("bigint").alias("n"), "positives", "predicted", "hits", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.when(F.lit(n) > 0, F.col("positives") / F.lit(max(n, 1))).alias("base_rate"))


# -- events of sequences ---------------------------------------------------------------------------


def _pending(cases: DataFrame, rules: DataFrame, combine: str, key: Sequence[str]) -> DataFrame:
    """``(key, item, score)`` from ``(key, items, firsts, lasts)``: items of rules complete in the history and still to come."""
    rules = rules.select("antecedents", "consequents", "confidence").withColumn("lead", F.element_at("antecedents", 1))
    at = lambda values, i: F.get(F.col(values), (F.array_position("items", i) - 1).cast("int"))
    hit = cases.select(*key, "items", "firsts", "lasts", F.explode("items").alias("lead")).join(sized(rules), "lead").where(_holds("antecedents"))
    done = hit.withColumn("done", F.array_max(F.transform("antecedents", lambda i: at("firsts", i)))).select(*key, "items", "lasts", "done", "confidence", F.explode("consequents").alias("item"))
    waiting = done.where(F.coalesce(at("lasts", F.col("item")), F.lit(-1)) <= F.col("done"))
    return waiting.groupBy(*key, "item").agg(_combined(combine).alias("score"))


def _history(elements: Column, upto: Column | None = None) -> Column:
    pos = F.slice(elements, 1, upto) if upto is not None else elements
    return F.flatten(F.transform(pos, lambda e, k: F.transform(e, lambda i: F.struct(i.alias("item"), k.alias("k")))))


def _seen(frame: DataFrame, key: Sequence[str], flat: Column) -> DataFrame:
    """Items of a history with first and last positions, per row and without a shuffle."""
    names = F.array_distinct(F.transform("_flat", lambda s: s["item"]))
    of = lambda i, f: f(F.transform(F.filter("_flat", lambda s: s["item"] == i), lambda s: s["k"]))
    table = frame.withColumn("_flat", flat).withColumn("items", names)
    return table.select(*key, "items", F.transform("items", lambda i: of(i, F.array_min)).alias("firsts"), F.transform("items", lambda i: of(i, F.array_max)).alias("lasts"))


def predict_next_events(sequences: DataFrame, rules: DataFrame, combine: str = "max") -> DataFrame:
    """``(sid, item, score)`` of the events still to be expected in each sequence."""
    cases = _seen(sequences.select("sid", clean_elements(F.col(ELEMENTS)).alias("e")), ["sid"], _history(F.col("e")))
    return _pending(cases, rules, combine, ["sid"])


def evaluate_next_events(sequences: DataFrame, rules: DataFrame, k: int = 1, min_prefix: int = 1, train: DataFrame | None = None, combine: str = "max", target: str = "future") -> DataFrame:
    """One row ``(cases, coverage, hit_rate, precision[, baseline_hit_rate, baseline_precision])`` over all cuts of all sequences."""
    if k < 1 or min_prefix < 1 or target not in ("future", "next"):
        raise ValueError("k and min_prefix must be positive, target future or next")
    rows = sequences.select("sid", clean_elements(F.col(ELEMENTS)).alias("e")).where(F.size("e") > min_prefix)
    cases = rows.select("sid", "e", F.explode(F.sequence(F.lit(min_prefix), F.size("e") - 1)).alias("cut"))
    rest = F.slice("e", F.col("cut") + 1, F.lit(1) if target == "next" else F.size("e"))
    cases = cut(cases.withColumn("future", F.array_distinct(F.flatten(rest))))
    key = ["sid", "cut"]
    scores = _pending(_seen(cases, key, _history(F.col("e"), F.col("cut"))), rules, combine, key)
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "item"))), 1, k)
    guesses = scores.groupBy(*key).agg(F.transform(top, lambda s: s["item"]).alias("top"))
    table = cases.join(guesses, key, "left").withColumn("right", F.size(F.array_intersect("top", "future")))
    share = lambda right, guess: F.col(right) / F.size(guess)
    aggs = [F.count(F.lit(1)).alias("cases"), (F.count("top") / F.count(F.lit(1))).alias("coverage"), (F.count_if(F.coalesce(F.col("right"), F.lit(0)) > 0) / F.count(F.lit(1))).alias("hit_rate"), F.avg(F.when(F.col("top").isNotNull(), share("right", "top"))).alias("precision")]
    if train is not None:
        counts = train.select("sid", F.explode(F.array_distinct(F.flatten(clean_elements(F.col(ELEMENTS))))).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        # a cut's history holds few items: the most popular k that are not among them lie within the first k + |history|
        longest = cases.agg(F.max(F.size(F.array_distinct(F.flatten("e"))))).first()[0] or 0
        popular = [r["item"] for r in counts.orderBy(F.desc("n"), "item").limit(k + longest).collect()]
        known = F.array(*map(F.lit, popular)) if popular else F.array().cast("array<string>")
        table = table.withColumn("base", F.slice(F.array_except(known, F.flatten(F.slice("e", 1, F.col("cut")))), 1, k)).withColumn("base_right", F.size(F.array_intersect("base", "future")))
        aggs += [(F.count_if(F.col("base_right") > 0) / F.count(F.lit(1))).alias("baseline_hit_rate"), F.avg(F.when(F.size("base") > 0, share("base_right", "base")).otherwise(0.0)).alias("baseline_precision")]
    return table.agg(*aggs)


# -- explanations ----------------------------------------------------------------------------------


def rule_evidence(rows: DataFrame, antecedent: Sequence[str], consequent: Sequence[str], pos: str = "pos", items: str = "items", labels: bool = True) -> DataFrame:
    """One row with the 2 x 2 table of a rule, its measures, and the positions that support and violate it."""
    lags = sorted({k for i in (*antecedent, *consequent) if (k := split_lag(i)[1])})
    first = rows.agg(F.min(pos)).first()[0] or 0
    table = with_history(rows, lags, pos, items).where(F.col(pos) >= first + max(lags, default=0))
    has = lambda side: F.size(F.array_except(F.array(*map(F.lit, side)), items)) == 0 if side else F.lit(True)
    a, c = has(antecedent), has(consequent)
    out = table.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(a & c).alias("both"), F.count_if(a & ~c).alias("only_antecedent"), F.count_if(~a & c).alias("only_consequent"), F.count_if(~a & ~c).alias("neither"), *([F.array_sort(F.collect_list(F.when(a & c, F.col(pos)))).alias("supporting"), F.array_sort(F.collect_list(F.when(a & ~c, F.col(pos)))).alias("violating")] if labels else []))
    div = lambda x, y: F.when(y > 0, x / y)
    conf = div(F.col("both"), F.col("both") + F.col("only_antecedent"))
    base = div(F.col("both") + F.col("only_consequent"), F.col("n_rows"))
    return out.withColumns({"support": div(F.col("both"), F.col("n_rows")), "confidence": conf, "lift": div(conf, base)})


def explain_rule(rows: DataFrame, rules: DataFrame, antecedent: Sequence[str], consequent: Sequence[str], top: int = 5, pos: str = "pos", items: str = "items") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(evidence, contributions, alternatives)`` of a rule: what each item of its antecedent adds, and how more
    general, more specific and other rules of the table fare on the same rows. Each part is one plan."""
    antecedent, consequent = sorted(antecedent), sorted(consequent)
    evidence = rule_evidence(rows, antecedent, consequent, pos, items)
    spark = rows.sparkSession
    own = evidence.select("confidence").first()[0]
    less = spark.createDataFrame([(i, [x for x in antecedent if x != i], consequent) for i in antecedent], "item string, antecedents array<string>, consequents array<string>").withColumn("rule", F.monotonically_increasing_id())
    contributions = less.join(_confidences(rows, less, pos, items), "rule", "left").select("item", F.col("confidence").alias("confidence_without"), (F.lit(own) - F.col("confidence")).alias("gain"))
    a, c = F.array(*map(F.lit, antecedent)), F.array(*map(F.lit, consequent))
    plain = rules.select(F.array_sort("antecedents").alias("antecedents"), F.array_sort("consequents").alias("consequents"))
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    same_c, same_a = F.col("consequents") == c, F.col("antecedents") == a
    relation = F.when(same_c & same_a, None).when(same_c & inside(F.col("antecedents"), a), "more general").when(same_c & inside(a, F.col("antecedents")), "more specific").when(same_a, "same antecedent")
    other = cut(plain.withColumn("relation", relation).where("relation is not null").withColumn("rule", F.monotonically_increasing_id()))
    best = Window.partitionBy("relation").orderBy(F.desc("confidence"), "text")
    found = other.join(_confidences(rows, other.select("rule", "antecedents", "consequents"), pos, items), "rule", "left").select("relation", rule_text().alias("text"), "confidence", "support")
    alternatives = found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top).select("relation", F.col("text").alias("rule"), "confidence", "support", (F.col("confidence") - F.lit(own)).alias("delta_confidence"))
    return evidence, contributions, alternatives


def _confidences(rows: DataFrame, rules: DataFrame, pos: str, items: str) -> DataFrame:
    n = rows.count()
    hit = fired(rows, rules.select("rule", "antecedents", "consequents"), pos, items).withColumn("good", _holds("consequents", items))
    reach = F.coalesce(F.array_max(F.transform(F.concat("antecedents", "consequents"), lag_of)), F.lit(0))
    return hit.groupBy("rule", reach.alias("reach")).agg((F.count_if("good") / F.count(F.lit(1))).alias("confidence"), F.count_if("good").alias("k")).select("rule", "confidence", (F.col("k") / (n - F.col("reach"))).alias("support"))


def explain_row(rows: DataFrame, rules: DataFrame, row: int, pos: str = "pos", items: str = "items") -> DataFrame:
    """``(rule, status, missing, confidence)`` of every rule for one row: confirmed, violated, not fired or no history."""
    lags = _lags(rules)
    near = rows.where(F.col(pos).between(row - max(lags, default=0), row)).select(pos, items)
    here = with_history(near, lags, pos, items).where(F.col(pos) == row).select(F.col(items).alias("_here"))
    first = rows.agg(F.min(pos)).first()[0] or 0
    reach = F.coalesce(F.array_max(F.transform(F.concat("antecedents", "consequents"), lag_of)), F.lit(0))
    missing = F.array_sort(F.array_except("antecedents", "_here"))
    late = F.lit(row - first) < reach
    status = F.when(late, "no history").when(F.size(missing) > 0, "not fired").when(_holds("consequents", "_here"), "confirmed").otherwise("violated")
    conf = F.col("confidence") if "confidence" in rules.columns else F.lit(None).cast("double")
    return rules.crossJoin(F.broadcast(here)).select(rule_text().alias("rule"), status.alias("status"), F.when(late, F.array().cast("array<string>")).otherwise(missing).alias("missing"), conf.alias("confidence"))
