"""Rules from itemsets: all splits, their supports by equi-joins, and measures as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import MEASURES, RULE_COLUMNS, measure, quotient, with_measures
from ..session import cut, sized
from . import itemsets as I

#: Tables of itemsets up to this many rows are broadcast when supports are looked up.
BROADCAST_ITEMSETS = 200_000


def splits(found: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(antecedents, consequents, itemset, keep...)``: all ways to part an itemset in two, by bit masks."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size("itemset")).cast("int") - 2)
    rows = found.where((F.size("itemset") > 1) & (F.size("itemset") < 31)).select("itemset", *keep, F.explode(masks).alias("mask"))
    bit = lambda i: F.col("mask").bitwiseAND(F.pow(F.lit(2.0), i).cast("int"))
    return rows.select(
        F.filter("itemset", lambda x, i: bit(i) != 0).alias("antecedents"), F.filter("itemset", lambda x, i: bit(i) == 0).alias("consequents"), "itemset", *keep
    )


def candidate_rule_count(found: DataFrame) -> int:
    """How many rules the itemsets allow."""
    return int(found.where(F.size("itemset") > 1).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), F.size("itemset")) - 2), F.lit(0.0))).first()[0])


def _lookup(rules: DataFrame, found: DataFrame, value: str, keys: Sequence[str], small: bool) -> DataFrame:
    hint = F.broadcast if small else (lambda x: x)
    side = lambda name, out: hint(found.select(*keys, F.col("itemset").alias(name), F.col(value).alias(out)))
    return rules.join(side("antecedents", "antecedent_support"), [*keys, "antecedents"], "left").join(side("consequents", "consequent_support"), [*keys, "consequents"], "left")


def association_rules(found: DataFrame, metric: str = "confidence", min_threshold: float = 0.8, support_only: bool = False, keys: Sequence[str] = (), max_consequent: int | None = None, max_antecedent: int | None = None) -> DataFrame:
    """``([keys,] antecedents, consequents, measures...)`` of all splits that reach a threshold of one measure.

    ``found`` has ``itemset, support`` (and ``keys``, mined side by side). An itemset without one of its subsets
    is an error, unless ``support_only``, which leaves all measures but the support null.
    """
    keys = list(keys)
    if metric not in MEASURES and metric not in ("support", "conviction", "antecedent_support", "consequent_support"):
        raise ValueError(f"unknown measure {metric!r}")
    rules = splits(found, [*keys, "support"])
    if max_consequent:
        rules = rules.where(F.size("consequents") <= max_consequent)
    if max_antecedent:
        rules = rules.where(F.size("antecedents") <= max_antecedent)
    if support_only:
        empty = [F.lit(None).cast("double").alias(n) for n in RULE_COLUMNS if n != "support"]
        return rules.where(F.col("support") >= min_threshold).select(*keys, "antecedents", "consequents", "support", *empty).select(*keys, "antecedents", "consequents", *RULE_COLUMNS)
    both = _lookup(rules, found, "support", keys, found.count() <= BROADCAST_ITEMSETS)
    known = lambda name, of: F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit("no support of "), F.array_join(of, ",")))).otherwise(F.col(name)).alias(name)
    rows = both.select(*keys, "antecedents", "consequents", known("antecedent_support", "antecedents"), known("consequent_support", "consequents"), "support")
    return with_measures(rows, metric, min_threshold).select(*keys, "antecedents", "consequents", *RULE_COLUMNS)


def generate_rules(found: DataFrame, min_conf: float) -> DataFrame:
    """``(antecedents, consequents, confidence)``."""
    return association_rules(found, "confidence", min_conf).select("antecedents", "consequents", "confidence")


def level_average(f, ab: str, a: str, b: str) -> Column:
    """Mean of a measure over alpha levels; ``f`` takes the three supports at one level."""
    zipped = F.arrays_zip(F.col(ab).alias("ab"), F.col(a).alias("a"), F.col(b).alias("b"))
    return F.aggregate(F.transform(zipped, lambda s: f(s["ab"], s["a"], s["b"])), F.lit(0.0), lambda x, y: x + y) / F.size(ab)


def fuzzy_measure(name: str, ab: str = "levels", a: str = "antecedent_levels", b: str = "consequent_levels") -> Column:
    if name == "FSupp":
        return F.aggregate(ab, F.lit(0.0), lambda x, y: x + y) / F.size(ab)
    if name == "FConf":  # a level without the antecedent counts as kept
        return level_average(lambda x, y, z: quotient(x, y, 1.0), ab, a, b)
    if name == "FCF":
        return level_average(lambda x, y, z: _level_cf(x, y, z), ab, a, b)
    if name not in MEASURES:
        raise ValueError(f"measure {name!r} has no fuzzy form")
    return level_average(lambda x, y, z: MEASURES[name](x, y, z), ab, a, b)


def _level_cf(ab, a, b):
    conf = quotient(ab, a, 1.0)
    return F.when(conf > b, quotient(conf - b, 1 - b)).when(conf < b, quotient(conf - b, b)).otherwise(F.lit(0.0))


def fuzzy_association_rules(found: DataFrame, metric: str = "FConf", min_threshold: float = 0.8, measures: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """``(antecedents, consequents, FSupp, FConf, FCF, ...)`` from itemsets with supports per alpha level."""
    keys = list(keys)
    rules = splits(found, [*keys, "levels"])
    side = lambda name, out: found.select(*keys, F.col("itemset").alias(name), F.col("levels").alias(out))
    both = rules.join(side("antecedents", "antecedent_levels"), [*keys, "antecedents"]).join(side("consequents", "consequent_levels"), [*keys, "consequents"])
    names = list(dict.fromkeys(["FSupp", "FConf", "FCF", *measures]))
    return both.where(fuzzy_measure(metric) >= min_threshold).select(*keys, "antecedents", "consequents", *[fuzzy_measure(n).alias(n) for n in names])


def top_k_rules(baskets: DataFrame, k: int, min_conf: float = 0.6, min_lift: float | None = None, max_antecedent: int | None = None, max_consequent: int | None = None, max_len: int | None = 6, min_supp: float = 0.0, items: str = "items") -> DataFrame:
    """The ``k`` rules of the largest support among those of enough confidence; ties by confidence, then names."""
    if k < 1:
        raise ValueError("k must be positive")
    total = baskets.count()
    share = max(min_supp, 0.5)
    while True:
        found = I.frequent_itemsets(baskets, max(share, 1 / max(total, 1)), max_len, items)
        rules = association_rules(found, "confidence", min_conf, max_consequent=max_consequent, max_antecedent=max_antecedent)
        if min_lift is not None:
            rules = rules.where(F.col("lift") >= min_lift)
        if total == 0 or share <= max(min_supp, 1 / total) or rules.count() >= k:
            return rules.orderBy(F.desc("support"), F.desc("confidence"), "antecedents", "consequents").limit(k)
        share = max(min_supp, 1 / total, share / 2)


def rare_rules(baskets: DataFrame, max_supp: float, min_supp: float = 0.0, least: int = 2, min_conf: float = 0.6, min_lift: float | None = None, max_antecedent: int | None = None, max_consequent: int | None = None, items: str = "items") -> DataFrame:
    """Rules from minimal rare itemsets; the supports of their parts are frequent, so they are known."""
    rare = cut(I.minimal_rare_itemsets(baskets, max_supp, min_supp, least, 2, None, items))
    frequent = I.frequent_itemsets(baskets, max_supp, items=items).select("itemset", "support")
    rules = splits(rare.select("itemset", "support"), ["support"])
    if max_antecedent:
        rules = rules.where(F.size("antecedents") <= max_antecedent)
    if max_consequent:
        rules = rules.where(F.size("consequents") <= max_consequent)
    out = with_measures(_lookup(rules, frequent, "support", [], True).drop("itemset"), "confidence", min_conf, with_conviction=False)
    return out if min_lift is None else out.where(F.col("lift") >= min_lift)


def high_utility_rules(utilities: DataFrame, min_utility: float = 0.1, absolute: bool = False, min_conf: float = 0.6, min_lift: float | None = None, max_antecedent: int | None = None, max_consequent: int | None = None, max_len: int | None = None, min_utility_conf: float | None = None) -> DataFrame:
    """Rules of high-utility itemsets, with the share of all utility, of the antecedent's utility that lies in rows
    of the rule, and of the rule's utility that is the consequent's."""
    rows = cut(utilities)
    baskets = cut(rows.groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("items")))
    total, whole = baskets.count(), rows.agg(F.sum("utility")).first()[0] or 0.0
    found = I.high_utility_itemsets(rows, min_utility, absolute, 2, max_len)
    rules = cut(splits(found.select("itemset", "support", "utility"), ["support", "utility"]).withColumn("rule", F.monotonically_increasing_id()))
    if max_antecedent:
        rules = rules.where(F.size("antecedents") <= max_antecedent)
    if max_consequent:
        rules = rules.where(F.size("consequents") <= max_consequent)
    parts = rules.select(F.col("antecedents").alias("itemset")).union(rules.select("consequents"))
    counts = cut(I.count_table(baskets, parts).select("itemset", (F.col("count") / F.lit(max(total, 1))).alias("support")))
    known = _lookup(rules, counts, "support", [], True)
    # utilities of antecedent and consequent: in rows with the antecedent, and in rows with the whole rule
    per_row = rows.groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("item", "utility"))).alias("u"))
    worth = lambda of: F.aggregate(F.transform(of, lambda i: F.col("u")[i]), F.lit(0.0), lambda s, x: s + x)
    first = rules.select("rule", F.element_at("antecedents", 1).alias("item"), "antecedents", "consequents")
    hit = rows.select("tid", "item").join(sized(first), "item").join(per_row, "tid").where(F.forall("antecedents", lambda i: F.map_contains_key("u", i)))
    whole_rule = F.forall("consequents", lambda i: F.map_contains_key("u", i))
    sums = hit.groupBy("rule").agg(F.sum(worth("antecedents")).alias("ua"), F.sum(F.when(whole_rule, worth("antecedents"))).alias("ua_rule"), F.sum(F.when(whole_rule, worth("consequents"))).alias("uc_rule"))
    out = with_measures(known.join(sums, "rule"), "confidence", min_conf, with_conviction=False)
    out = out.select("antecedents", "consequents", "antecedent_support", "consequent_support", "support", *MEASURES, "utility", (F.col("utility") / F.lit(whole or 1.0)).alias("utility_share"), quotient(F.col("ua_rule"), F.col("ua")).alias("utility_confidence"), quotient(F.col("uc_rule"), F.col("utility")).alias("consequent_utility_share"))
    if min_lift is not None:
        out = out.where(F.col("lift") >= min_lift)
    return out if min_utility_conf is None else out.where(F.col("utility_confidence") >= min_utility_conf)


NEGATION = I.NEGATION


def negate(item: str) -> str:
    return item[1:] if item.startswith(NEGATION) else NEGATION + item


def is_negated(item: str) -> bool:
    return item.startswith(NEGATION)


def add_absent_items(baskets: DataFrame, negate_items: Sequence[str], items: str = "items") -> DataFrame:
    """Baskets with ``~item`` for each named item that they lack."""
    absent = F.array_except(F.array(*[F.lit(i) for i in negate_items]), F.col(items)) if negate_items else F.array().cast("array<string>")
    return baskets.withColumn(items, F.array_sort(F.concat(items, F.transform(absent, lambda x: F.concat(F.lit(NEGATION), x)))))


def negative_association_rules(baskets: DataFrame, min_supp: float, metric: str = "confidence", min_threshold: float = 0.8, negate_items: Sequence[str] | None = None, only_frequent_positive: bool = True, only_negative: bool = True, items: str = "items", max_len: int | None = None) -> DataFrame:
    """Rules over items and their absence. By default only frequent items are negated.

    Absent items are complements of the miner's vectors: baskets stay as they are. Without
    ``only_frequent_positive`` every name of the table can be absent, and the result holds that many at least.
    """
    clean = cut(baskets.select(F.array_distinct(F.array_compact(F.coalesce(F.col(items), F.array().cast("array<string>")))).alias("items")))
    if negate_items is None:
        if only_frequent_positive:
            singles = I.frequent_itemsets(clean, min_supp, 1).select(F.col("itemset")[0].alias("i"))
        else:
            singles = clean.select(F.explode("items").alias("i")).distinct()
        negate_items = sorted(r["i"] for r in singles.collect())
    forbid = {i: {NEGATION + i} for i in negate_items} | {NEGATION + i: {i} for i in negate_items}
    found = I._counted(I.mine(clean, min_supp, forbid=forbid, max_len=max_len, payload=I.Literals(negate_items)))
    rules = association_rules(found, metric, min_threshold)
    negative = F.exists("antecedents", lambda x: x.startswith(NEGATION)) | F.exists("consequents", lambda x: x.startswith(NEGATION))
    return rules.where(negative) if only_negative else rules


def prune_redundant_rules(rules: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rules without a more general one (smaller antecedent, larger consequent of the same items or more) of the
    same support and confidence."""
    same = rules.select("antecedents", "consequents", "support", "confidence")
    other = same.select(F.col("antecedents").alias("a2"), F.col("consequents").alias("c2"), F.col("support").alias("s2"), F.col("confidence").alias("f2"), F.explode("consequents").alias("item"))
    asked = same.select("antecedents", "consequents", "support", "confidence", F.element_at("consequents", 1).alias("item"))
    near = (F.abs(F.col("support") - F.col("s2")) <= tolerance) & (F.abs(F.col("confidence") - F.col("f2")) <= tolerance)
    inside = (F.size(F.array_except("a2", "antecedents")) == 0) & (F.size(F.array_except("consequents", "c2")) == 0)
    differs = (F.size("a2") < F.size("antecedents")) | (F.size("c2") > F.size("consequents"))
    hit = asked.join(other, "item").where(near & inside & differs).select("antecedents", "consequents").distinct()
    return rules.join(hit, ["antecedents", "consequents"], "left_anti").select(*rules.columns)


def prune_unproductive_rules(rules: DataFrame, min_improvement: float = 0.0, value: str = "confidence") -> DataFrame:
    """Rules that beat every rule of the table with a part of their antecedent and the same consequent."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size("antecedents")).cast("int") - 2)
    long = rules.where(F.size("antecedents") > 1).select("antecedents", "consequents", value, F.explode(masks).alias("mask"))
    part = F.filter("antecedents", lambda x, i: F.col("mask").bitwiseAND(F.pow(F.lit(2.0), i).cast("int")) != 0)
    general = rules.select(F.col("antecedents").alias("part"), "consequents", F.col(value).alias("general"))
    best = long.withColumn("part", part).join(general, ["part", "consequents"]).groupBy("antecedents", "consequents", value).agg(F.max("general").alias("g"))
    bad = best.where(~(F.col(value) - F.col("g") > min_improvement + 1e-12)).select("antecedents", "consequents")
    return rules.join(bad, ["antecedents", "consequents"], "left_anti").select(*rules.columns)


def _masked(baskets: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of ``(tid, items)`` with the rules whose array ``column`` they contain, by the array's first item."""
    first = wanted.withColumn("first", F.element_at(column, 1))
    rows = baskets.select("tid", "items", F.explode("items").alias("first"))
    return rows.join(sized(first), "first").where(F.size(F.array_except(column, "items")) == 0).drop("first")


def _common(rows: DataFrame, rules: DataFrame | None, min_supp: float, min_conf: float) -> DataFrame:
    if rules is None:
        rules = association_rules(I.frequent_itemsets(rows, min_supp), "confidence", min_conf, max_consequent=1)
    one = rules.where(F.size("consequents") == 1)
    return cut(one.select("antecedents", F.col("consequents")[0].alias("consequent"), F.col("support").alias("common_support"), F.col("confidence").alias("common_confidence")).withColumn("rule", F.monotonically_increasing_id()))


def _combinations(frame: DataFrame, items: Column, size: int, name: str, keep: Sequence[str]) -> DataFrame:
    """Rows of ``keep`` with each combination of 1..size of the row's items, as a sorted array ``name``."""
    made = frame.select(*keep, items.alias("pool"), F.posexplode(items).alias("at", "one")).select(*keep, "pool", "at", F.array("one").alias(name))
    out = made
    for _ in range(size - 1):
        made = made.select(*keep, "pool", "at", name, F.posexplode("pool").alias("next", "one")).where("next > at").select(*keep, "pool", F.col("next").alias("at"), F.concat(name, F.array("one")).alias(name))
        out = out.unionByName(made)
    return out.select(*keep, name)


def exception_rules(baskets: DataFrame, min_supp: float = 0.1, min_conf: float = 0.8, min_exception_supp: float = 0.01, min_exception_conf: float = 0.8, max_reference_conf: float = 0.5, max_condition_size: int = 1, rules: DataFrame | None = None) -> DataFrame:
    """Conditions ``Z`` of strong rules ``A -> b`` such that ``A and Z -> not b`` is strong and ``Z -> not b`` is not.

    ``baskets`` has ``tid, items``. Counts of (rule, condition) come from one pass over the baskets that hold
    ``A``; those of (condition, consequent) from one over all baskets, for conditions that are left by then.
    """
    rows = cut(baskets.select("tid", "items"))
    total = rows.count()
    strong = _common(rows, rules, min_supp, min_conf)
    hit = _masked(rows, strong.select("rule", "antecedents", "consequent"), "antecedents")
    rest = F.array_sort(F.array_except("items", F.concat("antecedents", F.array("consequent"))))
    fails = ~F.array_contains("items", F.col("consequent"))
    each = _combinations(hit.withColumn("fails", fails), rest, max_condition_size, "condition", ["rule", "fails"])
    counts = each.groupBy("rule", "condition").agg(F.count(F.lit(1)).alias("n_az"), F.count_if("fails").alias("n_exception"))
    least = max(1, I.min_count(min_exception_supp, max(total, 1)))
    near = cut(counts.where((F.col("n_exception") >= least) & (F.col("n_exception") / F.col("n_az") >= min_exception_conf)).join(strong, "rule"))
    asked = near.select("condition", "consequent").distinct()
    seen = _masked(rows, asked, "condition").groupBy("condition", "consequent").agg(F.count(F.lit(1)).alias("n_z"), F.count_if(fails).alias("n_z_fails"))
    out = near.join(seen, ["condition", "consequent"]).where(F.col("n_z_fails") / F.col("n_z") <= max_reference_conf)
    return out.select("antecedents", "consequent", "condition", "common_support", "common_confidence", (F.col("n_exception") / total).alias("exception_support"), (F.col("n_exception") / F.col("n_az")).alias("exception_confidence"), (F.col("n_z_fails") / F.col("n_z")).alias("reference_confidence"))


def anomalous_rules(baskets: DataFrame, min_supp: float = 0.1, min_conf: float = 0.8, min_anomalous_supp: float = 0.01, min_anomalous_conf: float = 0.8, max_reference_conf: float = 0.5, max_anomaly_size: int = 1, rules: DataFrame | None = None) -> DataFrame:
    """Item sets ``C`` of strong rules ``A -> b`` such that ``A and not b -> C`` is strong and ``A -> C`` is not."""
    rows = cut(baskets.select("tid", "items"))
    total = rows.count()
    strong = _common(rows, rules, min_supp, min_conf)
    hit = _masked(rows, strong.select("rule", "antecedents", "consequent"), "antecedents").withColumn("fails", ~F.array_contains("items", F.col("consequent")))
    sizes = hit.groupBy("rule").agg(F.count(F.lit(1)).alias("n_a"), F.count_if("fails").alias("n_fails"))
    rest = F.array_sort(F.array_except("items", F.concat("antecedents", F.array("consequent"))))
    each = _combinations(hit, rest, max_anomaly_size, "anomaly", ["rule", "fails"])
    counts = each.groupBy("rule", "anomaly").agg(F.count(F.lit(1)).alias("n_ac"), F.count_if("fails").alias("n_anomaly"))
    least = max(1, I.min_count(min_anomalous_supp, max(total, 1)))
    out = counts.join(sizes, "rule").where((F.col("n_anomaly") >= least) & (F.col("n_anomaly") / F.col("n_fails") >= min_anomalous_conf) & (F.col("n_ac") / F.col("n_a") <= max_reference_conf)).join(strong, "rule")
    return out.select("antecedents", "consequent", "anomaly", "common_support", "common_confidence", F.col("n_fails").alias("anomalous_cases"), (F.col("n_anomaly") / total).alias("anomalous_support"), (F.col("n_anomaly") / F.col("n_fails")).alias("anomalous_confidence"), (F.col("n_ac") / F.col("n_a")).alias("reference_confidence"))


# -- rules of rule sets ----------------------------------------------------------------------------


def rule_key() -> Column:
    """``a,b=>c`` with sorted names on both sides."""
    side = lambda c: F.array_join(F.array_sort(F.col(c)), ",")
    return F.concat(side("antecedents"), F.lit("=>"), side("consequents"))


def primary_rules(baskets: DataFrame, dataset: str, min_supp: float, metric: str = "confidence", min_threshold: float = 0.8, items: str = "items", max_len: int | None = None) -> DataFrame:
    """``(dataset, antecedents, consequents, measures...)`` of every data set, mined side by side."""
    found = I.frequent_itemsets(baskets, min_supp, max_len, items, dataset)
    return association_rules(found, metric, min_threshold, keys=[dataset])


def meta_database(rules: DataFrame, dataset: str, measure_name: str | None = None, normalise: bool = False) -> DataFrame:
    """One transaction per data set whose items are its rules; with a measure, its values are the degrees."""
    rows = rules.select(dataset, rule_key().alias("rule"), *([F.col(measure_name).alias("degree")] if measure_name else []))
    if measure_name and normalise:
        top = rows.groupBy("rule").agg(F.max("degree").alias("top"))
        rows = rows.join(top, "rule").withColumn("degree", quotient(F.col("degree"), F.col("top")))
    if not measure_name:
        return rows.groupBy(dataset).agg(F.array_sort(F.collect_set("rule")).alias("items"))
    pairs = rows.groupBy(dataset, "rule").agg(F.max(F.least(F.greatest("degree", F.lit(0.0)), F.lit(1.0))).alias("degree"))
    s = pairs.groupBy(dataset).agg(F.sort_array(F.collect_list(F.struct("rule", "degree"))).alias("s"))
    return s.select(dataset, F.col("s.rule").alias("items"), F.col("s.degree").alias("degrees"))


def crisp_meta_rules(rules: DataFrame, dataset: str, min_supp: float, metric: str = "confidence", min_threshold: float = 0.8, datasets: DataFrame | None = None) -> DataFrame:
    """Rules between rules over data sets; ``datasets`` names those that may have none."""
    rows = meta_database(rules, dataset)
    if datasets is not None:
        rows = datasets.select(dataset).distinct().join(rows, dataset, "left")
    return association_rules(I.frequent_itemsets(rows, min_supp), metric, min_threshold)


def fuzzy_meta_rules(rules: DataFrame, dataset: str, min_supp: float, measure_name: str = "confidence", normalise: bool = False, num_alpha: int = 10, metric: str = "FConf", min_threshold: float = 0.8) -> DataFrame:
    from .fuzzy import fuzzy_itemsets

    return fuzzy_association_rules(fuzzy_itemsets(meta_database(rules, dataset, measure_name, normalise), min_supp, num_alpha), metric, min_threshold)
