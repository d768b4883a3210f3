from itertools import combinations
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions import measures
from basketry.operators import fuzzy, itemsets, rules, significance

TEN = [list(b) for b in "ABC BD ACD BC AC BD ABC BCD ABD BCD".split()]


def frame(spark, baskets):
    return spark.createDataFrame([(k, b) for k, b in enumerate(baskets)], "tid bigint, items array<string>")


def table(found, value="support"):
    return {"".join(r["itemset"]): r[value] for r in found.collect()}


def brute(baskets, share):
    sets = [set(b or []) for b in baskets]
    items = sorted(set().union(*sets))
    least = max(1, math.ceil(share * len(sets) - 1e-9))
    out = {}
    for n in range(1, len(items) + 1):
        for c in combinations(items, n):
            k = sum(s.issuperset(c) for s in sets)
            if k >= least:
                out["".join(c)] = k
    return out


def random_baskets(seed, n=60, items="abcdefg"):
    rng = np.random.default_rng(seed)
    return [[i for i in items if rng.random() < 0.1 + 0.5 * rng.random()] for _ in range(n)]


def test_worked_example(spark):
    want = {"A": 0.5, "B": 0.8, "C": 0.7, "D": 0.6, "AB": 0.3, "AC": 0.4, "BC": 0.5, "BD": 0.5, "CD": 0.3}
    found = itemsets.frequent_itemsets(frame(spark, TEN), 0.3)
    assert table(found) == want and table(itemsets.fpgrowth(frame(spark, TEN), 0.3)) == want
    got = {("".join(r["antecedents"]), "".join(r["consequents"])) for r in rules.association_rules(found, "confidence", 0.7).collect()}
    assert got == {("A", "C"), ("C", "B"), ("D", "B")}


@pytest.mark.parametrize("seed", range(3))
def test_miners_agree_with_brute_force(spark, seed):
    baskets = random_baskets(seed) + [[], None, ["a", "a", "b"]]
    f = frame(spark, baskets)
    for share in (0.07, 0.2):
        want = brute(baskets, share)
        assert table(itemsets.frequent_itemsets(f, share), "count") == want
        # many small chunks: candidates come from parts, counts from all
        assert {"".join(r["itemset"]): int(r["sums"][0]) for r in itemsets.mine(f.withColumn("items", F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))), share, chunk=16).collect()} == want
        assert table(itemsets.fpgrowth(f, share), "count") == want
        long = f.select("tid", F.explode("items").alias("item"))
        assert table(itemsets.apriori(long, share, len(baskets)), "count") == want
        assert table(itemsets.eclat(long, share, len(baskets)), "count") == want


def test_groups_are_mined_side_by_side(spark):
    parts = {"x": random_baskets(1, 40), "y": random_baskets(2, 25)}
    f = spark.createDataFrame([(g, b) for g, bs in parts.items() for b in bs], "g string, items array<string>")
    got = {}
    for r in itemsets.frequent_itemsets(f, 0.3, group="g").collect():
        got.setdefault(r["g"], {})["".join(r["itemset"])] = r["count"]
    assert got == {g: brute(bs, 0.3) for g, bs in parts.items()}


def test_empty(spark):
    f = frame(spark, [])
    assert itemsets.frequent_itemsets(f, 0.5).collect() == [] and itemsets.fpgrowth(f, 0.5).collect() == []
    assert itemsets.frequent_itemsets(frame(spark, [[], None]), 0.5).collect() == []


def test_condensed(spark):
    found = itemsets.frequent_itemsets(frame(spark, [list("abc")] * 3 + [["a", "b"], ["d"]]), 0.2)
    closed = itemsets.closed_itemsets(found)
    assert table(closed) == {"ab": 0.8, "abc": 0.6, "d": 0.2}
    assert set(table(itemsets.maximal_itemsets(found))) == {"abc", "d"}
    assert table(itemsets.support_from_closed(found, closed)) == table(found)


def test_rare(spark):
    f = frame(spark, [["a", "b"]] * 4 + [["a", "c"]] * 3 + [["b", "c"]] * 3 + [["a", "b", "c"], ["d"]])
    assert set(table(itemsets.minimal_rare_itemsets(f, 0.3))) == {"abc", "d"}
    assert set(table(itemsets.minimal_rare_itemsets(f, 0.3, min_len=2))) == {"abc"}
    assert itemsets.minimal_rare_itemsets(f, 0.3, least=2).collect() == []


def test_top_k(spark):
    baskets = random_baskets(5)
    every = sorted(brute(baskets, 1e-9).items(), key=lambda kv: (-kv[1], len(kv[0]), kv[0]))
    got = [("".join(r["itemset"]), r["count"]) for r in itemsets.top_k_itemsets(frame(spark, baskets), 9).collect()]
    assert got == every[:9]
    lazy = itemsets.iter_itemsets_by_support(frame(spark, baskets))
    assert ["".join(next(lazy)["itemset"]) for _ in range(5)] == [k for k, _ in every[:5]]


def test_utility(spark):
    from basketry.sources.datasets import load_dataset

    sales = load_dataset(spark, "sales")
    u = itemsets.utility_table(sales, sales.select("item", "profit").distinct())
    assert u.agg(F.sum("utility")).first()[0] == 94
    got = table(itemsets.high_utility_itemsets(u, 28, absolute=True), "utility")
    rows = {}
    for r in u.collect():
        rows.setdefault(r["tid"], {})[r["item"]] = r["utility"]
    want = {}
    for n in range(1, 8):
        for c in combinations("abcdefg", n):
            v = sum(sum(t[i] for i in c) for t in rows.values() if all(i in t for i in c))
            if v >= 28:
                want["".join(c)] = v
    assert got == want and got["bd"] == 30 and got["bcdf"] == 40
    with pytest.raises(Exception, match="no profit"):
        itemsets.utility_table(sales, spark.createDataFrame([("a", 1.0)], "item string, profit double")).collect()


def test_measures(spark):
    row = spark.createDataFrame([(0.4, 0.5, 0.7), (0.0, 0.0, 0.0)], "ab double, a double, b double")
    got = row.select(*[f(F.col("ab"), F.col("a"), F.col("b")).alias(n) for n, f in measures.MEASURES.items()]).collect()
    want = {"confidence": 0.8, "lift": 0.8 / 0.7, "leverage": 0.05, "jaccard": 0.5, "all_confidence": 0.4 / 0.7, "added_value": 0.1, "zhangs_metric": 0.25, "yules_q": (0.08 - 0.03) / (0.08 + 0.03)}
    for n, v in want.items():
        assert got[0][n] == pytest.approx(v)
    assert all(v == 0 for v in got[1])


def test_missing_subset_is_an_error(spark):
    found = spark.createDataFrame([(["a", "b"], 0.5)], "itemset array<string>, support double")
    with pytest.raises(Exception, match="no support of"):
        rules.association_rules(found).collect()
    assert rules.association_rules(found, "support", 0.1, support_only=True).count() == 2


def test_negative(spark):
    f = frame(spark, [["A", "B"]] * 3 + [["C"], ["B", "C"], ["A"]])
    got = {("".join(r["antecedents"]), "".join(r["consequents"])) for r in rules.negative_association_rules(f, 0.3, min_threshold=0.8).collect()}
    assert ("A", "~C") in got and all(not {i, "~" + i} <= set(a) | set(c) for a, c in got for i in "ABC")


def test_exceptions(spark):
    f = frame(spark, [["fever", "rest"]] * 60 + [["fever", "must_work"]] * 5 + [["must_work", "rest"]] * 35 + [["fever", "denied"]] * 5)
    r = [x for x in rules.exception_rules(f, min_supp=0.3, min_conf=0.8).collect() if x["condition"] == ["must_work"]]
    assert len(r) == 1 and r[0]["exception_support"] == pytest.approx(5 / 105) and r[0]["exception_confidence"] == 1 and r[0]["reference_confidence"] == pytest.approx(5 / 40) and r[0]["common_confidence"] == pytest.approx(60 / 70)
    g = frame(spark, [["fever", "rest"]] * 60 + [["fever", "hospital"]] * 10 + [["rest"]] * 30)
    a = rules.anomalous_rules(g, min_supp=0.3, min_conf=0.8).collect()
    assert [(x["antecedents"], x["consequent"], x["anomaly"]) for x in a] == [(["fever"], "rest", ["hospital"])]


def test_fuzzy_worked_example(spark):
    rows = {"i1": [1, 1, 0.4, 0.6, 0.4, 0], "i2": [0.2, 1, 0.1, 0, 0.1, 1], "i3": [1, 0.8, 0.7, 0.4, 0, 0], "i4": [0.8, 0, 0.6, 0.4, 0, 0], "i5": [0.9, 0, 0, 0.5, 0, 0]}
    data = [([i for i in rows], [float(rows[i][t]) for i in rows]) for t in range(6)]
    f = spark.createDataFrame(data, "items array<string>, degrees array<double>")
    found = fuzzy.fuzzy_itemsets(f, 0.1, 5)
    r = rules.fuzzy_association_rules(found, "FConf", 0.0).where((F.col("antecedents") == F.array(F.lit("i1"), F.lit("i3"))) & (F.col("consequents") == F.array(F.lit("i4")))).collect()
    assert len(r) == 1 and r[0]["FSupp"] == pytest.approx(0.2667, abs=1e-4) and r[0]["FConf"] == pytest.approx(0.5) and r[0]["FCF"] == pytest.approx(0.33, abs=0.01)


def test_crisp_equals_fuzzy_at_one(spark):
    baskets = random_baskets(9)
    f = frame(spark, baskets).withColumn("degrees", F.transform("items", lambda x: F.lit(1.0)))
    got = {k: round(v * len(baskets)) for k, v in table(fuzzy.fuzzy_itemsets(f, 0.2, 4)).items()}
    assert got == brute(baskets, 0.2)


def test_significance(spark):
    assert significance.fisher_tail(3, 4, 4, 8, "greater") == pytest.approx(17 / 70)
    assert significance.fisher_tail(3, 4, 4, 8, "less") == pytest.approx(69 / 70)
    assert significance.fisher_tail(3, 4, 4, 8, "two-sided") == pytest.approx(34 / 70)
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,)], "p_value double")
    want = {"bonferroni": [0.04, 0.16, 0.12, 0.02], "holm": [0.03, 0.06, 0.06, 0.02], "fdr_bh": [0.02, 0.04, 0.04, 0.02], "fdr_by": [x * 25 / 12 for x in (0.02, 0.04, 0.04, 0.02)]}
    for method, values in want.items():
        got = {r["p_value"]: r["p_adjusted"] for r in significance.adjust_pvalues(p, method).collect()}
        assert [got[x] for x in (0.01, 0.04, 0.03, 0.005)] == pytest.approx(values)
    r = spark.createDataFrame([(0.4, 0.5, 0.6)], "support double, antecedent_support double, consequent_support double")
    ci = significance.confidence_intervals(r, 20).first()
    assert ci["confidence_low"] == pytest.approx(0.4902, abs=1e-4) and ci["confidence_high"] == pytest.approx(0.9433, abs=1e-4)


def test_shuffles_keep_frequencies(spark):
    rows = spark.createDataFrame([(k, [i for i in "ab" if (k + ord(i)) % 3]) for k in range(100)], "pos bigint, items array<string>")
    for null in ("shift", "permute"):
        got = significance.shuffled_items(rows, null=null, n=3).select("perm", F.explode("items").alias("i")).groupBy("perm", "i").count().collect()
        want = {i: sum(i in r["items"] for r in rows.collect()) for i in "ab"}
        assert {(r["perm"], r["i"]): r["count"] for r in got} == {(p, i): want[i] for p in range(3) for i in "ab"}


def test_pruning(spark):
    schema = "antecedents array<string>, consequents array<string>, support double, confidence double"
    r = spark.createDataFrame([(["a"], ["c"], 0.5, 0.8), (["a", "b"], ["c"], 0.5, 0.8), (["a", "d"], ["c"], 0.3, 0.9)], schema)
    assert sorted(tuple(x["antecedents"]) for x in rules.prune_redundant_rules(r).collect()) == [("a",), ("a", "d")]
    assert sorted(tuple(x["antecedents"]) for x in rules.prune_unproductive_rules(r, 0.05).collect()) == [("a",), ("a", "d")]
    assert sorted(tuple(x["antecedents"]) for x in rules.prune_unproductive_rules(r, 0.1).collect()) == [("a",)]
