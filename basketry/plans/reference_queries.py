"""Queries of the pattern and rule operators over the star-schema tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import membership as M
from ..functions.measures import RULE_COLUMNS
from ..operators import action, classify, fuzzy, gradual, itemsets, quantitative, rules, sequences, series, significance, taxonomy, temporal
from ..operators.graph import RuleGraph
from ..operators.order import number_rows
from ..session import cut
from ..streaming.windows import BatchWindow
from .transaction_queries import SPLITS_SQL, levels_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SUPP = 0.2
LOW = 0.08


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(frame: DataFrame, *arrays: str) -> DataFrame:
    return frame.withColumns({a: F.array_join(a, "|") for a in arrays})


def _round(frame: DataFrame, *keep: str) -> DataFrame:
    return frame.select(*[F.round(c, 6).alias(c) if k == "double" and c not in keep else F.col(c) for c, k in frame.dtypes])


# -- base relations --------------------------------------------------------------------------------


def basket_rows(spark, d) -> DataFrame:
    """Distinct ``(tid, item)``: product types of orders."""
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = _t(spark, d, "part").select("p_partkey", "p_type")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), F.col("p_type").alias("item")).distinct()


def baskets(spark, d) -> DataFrame:
    return itemsets.to_baskets(basket_rows(spark, d))


def found(spark, d, share=LOW, max_len=3) -> DataFrame:
    return itemsets.frequent_itemsets(baskets(spark, d), share, max_len)


def event_sequences(spark, d) -> DataFrame:
    e = _t(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("sid"), "ts", "event_type")
    return sequences.sequences_from_events(e, "sid", "ts", "event_type")


def hourly(spark, d) -> DataFrame:
    """``(pos, ts, items)``: event types of at least the hour's mean count per type."""
    e = _t(spark, d, "events").where("event_type is not null").select(F.date_trunc("hour", "ts").alias("ts"), "event_type")
    n = e.groupBy("ts", "event_type").agg(F.count(F.lit(1)).alias("n"))
    level = n.groupBy("event_type").agg(F.avg("n").alias("m"))
    high = n.join(F.broadcast(level), "event_type").select("ts", F.when(F.col("n") >= F.col("m"), F.col("event_type")).alias("item"))
    return number_rows(high.groupBy("ts").agg(F.array_sort(F.collect_set("item")).alias("items")), ["ts"]).select("pos", "ts", "items")


B = """b AS (SELECT DISTINCT l_orderkey AS tid, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT tid) AS n FROM b)"""


def FI(share: float, size: int = 3) -> str:
    """SQL of frequent itemsets of 1..3 items: fi(itemset list, k, s)."""
    parts = [f"SELECT [item] AS itemset, count(*) AS k FROM b GROUP BY item HAVING count(*) >= ceil({share} * (SELECT n FROM n) - 1e-9)"]
    if size > 1:
        parts.append(f"SELECT [x.item, y.item], count(*) FROM b x JOIN b y ON x.tid = y.tid AND x.item < y.item GROUP BY x.item, y.item HAVING count(*) >= ceil({share} * (SELECT n FROM n) - 1e-9)")
    if size > 2:
        parts.append(f"SELECT [x.item, y.item, z.item], count(*) FROM b x JOIN b y ON x.tid = y.tid AND x.item < y.item JOIN b z ON z.tid = y.tid AND y.item < z.item GROUP BY x.item, y.item, z.item HAVING count(*) >= ceil({share} * (SELECT n FROM n) - 1e-9)")
    return f"{B}, fi AS (SELECT itemset, k, k / (SELECT n FROM n)::DOUBLE AS s FROM ({' UNION ALL '.join(parts)}))"


def RULES(share: float, size: int = 3) -> str:
    """SQL of all splits: r(a list, c list, sab, sa, sb) and their measures m."""
    return FI(share, size) + """, split AS (
       SELECT itemset, s, list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS a, list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS c
       FROM (SELECT itemset, s, unnest(range(1, (2 ** len(itemset))::BIGINT - 1)) AS mask FROM fi WHERE len(itemset) > 1)),
     r AS (SELECT split.a, split.c, split.s AS sab, x.s AS sa, y.s AS sb FROM split JOIN fi x ON x.itemset = split.a JOIN fi y ON y.itemset = split.c),
     m AS (SELECT array_to_string(a, '|') AS antecedents, array_to_string(c, '|') AS consequents, sa AS antecedent_support, sb AS consequent_support, sab AS support,
       sab / sa AS confidence, sab / sa / sb AS lift, sab - sa * sb AS leverage, CASE WHEN sab / sa >= 1 THEN NULL ELSE (1 - sb) / (1 - sab / sa) END AS conviction,
       CASE WHEN sab / sa > sb THEN (sab / sa - sb) / (1 - sb) WHEN sab / sa < sb THEN (sab / sa - sb) / sb ELSE 0 END AS certainty_factor,
       sab / (sa + sb - sab) AS jaccard, sab / sqrt(sa * sb) AS cosine, (sab / sa + sab / sb) / 2 AS kulczynski, sab / greatest(sa, sb) AS all_confidence, greatest(sab / sa, sab / sb) AS max_confidence,
       sab / sa - sb AS added_value, CASE WHEN greatest(sab * (1 - sa), sb * (sa - sab)) = 0 THEN 0 ELSE (sab - sa * sb) / greatest(sab * (1 - sa), sb * (sa - sab)) END AS zhangs_metric,
       CASE WHEN sab * (1 - sa - sb + sab) + (sa - sab) * (sb - sab) = 0 THEN 0 ELSE (sab * (1 - sa - sb + sab) - (sa - sab) * (sb - sab)) / (sab * (1 - sa - sb + sab) + (sa - sab) * (sb - sab)) END AS yules_q FROM r)"""


_MEASURE_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in RULE_COLUMNS)
_FI_SQL = "SELECT array_to_string(itemset, '|') AS itemset, len(itemset)::INT AS size, k AS count, round(s, 6) AS support FROM fi"


def _fi_out(frame):
    return _round(_text(frame.select("itemset", "size", "count", "support"), "itemset"))


# -- itemsets --------------------------------------------------------------------------------------


@query(f"WITH {FI(LOW)} {_FI_SQL}")
def frequent_itemsets(spark, d):
    return _fi_out(found(spark, d))


@query(f"WITH {FI(SUPP)} {_FI_SQL}")
def fpgrowth(spark, d):
    return _fi_out(itemsets.fpgrowth(baskets(spark, d), SUPP))


@query(f"WITH {FI(LOW, 2)} {_FI_SQL}")
def dense_itemsets_maxlen2(spark, d):
    return _fi_out(itemsets.frequent_itemsets(baskets(spark, d), LOW, 2))


@query(f"WITH {FI(LOW)} {_FI_SQL}")
def apriori_tid(spark, d):
    long = cut(basket_rows(spark, d))
    return _fi_out(itemsets.apriori(long, LOW, long.select("tid").distinct().count(), max_len=3))


@query(f"WITH {FI(SUPP)} {_FI_SQL}")
def eclat(spark, d):
    long = cut(basket_rows(spark, d))
    return _fi_out(itemsets.eclat(long, SUPP, long.select("tid").distinct().count()))


@query(f"WITH {FI(LOW)} {_FI_SQL} x WHERE NOT EXISTS (SELECT 1 FROM fi y WHERE len(y.itemset) = len(x.itemset) + 1 AND list_has_all(y.itemset, x.itemset) AND y.k = x.k)")
def closed_itemsets(spark, d):
    return _fi_out(itemsets.closed_itemsets(cut(found(spark, d))))


@query(f"WITH {FI(LOW)} {_FI_SQL} x WHERE NOT EXISTS (SELECT 1 FROM fi y WHERE len(y.itemset) = len(x.itemset) + 1 AND list_has_all(y.itemset, x.itemset))")
def maximal_itemsets(spark, d):
    return _fi_out(itemsets.maximal_itemsets(cut(found(spark, d))))


@query(f"WITH {FI(LOW)} SELECT array_to_string(itemset, '|') AS itemset, round(s, 6) AS support FROM fi")
def support_from_closed(spark, d):
    f = cut(found(spark, d))
    return _round(_text(itemsets.support_from_closed(f, itemsets.closed_itemsets(f)), "itemset"))


@query(f"WITH {FI(0.0001)} {_FI_SQL} ORDER BY k DESC, len(itemset), itemset LIMIT 12")
def top_k_itemsets(spark, d):
    return _fi_out(itemsets.top_k_itemsets(baskets(spark, d), 12, max_len=3))


_RARE = f"""WITH {FI(0.0001)}, t AS (SELECT ceil(0.22 * n - 1e-9) AS t FROM n),
  rare AS (SELECT x.* FROM fi x, t WHERE x.k < t.t AND NOT EXISTS (SELECT 1 FROM fi y, t u WHERE len(y.itemset) = len(x.itemset) - 1 AND list_has_all(x.itemset, y.itemset) AND y.k < u.t))"""


@query(f"{_RARE} SELECT array_to_string(itemset, '|') AS itemset, len(itemset)::INT AS size, k AS count, round(s, 6) AS support FROM rare")
def minimal_rare_itemsets(spark, d):
    return _fi_out(itemsets.minimal_rare_itemsets(baskets(spark, d), 0.22, max_len=3))


def utilities(spark, d):
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = _t(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    profit = part.groupBy(F.col("p_type").alias("item")).agg(F.round(F.avg("p_retailprice"), 0).alias("profit"))
    q = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("tid"), F.col("p_type").alias("item")).agg(F.sum("l_quantity").alias("qty"))
    return cut(itemsets.utility_table(q, profit))


_U = """u AS (SELECT tid, item, qty * profit AS u FROM (SELECT l_orderkey AS tid, p_type AS item, sum(l_quantity)::DOUBLE AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
   JOIN (SELECT p_type AS item, round(avg(p_retailprice), 0) AS profit FROM part GROUP BY p_type) USING (item)), w AS (SELECT sum(u) AS w, count(DISTINCT tid) AS n FROM u),
   h AS (SELECT [item] AS itemset, sum(u) AS utility, count(*) AS k FROM u GROUP BY item UNION ALL
     SELECT [x.item, y.item], sum(x.u + y.u), count(*) FROM u x JOIN u y ON x.tid = y.tid AND x.item < y.item GROUP BY x.item, y.item UNION ALL
     SELECT [x.item, y.item, z.item], sum(x.u + y.u + z.u), count(*) FROM u x JOIN u y ON x.tid = y.tid AND x.item < y.item JOIN u z ON y.tid = z.tid AND y.item < z.item GROUP BY x.item, y.item, z.item)"""


@query(f"WITH {_U} SELECT array_to_string(itemset, '|') AS itemset, len(itemset)::INT AS size, round(utility, 2) AS utility, k AS count, round(k / (SELECT n FROM w), 6) AS support FROM h WHERE utility >= 0.15 * (SELECT w FROM w)")
def high_utility_itemsets(spark, d):
    out = itemsets.high_utility_itemsets(utilities(spark, d), 0.15, max_len=3)
    return _text(out.select("itemset", "size", F.round("utility", 2).alias("utility"), "count", F.round("support", 6).alias("support")), "itemset")


@query(f"""WITH {_U}, p AS (SELECT itemset, utility, k FROM h WHERE len(itemset) = 2 AND utility >= 0.15 * (SELECT w FROM w)),
  r AS (SELECT itemset[1] AS a, itemset[2] AS c, utility, k FROM p UNION ALL SELECT itemset[2], itemset[1], utility, k FROM p),
  one AS (SELECT item, count(*) AS k, sum(u) AS u FROM u GROUP BY item),
  part AS (SELECT r.a, r.c, sum(x.u) AS ua, sum(y.u) AS uc FROM r JOIN u x ON x.item = r.a JOIN u y ON y.item = r.c AND y.tid = x.tid GROUP BY r.a, r.c)
  SELECT r.a AS antecedents, r.c AS consequents, round(r.k / (SELECT n FROM w), 6) AS support, round(r.k / one.k, 6) AS confidence, round(utility, 2) AS utility, round(utility / (SELECT w FROM w), 6) AS utility_share,
    round(ua / one.u, 6) AS utility_confidence, round(uc / utility, 6) AS consequent_utility_share FROM r JOIN one ON one.item = r.a JOIN part ON part.a = r.a AND part.c = r.c WHERE r.k / one.k >= 0.4""")
def high_utility_rules(spark, d):
    out = rules.high_utility_rules(utilities(spark, d), 0.15, min_conf=0.4, max_len=2)
    out = out.select("antecedents", "consequents", F.round("support", 6).alias("support"), F.round("confidence", 6).alias("confidence"), F.round("utility", 2).alias("utility"), *[F.round(c, 6).alias(c) for c in ("utility_share", "utility_confidence", "consequent_utility_share")])
    return _text(out, "antecedents", "consequents")


# -- rules -----------------------------------------------------------------------------------------


def _rules_out(frame, *extra):
    names = [c for c in RULE_COLUMNS if c in frame.columns]
    return _text(frame.select("antecedents", "consequents", *[F.round(c, 6).alias(c) for c in names], *extra), "antecedents", "consequents")


@query(f"WITH {RULES(LOW)} SELECT antecedents, consequents, {_MEASURE_SQL} FROM m WHERE confidence >= 0.4")
def association_rules(spark, d):
    return _rules_out(rules.association_rules(found(spark, d), "confidence", 0.4))


@query(f"WITH {RULES(LOW)} SELECT antecedents, consequents, {_MEASURE_SQL} FROM m WHERE lift >= 1.0")
def rules_lift_filter(spark, d):
    return _rules_out(rules.association_rules(found(spark, d), "lift", 1.0))


@query(f"WITH {RULES(LOW)} SELECT antecedents, consequents, {_MEASURE_SQL} FROM m WHERE zhangs_metric >= 0")
def rules_zhang_filter(spark, d):
    return _rules_out(rules.association_rules(found(spark, d), "zhangs_metric", 0.0))


@query(f"WITH {RULES(LOW)} SELECT antecedents, consequents, round(support, 6) AS support FROM m WHERE support >= 0.1")
def rules_support_only(spark, d):
    return _rules_out(rules.association_rules(found(spark, d), "support", 0.1, support_only=True).select("antecedents", "consequents", "support"))


@query(f"WITH {RULES(LOW)} SELECT antecedents, consequents, round(confidence, 6) AS confidence FROM m WHERE confidence >= 0.45")
def generate_rules(spark, d):
    return _rules_out(rules.generate_rules(found(spark, d), 0.45))


@query(f"WITH {FI(LOW)} SELECT sum((2 ** len(itemset))::BIGINT - 2)::BIGINT AS candidates FROM fi WHERE len(itemset) > 1")
def candidate_count(spark, d):
    return spark.createDataFrame([(rules.candidate_rule_count(found(spark, d)),)], "candidates bigint")


@query(f"WITH {RULES(0.0001, 2)} SELECT antecedents, consequents, {_MEASURE_SQL} FROM m WHERE confidence >= 0.4 ORDER BY support DESC, confidence DESC, antecedents, consequents LIMIT 7")
def top_k_rules(spark, d):
    return _rules_out(rules.top_k_rules(baskets(spark, d), 7, 0.4, max_len=2))


@query(f"""{_RARE}, split AS (SELECT k, list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS a, list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS c
   FROM (SELECT itemset, k, unnest(range(1, (2 ** len(itemset))::BIGINT - 1)) AS mask FROM rare WHERE len(itemset) > 1))
   SELECT array_to_string(a, '|') AS antecedents, array_to_string(c, '|') AS consequents, round(split.k / (SELECT n FROM n), 6) AS support, round(split.k / x.k, 6) AS confidence, round(split.k / x.k / y.s, 6) AS lift
   FROM split JOIN fi x ON x.itemset = a JOIN fi y ON y.itemset = c WHERE split.k / x.k >= 0.3""")
def rare_rules(spark, d):
    out = rules.rare_rules(baskets(spark, d), 0.22, min_conf=0.3, max_antecedent=2, max_consequent=2)
    return _rules_out(out.select("antecedents", "consequents", "support", "confidence", "lift"))


@query(f"""WITH {B}, i AS (SELECT DISTINCT item FROM b), one AS (SELECT item, count(*) AS k FROM b GROUP BY item), pair AS (SELECT x.item AS p, y.item AS q, count(*) AS k FROM b x JOIN b y ON x.tid = y.tid AND x.item <> y.item GROUP BY ALL),
   s AS (SELECT p AS x, '~' || q AS y, a.k - pair.k AS k, a.k AS kx, (SELECT n FROM n) - b2.k AS ky FROM pair JOIN one a ON a.item = p JOIN one b2 ON b2.item = q
     UNION ALL SELECT '~' || q, p, a.k - pair.k, (SELECT n FROM n) - b2.k, a.k FROM pair JOIN one a ON a.item = p JOIN one b2 ON b2.item = q
     UNION ALL SELECT '~' || p, '~' || q, (SELECT n FROM n) - a.k - b2.k + pair.k, (SELECT n FROM n) - a.k, (SELECT n FROM n) - b2.k FROM pair JOIN one a ON a.item = p JOIN one b2 ON b2.item = q)
   SELECT x AS antecedents, y AS consequents, round(k / (SELECT n FROM n), 6) AS support, round(k / kx, 6) AS confidence FROM s WHERE k >= ceil(0.2 * (SELECT n FROM n) - 1e-9) AND k / kx >= 0.45""")
def negative_rules(spark, d):
    return _rules_out(rules.negative_association_rules(baskets(spark, d), 0.2, min_threshold=0.45, max_len=2).select("antecedents", "consequents", "support", "confidence"))


_COMMON = f"""WITH {RULES(0.08)}, common AS (SELECT a, c[1] AS cons, sab, sab / sa AS conf FROM r WHERE len(c) = 1 AND sab / sa >= 0.45), tb AS (SELECT tid, list(item) AS items FROM b GROUP BY tid)"""


@query(f"""{_COMMON}, hit AS (SELECT a, cons, sab, conf, tid, list_contains(items, cons) AS kept FROM common JOIN tb ON list_has_all(items, a)),
   az AS (SELECT a, cons, sab, conf, item AS z, count(*) AS n_az, count(*) FILTER (NOT kept) AS n_ex FROM hit JOIN b USING (tid) WHERE item <> cons AND NOT list_contains(a, item) GROUP BY ALL),
   z AS (SELECT item AS z, cons, count(*) AS n_z, count(*) FILTER (NOT list_contains(items, cons)) AS n_zf FROM b JOIN tb USING (tid), (SELECT DISTINCT cons FROM common) GROUP BY ALL)
   SELECT array_to_string(a, '|') AS antecedents, cons AS consequent, z AS condition, round(sab, 6) AS common_support, round(conf, 6) AS common_confidence, round(n_ex / (SELECT n FROM n), 6) AS exception_support,
     round(n_ex / n_az, 6) AS exception_confidence, round(n_zf / n_z, 6) AS reference_confidence FROM az JOIN z USING (z, cons) WHERE n_ex >= ceil(0.01 * (SELECT n FROM n) - 1e-9) AND n_ex / n_az >= 0.5 AND n_zf / n_z <= 0.52""")
def exception_rules(spark, d):
    b = baskets(spark, d)
    common = rules.association_rules(itemsets.frequent_itemsets(b, 0.08, 3), "confidence", 0.45, max_consequent=1)
    return _round(_text(rules.exception_rules(b, min_exception_conf=0.5, max_reference_conf=0.52, rules=common), "antecedents", "condition"))


@query(f"""{_COMMON}, hit AS (SELECT a, cons, sab, conf, tid, list_contains(items, cons) AS kept FROM common JOIN tb ON list_has_all(items, a)),
   sz AS (SELECT a, cons, count(*) AS n_a, count(*) FILTER (NOT kept) AS n_f FROM hit GROUP BY ALL),
   ac AS (SELECT a, cons, sab, conf, item AS e, count(*) AS n_ac, count(*) FILTER (NOT kept) AS n_an FROM hit JOIN b USING (tid) WHERE item <> cons AND NOT list_contains(a, item) GROUP BY ALL)
   SELECT array_to_string(a, '|') AS antecedents, cons AS consequent, e AS anomaly, round(sab, 6) AS common_support, round(conf, 6) AS common_confidence, n_f AS anomalous_cases, round(n_an / (SELECT n FROM n), 6) AS anomalous_support,
     round(n_an / n_f, 6) AS anomalous_confidence, round(n_ac / n_a, 6) AS reference_confidence FROM ac JOIN sz USING (a, cons) WHERE n_an >= ceil(0.01 * (SELECT n FROM n) - 1e-9) AND n_an / n_f >= 0.45 AND n_ac / n_a <= 0.6""")
def anomalous_rules(spark, d):
    b = baskets(spark, d)
    common = rules.association_rules(itemsets.frequent_itemsets(b, 0.08, 3), "confidence", 0.45, max_consequent=1)
    return _round(_text(rules.anomalous_rules(b, min_anomalous_conf=0.45, max_reference_conf=0.6, rules=common), "antecedents", "anomaly"))


@query(f"""WITH {RULES(LOW)}, base AS (SELECT a, c, sab, sab / sa AS conf FROM r WHERE sab / sa >= 0.4)
   SELECT array_to_string(a, '|') AS antecedents, array_to_string(c, '|') AS consequents, round(conf, 6) AS confidence FROM base x WHERE NOT EXISTS (SELECT 1 FROM base y WHERE y.c = x.c AND len(y.a) < len(x.a) AND list_has_all(x.a, y.a) AND x.conf - y.conf <= 1e-12)""")
def unproductive_pruned(spark, d):
    r = cut(rules.association_rules(found(spark, d), "confidence", 0.4))
    return _rules_out(rules.prune_unproductive_rules(r).select("antecedents", "consequents", "confidence"))


@query(f"""WITH {RULES(LOW)}, base AS (SELECT a, c, round(sab, 2) AS sup, round(sab / sa, 1) AS conf FROM r)
   SELECT array_to_string(a, '|') AS antecedents, array_to_string(c, '|') AS consequents, sup AS support, conf AS confidence FROM base x WHERE NOT EXISTS (SELECT 1 FROM base y WHERE abs(y.sup - x.sup) <= 1e-9 AND abs(y.conf - x.conf) <= 1e-9 AND list_has_all(x.a, y.a) AND list_has_all(y.c, x.c) AND (len(y.a) < len(x.a) OR len(y.c) > len(x.c)))""")
def redundant_pruned(spark, d):
    r = rules.association_rules(found(spark, d), "support", 0.0).select("antecedents", "consequents", F.round("support", 2).alias("support"), F.round("confidence", 1).alias("confidence"))
    return _text(rules.prune_redundant_rules(cut(r)), "antecedents", "consequents")


# -- significance ----------------------------------------------------------------------------------


def _pairs(spark, d):
    b = cut(baskets(spark, d))
    return cut(rules.association_rules(itemsets.frequent_itemsets(b, LOW, 2), "support", 0.0)), b.count()


_P = f"""WITH {RULES(LOW, 2)}, q AS (SELECT array_to_string(a, '|') AS antecedents, array_to_string(c, '|') AS consequents, round(sab * n)::BIGINT AS ac, round(sa * n)::BIGINT AS ka, round(sb * n)::BIGINT AS kc, n AS nn FROM r, n),
  t AS (SELECT antecedents, consequents, least(1, sum(exp(lgamma(ka + 1) - lgamma(i + 1) - lgamma(ka - i + 1) + lgamma(nn - ka + 1) - lgamma(kc - i + 1) - lgamma(nn - ka - kc + i + 1) - lgamma(nn + 1) + lgamma(kc + 1) + lgamma(nn - kc + 1)))) AS p
    FROM (SELECT *, unnest(range(ac, least(ka, kc) + 1)) AS i FROM q) GROUP BY antecedents, consequents)"""


@query(f"{_P} SELECT antecedents, consequents, round(p, 5) AS p_value FROM t")
def rule_fisher(spark, d):
    r, n = _pairs(spark, d)
    return _text(significance.rule_significance(r, n).select("antecedents", "consequents", F.round("p_value", 5).alias("p_value")), "antecedents", "consequents")


@query(f"WITH {RULES(LOW, 2)} SELECT array_to_string(a, '|') AS antecedents, array_to_string(c, '|') AS consequents, round(n * pow(round(sab * n) * n - round(sa * n) * round(sb * n), 2) / (round(sa * n) * round(sb * n) * (n - round(sa * n)) * (n - round(sb * n))), 6) AS statistic FROM r, n")
def rule_chi2(spark, d):
    r, n = _pairs(spark, d)
    return _text(significance.rule_significance(r, n, "chi2", "two-sided").select("antecedents", "consequents", F.round("statistic", 6).alias("statistic")), "antecedents", "consequents")


def _adjusted(method):
    def run(spark, d):
        r, n = _pairs(spark, d)
        out = significance.adjust_pvalues(cut(significance.rule_significance(r, n)), method)
        return _text(out.select("antecedents", "consequents", F.round("p_adjusted", 4).alias("p_adjusted")), "antecedents", "consequents")

    run.__name__ = {"bonferroni": "adjust_bonferroni", "holm": "adjust_holm", "fdr_bh": "adjust_bh", "fdr_by": "adjust_by"}[method]
    return run


_RANK = f"{_P}, k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM t)"
query(f"{_P} SELECT antecedents, consequents, round(least(1, p * (SELECT count(*) FROM t)), 4) AS p_adjusted FROM t")(_adjusted("bonferroni"))
query(f"{_RANK} SELECT antecedents, consequents, round(least(1, max(p * (m - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 4) AS p_adjusted FROM k")(_adjusted("holm"))
query(f"{_RANK} SELECT antecedents, consequents, round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS p_adjusted FROM k")(_adjusted("fdr_bh"))
query(f"{_RANK} SELECT antecedents, consequents, round(least(1, min(p * m * (SELECT sum(1 / x) FROM (SELECT unnest(range(1, (SELECT count(*) FROM t) + 1)) AS x)) / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS p_adjusted FROM k")(_adjusted("fdr_by"))


@query(f"""WITH {RULES(LOW, 2)}, w AS (SELECT array_to_string(a, '|') AS antecedents, array_to_string(c, '|') AS consequents, round(sab * n) AS x, round(sa * n) AS k, 1.959963984540054 AS z FROM r, n)
   SELECT antecedents, consequents, round(greatest(0, (x + z * z / 2) / (k + z * z) - z / (k + z * z) * sqrt(x * (k - x) / k + z * z / 4)), 6) AS confidence_low, round(least(1, (x + z * z / 2) / (k + z * z) + z / (k + z * z) * sqrt(x * (k - x) / k + z * z / 4)), 6) AS confidence_high FROM w""")
def wilson_intervals(spark, d):
    r, n = _pairs(spark, d)
    return _round(_text(significance.confidence_intervals(r, n).select("antecedents", "consequents", "confidence_low", "confidence_high"), "antecedents", "consequents"))


@query()
def bootstrap_intervals(spark, d):
    r, n = _pairs(spark, d)
    return significance.confidence_intervals(r, n, method="bootstrap").select("antecedents", "consequents", "confidence_low", "confidence_high", "lift_low", "lift_high")


@query(f"{_RANK} SELECT antecedents, consequents FROM (SELECT *, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM k) WHERE least(1, q) <= 1.0")
def significant_rules(spark, d):
    r, n = _pairs(spark, d)
    return _text(significance.significant_rules(r, n, 1.0).select("antecedents", "consequents"), "antecedents", "consequents")


@query()
def permutation_test(spark, d):
    rows = cut(hourly(spark, d))
    null = significance.permutation_null(rows, temporal.crisp_rule_miner(0.05, "lift", 1.0, 2), "lift")
    r = rules.association_rules(itemsets.frequent_itemsets(rows, 0.05, 2), "lift", 1.0)
    return significance.permutation_p_values(r, null, "lift").select("antecedents", "consequents", "lift", "permutation_p")


# -- fuzzy -----------------------------------------------------------------------------------------

PEAKS = [5.0, 25.0, 45.0]
_TRI = """CASE WHEN q <= 5 THEN 1 WHEN q < 25 THEN (25 - q) / 20 ELSE 0 END AS qty_low, CASE WHEN q <= 5 THEN 0 WHEN q < 25 THEN (q - 5) / 20 WHEN q < 45 THEN (45 - q) / 20 ELSE 0 END AS qty_medium, CASE WHEN q <= 25 THEN 0 WHEN q < 45 THEN (q - 25) / 20 ELSE 1 END AS qty_high"""


def _lines(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("qty"), F.round(F.col("l_discount") * 100).cast("double").alias("disc"))


@query(f"SELECT l_orderkey, l_linenumber, round(qty_low, 6) AS qty_low, round(qty_medium, 6) AS qty_medium, round(qty_high, 6) AS qty_high FROM (SELECT l_orderkey, l_linenumber, {_TRI} FROM (SELECT *, l_quantity::DOUBLE AS q FROM lineitem))")
def fuzzify_triangular(spark, d):
    return _round(M.fuzzify(_lines(spark, d), {"qty": PEAKS}).drop("qty", "disc"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN q <= 10 THEN 1 WHEN q < 20 THEN (20 - q) / 10 ELSE 0 END, 6) AS qty_low, round(CASE WHEN q <= 10 THEN 0 WHEN q < 20 THEN (q - 10) / 10 WHEN q <= 30 THEN 1 WHEN q < 40 THEN (40 - q) / 10 ELSE 0 END, 6) AS qty_medium,
   round(CASE WHEN q <= 30 THEN 0 WHEN q < 40 THEN (q - 30) / 10 ELSE 1 END, 6) AS qty_high FROM (SELECT *, l_quantity::DOUBLE AS q FROM lineitem)""")
def fuzzify_trapezoid(spark, d):
    return _round(M.fuzzify(_lines(spark, d), {"qty": PEAKS}, "trapezoidal").drop("qty", "disc"))


@query("""SELECT l_orderkey, l_linenumber, round(exp(-0.5 * pow((q - 5) / g, 2)), 6) AS qty_low, round(exp(-0.5 * pow((q - 25) / g, 2)), 6) AS qty_medium, round(exp(-0.5 * pow((q - 45) / g, 2)), 6) AS qty_high FROM (SELECT *, l_quantity::DOUBLE AS q, 20 / (2 * sqrt(2 * ln(2))) AS g FROM lineitem)""")
def fuzzify_gaussian(spark, d):
    return _round(M.fuzzify(_lines(spark, d), {"qty": PEAKS}, "gaussian").drop("qty", "disc"))


@query("SELECT 'quantile' AS method, quantile_cont(p_retailprice, 0) AS low, quantile_cont(p_retailprice, 0.5) AS medium, quantile_cont(p_retailprice, 1) AS high FROM part")
def auto_partition_quantile(spark, d):
    peaks = M.automatic_peaks(_t(spark, d, "part"), "p_retailprice", 3, "quantile")
    return spark.createDataFrame([("quantile", *peaks)], "method string, low double, medium double, high double")


@query("SELECT 'uniform' AS method, min(p_retailprice) AS low, min(p_retailprice) + (max(p_retailprice) - min(p_retailprice)) * 0.5 AS medium, max(p_retailprice) AS high FROM part")
def auto_partition_uniform(spark, d):
    peaks = M.automatic_peaks(_t(spark, d, "part"), "p_retailprice", 3, "uniform")
    return spark.createDataFrame([("uniform", *peaks)], "method string, low double, medium double, high double")


@query()
def auto_partition_kmeans(spark, d):
    peaks = M.automatic_peaks(_t(spark, d, "lineitem"), "l_quantity", 3, "kmeans")
    return spark.createDataFrame([("kmeans", *peaks)], "method string, low double, medium double, high double")


def fuzzy_rows(spark, d):
    """Lines as fuzzy transactions: quantity and discount in three degrees each."""
    table = M.fuzzify(_lines(spark, d), {"qty": PEAKS, "disc": [0.0, 5.0, 10.0]})
    pairs = M.fuzzy_transactions(table, [f"{a}_{b}" for a in ("qty", "disc") for b in ("low", "medium", "high")])
    return table.select(pairs.alias("s")).select(F.col("s.item").alias("items"), F.col("s.degree").alias("degrees"))


_F = f"""WITH m AS (SELECT {_TRI}, CASE WHEN x <= 0 THEN 1 WHEN x < 5 THEN (5 - x) / 5 ELSE 0 END AS disc_low, CASE WHEN x <= 0 THEN 0 WHEN x < 5 THEN x / 5 WHEN x <= 5 THEN 1 WHEN x < 10 THEN (10 - x) / 5 ELSE 0 END AS disc_medium,
    CASE WHEN x <= 5 THEN 0 WHEN x < 10 THEN (x - 5) / 5 ELSE 1 END AS disc_high FROM (SELECT l_quantity::DOUBLE AS q, round(l_discount * 100)::DOUBLE AS x FROM lineitem)),
  u AS (SELECT row_number() OVER () AS t, * FROM m), l AS (UNPIVOT u ON qty_low, qty_medium, qty_high, disc_low, disc_medium, disc_high INTO NAME item VALUE g),
  one AS (SELECT item, [count(*) FILTER (g >= 1), count(*) FILTER (g >= 0.8), count(*) FILTER (g >= 0.6), count(*) FILTER (g >= 0.4), count(*) FILTER (g >= 0.2)] AS v FROM l GROUP BY item),
  two AS (SELECT x.item AS a, y.item AS b, [count(*) FILTER (least(x.g, y.g) >= 1), count(*) FILTER (least(x.g, y.g) >= 0.8), count(*) FILTER (least(x.g, y.g) >= 0.6), count(*) FILTER (least(x.g, y.g) >= 0.4), count(*) FILTER (least(x.g, y.g) >= 0.2)] AS v
    FROM l x JOIN l y ON x.t = y.t AND x.item < y.item WHERE x.g > 0 AND y.g > 0 GROUP BY x.item, y.item),
  fi AS (SELECT [item] AS itemset, v FROM one UNION ALL SELECT [a, b], v FROM two), n AS (SELECT count(*) AS n FROM u),
  fs AS (SELECT itemset, list_transform(v, lambda k: k / n) AS lv, list_sum(v) / 5 / n AS s FROM fi, n WHERE list_sum(v) / 5 >= 0.1 * n - 1e-9)"""


@query(f"{_F} SELECT array_to_string(itemset, '|') AS itemset, len(itemset)::INT AS size, round(s, 6) AS support FROM fs")
def fuzzy_itemsets(spark, d):
    return _round(_text(fuzzy.fuzzy_itemsets(fuzzy_rows(spark, d), 0.1, 5, max_len=2).select("itemset", "size", "support"), "itemset"))


@query(f"""{_F}, r AS (SELECT p.itemset[1] AS a, p.itemset[2] AS c, p.lv AS ab, x.lv AS la, y.lv AS lb FROM fs p JOIN fs x ON x.itemset = [p.itemset[1]] JOIN fs y ON y.itemset = [p.itemset[2]] WHERE len(p.itemset) = 2
     UNION ALL SELECT p.itemset[2], p.itemset[1], p.lv, y.lv, x.lv FROM fs p JOIN fs x ON x.itemset = [p.itemset[1]] JOIN fs y ON y.itemset = [p.itemset[2]] WHERE len(p.itemset) = 2),
   o AS (SELECT a AS antecedents, c AS consequents, list_sum(ab) / 5 AS fsupp, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN la[i] = 0 THEN 1 ELSE ab[i] / la[i] END)) / 5 AS fconf FROM r)
   SELECT antecedents, consequents, round(fsupp, 6) AS "FSupp", round(fconf, 6) AS "FConf" FROM o WHERE fconf >= 0.3""")
def fuzzy_rules(spark, d):
    r = rules.fuzzy_association_rules(cut(fuzzy.fuzzy_itemsets(fuzzy_rows(spark, d), 0.1, 5, max_len=2)), "FConf", 0.3)
    return _round(_text(r.select("antecedents", "consequents", "FSupp", "FConf"), "antecedents", "consequents"))


@query()
def fuzzy_negative_rules(spark, d):
    return _text(fuzzy.fuzzy_negative_association_rules(fuzzy_rows(spark, d), 0.15, 5, "FConf", 0.5), "antecedents", "consequents")


@query()
def fuzzy_rule_test(spark, d):
    rows = cut(fuzzy_rows(spark, d))
    r = cut(rules.fuzzy_association_rules(cut(fuzzy.fuzzy_itemsets(rows, 0.15, 5)), "FConf", 0.3))
    return _text(significance.fuzzy_rule_significance(r, rows), "antecedents", "consequents")


# -- taxonomy, ranges, gradual ---------------------------------------------------------------------


def _tax(spark, d):
    """Nations below regions; baskets are the nations of an order's customer and suppliers."""
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    links = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).union(region.select(F.col("r_name"), F.lit("WORLD")))
    name = F.broadcast(nation.select("n_nationkey", F.col("n_name").alias("item")))
    supp = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("tid"), "l_suppkey").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(name, F.col("s_nationkey") == F.col("n_nationkey")).select("tid", "item").distinct()
    return taxonomy.Taxonomy(links), itemsets.to_baskets(supp)


_T = """s AS (SELECT DISTINCT l_orderkey AS tid, n_name AS item, r_name AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  e AS (SELECT tid, item FROM s UNION SELECT tid, region FROM s UNION SELECT DISTINCT tid, 'WORLD' FROM s), n AS (SELECT count(DISTINCT tid) AS n FROM s)"""


@query("SELECT n_name AS item, r_name AS ancestor FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'WORLD' FROM nation UNION ALL SELECT r_name, 'WORLD' FROM region")
def taxonomy_closure(spark, d):
    return _tax(spark, d)[0].closure(spark)


@query("SELECT n_name AS item, 3 AS level FROM nation UNION ALL SELECT r_name, 2 FROM region UNION ALL SELECT 'WORLD', 1")
def taxonomy_levels(spark, d):
    return _tax(spark, d)[0].levels(spark)


@query(f"WITH {_T} SELECT tid, string_agg(item, '|' ORDER BY item) AS items FROM e GROUP BY tid")
def extend_transactions(spark, d):
    tax, b = _tax(spark, d)
    return _text(taxonomy.extend_transactions(b, tax), "items")


@query(f"WITH {_T} SELECT tid, string_agg(region, '|' ORDER BY region) AS items FROM (SELECT DISTINCT tid, region FROM s) GROUP BY tid")
def generalize_level(spark, d):
    tax, b = _tax(spark, d)
    return _text(taxonomy.generalize_transactions(b, tax, 2), "items")


_GI = f"""WITH {_T}, one AS (SELECT [item] AS itemset, count(*) AS k FROM e GROUP BY item), up AS (SELECT DISTINCT item AS lo, region AS hi FROM s UNION SELECT DISTINCT item, 'WORLD' FROM s UNION SELECT DISTINCT region, 'WORLD' FROM s),
  two AS (SELECT [x.item, y.item] AS itemset, count(*) AS k FROM e x JOIN e y ON x.tid = y.tid AND x.item < y.item WHERE NOT EXISTS (SELECT 1 FROM up WHERE (lo, hi) IN ((x.item, y.item), (y.item, x.item))) GROUP BY x.item, y.item),
  lvl AS (SELECT DISTINCT item, 0.05 AS t FROM s UNION SELECT DISTINCT region, 0.3 FROM s UNION SELECT 'WORLD', 0.5),
  fi AS (SELECT itemset, k, k / n AS s FROM (SELECT * FROM one UNION ALL SELECT * FROM two), n WHERE k >= ceil((SELECT max(t) FROM lvl WHERE list_contains(itemset, lvl.item)) * n - 1e-9))"""


@query(f"{_GI} {_FI_SQL}")
def generalized_itemsets(spark, d):
    tax, b = _tax(spark, d)
    return _fi_out(taxonomy.generalized_itemsets(b, tax, {1: 0.5, 2: 0.3, 3: 0.05}, 2))


@query(f"""{_GI}, r AS (SELECT p.itemset[1] AS a, p.itemset[2] AS c, p.s, x.s AS sa FROM fi p JOIN fi x ON x.itemset = [p.itemset[1]] WHERE len(p.itemset) = 2 UNION ALL SELECT p.itemset[2], p.itemset[1], p.s, y.s FROM fi p JOIN fi y ON y.itemset = [p.itemset[2]] WHERE len(p.itemset) = 2)
   SELECT a AS antecedents, c AS consequents, round(s, 6) AS support, round(s / sa, 6) AS confidence, (CASE WHEN a IN (SELECT item FROM s) OR c IN (SELECT item FROM s) THEN 3 ELSE 2 END)::INT AS level FROM r WHERE s / sa >= 0.3""")
def generalized_rules(spark, d):
    tax, b = _tax(spark, d)
    return _rules_out(taxonomy.generalized_rules(b, tax, {1: 0.5, 2: 0.3, 3: 0.05}, "confidence", 0.3, 2).select("antecedents", "consequents", "support", "confidence", "level"), "level")


@query()
def interesting_rules(spark, d):
    tax, b = _tax(spark, d)
    return _text(taxonomy.generalized_rules(b, tax, 0.05, "confidence", 0.2, interest=1.05), "antecedents", "consequents")


@query("""WITH q AS (SELECT quantile_cont(p_size, [0, 0.25, 0.5, 0.75, 1]) AS e, count(*) AS n FROM part), c AS (SELECT CASE WHEN p_size < e[2] THEN 1 WHEN p_size < e[3] THEN 2 WHEN p_size < e[4] THEN 3 ELSE 4 END AS k, count(*) AS c FROM part, q GROUP BY 1),
   f AS (SELECT i, j, e[i] AS low, e[j + 1] AS high, (SELECT sum(c) FROM c WHERE k BETWEEN i AND j) / n AS support FROM q, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS j) WHERE j >= i)
   SELECT 'p_size' AS "column", low::DOUBLE AS low, high::DOUBLE AS high, round(support, 6) AS support, (j - i + 1)::INT AS n_base FROM f WHERE i = j OR support <= 0.6 + 1e-9""")
def interval_partition(spark, d):
    part = quantitative.IntervalPartition(4, "quantile", 0.6, ["p_size"]).fit(_t(spark, d, "part"))
    return _round(part.intervals_frame(_t(spark, d, "part")).drop("item"))


@query()
def quantitative_rules(spark, d):
    table = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    return _text(quantitative.quantitative_rules(table, "p_partkey", 0.05, 4, 0.5, min_threshold=0.2), "antecedents", "consequents")


_GR = """WITH p AS (SELECT p_partkey AS i, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part), n AS (SELECT count(*) AS n FROM p), s AS (SELECT sign(b.x - a.x) AS u, sign(b.y - a.y) AS v, count(*) AS k FROM p a JOIN p b ON a.i < b.i GROUP BY ALL),
   fi AS (SELECT 'p_size+' AS itemset, 1 AS size, sum(k) FILTER (u <> 0) / (SELECT n * (n - 1) / 2 FROM n) AS support FROM s UNION ALL SELECT 'p_retailprice+', 1, sum(k) FILTER (v <> 0) / (SELECT n * (n - 1) / 2 FROM n) FROM s
     UNION ALL SELECT 'p_size+|p_retailprice+', 2, sum(k) FILTER (u * v = 1) / (SELECT n * (n - 1) / 2 FROM n) FROM s UNION ALL SELECT 'p_size+|p_retailprice-', 2, sum(k) FILTER (u * v = -1) / (SELECT n * (n - 1) / 2 FROM n) FROM s)"""


@query(f"{_GR} SELECT itemset, size::INT AS size, round(support, 6) AS support FROM fi WHERE support >= 0.1")
def gradual_itemsets(spark, d):
    return _round(_text(gradual.gradual_itemsets(_t(spark, d, "part"), 0.1, ["p_size", "p_retailprice"]), "itemset"))


@query()
def gradual_rules(spark, d):
    return _text(gradual.gradual_rules(_t(spark, d, "part"), 0.1, 0.2, ["p_size", "p_retailprice"]), "antecedents", "consequents")


# -- sequences -------------------------------------------------------------------------------------

_E = """e AS (SELECT DISTINCT user_id || '/' || CAST(ts AS DATE) AS sid, ts, event_type AS item FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL), n AS (SELECT count(DISTINCT sid) AS n FROM e),
   fl AS (SELECT sid, item, min(ts) AS f, max(ts) AS l FROM e GROUP BY ALL)"""


@query(f"WITH {_E} SELECT sid, string_agg(x, '>' ORDER BY ts) AS elements FROM (SELECT sid, ts, string_agg(item, '|' ORDER BY item) AS x FROM e GROUP BY ALL) GROUP BY sid")
def sequences_from_events(spark, d):
    return event_sequences(spark, d).select("sid", F.array_join(F.transform("elements", lambda e: F.array_join(e, "|")), ">").alias("elements"))


@query(f"""WITH {_E}, two AS (SELECT x.item AS a, y.item AS b, count(DISTINCT sid) AS k FROM e x JOIN e y USING (sid) WHERE x.ts < y.ts GROUP BY ALL), par AS (SELECT x.item AS a, y.item AS b, count(DISTINCT sid) AS k FROM e x JOIN e y USING (sid, ts) WHERE x.item < y.item GROUP BY ALL)
   SELECT sequence, length::INT AS length, k AS count FROM (SELECT '<{{' || item || '}}>' AS sequence, 1 AS length, count(*) AS k FROM fl GROUP BY item UNION ALL SELECT '<{{' || a || '}} {{' || b || '}}>', 2, k FROM two UNION ALL SELECT '<{{' || a || ', ' || b || '}}>', 2, k FROM par) WHERE k >= ceil(0.1 * (SELECT n FROM n) - 1e-9)""")
def prefixspan(spark, d):
    out = sequences.prefixspan(event_sequences(spark, d), 0.1, 2)
    return out.select(sequences.format_sequence(F.col("sequence")).alias("sequence"), "length", "count")


@query(f"""WITH {_E}, one AS (SELECT item, count(*) AS k FROM fl GROUP BY item), v AS (SELECT x.item AS a, y.item AS c, count(*) AS k, count(*) FILTER (x.f < y.l) AS valid FROM fl x JOIN fl y ON x.sid = y.sid AND x.item <> y.item GROUP BY ALL)
   SELECT a AS antecedents, c AS consequents, round(o.k / n, 6) AS antecedent_support, round(p.k / n, 6) AS consequent_support, round(valid / n, 6) AS support, round(valid / o.k, 6) AS confidence FROM v JOIN one o ON o.item = a JOIN one p ON p.item = c, n
   WHERE v.k >= ceil(0.05 * n - 1e-9) AND valid >= ceil(0.05 * n - 1e-9) AND valid / o.k >= 0.1 - 1e-9""")
def sequential_rules(spark, d):
    r = sequences.sequential_rules(event_sequences(spark, d), 0.05, 0.1, 1, 1)
    return _rules_out(r.select("antecedents", "consequents", "antecedent_support", "consequent_support", "support", "confidence"))


@query(f"""WITH {_E}, one AS (SELECT item, count(*) AS k FROM fl GROUP BY item), v AS (SELECT x.item AS a, y.item AS c, count(*) FILTER (z.l IS NULL OR z.l <= x.f) AS valid FROM fl x JOIN one y ON y.item <> x.item LEFT JOIN fl z ON z.sid = x.sid AND z.item = y.item GROUP BY ALL)
   SELECT a AS antecedents, c AS consequents, round(o.k / n, 6) AS antecedent_support, round((n - p.k) / n, 6) AS consequent_support, round(valid / n, 6) AS support, round(valid / o.k, 6) AS confidence FROM v JOIN one o ON o.item = a JOIN one p ON p.item = c, n
   WHERE o.k >= ceil(0.1 * n - 1e-9) AND valid >= ceil(0.1 * n - 1e-9) AND valid / o.k >= 0.7 - 1e-9""")
def veto_rules(spark, d):
    r = sequences.sequential_veto_rules(event_sequences(spark, d), 0.1, 0.7, 1, 0.1)
    return _rules_out(r.select("antecedents", "consequents", "antecedent_support", "consequent_support", "support", "confidence"))


@query(f"WITH {_E} SELECT DISTINCT x.sid FROM e x JOIN e y USING (sid) JOIN e z USING (sid) WHERE x.item = 'view' AND y.item = 'click' AND z.item = 'view' AND x.ts < y.ts AND y.ts < z.ts")
def contains_sequence(spark, d):
    return event_sequences(spark, d).where(sequences.contains_sequence(F.col("elements"), [["view"], ["click"], ["view"]])).select("sid")


def _fuzzy_sequences(spark, d):
    """Days of users; degrees are 0.2..1 by the event's number."""
    e = _t(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("sid"), "ts", "event_type", ((F.col("event_id") % 5 + 1) / 5).alias("g"))
    at = e.dropna().groupBy("sid", "ts", "event_type").agg(F.max("g").alias("g")).groupBy("sid", "ts").agg(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("item"), F.col("g").alias("degree")))).alias("e"))
    return at.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "e"))), lambda s: s["e"]).alias("elements"))


_FE = """g AS (SELECT user_id || '/' || CAST(ts AS DATE) AS sid, ts, event_type AS item, max((event_id % 5 + 1) / 5) AS g FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL), n AS (SELECT count(DISTINCT sid) AS n FROM g)"""


@query(f"""WITH {_FE}, one AS (SELECT item, sum(g) AS s FROM (SELECT sid, item, max(g) AS g FROM g GROUP BY ALL) GROUP BY item), two AS (SELECT a, b, sum(g) AS s FROM (SELECT sid, x.item AS a, y.item AS b, max(least(x.g, y.g)) AS g FROM g x JOIN g y USING (sid) WHERE x.ts < y.ts GROUP BY ALL) GROUP BY ALL)
   SELECT sequence, length::INT AS length, round(s / (SELECT n FROM n), 6) AS support FROM (SELECT item AS sequence, 1 AS length, s FROM one UNION ALL SELECT a || '>' || b, 2, s FROM two) WHERE s / (SELECT n FROM n) >= 0.05 - 1e-12""")
def fuzzy_prefixspan(spark, d):
    out = sequences.fuzzy_prefixspan(_fuzzy_sequences(spark, d), 0.05, 2)
    return _round(out.select(F.array_join(F.flatten("sequence"), ">").alias("sequence"), "length", "support"))


@query(f"""WITH {_FE}, best AS (SELECT sid, item, max(g) AS g FROM g GROUP BY ALL), one AS (SELECT item, sum(g) / (SELECT n FROM n) AS s FROM best GROUP BY item), joint AS (SELECT x.item AS a, y.item AS c, sum(least(x.g, y.g)) / (SELECT n FROM n) AS s FROM best x JOIN best y ON x.sid = y.sid AND x.item <> y.item GROUP BY ALL),
   v AS (SELECT a, c, sum(g) / (SELECT n FROM n) AS s FROM (SELECT sid, x.item AS a, y.item AS c, max(least(x.g, y.g)) AS g FROM g x JOIN g y USING (sid) WHERE x.ts < y.ts AND x.item <> y.item GROUP BY ALL) GROUP BY ALL)
   SELECT v.a AS antecedents, v.c AS consequents, round(o.s, 6) AS antecedent_support, round(p.s, 6) AS consequent_support, round(v.s, 6) AS support, round(v.s / o.s, 6) AS confidence FROM v JOIN joint USING (a, c) JOIN one o ON o.item = v.a JOIN one p ON p.item = v.c WHERE joint.s >= 0.03 - 1e-12 AND v.s >= 0.03 - 1e-9 AND v.s / o.s >= 0.1""")
def fuzzy_sequential_rules(spark, d):
    r = sequences.fuzzy_sequential_rules(_fuzzy_sequences(spark, d), 0.03, 0.1, 1, 1)
    return _rules_out(r.select("antecedents", "consequents", "antecedent_support", "consequent_support", "support", "confidence"))


@query()
def sequential_significance(spark, d):
    s = cut(event_sequences(spark, d))
    r = cut(sequences.sequential_rules(s, 0.05, 0.1, 1, 1))
    return _text(sequences.sequential_rule_significance(s, r).select("antecedents", "consequents", "p_value", "p_adjusted"), "antecedents", "consequents")


# -- series, time, drift ---------------------------------------------------------------------------

_SYM = "CASE WHEN p_retailprice < e[1] THEN 'low' WHEN p_retailprice < e[2] THEN 'medium' ELSE 'high' END"


def _symbols(method):
    def run(spark, d):
        return series.symbolize(_t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 3, method, out="symbol").select("p_partkey", "symbol")

    run.__name__ = f"symbolize_{method}"
    return run


query(f"WITH q AS (SELECT [quantile_cont(p_retailprice, 1 / 3), quantile_cont(p_retailprice, 2 / 3)] AS e FROM part) SELECT p_partkey, {_SYM} AS symbol FROM part, q")(_symbols("quantile"))
query(f"WITH q AS (SELECT [min(p_retailprice) + (max(p_retailprice) - min(p_retailprice)) * 1 / 3, min(p_retailprice) + (max(p_retailprice) - min(p_retailprice)) * 2 / 3] AS e FROM part) SELECT p_partkey, {_SYM} AS symbol FROM part, q")(_symbols("uniform"))
query(f"WITH q AS (SELECT [avg(p_retailprice) + stddev_pop(p_retailprice) * -0.4307272992954576, avg(p_retailprice) + stddev_pop(p_retailprice) * 0.4307272992954576] AS e FROM part) SELECT p_partkey, {_SYM} AS symbol FROM part, q")(_symbols("sax"))


@query("""SELECT event_id, concat_ws('|', 'hour=' || hour(ts), 'weekday=' || (isodow(ts) - 1), 'daytype=' || CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'workday' END, 'month=' || month(ts), 'part_of_day=' || ['night', 'morning', 'afternoon', 'evening'][hour(ts) // 6 + 1]) AS items FROM events WHERE ts IS NOT NULL""")
def calendar_items(spark, d):
    e = _t(spark, d, "events").where("ts is not null")
    return _text(e.select("event_id", series.calendar_items(F.col("ts"), series.PARTS[:5]).alias("items")).select("event_id", "items"), "items")


_H = """c AS (SELECT date_trunc('hour', ts) AS h, event_type AS item, count(*) AS k FROM events WHERE event_type IS NOT NULL GROUP BY ALL), lv AS (SELECT item, avg(k) AS m FROM c GROUP BY item), hh AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS pos FROM (SELECT DISTINCT h FROM c)),
   i AS (SELECT pos, item FROM c JOIN lv USING (item) JOIN hh USING (h) WHERE k >= m), n AS (SELECT count(*) AS n FROM hh), items AS (SELECT hh.pos, list_sort(list(item) FILTER (item IS NOT NULL)) AS items FROM hh LEFT JOIN i USING (pos) GROUP BY hh.pos)"""


@query(f"WITH {_H}, g AS (SELECT pos, item FROM i UNION ALL SELECT pos + 1, item || '@lag1' FROM i UNION ALL SELECT pos + 2, item || '@lag2' FROM i) SELECT hh.pos, coalesce(string_agg(item, '|' ORDER BY item), '') AS items FROM hh LEFT JOIN g USING (pos) WHERE hh.pos >= 2 GROUP BY hh.pos")
def lag_items(spark, d):
    return _text(series.lag_items(hourly(spark, d).select("pos", "items"), [1, 2]), "items").select("pos", "items")


def _flags(spark, d):
    return hourly(spark, d).select("pos", F.array_contains("items", "view").alias("seen_view"), F.array_contains("items", "click").alias("seen_click"))


def _window(how):
    def run(spark, d):
        return _round(series.window_items(_flags(spark, d), ["seen_view", "seen_click"], 6, 3, how))

    run.__name__ = f"window_items_{how}"
    return run


_W = f"WITH {_H}, f AS (SELECT hh.pos, max((item = 'view')::INT) AS v, max((item = 'click')::INT) AS k FROM hh LEFT JOIN i USING (pos) GROUP BY hh.pos), z AS (SELECT pos, coalesce(v, 0) AS v, coalesce(k, 0) AS k FROM f)"
_OVER = "OVER (ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
query(f"{_W} SELECT * FROM (SELECT pos, max(v) {_OVER} > 0 AS seen_view, max(k) {_OVER} > 0 AS seen_click FROM z) WHERE pos >= 5 AND (pos - 5) % 3 = 0")(_window("any"))
query(f"{_W} SELECT * FROM (SELECT pos, min(v) {_OVER} > 0 AS seen_view, min(k) {_OVER} > 0 AS seen_click FROM z) WHERE pos >= 5 AND (pos - 5) % 3 = 0")(_window("all"))
query(f"{_W} SELECT * FROM (SELECT pos, round(avg(v) {_OVER}, 6) AS seen_view, round(avg(k) {_OVER}, 6) AS seen_click FROM z) WHERE pos >= 5 AND (pos - 5) % 3 = 0")(_window("mean"))

_LAG1 = f"""WITH {_H}, g AS (SELECT pos, item AS x FROM i UNION ALL SELECT pos + 1, item || '@lag1' FROM i), b AS (SELECT pos AS tid, x AS item FROM g WHERE pos >= 1 AND pos < (SELECT n FROM n)), m AS (SELECT n - 1 AS n FROM n), one AS (SELECT item, count(*) AS k FROM b GROUP BY item),
   two AS (SELECT x.item AS a, y.item AS c, count(*) AS k FROM b x JOIN b y ON x.tid = y.tid AND x.item <> y.item GROUP BY ALL)"""


_LAGGED = f"WITH lagged AS ({_LAG1} SELECT tid, item FROM b), hours AS ({_LAG1} SELECT n FROM m), b AS (SELECT * FROM lagged), n AS (SELECT n FROM hours){levels_sql(0.05, 10)}, {SPLITS_SQL}"


@query(f"""{_LAGGED} SELECT array_to_string(a, '|') AS antecedents, array_to_string(c, '|') AS consequents, round(sab, 6) AS support, round(sab / sa, 6) AS confidence, 1 AS max_lag FROM r
   WHERE sab / sa >= 0.3 AND list_has_any(list_transform(a, lambda x: x LIKE '%@lag1'), [true]) AND NOT list_has_any(list_transform(c, lambda x: x LIKE '%@lag1'), [true])""")
def temporal_rules(spark, d):
    r = temporal.temporal_association_rules(hourly(spark, d), 1, 0.05, "confidence", 0.3)
    return _rules_out(r.select("antecedents", "consequents", "support", "confidence", "max_lag"), "max_lag")


@query()
def fuzzy_temporal_rules(spark, d):
    rows = hourly(spark, d).withColumn("degrees", F.transform("items", lambda x: F.lit(0.8)))
    return _text(temporal.fuzzy_temporal_association_rules(rows, 1, 0.05, 5, "FConf", 0.3), "antecedents", "consequents")


@query(f"""WITH {_H}, j AS (SELECT x.pos, list_contains(y.items, 'view') AS a, list_contains(x.items, 'click') AS c, hour(h) AS hr FROM items x JOIN items y ON y.pos = x.pos - 1 JOIN hh ON hh.pos = x.pos)
   SELECT hr::INT AS "group", count(*) AS n, count(*) FILTER (a) AS antecedent_count, count(*) FILTER (a AND c) AS joint_count, round(count(*) FILTER (a AND c) / count(*), 6) AS support, round(CASE WHEN count(*) FILTER (a) > 0 THEN count(*) FILTER (a AND c) / count(*) FILTER (a) END, 6) AS confidence FROM (SELECT pos, coalesce(a, false) AS a, coalesce(c, false) AS c, hr FROM j) GROUP BY hr""")
def rule_profile(spark, d):
    out = temporal.rule_profile(hourly(spark, d), ["view@lag1"], ["click"], F.hour("ts"))
    return _round(out.drop("lift"))


def _windowed(spark, d):
    return temporal.window_rules(hourly(spark, d), timedelta(days=5), None, 0.05, "confidence", 0.2, temporal.crisp_rule_miner(0.05, "confidence", 0.2, 2), time="ts")


_WIN = f"""WITH {_H}, w AS (SELECT pos, floor(epoch(h - (SELECT min(h) FROM hh)) / 432000)::INT AS win FROM hh), nw AS (SELECT win, count(*) AS n FROM w GROUP BY win), x AS (SELECT win, pos AS tid, item FROM i JOIN w USING (pos)), one AS (SELECT win, item, count(*) AS k FROM x GROUP BY ALL),
   two AS (SELECT p.win, p.item AS a, q.item AS c, count(*) AS k FROM x p JOIN x q ON p.tid = q.tid AND p.item <> q.item GROUP BY ALL), r AS (SELECT two.win, a, c, two.k / nw.n AS s, two.k / o.k AS conf FROM two JOIN nw USING (win) JOIN one o ON o.win = two.win AND o.item = a WHERE two.k >= ceil(0.05 * nw.n - 1e-9) AND two.k / o.k >= 0.2)"""


@query(f"{_WIN} SELECT win AS \"window\", a AS antecedents, c AS consequents, round(s, 6) AS support, round(conf, 6) AS confidence FROM r")
def window_rules(spark, d):
    return _rules_out(_windowed(spark, d)[0].select("window", "antecedents", "consequents", "support", "confidence"), "window")


@query(f"""{_WIN} SELECT a AS antecedents, c AS consequents, count(*) AS windows, round(count(*) / (SELECT count(*) FROM nw), 6) AS persistence, min(win) AS first_window, max(win) AS last_window, round(avg(conf), 6) AS mean_confidence, round(CASE WHEN count(*) >= 3 THEN regr_slope(conf, win) END, 6) AS slope,
   CASE WHEN min(win) = 0 AND max(win) = (SELECT count(*) FROM nw) - 1 THEN CASE WHEN count(*) / (SELECT count(*) FROM nw) >= 0.8 THEN 'stable' ELSE 'intermittent' END WHEN max(win) = (SELECT count(*) FROM nw) - 1 THEN 'emerging' WHEN min(win) = 0 THEN 'vanishing' ELSE 'intermittent' END AS status FROM r GROUP BY a, c""")
def rule_drift(spark, d):
    r, n = _windowed(spark, d)
    out = temporal.rule_drift(cut(r), n).drop("min_confidence", "max_confidence")
    return _round(_text(out, "antecedents", "consequents"))


@query(f"""{_WIN} SELECT coalesce(x.a, y.a) AS antecedents, coalesce(x.c, y.c) AS consequents, round(x.conf, 6) AS confidence_before, round(y.conf, 6) AS confidence_after, round(y.conf - x.conf, 6) AS delta, CASE WHEN x.conf IS NULL THEN 'new' WHEN y.conf IS NULL THEN 'lost' WHEN abs(y.conf - x.conf) > 0.05 THEN 'changed' ELSE 'stable' END AS status
   FROM (SELECT * FROM r WHERE win = 0) x FULL JOIN (SELECT * FROM r WHERE win = 1) y ON x.a = y.a AND x.c = y.c""")
def compare_rule_sets(spark, d):
    r = cut(_windowed(spark, d)[0])
    return _round(_text(temporal.compare_rule_sets(r.where("window = 0"), r.where("window = 1")), "antecedents", "consequents"))


# -- rules at work ---------------------------------------------------------------------------------

LITERAL = [(["click@lag1"], ["view"], 0.6), (["view@lag1"], ["click"], 0.5), (["click@lag1", "view@lag1"], ["view"], 0.7), (["purchase@lag2"], ["view"], 0.4), (["view"], ["click"], 0.55)]
_LIT = "rr AS (SELECT * FROM (VALUES (1, ['click@lag1'], 'view', 0.6), (2, ['view@lag1'], 'click', 0.5), (3, ['click@lag1', 'view@lag1'], 'view', 0.7), (4, ['purchase@lag2'], 'view', 0.4), (5, ['view'], 'click', 0.55)) t(rule, a, c, conf))"
_FIRED = f"""WITH {_H}, {_LIT}, g AS (SELECT pos, item FROM i UNION ALL SELECT pos + 1, item || '@lag1' FROM i UNION ALL SELECT pos + 2, item || '@lag2' FROM i), t AS (SELECT hh.pos, list(item) AS its FROM hh LEFT JOIN g USING (pos) GROUP BY hh.pos),
   fired AS (SELECT pos, rule, a, c, conf, list_contains(its, c) AS good FROM t JOIN rr ON list_has_all(its, a))"""


def _literal(spark):
    return spark.createDataFrame(LITERAL, "antecedents array<string>, consequents array<string>, confidence double")


@query(f"{_FIRED} SELECT pos, array_to_string(a, '|') AS antecedents, c AS consequents FROM fired WHERE NOT good")
def rule_violations(spark, d):
    return _text(action.rule_violations(hourly(spark, d), _literal(spark)).drop("rule"), "antecedents", "consequents")


@query(f"{_FIRED} SELECT hh.pos, round(coalesce(sum(CASE WHEN NOT good THEN -log2(greatest(1 - conf, 0.001)) ELSE 0 END), 0), 6) AS score, count(*) FILTER (NOT good) AS violations, count(rule) AS applicable FROM hh LEFT JOIN fired USING (pos) GROUP BY hh.pos")
def anomaly_scores(spark, d):
    return _round(action.anomaly_scores(hourly(spark, d), _literal(spark)))


@query(f"{_FIRED} SELECT pos, round(sum(-log2(greatest(1 - conf, 0.001))), 6) AS score, count(*) AS violations FROM fired WHERE NOT good GROUP BY pos ORDER BY sum(-log2(greatest(1 - conf, 0.001))) DESC, pos LIMIT 10")
def detect_anomalies(spark, d):
    return _round(action.detect_anomalies(hourly(spark, d), _literal(spark), top=10).select("pos", "score", "violations"))


@query(f"{_FIRED} SELECT pos, c AS item, max(conf) AS score FROM fired WHERE rule < 5 GROUP BY ALL")
def rule_scores(spark, d):
    return action.rule_scores(hourly(spark, d), _literal(spark))


@query(f"{_FIRED} SELECT pos, c AS item, round(1 - product(1 - conf), 6) AS score FROM fired WHERE rule < 5 GROUP BY ALL")
def rule_scores_noisy_or(spark, d):
    return _round(action.rule_scores(hourly(spark, d), _literal(spark), "noisy_or"))


@query(f"""{_FIRED}, nx AS (SELECT n AS p FROM n), h2 AS (SELECT item || '@lag1' AS x FROM i, nx WHERE pos = p - 1 UNION ALL SELECT item || '@lag2' FROM i, nx WHERE pos = p - 2) SELECT c AS item, max(conf) AS score FROM rr WHERE rule < 5 AND list_has_all((SELECT coalesce(list(x), []) FROM h2), a) GROUP BY c""")
def forecast_next(spark, d):
    return action.forecast_next(hourly(spark, d), _literal(spark))


@query(f"""{_FIRED}, sc AS (SELECT pos, c, max(conf) AS s FROM fired WHERE rule < 5 AND pos >= 2 GROUP BY ALL), ev AS (SELECT hh.pos, k.c, coalesce(sc.s, 0) >= 0.5 AS p, list_contains(items.items, k.c) AS r FROM hh JOIN (SELECT DISTINCT c FROM rr WHERE rule < 5) k ON true LEFT JOIN sc ON sc.pos = hh.pos AND sc.c = k.c JOIN items ON items.pos = hh.pos WHERE hh.pos >= 2)
   SELECT c AS item, count(*) AS n, count(*) FILTER (r) AS positives, count(*) FILTER (p) AS predicted, count(*) FILTER (p AND r) AS hits, round(count(*) FILTER (p AND r) / count(*) FILTER (p), 6) AS precision, round(count(*) FILTER (p AND r) / count(*) FILTER (r), 6) AS recall, round(count(*) FILTER (r) / count(*), 6) AS base_rate FROM ev GROUP BY c""")
def evaluate_forecast(spark, d):
    return _round(action.evaluate_forecast(hourly(spark, d), _literal(spark)).drop("f1"))


_NEXT = [(["view"], ["click"], 0.6), (["click"], ["purchase"], 0.4), (["click", "view"], ["purchase"], 0.5)]


def _next(spark):
    return spark.createDataFrame(_NEXT, "antecedents array<string>, consequents array<string>, confidence double")


@query(f"""WITH {_E}, rn AS (SELECT * FROM (VALUES (['view'], 'click', 0.6), (['click'], 'purchase', 0.4), (['click', 'view'], 'purchase', 0.5)) t(a, c, conf)), done AS (SELECT fl.sid, a, c, conf, max(f) AS fin, count(*) AS k FROM fl JOIN rn ON list_contains(a, fl.item) GROUP BY ALL),
   w AS (SELECT done.sid, c, conf FROM done LEFT JOIN fl ON fl.sid = done.sid AND fl.item = c WHERE k = len(a) AND (fl.l IS NULL OR fl.l <= fin)) SELECT sid, c AS item, max(conf) AS score FROM w GROUP BY ALL""")
def next_events(spark, d):
    return action.predict_next_events(event_sequences(spark, d), _next(spark))


@query()
def evaluate_next_events(spark, d):
    s = cut(event_sequences(spark, d))
    return action.evaluate_next_events(s, _next(spark), k=1, train=s)


@query(f"""WITH {_H}, j AS (SELECT x.pos, coalesce(list_contains(y.items, 'view'), false) AS a, coalesce(list_contains(x.items, 'click'), false) AS c FROM items x JOIN items y ON y.pos = x.pos - 1)
   SELECT count(*) AS n_rows, count(*) FILTER (a AND c) AS "both", count(*) FILTER (a AND NOT c) AS only_antecedent, count(*) FILTER (NOT a AND c) AS only_consequent, count(*) FILTER (NOT a AND NOT c) AS neither, round(count(*) FILTER (a AND c) / count(*), 6) AS support, round(count(*) FILTER (a AND c) / count(*) FILTER (a), 6) AS confidence FROM j""")
def rule_evidence(spark, d):
    return _round(action.rule_evidence(hourly(spark, d), ["view@lag1"], ["click"], labels=False).drop("lift"))


@query(f"""WITH {_H}, j AS (SELECT x.pos, coalesce(list_contains(y.items, 'view'), false) AS v, coalesce(list_contains(y.items, 'click'), false) AS k, coalesce(list_contains(x.items, 'view'), false) AS c FROM items x JOIN items y ON y.pos = x.pos - 1),
   f AS (SELECT count(*) FILTER (v AND k AND c) / count(*) FILTER (v AND k) AS own, count(*) FILTER (v AND c) / count(*) FILTER (v) AS only_v, count(*) FILTER (k AND c) / count(*) FILTER (k) AS only_k FROM j)
   SELECT 'click@lag1' AS item, round(only_v, 6) AS confidence_without, round(own - only_v, 6) AS gain FROM f UNION ALL SELECT 'view@lag1', round(only_k, 6), round(own - only_k, 6) FROM f""")
def explain_rule(spark, d):
    return _round(action.explain_rule(cut(hourly(spark, d)), _literal(spark), ["click@lag1", "view@lag1"], ["view"])[1])


@query(f"{_FIRED} SELECT array_to_string(list_sort(rr.a), ', ') || ' => ' || rr.c AS rule, CASE WHEN NOT list_has_all(coalesce(its, []), rr.a) THEN 'not fired' WHEN list_contains(its, rr.c) THEN 'confirmed' ELSE 'violated' END AS status, rr.conf AS confidence FROM t, rr WHERE t.pos = 100")
def explain_row(spark, d):
    return action.explain_row(hourly(spark, d), _literal(spark), 100).select("rule", "status", "confidence")


# -- classes ---------------------------------------------------------------------------------------


def cases(spark, d):
    """Orders: product types and priority as items, status as the class."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"))
    return o.join(baskets(spark, d), "tid").select("tid", "status", F.array_sort(F.concat("items", F.array(F.concat(F.lit("prio="), F.col("prio"))))).alias("items"))


_C = f"""WITH {B}, o AS (SELECT o_orderkey AS tid, o_orderstatus AS cls, 'prio=' || o_orderpriority AS prio FROM orders WHERE o_orderkey IN (SELECT tid FROM b)), x AS (SELECT tid, item FROM b JOIN o USING (tid) UNION ALL SELECT tid, prio FROM o), cn AS (SELECT cls, count(*) AS n FROM o GROUP BY cls), t AS (SELECT count(*) AS n FROM o),
   one AS (SELECT [item] AS a, cls, count(*) AS k FROM x JOIN o USING (tid) GROUP BY ALL UNION ALL SELECT [p.item, q.item], cls, count(*) FROM x p JOIN x q ON p.tid = q.tid AND p.item < q.item JOIN o ON o.tid = p.tid GROUP BY p.item, q.item, cls), al AS (SELECT a, sum(k) AS k FROM one GROUP BY a)"""


@query(f"""{_C} SELECT array_to_string(one.a, '|') AS antecedents, 'status=' || one.cls AS consequents, round(al.k / t.n, 6) AS antecedent_support, round(cn.n / t.n, 6) AS consequent_support, round(one.k / t.n, 6) AS support, round(one.k / al.k, 6) AS confidence FROM one JOIN cn USING (cls) JOIN al ON al.a = one.a, t WHERE one.k >= ceil(0.05 * cn.n - 1e-9) AND one.k / al.k >= 0.3 - 1e-9""")
def class_rules(spark, d):
    r = classify.class_association_rules(cases(spark, d), "status", 0.05, 0.3, 2)
    return _rules_out(r.select("antecedents", "consequents", "antecedent_support", "consequent_support", "support", "confidence"))


@query()
def cba_select(spark, d):
    c = cut(cases(spark, d))
    r = cut(classify.class_association_rules(c, "status", 0.05, 0.3, None))
    return _text(classify.select_rules(r, c, "status")[0], "antecedents")


@query()
def cba_predict(spark, d):
    c = cut(cases(spark, d))
    return classify.RuleClassifier(0.05, 0.3, None).fit(c, "status").predict(c, "tid")


def _fuzzy_cases(spark, d):
    line = _t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("qty"), F.col("l_discount").cast("double").alias("disc"))
    return M.fuzzify(line, {"qty": PEAKS, "disc": [0.0, 0.05, 0.1]})


_FUZZY = [f"{a}_{b}" for a in ("qty", "disc") for b in ("low", "medium", "high")]


@query()
def fuzzy_class_rules(spark, d):
    return _text(classify.fuzzy_class_rules(_fuzzy_cases(spark, d), _FUZZY, "flag", 0.02, 0.2, 2), "antecedents", "consequents")


@query()
def fuzzy_predict(spark, d):
    c = _fuzzy_cases(spark, d)
    return classify.FuzzyRuleClassifier(0.02, 0.2, 2).fit(c, _FUZZY, "flag").predict(c, "case")


# -- rules of rules, graphs, streams ---------------------------------------------------------------


def _primary(spark, d):
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    part = _t(spark, d, "part").select("p_partkey", "p_type")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_set("p_type")).alias("items"))
    return rules.primary_rules(rows, "l_returnflag", 0.05, "confidence", 0.2, max_len=2)


_META = """WITH b AS (SELECT DISTINCT l_returnflag AS f, l_orderkey AS tid, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT f, count(DISTINCT tid) AS n FROM b GROUP BY f), one AS (SELECT f, item, count(*) AS k FROM b GROUP BY ALL),
   r AS (SELECT x.f, x.item AS a, y.item AS c, count(*) AS k FROM b x JOIN b y ON x.f = y.f AND x.tid = y.tid AND x.item <> y.item GROUP BY ALL), p AS (SELECT f, a || '=>' || c AS rule, r.k / n.n AS s, r.k / one.k AS conf FROM r JOIN n USING (f) JOIN one ON one.f = r.f AND one.item = a WHERE r.k >= ceil(0.05 * n.n - 1e-9) AND r.k / one.k >= 0.2)"""


@query(f"{_META} SELECT f AS dataset, rule, round(s, 6) AS support, round(conf, 6) AS confidence FROM p")
def primary_rules(spark, d):
    return _round(_primary(spark, d).select(F.col("l_returnflag").alias("dataset"), rules.rule_key().alias("rule"), "support", "confidence"))


@query()
def meta_rules_crisp(spark, d):
    p = cut(_primary(spark, d))
    return _text(rules.crisp_meta_rules(p, "l_returnflag", 0.3, datasets=p.select("l_returnflag")), "antecedents", "consequents")


@query()
def meta_rules_fuzzy(spark, d):
    return _text(rules.fuzzy_meta_rules(cut(_primary(spark, d)), "l_returnflag", 0.1, "confidence", True, 5), "antecedents", "consequents")


def _graph(spark, d):
    return RuleGraph(cut(rules.association_rules(found(spark, d, max_len=2), "confidence", 0.4)), ["support", "confidence"])


_RG = f"WITH {RULES(LOW, 2)}, g AS (SELECT 'rule::' || array_to_string(a, ',') || '=>' || array_to_string(c, ',') AS id, a, c, sab, sab / sa AS conf FROM r WHERE sab / sa >= 0.4)"


@query(f"{_RG} SELECT id, 'rule' AS kind, round(sab, 6) AS support, round(conf, 6) AS confidence FROM g UNION ALL SELECT DISTINCT unnest(list_concat(a, c)), 'item', NULL, NULL FROM g")
def rule_graph_nodes(spark, d):
    return _round(_graph(spark, d).nodes.select("id", "kind", "support", "confidence"))


@query(f"{_RG} SELECT unnest(a) AS source, id AS target, 'antecedent' AS relation FROM g UNION ALL SELECT id, unnest(c), 'consequent' FROM g")
def rule_graph_edges(spark, d):
    return _graph(spark, d).edges


@query(f"""{_RG} SELECT array_to_string(a, '|') AS antecedents, count(*) AS rule_count, round(min(conf), 6) AS confidence_min, round(max(conf), 6) AS confidence_max, round(avg(conf), 6) AS confidence_mean, round(quantile_cont(conf, 0.25), 6) AS confidence_q25, round(quantile_cont(conf, 0.5), 6) AS confidence_q50, round(quantile_cont(conf, 0.75), 6) AS confidence_q75 FROM g GROUP BY a""")
def rule_graph_summary(spark, d):
    s = _graph(spark, d).summarize("antecedent", ["confidence"])
    return _round(_text(s.select("antecedents", "rule_count", *[f"confidence_{x}" for x in ("min", "max", "mean", "q25", "q50", "q75")]), "antecedents"))


def _stream(spark, d):
    """Days as batches; the window after the last day holds the last three."""
    e = _t(spark, d, "events").where("event_type is not null and ts is not null").select(F.to_date("ts").alias("day"), "user_id", "event_type")
    b = cut(e.groupBy("day", "user_id").agg(F.array_sort(F.collect_set("event_type")).alias("items")))
    days = sorted(r["day"] for r in b.select("day").distinct().collect())
    window = BatchWindow(0.2, 3)
    for day in days:
        window.add(b.where(F.col("day") == day).select("items"))
    return window


_ST = """b AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id || '/' || CAST(ts AS DATE) AS tid, event_type AS item FROM events WHERE event_type IS NOT NULL AND CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM events WHERE event_type IS NOT NULL ORDER BY 1 DESC LIMIT 3)), n AS (SELECT count(DISTINCT tid) AS n FROM b)"""


@query(f"WITH {FI(0.2).replace(B, _ST)} {_FI_SQL}")
def stream_window_itemsets(spark, d):
    return _fi_out(_stream(spark, d).itemsets(spark))


@query(f"WITH {RULES(0.2).replace(B, _ST)} SELECT antecedents, consequents, round(support, 6) AS support, round(confidence, 6) AS confidence FROM m WHERE confidence >= 0.3")
def stream_window_rules(spark, d):
    w = _stream(spark, d)
    return _rules_out(rules.association_rules(w.itemsets(spark), "confidence", 0.3).select("antecedents", "consequents", "support", "confidence"))
