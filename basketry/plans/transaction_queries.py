"""Queries of the itemset and rule operators over the varied baskets of ``transactions``, each with its SQL.

Thousands of names, long tails and correlated groups: at these thresholds most itemsets fall away, some are not
closed, and lengths are not bounded. The SQL goes on to longer itemsets as long as the data has any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import BLANKS, clean_name
from ..operators import itemsets, rules, significance, taxonomy
from ..operators.hierarchy import hierarchy
from ..session import cut
from ..streaming.windows import BatchWindow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Shares of the baskets: for itemsets, for rules, below which an itemset is rare.
LOW, SUPP, RARE = 0.004, 0.006, 0.02
#: Deep enough for itemsets that are not closed.
DEEP = 0.0015

_STRIP = " || ".join(f"chr({ord(c)})" for c in BLANKS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _out(frame: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, doubles to six places."""
    kinds = dict(frame.dtypes)
    made = {c: F.array_join(c, "|") if kinds[c].startswith("array") else F.round(c, 6) if kinds[c] == "double" else F.col(c) for c in columns or frame.columns}
    return frame.select(*[x.alias(c) for c, x in made.items()])


# -- base relations --------------------------------------------------------------------------------


def shop_baskets(spark, d) -> DataFrame:
    """``(tid, items)``: distinct non-void names of each tid; rows of an equal tid are one basket."""
    rows = _t(spark, d, "transactions").where("tid is not null").select("tid", F.explode_outer("items").alias("item")).select("tid", clean_name(F.col("item")).alias("item"))
    return itemsets.to_baskets(rows)


def shop_rows(spark, d) -> DataFrame:
    return _t(spark, d, "transactions").where("tid is not null").select("tid", F.explode("items").alias("item")).select("tid", clean_name(F.col("item")).alias("item")).where("item is not null").distinct()


_B = f"""b AS (SELECT DISTINCT tid, trim(i, {_STRIP}) AS item FROM (SELECT tid, unnest(items) AS i FROM transactions WHERE tid IS NOT NULL) WHERE trim(i, {_STRIP}) <> ''),
  n AS (SELECT count(DISTINCT tid) AS n FROM transactions)"""


def _fi(share: float, longest: int = 6) -> str:
    """SQL of the frequent itemsets, level by level: fi(itemset list, k, s). The last level has to be empty."""
    least = f"(SELECT ceil({share} * n - 1e-9) FROM n)"
    steps = [_B, f"f1 AS (SELECT [item] AS itemset, count(*) AS k FROM b GROUP BY item HAVING count(*) >= {least})", "c AS (SELECT tid, item FROM b WHERE item IN (SELECT itemset[1] FROM f1))", "t1 AS (SELECT tid, [item] AS itemset FROM c)"]
    for k in range(2, longest + 1):
        steps.append(f"x{k} AS (SELECT t.tid, list_append(t.itemset, c.item) AS itemset FROM t{k - 1} t JOIN c ON c.tid = t.tid AND c.item > t.itemset[-1])")
        steps.append(f"f{k} AS (SELECT itemset, count(*) AS k FROM x{k} GROUP BY itemset HAVING count(*) >= {least})")
        steps.append(f"t{k} AS (SELECT x{k}.* FROM x{k} JOIN f{k} USING (itemset))")
    every = " UNION ALL ".join(f"SELECT itemset, k FROM f{k}" for k in range(1, longest + 1))
    return ", ".join(steps) + f", fi AS (SELECT itemset, k, k / (SELECT n FROM n)::DOUBLE AS s FROM ({every}))"


SPLITS_SQL = """split AS (SELECT itemset, s, list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS a, list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS c
       FROM (SELECT itemset, s, unnest(range(1, (2 ** len(itemset))::BIGINT - 1)) AS mask FROM fi WHERE len(itemset) > 1)),
     r AS (SELECT split.a, split.c, split.s AS sab, x.s AS sa, y.s AS sb FROM split JOIN fi x ON x.itemset = split.a JOIN fi y ON y.itemset = split.c)"""
_SIDES = "array_to_string(a, '|') AS antecedents, array_to_string(c, '|') AS consequents"
_SET = "array_to_string(itemset, '|') AS itemset, len(itemset)::INT AS size, k AS count, round(s, 6) AS support"


def levels_sql(share: float, longest: int) -> str:
    """What :func:`_fi` adds to tables ``b(tid, item)`` and ``n(n)``."""
    return _fi(share, longest)[len(_B) :]


def found(spark, d, share=LOW) -> DataFrame:
    return itemsets.frequent_itemsets(shop_baskets(spark, d), share)


def _sets(frame: DataFrame) -> DataFrame:
    return _out(frame, "itemset", "size", "count", "support")


# -- itemsets --------------------------------------------------------------------------------------


@query(f"WITH {_fi(LOW)} SELECT {_SET} FROM fi")
def shop_itemsets(spark, d):
    return _sets(found(spark, d))


@query(f"WITH {_fi(LOW)} SELECT {_SET} FROM fi")
def shop_apriori(spark, d):
    total = shop_baskets(spark, d).count()
    return _sets(itemsets.apriori(shop_rows(spark, d), LOW, total))


@query(f"WITH {_fi(LOW)} SELECT {_SET} FROM fi")
def shop_eclat(spark, d):
    total = shop_baskets(spark, d).count()
    return _sets(itemsets.eclat(shop_rows(spark, d), LOW, total))


@query(f"WITH {_fi(LOW)} SELECT {_SET} FROM fi")
def shop_fpgrowth(spark, d):
    return _sets(itemsets.fpgrowth(shop_baskets(spark, d), LOW))


# one line per itemset and subset: subsets of equal count are not closed
_OPEN = "below AS (SELECT list_filter(y.itemset, lambda x, i: i <> p) AS itemset, k FROM (SELECT itemset, k, unnest(range(1, len(itemset) + 1)) AS p FROM fi WHERE len(itemset) > 1) y)"


@query(f"WITH {_fi(DEEP)}, {_OPEN} SELECT {_SET} FROM fi WHERE (itemset, k) NOT IN (SELECT (itemset, k) FROM below)")
def shop_closed(spark, d):
    return _sets(itemsets.closed_itemsets(found(spark, d, DEEP)))


@query(f"WITH {_fi(LOW)} SELECT {_SET} FROM fi x WHERE NOT EXISTS (SELECT 1 FROM fi y WHERE len(y.itemset) = len(x.itemset) + 1 AND list_has_all(y.itemset, x.itemset))")
def shop_maximal(spark, d):
    return _sets(itemsets.maximal_itemsets(found(spark, d)))


@query(f"WITH {_fi(DEEP)} SELECT array_to_string(itemset, '|') AS itemset, round(s, 6) AS support FROM fi")
def shop_support_from_closed(spark, d):
    every = found(spark, d, DEEP)
    return _out(itemsets.support_from_closed(every, itemsets.closed_itemsets(every)))


@query(f"WITH {_fi(LOW)} SELECT {_SET} FROM fi WHERE len(itemset) >= 2 ORDER BY k DESC, len(itemset), itemset LIMIT 40")
def shop_top_k(spark, d):
    return _sets(itemsets.top_k_itemsets(shop_baskets(spark, d), 40, min_len=2))


_RARE = f"""{_fi(RARE, 4)}, cut AS (SELECT ceil({RARE} * n - 1e-9) AS t FROM n), one AS (SELECT item, count(*) AS k FROM b GROUP BY item),
   two AS (SELECT [x.item, y.item] AS itemset, count(*) AS k FROM c x JOIN c y ON x.tid = y.tid AND x.item < y.item GROUP BY ALL HAVING count(*) < (SELECT t FROM cut)),
   three AS (SELECT itemset, count(*) AS k FROM x3 WHERE [itemset[1], itemset[3]] IN (SELECT itemset FROM f2) AND [itemset[2], itemset[3]] IN (SELECT itemset FROM f2) GROUP BY itemset HAVING count(*) < (SELECT t FROM cut)),
   rare AS (SELECT [item] AS itemset, k FROM one WHERE k < (SELECT t FROM cut) UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)"""


@query(f"WITH {_RARE} SELECT array_to_string(itemset, '|') AS itemset, len(itemset)::INT AS size, k AS count, round(k / (SELECT n FROM n), 6) AS support FROM rare WHERE len(itemset) >= 2 AND k >= 5")
def shop_minimal_rare(spark, d):
    return _sets(itemsets.minimal_rare_itemsets(shop_baskets(spark, d), RARE, least=5, min_len=2))


_UTIL = f"""{_B}, p AS (SELECT item, max(profit) AS profit FROM profits WHERE profit > 0 AND NOT isnan(profit) GROUP BY item), u AS (SELECT tid, item, profit AS u FROM b JOIN p USING (item)),
   w AS (SELECT sum(u) AS w, count(DISTINCT tid) AS n FROM u), t AS (SELECT tid, sum(u) AS tu FROM u GROUP BY tid),
   h1 AS (SELECT [item] AS itemset, sum(u) AS utility, sum(tu) AS twu, count(*) AS k FROM u JOIN t USING (tid) GROUP BY item),
   v AS (SELECT tid, item, u FROM u WHERE item IN (SELECT itemset[1] FROM h1 WHERE twu >= 0.01 * (SELECT w FROM w))),
   y2 AS (SELECT x.tid, [x.item, y.item] AS itemset, x.u + y.u AS u FROM v x JOIN v y ON x.tid = y.tid AND x.item < y.item),
   h2 AS (SELECT itemset, sum(u) AS utility, sum(tu) AS twu, count(*) AS k FROM y2 JOIN t USING (tid) GROUP BY itemset HAVING sum(tu) >= 0.009999 * (SELECT w FROM w)),
   y3 AS (SELECT z.tid, list_append(itemset, v.item) AS itemset, z.u + v.u AS u FROM y2 z JOIN h2 USING (itemset) JOIN v ON v.tid = z.tid AND v.item > z.itemset[2]),
   h3 AS (SELECT itemset, sum(u) AS utility, sum(tu) AS twu, count(*) AS k FROM y3 JOIN t USING (tid) GROUP BY itemset HAVING sum(tu) >= 0.009999 * (SELECT w FROM w)),
   y4 AS (SELECT z.tid, list_append(itemset, v.item) AS itemset, z.u + v.u AS u FROM y3 z JOIN h3 USING (itemset) JOIN v ON v.tid = z.tid AND v.item > z.itemset[3]),
   h4 AS (SELECT itemset, sum(u) AS utility, sum(tu) AS twu, count(*) AS k FROM y4 JOIN t USING (tid) GROUP BY itemset)"""


@query(f"WITH {_UTIL} SELECT array_to_string(itemset, '|') AS itemset, len(itemset)::INT AS size, round(utility, 2) AS utility, k AS count FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4) WHERE utility >= 0.01 * (SELECT w FROM w)")
def shop_high_utility(spark, d):
    profit = _t(spark, d, "profits").where("profit > 0 and not isnan(profit)").groupBy("item").agg(F.max("profit").alias("profit"))
    rows = shop_rows(spark, d).join(profit.select("item"), "item", "left_semi").withColumn("qty", F.lit(1.0))
    out = itemsets.high_utility_itemsets(itemsets.utility_table(rows, profit), 0.01)
    return _out(out.withColumn("utility", F.round("utility", 2)), "itemset", "size", "utility", "count")


# -- rules -----------------------------------------------------------------------------------------

_MEASURES = {
    "antecedent_support": "sa", "consequent_support": "sb", "support": "sab", "confidence": "sab / sa", "lift": "sab / sa / sb", "leverage": "sab - sa * sb",
    "jaccard": "sab / (sa + sb - sab)", "cosine": "sab / sqrt(sa * sb)", "kulczynski": "(sab / sa + sab / sb) / 2",
}


@query(f"WITH {_fi(SUPP)}, {SPLITS_SQL} SELECT {_SIDES}, {', '.join(f'round({x}, 6) AS {c}' for c, x in _MEASURES.items())} FROM r WHERE sab / sa >= 0.25")
def shop_rules(spark, d):
    return _out(rules.association_rules(found(spark, d, SUPP), "confidence", 0.25), "antecedents", "consequents", *_MEASURES)


@query(f"WITH {_fi(SUPP)}, {SPLITS_SQL} SELECT {_SIDES}, round(sab / sa / sb, 6) AS lift FROM r WHERE sab / sa / sb >= 2")
def shop_rules_by_lift(spark, d):
    return _out(rules.association_rules(found(spark, d, SUPP), "lift", 2.0), "antecedents", "consequents", "lift")


@query(f"WITH {_fi(SUPP)}, {SPLITS_SQL} SELECT {_SIDES}, round(sab, 6) AS support, round(sab / sa, 6) AS confidence FROM r WHERE sab / sa >= 0.4 ORDER BY sab DESC, sab / sa DESC, a, c LIMIT 25")
def shop_top_k_rules(spark, d):
    return _out(rules.top_k_rules(shop_baskets(spark, d), 25, 0.4, max_len=None, min_supp=SUPP), "antecedents", "consequents", "support", "confidence")


@query(f"""WITH {_fi(SUPP)}, {SPLITS_SQL}, base AS (SELECT a, c, sab / sa AS conf FROM r WHERE sab / sa >= 0.3)
   SELECT {_SIDES}, round(conf, 6) AS confidence FROM base x WHERE NOT EXISTS (SELECT 1 FROM base y WHERE y.c = x.c AND len(y.a) < len(x.a) AND list_has_all(x.a, y.a) AND x.conf - y.conf <= 1e-12)""")
def shop_productive(spark, d):
    return _out(rules.prune_unproductive_rules(cut(rules.association_rules(found(spark, d, SUPP), "confidence", 0.3))), "antecedents", "consequents", "confidence")


_NEG = f"""{_fi(0.08, 3)}, one AS (SELECT itemset[1] AS item, k FROM f1), pair AS (SELECT x.item AS p, y.item AS q, coalesce(k.k, 0) AS k, x.k AS kp, y.k AS kq FROM one x JOIN one y ON x.item <> y.item
     LEFT JOIN (SELECT x.item AS p, y.item AS q, count(*) AS k FROM c x JOIN c y ON x.tid = y.tid AND x.item <> y.item GROUP BY ALL) k ON k.p = x.item AND k.q = y.item),
   s AS (SELECT p AS x, '~' || q AS y, kp - k AS k, kp AS kx FROM pair UNION ALL SELECT '~' || q, p, kp - k, (SELECT n FROM n) - kq FROM pair UNION ALL SELECT '~' || p, '~' || q, (SELECT n FROM n) - kp - kq + k, (SELECT n FROM n) - kp FROM pair)"""


@query(f"WITH {_NEG} SELECT x AS antecedents, y AS consequents, round(k / (SELECT n FROM n), 6) AS support, round(k / kx, 6) AS confidence FROM s WHERE k >= ceil(0.08 * (SELECT n FROM n) - 1e-9) AND k / kx >= 0.9")
def shop_negative_rules(spark, d):
    return _out(rules.negative_association_rules(shop_baskets(spark, d), 0.08, min_threshold=0.9, max_len=2), "antecedents", "consequents", "support", "confidence")


_COMMON = f"{_fi(0.02, 3)}, {SPLITS_SQL}, common AS (SELECT a, c[1] AS cons, sab, sab / sa AS conf FROM r WHERE len(c) = 1 AND sab / sa >= 0.3), tb AS (SELECT tid, list(item) AS items FROM b GROUP BY tid)"
_HIT = "hit AS (SELECT a, cons, sab, conf, tid, list_contains(items, cons) AS kept FROM common JOIN b f ON f.item = a[1] JOIN tb USING (tid) WHERE list_has_all(items, a))"


@query(f"""WITH {_COMMON}, {_HIT},
   az AS (SELECT a, cons, sab, conf, item AS z, count(*) AS n_az, count(*) FILTER (NOT kept) AS n_ex FROM hit JOIN b USING (tid) WHERE item <> cons AND NOT list_contains(a, item) GROUP BY ALL HAVING count(*) FILTER (NOT kept) >= (SELECT ceil(0.002 * n - 1e-9) FROM n)),
   z AS (SELECT q.z, q.cons, count(*) AS n_z, count(*) FILTER (NOT list_contains(items, q.cons)) AS n_zf FROM (SELECT DISTINCT z, cons FROM az) q JOIN b ON b.item = q.z JOIN tb USING (tid) GROUP BY ALL)
   SELECT array_to_string(a, '|') AS antecedents, cons AS consequent, z AS condition, round(sab, 6) AS common_support, round(conf, 6) AS common_confidence, round(n_ex / (SELECT n FROM n), 6) AS exception_support,
     round(n_ex / n_az, 6) AS exception_confidence, round(n_zf / n_z, 6) AS reference_confidence FROM az JOIN z USING (z, cons) WHERE n_ex / n_az >= 0.6 AND n_zf / n_z <= 0.9""")
def shop_exceptions(spark, d):
    b = cut(shop_baskets(spark, d))
    common = rules.association_rules(itemsets.frequent_itemsets(b, 0.02), "confidence", 0.3, max_consequent=1)
    return _out(rules.exception_rules(b, min_exception_supp=0.002, min_exception_conf=0.6, max_reference_conf=0.9, rules=common))


@query(f"""WITH {_COMMON}, {_HIT},
   sz AS (SELECT a, cons, count(*) AS n_a, count(*) FILTER (NOT kept) AS n_f FROM hit GROUP BY ALL),
   ac AS (SELECT a, cons, sab, conf, item AS e, count(*) AS n_ac, count(*) FILTER (NOT kept) AS n_an FROM hit JOIN b USING (tid) WHERE item <> cons AND NOT list_contains(a, item) GROUP BY ALL)
   SELECT array_to_string(a, '|') AS antecedents, cons AS consequent, e AS anomaly, round(sab, 6) AS common_support, round(conf, 6) AS common_confidence, n_f AS anomalous_cases, round(n_an / (SELECT n FROM n), 6) AS anomalous_support,
     round(n_an / n_f, 6) AS anomalous_confidence, round(n_ac / n_a, 6) AS reference_confidence FROM ac JOIN sz USING (a, cons) WHERE n_an >= ceil(0.005 * (SELECT n FROM n) - 1e-9) AND n_an / n_f >= 0.2 AND n_ac / n_a <= 0.5""")
def shop_anomalies(spark, d):
    b = cut(shop_baskets(spark, d))
    common = rules.association_rules(itemsets.frequent_itemsets(b, 0.02), "confidence", 0.3, max_consequent=1)
    return _out(rules.anomalous_rules(b, min_anomalous_supp=0.005, min_anomalous_conf=0.2, max_reference_conf=0.5, rules=common))


_P = f"""{_fi(0.02, 3)}, {SPLITS_SQL}, q AS (SELECT {_SIDES}, round(sab * n)::BIGINT AS ac, round(sa * n)::BIGINT AS ka, round(sb * n)::BIGINT AS kc, n AS nn FROM r, n)"""
_TERM = "exp(lgamma(ka + 1) - lgamma(i + 1) - lgamma(ka - i + 1) + lgamma(nn - ka + 1) - lgamma(kc - i + 1) - lgamma(nn - ka - kc + i + 1) - lgamma(nn + 1) + lgamma(kc + 1) + lgamma(nn - kc + 1))"


def _tested(spark, d, method):
    b = cut(shop_baskets(spark, d))
    r = cut(rules.association_rules(itemsets.frequent_itemsets(b, 0.02), "support", 0.0))
    out, n = r.select("antecedents", "consequents"), b.count()
    for way in ("greater", "less", "two-sided"):
        tested = significance.rule_significance(r, n, method, way).select("antecedents", "consequents", F.round("p_value", 5).alias(way.replace("-", "_")))
        out = out.join(tested, ["antecedents", "consequents"])
    return _out(out, "antecedents", "consequents", "greater", "less", "two_sided")


@query(f"""WITH {_P}, t AS (SELECT antecedents, consequents, least(1, sum({_TERM}) FILTER (i >= ac)) AS g, least(1, sum({_TERM}) FILTER (i <= ac)) AS l
    FROM (SELECT *, unnest(range(greatest(0, ka + kc - nn), least(ka, kc) + 1)) AS i FROM q) GROUP BY antecedents, consequents)
   SELECT antecedents, consequents, round(g, 5) AS greater, round(l, 5) AS less, round(least(1, 2 * least(g, l)), 5) AS two_sided FROM t""")
def shop_fisher(spark, d):
    return _tested(spark, d, "fisher")


@query(f"""WITH {_B}, one AS (SELECT item, count(*) AS k FROM b GROUP BY item HAVING count(*) >= (SELECT ceil(0.02 * n - 1e-9) FROM n)), c AS (SELECT * FROM b WHERE item IN (SELECT item FROM one)),
   p AS (SELECT x.item AS a, y.item AS c, count(*) AS k FROM c x JOIN c y ON x.tid = y.tid AND x.item <> y.item GROUP BY ALL HAVING count(*) >= (SELECT ceil(0.02 * n - 1e-9) FROM n))
   SELECT p.a AS antecedents, p.c AS consequents, sign(p.k::DOUBLE * n - x.k::DOUBLE * y.k) AS direction, round(n * pow(p.k::DOUBLE * n - x.k::DOUBLE * y.k, 2) / (x.k::DOUBLE * y.k * (n - x.k) * (n - y.k)), 6) AS statistic
   FROM p JOIN one x ON x.item = p.a JOIN one y ON y.item = p.c, n""")
def shop_chi2(spark, d):
    b = cut(shop_baskets(spark, d))
    r = cut(rules.association_rules(itemsets.frequent_itemsets(b, 0.02), "support", 0.0))
    tested = significance.rule_significance(r, b.count(), "chi2", "greater")
    return _out(tested.withColumn("direction", F.when(F.col("statistic") == 0, 0.0).when(F.col("p_value") < 0.5, 1.0).otherwise(-1.0)), "antecedents", "consequents", "direction", "statistic")


# -- hierarchies, groups, streams ------------------------------------------------------------------


def shop_taxonomy(spark, d) -> taxonomy.Taxonomy:
    """The part of ``taxonomy`` that hangs on no ring."""
    pairs = _t(spark, d, "taxonomy").select(clean_name(F.col("child")).alias("child"), clean_name(F.col("parent")).alias("parent")).dropna().distinct()
    hung = hierarchy(_t(spark, d, "taxonomy"), paths=False).where("depth = 0").select(F.col("item").alias("child")).distinct()
    return taxonomy.Taxonomy(pairs.join(hung, "child", "left_anti").select("child", "parent"))


_GEN = f"""WITH RECURSIVE {_B}, link AS (SELECT DISTINCT trim(child, {_STRIP}) AS child, trim(parent, {_STRIP}) AS parent FROM taxonomy WHERE trim(child, {_STRIP}) <> '' AND trim(parent, {_STRIP}) <> ''),
   up0 AS (SELECT child AS item, parent AS ancestor FROM link UNION SELECT up0.item, link.parent FROM up0 JOIN link ON link.child = up0.ancestor),
   hung AS (SELECT item FROM up0 WHERE item = ancestor UNION SELECT u.item FROM up0 u JOIN up0 r ON r.item = u.ancestor AND r.item = r.ancestor),
   up AS (SELECT * FROM up0 WHERE item NOT IN (SELECT item FROM hung)), e AS (SELECT tid, item FROM b UNION SELECT tid, ancestor FROM b JOIN up USING (item)),
   one AS (SELECT item, count(*) AS k FROM e GROUP BY item HAVING count(*) >= (SELECT ceil(0.03 * n - 1e-9) FROM n)), g AS (SELECT * FROM e WHERE item IN (SELECT item FROM one)),
   two AS (SELECT x.item AS p, y.item AS q, count(*) AS k FROM g x JOIN g y ON x.tid = y.tid AND x.item < y.item GROUP BY ALL HAVING count(*) >= (SELECT ceil(0.03 * n - 1e-9) FROM n)),
   apart AS (SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM up WHERE (up.item = p AND up.ancestor = q) OR (up.item = q AND up.ancestor = p)))"""


@query(f"{_GEN} SELECT item AS itemset, 1 AS size, k AS count, round(k / (SELECT n FROM n), 6) AS support FROM one UNION ALL SELECT p || '|' || q, 2, k, round(k / (SELECT n FROM n), 6) FROM apart")
def shop_generalized(spark, d):
    return _sets(taxonomy.generalized_itemsets(shop_baskets(spark, d), shop_taxonomy(spark, d), 0.03, 2))


def daily_baskets(spark, d) -> DataFrame:
    """``(day, items)``: each basket on the earliest of its days; baskets without a day are left out."""
    days = _t(spark, d, "transactions").where("tid is not null and day is not null").groupBy("tid").agg(F.min("day").alias("day"))
    return shop_baskets(spark, d).join(days, "tid").select("day", "items")


def _days(spark, d) -> list:
    return sorted(r["day"] for r in daily_baskets(spark, d).select("day").distinct().collect())


_WINDOW = f"""WITH d AS (SELECT tid, min(day) AS day FROM transactions WHERE tid IS NOT NULL AND day IS NOT NULL GROUP BY tid),
   w AS (SELECT tid FROM d WHERE day IN (SELECT DISTINCT day FROM d ORDER BY day DESC LIMIT 3)), n AS (SELECT count(*) AS n FROM w),
   b AS (SELECT DISTINCT tid, trim(i, {_STRIP}) AS item FROM (SELECT tid, unnest(items) AS i FROM transactions WHERE tid IN (SELECT tid FROM w)) WHERE trim(i, {_STRIP}) <> '')"""


@query(f"{_WINDOW}{levels_sql(0.02, 4)} SELECT array_to_string(itemset, '|') AS itemset, k AS count, round(s, 6) AS support FROM fi")
def shop_stream_itemsets(spark, d):
    return _out(_fed(spark, d).itemsets(), "itemset", "count", "support")


@query(f"{_WINDOW}{levels_sql(0.02, 4)}, {SPLITS_SQL} SELECT {_SIDES}, round(sab, 6) AS support, round(sab / sa, 6) AS confidence FROM r WHERE sab / sa >= 0.3")
def shop_stream_rules(spark, d):
    return _out(_fed(spark, d).rules(min_threshold=0.3), "antecedents", "consequents", "support", "confidence")


def _fed(spark, d) -> BatchWindow:
    """A window of the last three days, fed day after day."""
    rows = cut(daily_baskets(spark, d))
    window = BatchWindow(0.02, 3)
    for day in _days(spark, d):
        window.add(rows.where(F.col("day") == F.lit(day)).select("items"))
    return window
