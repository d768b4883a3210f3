"""The queries of the operators for training data, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import BLANKS
from . import heavy, packing, pairs, quality, quantiles, sequences, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark, sf_dir):
    return pairs.cooccurrence(_table(spark, sf_dir, "transactions"), min_count=5, min_share=0.001, min_lift=3.0).select("item_a", "item_b")


def p1_pairs(spark, sf_dir):
    found = pairs.cooccurrence(_table(spark, sf_dir, "transactions"))
    return found.select("item_a", "item_b", "pair_count", "count_a", "count_b", "baskets", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p2_found(spark, sf_dir):
    return quantiles.misstated(_table(spark, sf_dir, "summaries"), _table(spark, sf_dir, "rules"))


def p2_percentiles(spark, sf_dir):
    return quantiles.member_percentiles(_table(spark, sf_dir, "summaries"), _table(spark, sf_dir, "rules"), [0.05, 0.25, 0.5, 0.75, 0.95])


def p3_found(spark, sf_dir):
    return heavy.frequent_items(_table(spark, sf_dir, "transactions"), 0.005).select("item")


def p3_counts(spark, sf_dir):
    return heavy.frequent_items(_table(spark, sf_dir, "transactions"), 0.005).select("item", "occurrences", "total")


def p4_found(spark, sf_dir):
    return sequences.state_orders(_table(spark, sf_dir, "sensors")).select("pattern")


def p4_orders(spark, sf_dir):
    return sequences.state_orders(_table(spark, sf_dir, "sensors"), min_len=1)


def p7_ids(spark, sf_dir):
    return tokens.encode_texts(_table(spark, sf_dir, "documents"))


def p8_containers(spark, sf_dir):
    return packing.pack(tokens.count_tokens(_table(spark, sf_dir, "documents")))


def p8_fill(spark, sf_dir):
    return packing.fill(p8_containers(spark, sf_dir))


def p9_found(spark, sf_dir):
    return quality.unnatural(*(_table(spark, sf_dir, t) for t in ("documents", "common_words", "text_labels")))


def p9_quality(spark, sf_dir):
    return quality.document_quality(*(_table(spark, sf_dir, t) for t in ("documents", "common_words", "text_labels")))


def p9_components(spark, sf_dir):
    return quality.components(*(_table(spark, sf_dir, t) for t in ("documents", "common_words")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_percentiles, p3_found, p3_counts, p4_found, p4_orders, p7_ids, p8_containers, p8_fill, p9_found, p9_quality, p9_components)
}

_STRIP = " || ".join(f"chr({ord(c)})" for c in BLANKS)
_BASKETS = f"""names AS (SELECT DISTINCT tid, trim(i, {_STRIP}) AS item FROM (SELECT tid, unnest(items) AS i FROM transactions WHERE tid IS NOT NULL) WHERE trim(i, {_STRIP}) <> ''),
     total AS (SELECT count(DISTINCT tid) AS n FROM transactions)"""
_PAIRS = f"""WITH {_BASKETS},
     single AS (SELECT item, count(*) AS n FROM names GROUP BY item),
     kept AS (SELECT names.* FROM names JOIN single USING (item), total WHERE single.n >= greatest(5, ceil(0.001 * total.n - 1e-9))),
     pair AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS k FROM kept a JOIN kept b ON a.tid = b.tid AND a.item < b.item GROUP BY 1, 2),
     found AS (SELECT item_a, item_b, k AS pair_count, x.n AS count_a, y.n AS count_b, total.n AS baskets, CAST(k AS DOUBLE) * total.n / (CAST(x.n AS DOUBLE) * y.n) AS lift
               FROM pair JOIN single x ON x.item = item_a JOIN single y ON y.item = item_b, total WHERE k >= greatest(5, ceil(0.001 * total.n - 1e-9)))"""
_EVENTS = f"""events_ AS (
       SELECT DISTINCT house, day, time, state FROM (
         SELECT trim(house, {_STRIP}) AS house, CASE WHEN length(regexp_replace(day, '[^0-9]', '', 'g')) = 8 THEN regexp_replace(day, '[^0-9]', '', 'g') ELSE strftime(time AT TIME ZONE 'UTC', '%Y%m%d') END AS day,
                time, trim(state, {_STRIP}) AS state
         FROM sensors WHERE time >= TIMESTAMPTZ '2020-01-01 00:00:00+00') WHERE house <> '' AND state <> ''),
     total AS (SELECT count(*) AS n FROM (SELECT DISTINCT house, day FROM events_))"""

ORACLE: dict[str, str] = {
    "p1_found": f"{_PAIRS} SELECT item_a, item_b FROM found WHERE lift >= 3",
    "p1_pairs": f"""WITH {_BASKETS}, single AS (SELECT item, count(*) AS n FROM names GROUP BY item),
     pair AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS k FROM names a JOIN names b ON a.tid = b.tid AND a.item < b.item GROUP BY 1, 2),
     every AS (SELECT item_a, item_b, k, x.n AS na, y.n AS nb, total.n AS n, CAST(k AS DOUBLE) * total.n / (CAST(x.n AS DOUBLE) * y.n) AS lift FROM pair JOIN single x ON x.item = item_a JOIN single y ON y.item = item_b, total)
     SELECT item_a, item_b, k AS pair_count, na AS count_a, nb AS count_b, n AS baskets, round(lift, 6) AS lift, round(log2(lift), 6) AS pmi FROM every""",
    "p3_found": f"WITH {_BASKETS} SELECT item FROM names GROUP BY item HAVING count(*) >= ceil(0.005 * (SELECT count(*) FROM names) - 1e-9)",
    "p3_counts": f"WITH {_BASKETS} SELECT item, count(*) AS occurrences, (SELECT count(*) FROM names) AS total FROM names GROUP BY item HAVING count(*) >= ceil(0.005 * (SELECT count(*) FROM names) - 1e-9)",
    "p2_found": """WITH one AS (SELECT rule_id, min(confidence) AS confidence, min(lift) AS lift FROM rules WHERE rule_id IS NOT NULL GROUP BY rule_id),
     member AS (SELECT DISTINCT summary_id, unnest(members) AS rule_id FROM summaries WHERE summary_id IS NOT NULL),
     val AS (SELECT summary_id, 'confidence' AS stat, confidence AS v FROM member JOIN one USING (rule_id) WHERE NOT isnan(confidence) AND confidence BETWEEN 0 AND 1
             UNION ALL SELECT summary_id, 'lift', lift FROM member JOIN one USING (rule_id) WHERE isfinite(lift) AND lift >= 0),
     claim AS (SELECT summary_id, unnest([{'name': 'confidence_q25', 'stat': 'confidence', 'q': 25, 'stated': confidence_q25}, {'name': 'confidence_q50', 'stat': 'confidence', 'q': 50, 'stated': confidence_q50},
               {'name': 'confidence_q75', 'stat': 'confidence', 'q': 75, 'stated': confidence_q75}, {'name': 'lift_q25', 'stat': 'lift', 'q': 25, 'stated': lift_q25}, {'name': 'lift_q50', 'stat': 'lift', 'q': 50, 'stated': lift_q50},
               {'name': 'lift_q75', 'stat': 'lift', 'q': 75, 'stated': lift_q75}]) AS c FROM summaries),
     lim AS (SELECT summary_id, stat, quantile_cont(v, [0.20, 0.45, 0.70]) AS lo, quantile_cont(v, [0.30, 0.55, 0.80]) AS hi FROM val GROUP BY ALL)
     SELECT DISTINCT claim.summary_id, c.name AS stat FROM claim JOIN lim ON lim.summary_id = claim.summary_id AND lim.stat = c.stat
     WHERE c.stated IS NOT NULL AND (c.stated < lo[c.q // 25] OR c.stated > hi[c.q // 25])""",
    "p4_found": f"""WITH {_EVENTS},
     single AS (SELECT state FROM (SELECT DISTINCT house, day, state FROM events_) GROUP BY state HAVING count(*) >= ceil(0.1 * (SELECT n FROM total) - 1e-9)),
     e AS (SELECT events_.* FROM events_ JOIN single USING (state)),
     two AS (SELECT house, day, a.state AS s1, b.state AS s2, min(b.time) AS t FROM e a JOIN e b USING (house, day) WHERE a.time < b.time GROUP BY ALL),
     f2 AS (SELECT s1, s2 FROM two GROUP BY ALL HAVING count(*) >= ceil(0.1 * (SELECT n FROM total) - 1e-9)),
     three AS (SELECT house, day, s1, s2, e.state AS s3, min(e.time) AS t FROM two JOIN f2 USING (s1, s2) JOIN e USING (house, day) WHERE e.time > two.t GROUP BY ALL),
     f3 AS (SELECT s1, s2, s3 FROM three GROUP BY ALL HAVING count(*) >= ceil(0.1 * (SELECT n FROM total) - 1e-9)),
     four AS (SELECT house, day, s1, s2, s3, e.state AS s4, min(e.time) AS t FROM three JOIN f3 USING (s1, s2, s3) JOIN e USING (house, day) WHERE e.time > three.t GROUP BY ALL),
     f4 AS (SELECT s1, s2, s3, s4 FROM four GROUP BY ALL HAVING count(*) >= ceil(0.1 * (SELECT n FROM total) - 1e-9)),
     five AS (SELECT house, day, s1, s2, s3, s4, e.state AS s5, min(e.time) AS t FROM four JOIN f4 USING (s1, s2, s3, s4) JOIN e USING (house, day) WHERE e.time > four.t GROUP BY ALL),
     f5 AS (SELECT s1, s2, s3, s4, s5 FROM five GROUP BY ALL HAVING count(*) >= ceil(0.1 * (SELECT n FROM total) - 1e-9)),
     six AS (SELECT house, day, s1, s2, s3, s4, s5, e.state AS s6 FROM five JOIN f5 USING (s1, s2, s3, s4, s5) JOIN e USING (house, day) WHERE e.time > five.t GROUP BY ALL),
     f6 AS (SELECT s1, s2, s3, s4, s5, s6 FROM six GROUP BY ALL HAVING count(*) >= ceil(0.1 * (SELECT n FROM total) - 1e-9))
     SELECT concat_ws('>', s1, s2, s3) AS pattern FROM f3 UNION ALL SELECT concat_ws('>', s1, s2, s3, s4) FROM f4 UNION ALL SELECT concat_ws('>', s1, s2, s3, s4, s5) FROM f5 UNION ALL SELECT concat_ws('>', s1, s2, s3, s4, s5, s6) FROM f6""",
}
