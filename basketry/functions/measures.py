"""Interest measures of rules as column expressions of three supports.

``ab``, ``a`` and ``b`` are the supports of the whole rule, its antecedent and its consequent. Every quotient
by zero is 0, unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty))


def confidence(ab, a, b):
    return quotient(ab, a)


def lift(ab, a, b):
    return quotient(confidence(ab, a, b), b)


def leverage(ab, a, b):
    return ab - a * b


def certainty_factor(ab, a, b):
    conf = confidence(ab, a, b)
    gain = F.when(conf > b, quotient(conf - b, 1 - b)).when(conf < b, quotient(conf - b, b)).otherwise(F.lit(0.0))
    return F.when(a == 0, F.lit(0.0)).otherwise(gain)


def jaccard(ab, a, b):
    return quotient(ab, a + b - ab)


def cosine(ab, a, b):
    return quotient(ab, F.sqrt(a * b))


def kulczynski(ab, a, b):
    return (quotient(ab, a) + quotient(ab, b)) / 2


def all_confidence(ab, a, b):
    return quotient(ab, F.greatest(a, b))


def max_confidence(ab, a, b):
    return F.greatest(quotient(ab, a), quotient(ab, b))


def added_value(ab, a, b):
    return F.when(a > 0, confidence(ab, a, b) - b).otherwise(F.lit(0.0))


def zhangs_metric(ab, a, b):
    return quotient(ab - a * b, F.greatest(ab * (1 - a), b * (a - ab)))


def yules_q(ab, a, b):
    agree, differ = ab * (1 - a - b + ab), (a - ab) * (b - ab)
    return quotient(agree - differ, agree + differ)


def conviction(ab, a, b):
    """Infinite where the confidence is 1."""
    conf = confidence(ab, a, b)
    return F.when(conf >= 1, F.lit(float("inf"))).otherwise((1 - b) / F.when(conf < 1, 1 - conf))


#: The twelve measures that rules can be ranked by, in the order of their columns.
MEASURES = {
    "confidence": confidence, "lift": lift, "leverage": leverage, "certainty_factor": certainty_factor, "jaccard": jaccard, "cosine": cosine,
    "kulczynski": kulczynski, "all_confidence": all_confidence, "max_confidence": max_confidence, "added_value": added_value,
    "zhangs_metric": zhangs_metric, "yules_q": yules_q,
}
#: Columns of a full rule table, in order.
RULE_COLUMNS = ["antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage", "conviction", "certainty_factor", *list(MEASURES)[4:]]


def measure(name: str, ab: Column, a: Column, b: Column) -> Column:
    if name == "support":
        return ab
    if name == "antecedent_support":
        return a
    if name == "consequent_support":
        return b
    if name == "conviction":
        return conviction(ab, a, b)
    if name not in MEASURES:
        raise ValueError(f"unknown measure {name!r}")
    return MEASURES[name](ab, a, b)


def with_measures(rules, metric: str | None = None, min_threshold: float = 0.0, with_conviction: bool = True):
    """``rules`` (with the three supports) filtered by one measure and then given all of them."""
    ab, a, b = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    if metric is not None:
        rules = rules.where(measure(metric, ab, a, b) >= F.lit(float(min_threshold)))
    names = [n for n in RULE_COLUMNS[3:] if with_conviction or n != "conviction"]
    return rules.select("*", *[measure(n, ab, a, b).alias(n) for n in names])
