"""Fuzzy itemsets: supports per alpha level, kept whole, and fuzzy rules over complements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.membership import alpha_levels, fuzzy_support
from . import itemsets as I


def _degrees(frame: DataFrame, items: str, degrees: str) -> DataFrame:
    """Largest degree of each item of a transaction; degrees outside 0..1 are an error, zeros dropped."""
    pairs = F.arrays_zip(F.coalesce(F.col(items), F.array().cast("array<string>")).alias("i"), F.coalesce(F.col(degrees), F.array().cast("array<double>")).alias("d"))
    bad = F.exists(pairs, lambda s: (s["d"] < 0) | (s["d"] > 1) | F.isnan(s["d"]))
    good = F.filter(F.when(bad, F.raise_error(F.lit("degrees must lie in [0, 1]"))).otherwise(pairs), lambda s: (s["d"] > 0) & s["i"].isNotNull())
    table = frame.withColumn("_sorted", F.array_sort(good))
    # sorted by item and degree, the last of equal items has the largest degree
    table = table.withColumn("_top", F.filter("_sorted", lambda x, k: (k == F.size("_sorted") - 1) | (F.get("_sorted", k + 1)["i"] != x["i"])))
    # most rows have nothing to mend and skip the steps above
    plain = (F.size(items) == F.size(degrees)) & (F.size(F.array_distinct(items)) == F.size(items)) & (F.size(F.array_compact(items)) == F.size(items)) & (F.size(F.array_compact(degrees)) == F.size(degrees)) & (F.array_min(degrees) > 0) & (F.array_max(degrees) <= 1)
    mended = F.when(plain, F.struct(F.col(items).alias("i"), F.col(degrees).alias("d"))).otherwise(F.struct(F.col("_top.i").alias("i"), F.col("_top.d").alias("d")))
    return table.select(*[c for c in frame.columns if c not in (items, degrees)], mended.alias("_s")).select(*[c for c in frame.columns if c not in (items, degrees)], F.col("_s.i").alias(items), F.col("_s.d").alias(degrees))


def fuzzy_itemsets(frame: DataFrame, min_supp: float, num_alpha: int = 10, items: str = "items", degrees: str = "degrees", group: str | None = None, max_len: int | None = None) -> DataFrame:
    """``([group,] itemset, size, levels array<double>, support)``: itemsets whose mean support over the alpha
    levels reaches ``min_supp``; the t-norm is the minimum. Empty transactions count."""
    I.check_share(min_supp)
    alpha_levels(num_alpha)
    found = I.mine(_degrees(frame, items, degrees), min_supp, items, degrees, group, max_len, I.Degrees(num_alpha))
    levels = F.transform("sums", lambda s: s / F.col("n"))
    return found.select(*([group] if group else []), "itemset", "size", levels.alias("levels")).withColumn("support", fuzzy_support(F.col("levels")))


def fuzzy_negative_itemsets(frame: DataFrame, min_supp: float, num_alpha: int, negate_items: Sequence[str], items: str = "items", degrees: str = "degrees", max_len: int | None = None) -> DataFrame:
    """Itemsets over items and their complements, complemented level by level: at level ``a`` the item ``~x``
    holds where ``x`` does not reach ``a``.

    The complement is one of sets, level by level, and not of degrees. Complements are made of the items' vectors
    within the miner, so transactions stay as they are.
    """
    I.check_share(min_supp)
    alpha_levels(num_alpha)
    forbid = {i: {I.NEGATION + i} for i in negate_items} | {I.NEGATION + i: {i} for i in negate_items}
    found = I.mine(_degrees(frame, items, degrees), min_supp, items, degrees, max_len=max_len, payload=I.FuzzyLiterals(num_alpha, negate_items), forbid=forbid)
    levels = F.transform("sums", lambda s: s / F.col("n"))
    return found.select("itemset", "size", levels.alias("levels")).withColumn("support", fuzzy_support(F.col("levels")))


def fuzzy_negative_association_rules(frame: DataFrame, min_supp: float, num_alpha: int = 10, metric: str = "FConf", min_threshold: float = 0.8, negate_items: Sequence[str] | None = None, only_negative: bool = True, items: str = "items", degrees: str = "degrees", max_len: int | None = None) -> DataFrame:
    from .rules import NEGATION, fuzzy_association_rules

    if negate_items is None:
        negate_items = sorted(r["itemset"][0] for r in fuzzy_itemsets(frame, min_supp, num_alpha, items, degrees, max_len=1).select("itemset").collect())
    rules = fuzzy_association_rules(fuzzy_negative_itemsets(frame, min_supp, num_alpha, negate_items, items, degrees, max_len), metric, min_threshold)
    negative = F.exists("antecedents", lambda x: x.startswith(NEGATION)) | F.exists("consequents", lambda x: x.startswith(NEGATION))
    return rules.where(negative) if only_negative else rules
