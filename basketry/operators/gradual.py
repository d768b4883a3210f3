"""Gradual rules: the more of one attribute, the more (or less) of another."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import itemsets as I


def _attributes(frame: DataFrame, attributes: Sequence[str] | None) -> list[str]:
    names = list(attributes) if attributes is not None else [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType)]
    if not names:
        raise ValueError("there are no numeric attributes")
    return names


def sign_patterns(frame: DataFrame, attributes: Sequence[str], max_rows: int | None = None, seed: int = 0, block_rows: int = 4_000) -> tuple[DataFrame, int]:
    """``(signs array<int>, n)`` over all pairs of rows, and the number of rows.

    Equal rows are merged first and carry weights. The pairs of the remaining rows are compared block against
    block: each row is sent to the pairs of blocks that its own takes part in, so all cores share the work
    and no pair of blocks is more than some ``block_rows`` squared comparisons, whatever the number of rows. The
    number of patterns is at most 3 to the number of attributes.
    """
    rows = frame.select(*[F.col(a).cast("double").alias(f"a{k}") for k, a in enumerate(attributes)]).dropna()
    total = rows.count()
    if max_rows is not None and total > max_rows:
        rows = rows.orderBy(F.rand(seed)).limit(max_rows)
        total = max_rows
    names = [f"a{k}" for k in range(len(attributes))]
    merged, distinct = I.cut_counted(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("w")).withColumn("key", F.xxhash64(*names)))
    blocks = max(8, -(-distinct // block_rows))
    merged = merged.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    left = merged.select(F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"), *[F.col(n).alias(f"l_{n}") for n in names], F.col("w").alias("lw"), F.col("key").alias("lk"))
    right = merged.select(F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), *[F.col(n).alias(f"r_{n}") for n in names], F.col("w").alias("rw"), F.col("key").alias("rk"))
    once = (F.col("i") < F.col("j")) | (F.struct("lk", *[f"l_{n}" for n in names]) < F.struct("rk", *[f"r_{n}" for n in names]))
    signs = F.array(*[F.signum(F.col(f"r_{n}") - F.col(f"l_{n}")).cast("int") for n in names])
    pairs = left.join(right, ["i", "j"]).where(once)
    return pairs.groupBy(signs.alias("signs")).agg(F.sum(F.col("lw") * F.col("rw")).alias("n")), total


def gradual_itemsets(frame: DataFrame, min_supp: float, attributes: Sequence[str] | None = None, max_len: int | None = None, max_rows: int | None = None, seed: int = 0) -> DataFrame:
    """``(itemset array<string>, size, support)`` with items like ``age+``; the first direction is always ``+``.

    A pair of rows supports an itemset if one of its rows is strictly above (below) the other in every
    attribute; ties never count. Rows with a null are left out. All itemsets are summed from one table of sign patterns.
    """
    I.check_share(min_supp)
    names = _attributes(frame, attributes)
    patterns, n = sign_patterns(frame, names, max_rows, seed)
    if n < 2:
        raise ValueError("at least 2 rows are needed to form pairs")
    counted = [(r["signs"], r["n"]) for r in patterns.collect()]  # at most 3 ** len(attributes)
    whole = n * (n - 1) / 2

    def support(itemset) -> float:
        hit = 0
        for signs, k in counted:
            values = [signs[a] * d for a, d in itemset]
            hit += k if all(v == 1 for v in values) or all(v == -1 for v in values) else 0
        return hit / whole

    level = {((a, 1),): support(((a, 1),)) for a in range(len(names))}
    level = {k: v for k, v in level.items() if v >= min_supp}
    found = dict(level)
    while level and (max_len is None or len(next(iter(level))) < max_len):
        new = {}
        for itemset in level:
            for a, d in product(range(itemset[-1][0] + 1, len(names)), (1, -1)):
                longer = (*itemset, (a, d))
                if all(_canonical(longer[:k] + longer[k + 1 :]) in found for k in range(len(longer))):
                    s = support(longer)
                    if s >= min_supp:
                        new[longer] = s
        found |= new
        level = new
    rows = [([f"{names[a]}{'+' if d > 0 else '-'}" for a, d in k], len(k), v) for k, v in found.items()]
    return frame.sparkSession.createDataFrame(rows, "itemset array<string>, size int, support double")


def _canonical(itemset):
    return itemset if itemset[0][1] > 0 else tuple((a, -d) for a, d in itemset)


def _mirror(items: Sequence[str]) -> tuple[str, ...]:
    if items[0].endswith("+"):
        return tuple(items)
    return tuple(i[:-1] + ("-" if i.endswith("+") else "+") for i in items)


def gradual_rules(frame: DataFrame, min_supp: float, min_conf: float, attributes: Sequence[str] | None = None, max_len: int | None = None, max_rows: int | None = None, seed: int = 0) -> DataFrame:
    """``(antecedents, consequents, antecedent_support, consequent_support, support, confidence)``."""
    found = {tuple(r["itemset"]): r["support"] for r in gradual_itemsets(frame, min_supp, attributes, max_len, max_rows, seed).collect()}
    rows = []
    for itemset, support in found.items():
        for size in range(1, len(itemset)):
            for a in combinations(itemset, size):
                c = tuple(i for i in itemset if i not in a)
                sa, sc = found[_mirror(a)], found[_mirror(c)]
                if sa and support / sa >= min_conf:
                    rows.append((list(a), list(c), sa, sc, support, support / sa))
    return frame.sparkSession.createDataFrame(rows, "antecedents array<string>, consequents array<string>, antecedent_support double, consequent_support double, support double, confidence double")


def format_gradual_item(item: str) -> str:
    return f"the {'more' if item.endswith('+') else 'less'} {item[:-1]}"


def format_gradual_itemset(itemset: Sequence[str]) -> str:
    return ", ".join(map(format_gradual_item, itemset))
