"""Encoders and rule miners with fit and transform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import itemsets as I
from .rules import association_rules, candidate_rule_count, prune_redundant_rules, rare_rules, top_k_rules
from .significance import significant_rules


class Params:
    """Constructor arguments as parameters to read, set and show."""

    def get_params(self) -> dict:
        return {k: v for k, v in vars(self).items() if not k.endswith("_") and not k.startswith("_")}

    def set_params(self, **values):
        unknown = [k for k in values if k not in self.get_params()]
        if unknown:
            raise ValueError(f"unknown parameters: {unknown}")
        for k, v in values.items():
            setattr(self, k, v)
        return self

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params().items())})"


class TransactionEncoder(Params):
    """Baskets to boolean columns, in order of the item names, and back."""

    def __init__(self, handle_unknown: str = "ignore", max_items: int = 2000) -> None:
        if handle_unknown not in ("ignore", "error"):
            raise ValueError("handle_unknown must be ignore or error")
        self.handle_unknown, self.max_items = handle_unknown, max_items

    def fit(self, baskets: DataFrame, items: str = "items") -> TransactionEncoder:
        names = [r["i"] for r in baskets.select(F.explode(items).alias("i")).where("i is not null").distinct().orderBy("i").limit(self.max_items + 1).collect()]
        if len(names) > self.max_items:
            raise ValueError(f"more than {self.max_items} items: keep the long layout")
        self.columns_ = names
        return self

    def transform(self, baskets: DataFrame, items: str = "items") -> DataFrame:
        rest = [c for c in baskets.columns if c != items]
        held = F.coalesce(F.col(items), F.array().cast("array<string>"))
        if self.handle_unknown == "error":
            unknown = F.array_except(F.array_compact(held), F.array(*map(F.lit, self.columns_)) if self.columns_ else F.array().cast("array<string>"))
            held = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown items: "), F.array_join(unknown, ", ")))).otherwise(held)
        return baskets.select(*rest, *[F.array_contains(held, c).alias(c) for c in self.columns_])

    def fit_transform(self, baskets: DataFrame, items: str = "items") -> DataFrame:
        return self.fit(baskets, items).transform(baskets, items)

    def inverse_transform(self, table: DataFrame, items: str = "items") -> DataFrame:
        rest = [c for c in table.columns if c not in self.columns_]
        return table.select(*rest, F.array_compact(F.array(*[F.when(F.col(f"`{c}`"), F.lit(c)) for c in self.columns_])).alias(items))


class RuleMiner(Params):
    """Mines rules on ``fit``; ``transform`` tells which of them fire in a basket."""

    def __init__(self, method: str = "fpgrowth", min_supp: float = 0.1, metric: str = "confidence", min_threshold: float = 0.8, k: int = 10, max_supp: float = 0.1, max_len: int | None = None, alpha: float | None = None, correction: str = "fdr_bh", test: str = "fisher", prune: bool = False, algorithm: str = "vertical") -> None:
        if method not in ("fpgrowth", "top_k", "rare") or algorithm not in ("vertical", "fpgrowth"):
            raise ValueError("method must be fpgrowth, top_k or rare, algorithm vertical or fpgrowth")
        self.method, self.min_supp, self.metric, self.min_threshold, self.k, self.max_supp, self.max_len = method, min_supp, metric, min_threshold, k, max_supp, max_len
        self.alpha, self.correction, self.test, self.prune, self.algorithm = alpha, correction, test, prune, algorithm

    def fit(self, baskets: DataFrame, items: str = "items") -> RuleMiner:
        n = baskets.count()
        family = None
        if self.method == "top_k":
            rules = top_k_rules(baskets, self.k, self.min_threshold, max_len=self.max_len or 6, items=items)
        elif self.method == "rare":
            rules = rare_rules(baskets, self.max_supp, min_conf=self.min_threshold, items=items)
        else:
            found = cut(I.fpgrowth(baskets, self.min_supp, items) if self.algorithm == "fpgrowth" else I.frequent_itemsets(baskets, self.min_supp, self.max_len, items))
            family = candidate_rule_count(found)
            rules = association_rules(found, self.metric, self.min_threshold)
        if self.alpha is not None:
            rules = significant_rules(rules, n, self.alpha, self.correction, self.test, n_tests=family)
        if self.prune:
            rules = prune_redundant_rules(cut(rules))
        self.rules_ = cut(rules)
        self.n_transactions_ = n
        return self

    def get_feature_names_out(self) -> list[str]:
        from .action import rule_text

        return [r[0] for r in self.rules_.select(rule_text().alias("t")).orderBy("t").collect()]

    def transform(self, baskets: DataFrame, key: str, items: str = "items") -> DataFrame:
        """``(key, rules array<string>)``: the texts of the rules whose antecedent a basket holds."""
        from .action import rule_text

        rules = self.rules_.select("antecedents", rule_text().alias("text")).withColumn("lead", F.element_at("antecedents", 1))
        hit = baskets.select(key, items, F.explode(items).alias("lead")).join(F.broadcast(rules), "lead").where(F.size(F.array_except("antecedents", items)) == 0)
        some = hit.groupBy(key).agg(F.array_sort(F.collect_set("text")).alias("rules"))
        return baskets.select(key).join(some, key, "left").select(key, F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))

    def fit_transform(self, baskets: DataFrame, key: str, items: str = "items") -> DataFrame:
        return self.fit(baskets, items).transform(baskets, key, items)
