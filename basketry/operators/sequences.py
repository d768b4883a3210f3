"""Sequences of events: building them, frequent patterns, rules between earlier and later items, crisp and fuzzy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import measure, with_measures
from ..session import cut, cut_counted, sized, spread
from . import itemsets as I
from .rules import splits

ELEMENTS = "elements"


def sequences_from_events(events: DataFrame, sequence: str, time: str, item: str, bin_seconds: int | None = None) -> DataFrame:
    """``(sid, elements array<array<string>>)``: items of the same instant (or bin) form one element."""
    t = F.col(time)
    if bin_seconds:
        t = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (bin_seconds * 1_000_000))
    rows = events.dropna(subset=[sequence, time, item]).select(F.col(sequence).alias("sid"), t.alias("t"), F.col(item).cast("string").alias("item"))
    elements = rows.groupBy("sid", "t").agg(F.array_sort(F.collect_set("item")).alias("e"))
    return elements.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "e"))), lambda s: s["e"]).alias(ELEMENTS))


def sequences_from_items(rows: DataFrame, order: str, by: str | None = None, items: str = "items") -> DataFrame:
    """Rows of item arrays as elements, in order; empty rows are skipped, groups without any stay."""
    sid = F.col(by) if by else F.lit(0)
    kept = F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.array_sort(items).alias("e")))), lambda s: F.size(s["e"]) > 0)
    return rows.groupBy(sid.alias("sid")).agg(F.transform(kept, lambda s: s["e"]).alias(ELEMENTS))


def fuzzy_sequences_from_memberships(rows: DataFrame, columns: Sequence[str], order: str, by: str | None = None, min_degree: float = 0.0) -> DataFrame:
    """``(sid, elements array<array<struct<item,degree>>>)`` of degrees above ``min_degree``; empty groups stay."""
    sid = F.col(by) if by else F.lit(0)
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("degree")) for c in columns]), lambda s: s["degree"] > min_degree)
    kept = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), pairs.alias("e"))))
    return rows.groupBy(sid.alias("sid")).agg(F.transform(F.filter(kept, lambda s: F.size(s["e"]) > 0), lambda s: s["e"]).alias(ELEMENTS))


def clean_elements(elements: Column) -> Column:
    """Sorted sets without nulls; empty elements dropped."""
    return F.filter(F.transform(F.coalesce(elements, F.array().cast("array<array<string>>")), lambda e: F.array_sort(F.array_distinct(F.array_compact(e)))), lambda e: F.size(e) > 0)


def prefixspan(sequences: DataFrame, min_supp: float, max_len: int | None = None, min_len: int = 1) -> DataFrame:
    """``(sequence array<array<string>>, length, count, support)``; ``max_len`` counts items.

    Spark's own pattern growth, its threshold set between whole counts; empty sequences count in the total.
    """
    from pyspark.ml.fpm import PrefixSpan

    I.check_share(min_supp)
    rows = cut(sequences.select(clean_elements(F.col(ELEMENTS)).alias("sequence")))
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "sequence array<array<string>>, length int, count bigint, support double")
    longest = rows.agg(F.max(F.aggregate("sequence", F.lit(0), lambda s, e: s + F.size(e)))).first()[0] or 1
    model = PrefixSpan(minSupport=(I.min_count(min_supp, total) - 0.5) / total, maxPatternLength=max(1, min(max_len or longest, longest)))
    found = model.findFrequentSequentialPatterns(rows)
    length = F.aggregate("sequence", F.lit(0), lambda s, e: s + F.size(e))
    return found.select("sequence", length.alias("length"), F.col("freq").alias("count"), (F.col("freq") / total).alias("support")).where(F.col("length") >= min_len)


def contains_sequence(elements: Column, pattern: Sequence[Sequence[str]]) -> Column:
    """Whether the pattern's elements are contained in later and later elements (earliest match)."""
    steps = F.array(*[F.array(*map(F.lit, e)) for e in pattern])
    matched = F.aggregate(elements, F.lit(0), lambda k, e: F.when((k < len(pattern)) & (F.size(F.array_except(F.get(steps, k), e)) == 0), k + 1).otherwise(k))
    return matched == len(pattern)


def format_sequence(sequence: Column) -> Column:
    """``<{a, b} {c}>``."""
    return F.concat(F.lit("<"), F.array_join(F.transform(sequence, lambda e: F.concat(F.lit("{"), F.array_join(e, ", "), F.lit("}"))), " "), F.lit(">"))


def first_last(sequences: DataFrame) -> DataFrame:
    """``(sid, items, firsts, lasts)``: a sequence's items and the positions of their first and last occurrence."""
    rows = sequences.select("sid", F.posexplode_outer(clean_elements(F.col(ELEMENTS))).alias("pos", "e")).select("sid", "pos", F.explode_outer("e").alias("item"))
    each = rows.groupBy("sid", "item").agg(F.min("pos").alias("f"), F.max("pos").alias("l"))
    s = F.filter(F.array_sort(F.collect_list(F.struct("item", "f", "l"))), lambda x: x["item"].isNotNull())
    return each.groupBy("sid").agg(s.alias("s")).select("sid", F.col("s.item").alias("items"), F.col("s.f").alias("firsts"), F.col("s.l").alias("lasts"))


def _at(values: str, item: Column) -> Column:
    return F.get(F.col(values), (F.array_position("items", item) - 1).cast("int"))


def _completed(side: str) -> Column:
    return F.array_max(F.transform(F.col(side), lambda i: _at("firsts", i)))


def sequential_rules(sequences: DataFrame, min_supp: float, min_conf: float = 0.8, max_antecedent: int = 2, max_consequent: int = 2, metric: str = "confidence", min_threshold: float = 0.0) -> DataFrame:
    """Rules whose antecedent has appeared in full before its consequent can still appear in full.

    A threshold of 0 is no filter. Supports of both sides are shares of sequences that contain them.
    """
    I.check_share(min_supp)
    rows = cut(first_last(sequences))
    total = rows.count()
    found = I.frequent_itemsets(rows, min_supp, max_antecedent + max_consequent)
    rules = splits(found, []).where((F.size("antecedents") <= max_antecedent) & (F.size("consequents") <= max_consequent))
    hit = rows.select("items", "firsts", "lasts", F.explode("items").alias("lead")).join(sized(rules.withColumn("lead", F.element_at("antecedents", 1))), "lead").where(F.size(F.array_except("itemset", "items")) == 0)
    expires = F.array_min(F.transform("consequents", lambda i: _at("lasts", i)))
    valid = hit.where(_completed("antecedents") < expires).groupBy("antecedents", "consequents").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= I.min_count(min_supp, max(total, 1)))
    return _finish(valid, found, total, min_conf, metric, min_threshold)


def _finish(valid: DataFrame, found: DataFrame, total: int, min_conf: float, metric: str, min_threshold: float) -> DataFrame:
    side = lambda name, out: sized(found.select(F.col("itemset").alias(name), F.col("support").alias(out)))
    both = valid.join(side("antecedents", "antecedent_support"), "antecedents").join(side("consequents", "consequent_support"), "consequents")
    rows = both.select("antecedents", "consequents", "antecedent_support", "consequent_support", (F.col("n") / F.lit(max(total, 1))).alias("support"))
    rows = rows.where(F.col("support") / F.col("antecedent_support") >= min_conf - 1e-9)
    out = with_measures(rows, with_conviction=False)
    if metric != "support" and min_threshold:
        out = out.where(measure(metric, F.col("support"), F.col("antecedent_support"), F.col("consequent_support")) >= min_threshold)
    return out


def contains_rule(antecedent: Sequence[str], consequent: Sequence[str]) -> Column:
    """On rows of :func:`first_last`: whether the rule holds in the sequence."""
    x, y = F.array(*map(F.lit, antecedent)), F.array(*map(F.lit, consequent))
    there = F.size(F.array_except(F.array_union(x, y), "items")) == 0
    done, left = F.array_max(F.transform(x, lambda i: _at("firsts", i))), F.array_min(F.transform(y, lambda i: _at("lasts", i)))
    return F.coalesce(there & (done < left), F.lit(False))


def sequential_veto_rules(sequences: DataFrame, min_supp: float, min_conf: float = 0.8, max_antecedent: int = 2, min_antecedent_supp: float = 0.1, metric: str = "confidence", min_threshold: float = 0.0) -> DataFrame:
    """``X => not y``: once X is complete, y never comes after. ``consequent_support`` is the share without y at all."""
    I.check_share(min_supp)
    rows = cut(first_last(sequences))
    total = rows.count()
    found = cut(I.frequent_itemsets(rows, min_antecedent_supp, max_antecedent))
    lead = sized(found.select(F.col("itemset").alias("antecedents"), F.element_at("itemset", 1).alias("lead")))
    hit = rows.select("items", "firsts", "lasts", F.explode("items").alias("lead")).join(lead, "lead").where(F.size(F.array_except("antecedents", "items")) == 0).withColumn("done", _completed("antecedents"))
    later = F.filter("items", lambda i: _at("lasts", i) > F.col("done"))
    broken = hit.select("antecedents", F.explode(later).alias("y")).groupBy("antecedents", "y").agg(F.count(F.lit(1)).alias("broken"))
    vocabulary = rows.select(F.explode("items").alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("with_y"))
    # every item may be vetoed: the result has a row per antecedent and item; the antecedents are few, by their threshold
    pairs = vocabulary.crossJoin(F.broadcast(found.select(F.col("itemset").alias("antecedents"), F.col("count").alias("with_x")))).where(~F.array_contains("antecedents", F.col("y")))
    valid = pairs.join(broken, ["antecedents", "y"], "left").withColumn("n", F.col("with_x") - F.coalesce("broken", F.lit(0))).where(F.col("n") >= I.min_count(min_supp, max(total, 1)))
    n = F.lit(max(total, 1))
    table = valid.select("antecedents", F.array("y").alias("consequents"), (F.col("with_x") / n).alias("antecedent_support"), ((n - F.col("with_y")) / n).alias("consequent_support"), (F.col("n") / n).alias("support")).where(F.col("support") / F.col("antecedent_support") >= min_conf - 1e-9)
    out = with_measures(table, with_conviction=False)
    if metric != "support" and min_threshold:
        out = out.where(measure(metric, F.col("support"), F.col("antecedent_support"), F.col("consequent_support")) >= min_threshold)
    return out


def contains_veto_rule(antecedent: Sequence[str], vetoed: str) -> Column:
    """On rows of :func:`first_last`: the antecedent completes and ``vetoed`` does not come after."""
    x = F.array(*map(F.lit, antecedent))
    done = F.array_max(F.transform(x, lambda i: _at("firsts", i)))
    last = F.coalesce(_at("lasts", F.lit(vetoed)), F.lit(-1))
    return F.coalesce((F.size(F.array_except(x, "items")) == 0) & (last <= done), F.lit(False))


# -- fuzzy sequences -------------------------------------------------------------------------------

Pattern = tuple[tuple[str, ...], ...]


def _norm(tnorm: str) -> Callable:
    if tnorm not in ("min", "product"):
        raise ValueError("tnorm must be min or product")
    return np.minimum if tnorm == "min" else np.multiply


def degree_matrix(elements: Sequence[Sequence[dict]]) -> dict[str, np.ndarray]:
    """Degree of each item at each position, the largest of repeats; zero degrees dropped."""
    out: dict[str, np.ndarray] = {}
    for at, element in enumerate(elements or []):
        for s in element:
            if s["degree"] and s["degree"] > 0:
                row = out.setdefault(s["item"], np.zeros(len(elements)))
                row[at] = max(row[at], s["degree"])
    return out


def _together(table: dict[str, np.ndarray], items: Sequence[str], norm: Callable) -> np.ndarray | None:
    """Joint degree of items by position, None if one of them is nowhere."""
    return reduce(norm, [table[i] for i in items]) if all(i in table for i in items) else None


def _so_far(x: np.ndarray, strictly: bool = False) -> np.ndarray:
    """The largest value up to each position, or strictly before it (0 at the first)."""
    top = np.maximum.accumulate(x)
    return np.concatenate([[0.0], top[:-1]]) if strictly else top


def _ends(table: dict[str, np.ndarray], pattern: Pattern, norm: Callable, n: int) -> np.ndarray | None:
    """Best degree of a pattern by the position of its last element."""
    rows = [_together(table, element, norm) for element in pattern]
    if not rows or any(r is None for r in rows):
        return None
    return reduce(lambda done, row: norm(_so_far(done, True), row), rows)


def fuzzy_pattern_degree(elements: Sequence[Sequence[dict]], pattern: Pattern, tnorm: str = "min") -> float:
    best = _ends(degree_matrix(elements), pattern, _norm(tnorm), len(elements))
    return float(best.max()) if best is not None and len(best) else 0.0


def _one_less(pattern: Pattern) -> Iterator[Pattern]:
    """The pattern without one of its items, for each of them."""
    for at, element in enumerate(pattern):
        for k in range(len(element)):
            left = (*element[:k], *element[k + 1 :])
            yield (*pattern[:at], *([left] if left else []), *pattern[at + 1 :])


def fuzzy_prefixspan(sequences: DataFrame, min_supp: float, max_len: int | None = 4, min_len: int = 1, tnorm: str = "min", itemset_elements: bool = False) -> DataFrame:
    """``(sequence array<array<string>>, length, support)``: mean best degree over all sequences.

    Level by level: patterns grow at their end by one item, and a candidate is counted only if every pattern that
    lacks one of its items is frequent; sums of degrees per candidate are all that leaves a task.
    """
    I.check_share(min_supp)
    norm = _norm(tnorm)
    rows = cut(sequences.select(ELEMENTS))
    total = rows.count()

    def degrees(patterns: list[Pattern]) -> dict[Pattern, float]:
        by_head: dict[Pattern, list[int]] = {}
        for k, p in enumerate(patterns):
            head = p[:-1]
            by_head.setdefault(head, []).append(k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(patterns))
            for batch in batches:
                for elements in batch.column(0).to_pylist():
                    table = degree_matrix(elements or [])
                    for head, members in by_head.items():
                        if head:
                            best = _ends(table, head, norm, len(elements or []))
                            if best is None or not best.any():
                                continue
                            allowed = _so_far(best, True)
                        for k in members:
                            tail = _ends(table, patterns[k][-1:], norm, len(elements or []))
                            if tail is not None:
                                sums[k] += (norm(allowed, tail) if head else tail).max()
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(sums[hit])], names=["k", "s"])

        found = rows.mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        return {patterns[r["k"]]: r["s"] / total for r in found}

    if not total:
        return rows.sparkSession.createDataFrame([], "sequence array<array<string>>, length int, support double")
    items = sorted(r[0] for r in rows.select(F.explode(ELEMENTS).alias("e")).select(F.explode("e").alias("s")).select("s.item").distinct().collect())
    good = lambda found: {p: s for p, s in found.items() if s >= min_supp - 1e-12}
    level = good(degrees([((i,),) for i in items]))
    singles, found, size = [p[0][0] for p in sorted(level)], dict(level), 1
    while level and (max_len is None or size < max_len):
        new = [(*p, (i,)) for p in level for i in singles]
        if itemset_elements:
            new += [(*p[:-1], (*p[-1], i)) for p in level for i in singles if i > p[-1][-1]]
        new = [p for p in new if all(q in level for q in _one_less(p))]
        level = good(degrees(sorted(new))) if new else {}
        found |= level
        size += 1
    rows_ = [([list(e) for e in p], sum(map(len, p)), s) for p, s in found.items() if sum(map(len, p)) >= min_len]
    return sequences.sparkSession.createDataFrame(rows_, "sequence array<array<string>>, length int, support double")


def fuzzy_rule_degree(elements: Sequence[Sequence[dict]], antecedent: Sequence[str], consequent: Sequence[str], tnorm: str = "min") -> float:
    """Best joint degree of the antecedent up to some position and the consequent after it."""
    return _rule_degree(degree_matrix(elements), antecedent, consequent, _norm(tnorm))


def _rule_degree(table, antecedent, consequent, norm) -> float:
    if not all(i in table for i in (*antecedent, *consequent)):
        return 0.0
    begun = reduce(norm, [_so_far(table[i]) for i in antecedent])
    # read backwards, what is still to come is what has been
    to_come = reduce(norm, [_so_far(table[i][::-1], True)[::-1] for i in consequent])
    return float(norm(begun, to_come).max())


def fuzzy_sequential_rules(sequences: DataFrame, min_supp: float, min_conf: float = 0.8, max_antecedent: int = 2, max_consequent: int = 2, metric: str = "confidence", min_threshold: float = 0.0, tnorm: str = "min") -> DataFrame:
    """Sequential rules whose supports are mean degrees."""
    norm = _norm(tnorm)
    rows = cut(sequences.select("sid", ELEMENTS))
    total = rows.count()
    flat = F.filter(F.flatten(F.coalesce(F.col(ELEMENTS), F.array().cast(dict(rows.dtypes)[ELEMENTS]))), lambda s: s["degree"] > 0)
    best = rows.select(F.array_sort(flat).alias("s"))
    best = best.select(F.filter("s", lambda x, k: (k == F.size("s") - 1) | (F.get("s", k + 1)["item"] != x["item"])).alias("s"))
    found = I.mine(best.select(F.col("s.item").alias("items"), F.col("s.degree").alias("degrees")), min_supp, "items", "degrees", max_len=max_antecedent + max_consequent, payload=I.Mean(tnorm))
    found = cut(found.select("itemset", (F.col("sums")[0] / F.col("n")).alias("support")))
    wanted = [(tuple(r["antecedents"]), tuple(r["consequents"])) for r in splits(found, []).where((F.size("antecedents") <= max_antecedent) & (F.size("consequents") <= max_consequent)).collect()]

    by_items: dict[tuple[str, str], list[int]] = {}
    for k, (a, c) in enumerate(wanted):
        by_items.setdefault((a[0], c[0]), []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(wanted))
        for batch in batches:
            for elements in batch.column(0).to_pylist():
                table = degree_matrix(elements or [])
                for both in permutations(table, 2):  # of all rules those that begin with items of this sequence
                    for k in by_items.get(both, ()):
                        sums[k] += _rule_degree(table, *wanted[k], norm)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([wanted[k][0] for k in hit], pa.list_(pa.string())), pa.array([wanted[k][1] for k in hit], pa.list_(pa.string())), pa.array(sums[hit])], names=["antecedents", "consequents", "n"])

    valid = rows.select(ELEMENTS).mapInArrow(run, "antecedents array<string>, consequents array<string>, n double").groupBy("antecedents", "consequents").agg(F.sum("n").alias("n")).where(F.col("n") >= min_supp * max(total, 1) - 1e-9)
    return _finish(valid, found, total, min_conf, metric, min_threshold)


#: Elements of equal sequences that are permuted by one task at a time, numbers that it holds of them, and counters of
#: rules by permutations; further rules take another pass.
PIECE, CELLS, COUNTERS = 200_000, 1 << 20, 2_000_000


def sequential_rule_significance(sequences: DataFrame, rules: DataFrame, n_permutations: int = 200, correction: str = "fdr_bh", seed: int = 0) -> DataFrame:
    """``rules`` with ``p_value`` and ``p_adjusted``: how often a random order of each sequence's elements supports
    them as much.

    Of a sequence matter the elements with items of the rules. Equal sequences are one row with their number, and so
    are, for the permutations, those of the same elements in whatever order. A task permutes its rows itself and
    passes on sums by rule and permutation, so what is shuffled or stored does not grow with the permutations of events.
    """
    from .significance import adjust_pvalues

    if n_permutations < 1:
        raise ValueError("n_permutations must be positive")
    wanted, total = cut_counted(rules.select("antecedents", "consequents").distinct().withColumn("k", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(total * max(n_permutations, 200) / COUNTERS))
    tested = [_permuted(sequences, wanted.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b), n_permutations, seed) for b in range(blocks)]
    p = reduce(DataFrame.unionByName, tested)
    return adjust_pvalues(rules.join(p, ["antecedents", "consequents"]), correction)


def significant_sequential_rules(sequences: DataFrame, rules: DataFrame, alpha: float = 0.05, n_permutations: int = 200, correction: str = "fdr_bh", seed: int = 0) -> DataFrame:
    return sequential_rule_significance(sequences, rules, n_permutations, correction, seed).where(F.col("p_adjusted") <= alpha)


def _permuted(sequences: DataFrame, rules: DataFrame, n_permutations: int, seed: int) -> DataFrame:
    """``(antecedents, consequents, p_value)`` of a block of rules ``(k, antecedents, consequents)``."""
    held = sorted(((r["antecedents"], r["consequents"], r["k"]) for r in rules.collect()), key=str)
    items = sorted({i for a, c, _ in held for i in (*a, *c) if i is not None})
    known = F.filter(F.transform(clean_elements(F.col(ELEMENTS)), lambda e: F.filter(e, lambda i: i.isin(items))), lambda e: F.size(e) > 0)
    rows = cut(sequences.select(known.alias("e")).where(F.size("e") > 1).groupBy("e").agg(F.count(F.lit(1)).alias("w")))
    piece = F.greatest(F.lit(1), F.floor(F.lit(PIECE) / F.size("e")))
    alike = rows.groupBy(F.array_sort("e").alias("e")).agg(F.sum("w").alias("w")).withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("w") - 1) / piece))))
    alike = cut(alike.select("e", F.least(piece, F.col("w") - F.col("at") * piece).cast("bigint").alias("w"), F.xxhash64("e", "at").alias("key")))

    by_lead: dict[str, dict[str, list[int]]] = {}
    for at, (a, c, _) in enumerate(held):
        if a and c:
            by_lead.setdefault(a[0], {}).setdefault(c[0], []).append(at)

    def inside(elements: list[list[str]]) -> list[int]:
        """Rules whose items are all in a sequence."""
        there = {i for e in elements for i in e}
        leads = [k for a in there & by_lead.keys() for c in there & by_lead[a].keys() for k in by_lead[a][c]]
        return sorted(k for k in leads if there.issuperset(held[k][0]) and there.issuperset(held[k][1]))

    def count(batches: Iterator[pa.RecordBatch], width: int, of: Callable) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(held), width), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                for row in zip(*(c.to_pylist() for c in batch.slice(begin, 1000).columns), strict=True):
                    if met := inside(row[0]):
                        sums[met] += of([held[k][:2] for k in met], *row)
        k, perm = np.nonzero(sums)
        ids = np.array([k for _, _, k in held], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(perm, pa.int32()), pa.array(sums[k, perm])], names=["k", "perm", "n"])

    real = lambda batches: count(batches, 1, lambda met, e, w: w * _as_it_is(met, e))
    null = lambda batches: count(batches, n_permutations, lambda met, e, w, key: _at_random(met, e, w, n_permutations, np.random.default_rng([seed & _WORD, key & _WORD])))
    kinds = "k bigint, perm int, n bigint"
    observed = rules.join(spread(rows).mapInArrow(real, kinds).groupBy("k").agg(F.sum("n").alias("n")), "k", "left").fillna(0, ["n"])
    drawn = spread(alike).mapInArrow(null, kinds).groupBy("k", "perm").agg(F.sum("n").alias("m"))
    hits = observed.join(drawn, "k", "left").groupBy("antecedents", "consequents", "n").agg(F.count_if(F.col("m") >= F.col("n")).alias("reached"))
    # permutations without the rule have no row: they reach only a count of zero
    reached = F.when(F.col("n") == 0, n_permutations).otherwise(F.col("reached"))
    return cut(hits.select("antecedents", "consequents", ((1 + reached) / (1 + n_permutations)).alias("p_value")))


_WORD = (1 << 64) - 1


def _holds(rules: list[tuple[list[str], list[str]]], kinds: Sequence[tuple[str, ...]], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether rules (rows) hold in orders (columns), by the first and last places of each kind of element in them."""
    of: dict[str, list[int]] = {}
    for at, kind in enumerate(kinds):
        for i in kind:
            of.setdefault(i, []).append(at)
    first, last = {i: low[:, at].min(1) for i, at in of.items()}, {i: high[:, at].max(1) for i, at in of.items()}
    return np.stack([reduce(np.maximum, [first[i] for i in a]) < reduce(np.minimum, [last[i] for i in c]) for a, c in rules])


def _as_it_is(rules: list[tuple[list[str], list[str]]], elements: list[list[str]]) -> np.ndarray:
    first, last = {}, {}
    for at, e in enumerate(elements):
        for i in e:
            first.setdefault(i, at)
            last[i] = at
    return np.array([[max(first[i] for i in a) < min(last[i] for i in c)] for a, c in rules], np.int64)


@lru_cache(8)
def _orders(sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of kinds that occur so many times, a row for each of their distinct orders."""
    free, low, high = np.arange(sum(sizes), dtype=np.int32)[None, :], [], []
    for n in sizes:
        rest = free.shape[1]
        taken = list(combinations(range(rest), n))
        left = np.array([[x for x in range(rest) if x not in t] for t in map(set, taken)], int).reshape(len(taken), rest - n)
        low = [np.repeat(x, len(taken)) for x in low] + [free[:, [t[0] for t in taken]].ravel()]
        high = [np.repeat(x, len(taken)) for x in high] + [free[:, [t[-1] for t in taken]].ravel()]
        free = free[:, left].reshape(len(free) * len(taken), rest - n)
    return np.stack(low, 1), np.stack(high, 1)


def _at_random(rules: list[tuple[list[str], list[str]]], elements: list[list[str]], copies: int, n_permutations: int, rng: np.random.Generator) -> np.ndarray:
    """In how many of ``copies`` equal sequences each rule (rows) holds in each permutation (columns).

    Where elements have fewer distinct orders than are drawn, all orders are equally likely, so it is drawn how many
    copies get an order with the same rules; otherwise each copy's elements get random places.
    """
    kinds, sizes = zip(*Counter(map(tuple, elements)).most_common(), strict=True)
    draws = copies * n_permutations
    orders = math.lgamma(len(elements) + 1) - sum(math.lgamma(n + 1) for n in sizes)
    if orders <= math.log(min(draws, CELLS / (len(kinds) + len(rules)))) + 1e-9:
        holds = np.packbits(_holds(rules, kinds, *_orders(sizes)), axis=0)
        same, n = np.unique(holds, axis=1, return_counts=True)
        got = rng.multinomial(copies, n / n.sum(), n_permutations)
        return (np.unpackbits(same, axis=0, count=len(rules)).astype(float) @ got.T.astype(float)).astype(np.int64)  # whole below 2^53
    out = np.zeros((len(rules), n_permutations), np.int64)
    starts, step = np.cumsum([0, *sizes[:-1]]), max(1, CELLS // (len(elements) + len(rules)))
    for begin in range(0, draws, step):
        perm = np.arange(begin, min(begin + step, draws)) // copies
        place = rng.random((len(perm), len(elements)))
        holds = _holds(rules, kinds, np.minimum.reduceat(place, starts, axis=1), np.maximum.reduceat(place, starts, axis=1))
        edges = np.flatnonzero(np.diff(perm, prepend=-1))
        out[:, perm[edges]] += np.add.reduceat(holds, edges, axis=1, dtype=np.int64)
    return out
