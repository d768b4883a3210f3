"""Queries against brute force on small tables: nothing is left out."""

import inspect
import math
from datetime import datetime, timedelta
from itertools import combinations

import pytest

from basketry.operators import sequences, significance
from basketry.plans import core_queries
from basketry.plans import reference_queries as q

#: Orders (their product types) of each return flag.
META = {"N": ["abc"], "R": ["ab", "ac"], "A": ["abc", "a", "b"]}


def subsets(items, least=1):
    return [frozenset(c) for n in range(least, len(items) + 1) for c in combinations(sorted(items), n)]


def pairs(sets):
    return [(a, c) for a in sets for c in sets if not a & c]


def sides(frame, *extra):
    got = [(frozenset(r["antecedents"].split("|")), frozenset(r["consequents"].split("|")), *(round(r[x], 6) for x in extra)) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def meta_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("meta"))
    lines, order = [], 0
    for flag, baskets in META.items():
        for basket in baskets:
            order += 1
            lines += [(order, ord(x), flag) for x in basket]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(ord(x), x) for x in "abc"], "p_partkey long, p_type string").write.parquet(f"{d}/part.parquet")
    return d


def primary():
    """Confidence of each pair rule by flag."""
    out = {}
    for flag, baskets in META.items():
        for x in "abc":
            for y in "abc":
                both, one = sum(x in b and y in b for b in baskets), sum(x in b for b in baskets)
                if x != y and both:
                    out.setdefault(f"{x}=>{y}", {})[flag] = both / one
    return out


def test_meta_rules_fuzzy(spark, meta_dir):
    degrees = primary()
    assert sum(map(len, degrees.values())) > 12
    top = {rule: max(v.values()) for rule, v in degrees.items()}
    levels = [1.0, 0.8, 0.6, 0.4, 0.2]

    def shares(itemset):
        low = [min(degrees[r].get(flag, 0) / top[r] for r in itemset) for flag in META]
        return [sum(x >= level for x in low) / len(META) for level in levels]

    want = set()
    for a, c in pairs(subsets(degrees)):
        ab, one = shares(a | c), shares(a)
        conf = sum(x / y if y else 1 for x, y in zip(ab, one)) / 5
        if sum(ab) / 5 >= 0.1 and conf >= 0.8:
            want.add((a, c, round(sum(ab) / 5, 6), round(conf, 6)))
    assert want and sides(q.meta_rules_fuzzy(spark, meta_dir), "FSupp", "FConf") == want


def test_meta_rules_crisp(spark, meta_dir):
    degrees = primary()
    assert len({rule[0] for rule in degrees}) > 1
    share = lambda itemset: sum(all(flag in degrees[r] for r in itemset) for flag in META) / len(META)
    want = {(a, c, round(share(a | c), 6), round(share(a | c) / share(a), 6)) for a, c in pairs(subsets(degrees)) if share(a | c) >= 0.3 and share(a | c) / share(a) >= 0.8}
    assert want and sides(q.meta_rules_crisp(spark, meta_dir), "support", "confidence") == want


#: Event types of each hour.
HOURS = ["ab", "c", "abc", "bc", "a", "abc", "ac", "b", "abc", "bc", "ab", "abc"]


def test_temporal_rules(spark, tmp_path):
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(start + timedelta(hours=k), x) for k, h in enumerate(HOURS) for x in h], "ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    table = [frozenset(now) | {f"{x}@lag1" for x in before} for before, now in zip(HOURS, HOURS[1:])]
    count = lambda itemset: sum(itemset <= row for row in table)
    frequent = [x for x in subsets(frozenset().union(*table)) if count(x) >= math.ceil(0.05 * len(table) - 1e-9)]
    lagged = lambda side: [x for x in side if "@" in x]
    want = set()
    for both in frequent:
        for a in subsets(both):
            c = both - a
            if c and not lagged(c) and lagged(a) and count(both) / count(a) >= 0.3:
                want.add((a, c, round(count(both) / len(table), 6), round(count(both) / count(a), 6), 1))
    assert any(len(a | c) > 2 for a, c, *_ in want)
    assert sides(q.temporal_rules(spark, str(tmp_path)), "support", "confidence", "max_lag") == want


def test_rare_rules(spark, tmp_path):
    # abcd is rare, all of its parts are frequent
    baskets = ["abcd"] * 4 + ["abc", "abd", "acd", "bcd"] * 3 + ["e"] * 4
    spark.createDataFrame([(k, ord(x)) for k, b in enumerate(baskets) for x in b], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(ord(x), x) for x in "abcde"], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    share = lambda itemset: sum(itemset <= set(b) for b in baskets) / len(baskets)
    want = {(a, c, round(share(a | c), 6), round(share(a | c) / share(a), 6)) for a, c in pairs(subsets("abcd")) if len(a) == len(c) == 2 and len(a | c) == 4}
    assert len(want) == 6 and all(conf >= 0.3 for *_, conf in want)
    assert sides(q.rare_rules(spark, str(tmp_path)), "support", "confidence") == want


def test_interesting_rules(spark, tmp_path):
    # regions have no kept ancestor, so all their rules stay
    orders = ["abc"] * 3 + ["ab", "bc"]
    spark.createDataFrame([(k, ord(x)) for k, o in enumerate(orders) for x in o], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    for table, schema, row in (("supplier", "s_suppkey long, s_nationkey long", lambda x: (ord(x), ord(x))), ("nation", "n_nationkey long, n_name string, n_regionkey long", lambda x: (ord(x), x, ord(x))), ("region", "r_regionkey long, r_name string", lambda x: (ord(x), x.upper()))):
        spark.createDataFrame([row(x) for x in "abc"], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    share = lambda itemset: sum(itemset <= set(o.upper()) for o in orders) / len(orders)
    want = {(a, c, round(share(a | c), 6), round(share(a | c) / share(a), 6)) for a, c in pairs(subsets("ABC"))}
    got = sides(q.interesting_rules(spark, str(tmp_path)), "support", "confidence")
    assert {r for r in got if r[0] | r[1] <= set("ABC")} == want


def test_fuzzy_negative_rules(spark, tmp_path):
    # all degrees are 0 or 1
    lines = [(5, 0), (5, 0), (25, 0), (25, 5), (45, 10), (45, 5)]
    spark.createDataFrame([(k, k, float(q_), x / 100) for k, (q_, x) in enumerate(lines)], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    names = [f"qty_{x}" for x in ("low", "medium", "high")] + [f"disc_{x}" for x in ("low", "medium", "high")]
    held = [{names[[5, 25, 45].index(x)], names[3 + [0, 5, 10].index(y)]} for x, y in lines]
    table = [h | {f"~{i}" for i in names if i not in h} for h in held]
    share = lambda itemset: sum(itemset <= row for row in table) / len(table)
    frequent = [x for x in subsets(frozenset().union(*table)) if len({i.strip("~") for i in x}) == len(x) and share(x) >= 0.15]
    want = {(a, both - a, round(share(both), 6), round(share(both) / share(a), 6)) for both in frequent for a in subsets(both) if a != both and any(i[0] == "~" for i in both) and share(both) / share(a) >= 0.5}
    assert any(len(a | c) > 2 for a, c, *_ in want)
    assert sides(q.fuzzy_negative_rules(spark, str(tmp_path)), "FSupp", "FConf") == want


def test_p5_paths(spark, tmp_path):
    # eight steps, each by a short and a long way, and a second root; u and v are a ring below
    links = [(f"n{k + 1}", f"n{k}") for k in range(4)] + [(f"m{k}", f"n{k}") for k in range(4)] + [(f"n{k + 1}", f"m{k}") for k in range(4)] + [("n2", "z"), ("u", "n4"), ("v", "u"), ("u", "v")]
    spark.createDataFrame(links, "child string, parent string").write.parquet(f"{tmp_path}/taxonomy.parquet")
    want, todo = set(), [("n0",), ("z",)]
    while todo:
        path = todo.pop()
        want.add(path)
        todo += [(*path, c) for c, p in links if p == path[-1] and c not in "uv"]
    rows = core_queries.p5_paths(spark, str(tmp_path)).collect()
    got = [tuple(r["path"].split("|")) for r in rows if r["path"]]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(r["depth"] == max(len(p) for p in want if (p[0], p[-1]) == (r["root"], r["item"])) for r in rows if r["path"])
    assert {(r["item"], r["root"], r["depth"], r["on_ring"]) for r in rows if not r["path"]} == {(i, r, 0, True) for i in "uv" for r in ("n0", "z", "u")}


def test_stream_window(spark, tmp_path, monkeypatch):
    added = []
    add = q.BatchWindow.add
    monkeypatch.setattr(q.BatchWindow, "add", lambda self, rows: (added.append(1), add(self, rows)))
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(start + timedelta(days=k), u, x) for k in range(7) for u in (1, 2) for x in "abcd"], "ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["itemset"], r["count"]) for r in q.stream_window_itemsets(spark, str(tmp_path)).collect()}
    assert len(added) == 7 and got == {("|".join(sorted(x)), 6) for x in subsets("abcd")}
    assert {r[:2] for r in sides(q.stream_window_rules(spark, str(tmp_path)))} == set(pairs(subsets("abcd")))


def test_repetitions(spark, monkeypatch):
    # the queries leave the repetitions to the operators
    asked = {}

    def watch(module, name, of):
        def run(*args, **options):
            asked[name] = inspect.signature(of).bind(*args, **options).arguments
            raise StopIteration

        monkeypatch.setattr(module, name, run)

    for query, module, name in ((q.bootstrap_intervals, significance, "confidence_intervals"), (q.permutation_test, significance, "permutation_null"), (q.fuzzy_rule_test, significance, "fuzzy_rule_significance"), (q.sequential_significance, sequences, "sequential_rule_significance")):
        watch(module, name, getattr(module, name))
        with monkeypatch.context() as m:
            m.setattr(q, "cut", lambda frame: frame)
            with pytest.raises(StopIteration):
                query(spark, "/root/testdata/sf0.001")
        assert not {"n_resamples", "n_permutations"} & set(asked[name])
