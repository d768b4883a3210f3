from itertools import product

import numpy as np
import pytest

from basketry.llm import quantiles
from basketry.llm.quantiles import Summary, merge_summaries, misstated, quantile_bounds, summarise
from basketry.llm.sequences import candidates, frequent_orders, state_orders


@pytest.mark.parametrize("seed", range(5))
def test_summary_bounds(seed):
    rng = np.random.default_rng(seed)
    parts = [np.sort(np.round(rng.normal(size=rng.integers(1, 900)), 2)) for _ in range(12)]
    made = [Summary.of_sorted(p).compress(20) for p in parts]
    whole = Summary.merge([Summary.merge(made[:5]).compress(20), Summary.merge(made[5:]).compress(30)]).compress(25)
    values = np.sort(np.concatenate(parts))
    assert whole.n == len(values)
    low, high = np.searchsorted(values, whole.values, "left") + 1, np.searchsorted(values, whole.values, "right")
    assert (whole.low <= high).all() and (whole.high >= low).all() and (np.diff(whole.low) >= 0).all() and (np.diff(whole.high) >= 0).all()
    for q in np.linspace(0, 1, 41):
        lower, upper, _, _ = whole.bounds(q)
        assert lower <= np.quantile(values, q) + 1e-12 and upper >= np.quantile(values, q) - 1e-12
    assert whole.error <= len(values) * 4 / 25


def test_daily_summaries_combine(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(d), float(v)) for k, d, v in zip(rng.integers(0, 3, 3000), rng.integers(0, 5, 3000), rng.exponential(size=3000))] + [(0, 1, None), (1, 2, float("nan")), (None, 0, 5.0)]
    frame = spark.createDataFrame(rows, "k int, d int, v double").repartition(4)
    days = merge_summaries(summarise(frame, ["k", "d"], "v", 30, 500), ["k", "d"], 30)
    got = quantile_bounds(merge_summaries(days, ["k"], 30), ["k"], [0.1, 0.5, 0.9]).collect()
    for r in got:
        values = [v for k, _, v in rows if k == r["k"] and v is not None and v == v]
        assert r["n"] == len(values) and r["lower"] - 1e-9 <= np.quantile(values, r["share"]) <= r["upper"] + 1e-9
        assert r["error"] <= 0.1 * len(values)
    assert {r["k"] for r in got} == {0, 1, 2, None}


@pytest.mark.parametrize("tuples", [8, 400])
def test_misstated(spark, monkeypatch, tuples):
    for f in (quantiles.summarise, quantiles.merge_summaries):
        monkeypatch.setattr(f, "__defaults__", (tuples, *f.__defaults__[1:]))
    rng = np.random.default_rng(7)
    conf, lift = np.round(rng.uniform(-0.05, 1.05, 400), 3), rng.exponential(size=400)
    rules = [(k, int(k % 5), float(conf[k]), float("inf") if k % 50 == 0 else float(lift[k])) for k in range(400)]
    rules += rules[:20] + [(None, 1, 0.5, 1.0)]
    groups = []
    for s in range(30):
        members = [int(x) for x in rng.integers(0, 450, rng.integers(1, 300))]
        v = [c for k, _, c, _ in rules[:400] if k in set(members) and 0 <= c <= 1]
        w = [x for k, _, _, x in rules[:400] if k in set(members) and x < float("inf")]
        shift = rng.choice([0, 0, 0.04, -0.2, 0.3], 6)
        stated = [float(np.quantile(x, min(1, max(0, q + d)))) if x else 0.5 for x, q, d in zip([v] * 3 + [w] * 3, [0.25, 0.5, 0.75] * 2, shift)]
        if s % 4 == 0:
            stated[2] = None
        groups.append((f"s{s}", members + [None] if s % 3 else members, *stated))
    groups.append(("none", None, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1))
    names = [f"{m}_q{q}" for m in ("confidence", "lift") for q in (25, 50, 75)]
    want = set()
    table = {k: (c, x) for k, _, c, x in rules if k is not None}
    for sid, members, *stated in groups:
        for i, name in enumerate(names):
            side = i // 3
            v = [table[k][side] for k in set(members or []) if k in table]
            v = [x for x in v if x >= 0 and (x <= 1 if side == 0 else x < float("inf"))]
            q = int(name[-2:]) / 100
            if v and stated[i] is not None and (stated[i] < np.quantile(v, q - 0.05) or stated[i] > np.quantile(v, q + 0.05)):
                want.add((sid, name))
    r = spark.createDataFrame(rules, "rule_id bigint, mined_day int, confidence double, lift double")
    s = spark.createDataFrame(groups, "summary_id string, members array<bigint>, " + ", ".join(f"{n} double" for n in names))
    assert {(x["summary_id"], x["stat"]) for x in misstated(s, r).collect()} == want and want
    assert misstated(s.limit(0), r).collect() == [] and misstated(s, r.limit(0)).collect() == []


def contains(moments, pattern):
    at = -1
    for step in pattern:
        at = next((k for k in range(at + 1, len(moments)) if step in moments[k]), None)
        if at is None:
            return False
    return True


@pytest.mark.parametrize("long", [2, 20_000])
def test_orders(spark, long):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(11)
    start = datetime(2024, 1, 1)
    rows = [(f"h{int(h)}", start + timedelta(minutes=int(m) * 7), "abcde"[int(s)]) for h, m, s in zip(rng.integers(0, 20, 400), rng.integers(0, 60, 400), rng.integers(0, 5, 400))]
    rows += rows[:30] + [(None, start, "a"), ("h1", None, "a"), ("h1", start, None)]
    frame = spark.createDataFrame(rows, "h string, t timestamp, s string")
    table = {}
    for h, t, s in rows:
        if h and t and s:
            table.setdefault(h, {}).setdefault(t, set()).add(s)
    sequences = [[m[t] for t in sorted(m)] for m in table.values()]
    want = {}
    for n in (1, 2, 3, 4):
        for p in product("abcde", repeat=n):
            k = sum(contains(q, p) for q in sequences)
            if k >= 0.6 * len(sequences):
                want[p] = k
    got = {tuple(r["pattern"]): r["support"] for r in frequent_orders(frame, ["h"], "t", "s", 0.6, 4, piece=long).collect()}
    assert got == want and any(len(p) == 4 for p in want)


def test_orders_degenerate(spark):
    empty = spark.createDataFrame([], "house string, day string, time timestamp, state string")
    assert state_orders(empty).collect() == []
    assert candidates({("a", "b"), ("b", "c")}) == [] and candidates({("a", "a")}) == [("a", "a", "a")]
