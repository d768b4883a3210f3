from datetime import datetime, timedelta

import numpy as np
import pytest

from basketry.operators.grid import missing_hours, regular_grid
from basketry.operators.hierarchy import descendants, hierarchy

PAIRS = "child string, parent string"


def brute(pairs):
    items, above = set(), {}
    for c, p in pairs:
        c, p = (c or "").strip(), (p or "").strip()
        if c:
            items.add(c)
            if p:
                items.add(p)
                above.setdefault(c, set()).add(p)
    reach = {}
    for i in items:
        seen, todo = set(), [i]
        while todo:
            for p in above.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        reach[i] = seen
    ring = {i: min(j for j in reach[i] | {i} if j == i or i in reach[j]) for i in items if i in reach[i]}

    def longest(i, r):
        return 1 if i == r else 1 + max(longest(p, r) for p in above[i] if p == r or r in reach[p])

    out = set()
    for i in items:
        roots = {r for r in reach[i] | {i} if not above.get(r)}
        mine = {ring[j] for j in reach[i] | {i} if j in ring}
        out |= {(i, r, 0) for r in roots | mine} if mine else {(i, r, longest(i, r)) for r in roots}
    return out, reach, ring


CASES = {
    "dag": [("b", "a"), ("c", "b"), ("x", "c"), ("x", "d"), ("x ", "\td"), ("c", "a"), (None, "a"), (" ", "q"), ("solo", None), ("e", "")],
    "rings": [("b", "a"), ("a", "b"), ("c", "b"), ("d", "c"), ("d", "r"), ("s", "s"), ("t", "s"), ("t", "d"), ("u", "t"), ("f", "e"), ("g", "f"), ("e", "g"), ("f", "a"), ("h", "r"), ("k", "g"), ("m", "k"), ("n", "m"), ("m", "n")],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    pairs = CASES[name]
    frame = spark.createDataFrame([(c, p, 1) for c, p in pairs], PAIRS + ", item int")
    want, reach, ring = brute(pairs)
    rows = hierarchy(frame).collect()
    assert {(r["item"], r["root"], r["depth"]) for r in rows} == want
    for r in rows:
        assert r["on_ring"] == (r["item"] in ring)
        if r["depth"]:
            assert len(r["path"]) == r["depth"] and r["path"][0] == r["root"] and r["path"][-1] == r["item"]
            assert all(p in reach[c] for p, c in zip(r["path"], r["path"][1:]))
        else:
            assert r["path"] is None
    assert {(r["item"], r["descendant"]) for r in descendants(frame).collect()} == {(a, i) for i, up in reach.items() for a in up}


def test_random(spark):
    rng = np.random.default_rng(8)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (75, 2))]
    got = {(r["item"], r["root"], r["depth"]) for r in hierarchy(spark.createDataFrame(pairs, PAIRS), paths=False).collect()}
    assert got == brute(pairs)[0]


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], PAIRS)).collect() == []
    assert descendants(spark.createDataFrame([], PAIRS)).collect() == []


START = datetime(2024, 1, 1)


def test_grid_cases(spark):
    rows = [("a", START + timedelta(minutes=5), 1.0), ("a", START + timedelta(minutes=5), 1.0), ("a", START + timedelta(minutes=50), 4.0), ("a", START + timedelta(hours=3), 2.0), ("b", START, 5.0), ("a", START + timedelta(hours=503), 9.0), (None, START, 1.0), ("c", None, 1.0), ("c", START, None), ("c", START, float("nan"))]
    got = regular_grid(spark.createDataFrame(rows, "s string, time timestamp, v double"), "s", "time", "v").collect()
    a = {r["slot"]: r for r in got if r["s"] == "a"}
    zero = min(a)
    assert a[zero]["v"] == 2.5 and a[zero]["readings"] == 2 and a[zero]["status"] == "observed"
    assert [a[zero + 3600 * k]["gap"] for k in (1, 2)] == [2, 2] and len(a) == 504
    assert a[zero + 3600 * 4]["status"] == "out" and a[zero + 3600 * 4]["v"] is None
    assert {r["s"] for r in got} == {"a", "b"}
    assert regular_grid(spark.createDataFrame([], "s string, time timestamp, v double"), "s", "time", "v").collect() == []


def test_low_rank_gaps(spark):
    rng = np.random.default_rng(3)
    people, hours = rng.normal(size=(40, 2)), rng.normal(size=(60, 2))
    true = 10 + people @ hours.T
    rows, hidden = [], {}
    for i in range(40):
        for j in range(60):
            if 0 < j < 59 and rng.random() < 0.25:
                hidden[f"h{i}", j] = true[i, j]
            else:
                rows.append((f"h{i}", START + timedelta(hours=j, minutes=int(rng.integers(60))), float(true[i, j])))
    got = regular_grid(spark.createDataFrame(rows, "s string, time timestamp, v double"), "s", "time", "v", rank=3, iterations=12, ridge=0.01).where("status <> 'observed'").collect()
    base = min(r["slot"] for r in got) // 3600 * 3600
    zero = 1704067200
    assert len(got) == len(hidden) and base >= zero
    error = [r["v"] - hidden[r["s"], (r["slot"] - zero) // 3600] for r in got if r["v"] is not None]
    assert len(error) >= 0.95 * len(hidden) and np.sqrt(np.mean(np.square(error))) < 0.5 * np.std(list(hidden.values()))


def test_missing_hours(spark):
    rows = [(" h\t", START, 20.0), ("h", START + timedelta(hours=2), 21.0), ("h", START + timedelta(hours=1), -999.0), ("h", datetime(2010, 1, 1), 20.0), ("h", START + timedelta(hours=1), None)]
    got = [(r["house"], r["slot"]) for r in missing_hours(spark.createDataFrame(rows, "house string, time timestamp, temp double")).collect()]
    assert got == [("h", 1704067200 + 3600)]
