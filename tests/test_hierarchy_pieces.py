import numpy as np
from test_hierarchy_grid import PAIRS, brute

from basketry.operators import hierarchy as h


def found(spark, pairs):
    return [tuple(r) for r in h.hierarchy(spark.createDataFrame(pairs, PAIRS), paths=False).collect()]


def deep(n):
    """A chain with a second root halfway, a ring below its end, and an item of its own."""
    return [(f"c{k + 1:03}", f"c{k:03}") for k in range(n)] + [(f"c{n // 2:03}", "z"), ("u", f"c{n:03}"), ("v", "u"), ("u", "v"), ("solo", None)]


def test_jobs_do_not_grow_with_depth(spark):
    context = spark.sparkContext
    spark.sparkContext.setJobGroup("deep", "deep")
    try:
        rows = found(spark, deep(60))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    want, _, ring = brute(deep(60))
    assert len(rows) == len(want) and {r[:3] for r in rows} == want
    assert all(r[3] == (r[0] in ring) for r in rows)
    assert 0 < len(context.statusTracker().getJobIdsForGroup("deep")) < 60


def test_both_ways_agree(spark, monkeypatch):
    # pieces of more than 12 rows go by levels, the others to a task; tasks join 6 names at a time
    rng = np.random.default_rng(5)
    pairs = deep(16) + [(f"p{g}-{a}", f"p{g}-{b}") for g in range(12) for a, b in rng.integers(0, 9, (int(rng.integers(3, 20)), 2))]
    want, _, ring = brute(pairs)
    calls, levels = [], h._levels
    monkeypatch.setattr(h, "_levels", lambda rows, *other: (calls.append(rows.count()), levels(rows, *other))[1])
    for piece, joined in ((12, 6), (h.PIECE, 6), (0, 6)):
        monkeypatch.setattr(h, "PIECE", piece)
        monkeypatch.setattr(h, "JOINED", joined)
        rows = found(spark, pairs)
        assert len(rows) == len(want) and {r[:3] for r in rows} == want
        assert all(r[3] == (r[0] in ring) for r in rows)
    distinct = len(set(pairs))
    assert len(calls) == 2 and 0 < calls[0] < distinct and calls[1] == distinct


def test_components_of_a_shuffled_chain(spark, monkeypatch):
    monkeypatch.setattr(h, "JOINED", 4)
    names = [f"n{k:03}" for k in np.random.default_rng(2).permutation(120)]
    pairs = list(zip(names[1:100], names)) + list(zip(names[101:], names[100:]))
    got = {r["item"]: r["component"] for r in h.components(spark.createDataFrame(pairs, PAIRS), len(pairs)).collect()}
    parts = (names[:100], names[100:])
    assert got == {x: min(part) for part in parts for x in part if x != min(part)}
