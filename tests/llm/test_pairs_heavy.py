from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from basketry.llm import pairs
from basketry.llm.heavy import CountMin, frequent_items, heavy_hitters
from basketry.llm.pairs import cooccurrence

SCHEMA = "tid bigint, items array<string>"
ROWS = [
    (1, ["b ", "a", "a", None, " "]), (1, ["c", "a"]), (2, ["a", "b"]), (3, None), (4, []), (5, [" a\t", "c"]), (None, ["a", "b"]), (6, ["B", "a"]), (2, ["b", "a"]),
]


def brute(rows):
    baskets = {}
    for tid, items in rows:
        if tid is not None:
            baskets.setdefault(tid, set()).update(i.strip() for i in items or [] if i and i.strip())
    single = Counter(i for b in baskets.values() for i in b)
    pair = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    return {(a, b): (k, single[a], single[b], len(baskets)) for (a, b), k in pair.items()}, single


def got(frame):
    return {(r["item_a"], r["item_b"]): (r["pair_count"], r["count_a"], r["count_b"], r["baskets"]) for r in frame.collect()}


@pytest.mark.parametrize("block", [2, 256])
def test_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = ROWS + [(100 + k, [f"i{j}" for j in rng.integers(0, 12, rng.integers(0, 9))]) for k in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want, _ = brute(rows)
    assert got(cooccurrence(frame)) == want
    assert got(cooccurrence(frame, min_count=6)) == {k: v for k, v in want.items() if v[0] >= 6}
    strong = cooccurrence(frame, min_count=2, min_lift=1.2)
    assert got(strong) == {k: v for k, v in want.items() if v[0] >= 2 and v[0] * v[3] / (v[1] * v[2]) >= 1.2}


def test_pairs_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 0)
    assert got(cooccurrence(spark.createDataFrame(ROWS, SCHEMA))) == brute(ROWS)[0]


def test_pairs_empty(spark):
    assert cooccurrence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_never_below():
    rng = np.random.default_rng(2)
    sketch, true = CountMin(6, 3), Counter()
    for _ in range(20):
        values, n = np.unique(rng.zipf(1.3, 500) % 1000, return_counts=True)
        estimates = sketch.add(values.astype(np.int64), n)
        true.update(dict(zip(values.tolist(), n.tolist())))
        assert all(e >= true[v] for v, e in zip(values.tolist(), estimates.tolist()))


def test_heavy_small_heap_and_buffer(spark):
    rng = np.random.default_rng(4)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 5000) % 3000] + [None] * 10
    frame = spark.createDataFrame([(w,) for w in words], "v string").repartition(6)
    count = Counter(w for w in words if w)
    total = sum(count.values())
    want = {w for w, n in count.items() if n >= 0.01 * total}
    rows = {r["value"]: r for r in heavy_hitters(frame, 0.01, width_bits=8, heap=2, buffer=50).collect()}
    assert want <= set(rows)
    assert all(r["estimate"] >= count[v] and r["total"] == total for v, r in rows.items())


def test_frequent_items(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    _, single = brute(ROWS)
    total = sum(single.values())
    for share in (0.1, 0.3, 1.0):
        got = {r["item"]: r["occurrences"] for r in frequent_items(frame, share).collect()}
        assert got == {i: n for i, n in single.items() if n >= share * total}
    assert frequent_items(frame.limit(0), 0.1).collect() == []
