"""Parts of the two-pass miner: few candidates whatever the number of rows, and exact results."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import itemsets


def _brute(baskets, share):
    count = {}
    for basket in baskets:
        for size in range(1, len(basket) + 1):
            for itemset in combinations(sorted(basket), size):
                count[itemset] = count.get(itemset, 0) + 1
    return {k: n for k, n in count.items() if n >= itemsets.min_count(share, len(baskets))}


@pytest.fixture
def candidates(monkeypatch):
    """The numbers of candidates of the runs of a test."""
    seen = []
    real = itemsets._blocks

    def spy(table, count):
        seen.append(count)
        return real(table, count)

    monkeypatch.setattr(itemsets, "_blocks", spy)
    return seen


@pytest.mark.parametrize("rows", [50_001, 100_003])
def test_wide_baskets_in_one_partition(spark, candidates, rows):
    # 18 of 60 items per basket: a part of few rows would make 2^18 itemsets of each basket frequent
    frame = spark.range(rows, numPartitions=1).select(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda k: F.concat(F.lit("i"), F.format_string("%02d", F.pmod(F.xxhash64("id", k), F.lit(60))))).alias("items"))
    frame = frame.select(F.array_sort(F.array_distinct("items")).alias("items"))
    found = itemsets.mine(frame, 0.06, max_len=None)
    got = {tuple(r["itemset"]): int(r["sums"][0]) for r in found.collect()}
    assert candidates and max(candidates) <= 2_000
    table = np.zeros((rows, 60), bool)
    for k, r in enumerate(frame.collect()):
        table[k, [int(i[1:]) for i in r["items"]]] = True
    least = itemsets.min_count(0.06, rows)
    pairs = table.T.astype(np.int64) @ table
    name = [f"i{k:02d}" for k in range(60)]
    want = {(name[a],): int(pairs[a, a]) for a in range(60) if pairs[a, a] >= least}
    want |= {(name[a], name[b]): int(pairs[a, b]) for a in range(60) for b in range(a + 1, 60) if pairs[a, b] >= least}
    assert {k: n for k, n in got.items() if len(k) <= 2} == want
    assert all(len(k) <= 2 for k in got)  # three items stand together in 2.3 % of the baskets


def test_uneven_groups_stay_whole(spark):
    rng = np.random.default_rng(3)
    rows, by = [], {}
    for group in range(200):
        for _ in range(int(rng.integers(1, 40)) if group else 3_000):  # one group holds a third and more
            basket = [i for i in "abcdef" if rng.random() < 0.5]
            rows.append((f"g{group}", basket))
            by.setdefault(f"g{group}", []).append(basket)
    frame = spark.createDataFrame(rows, "grp string, items array<string>")
    found = itemsets.mine(frame, 0.3, group="grp", chunk=500, least_part=100)
    got = {}
    for r in found.collect():
        got.setdefault(r["grp"], {})[tuple(r["itemset"])] = int(r["sums"][0])
    for group, baskets in by.items():
        assert got.get(group, {}) == _brute(baskets, 0.3), group


def test_candidates_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    baskets = [[i for i in "abcdefgh" if rng.random() < 0.4] for _ in range(400)]
    monkeypatch.setattr(itemsets, "BLOCK", 7)
    frame = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    found = itemsets.mine(frame, 0.05, chunk=64, least_part=32)
    assert {tuple(r["itemset"]): int(r["sums"][0]) for r in found.collect()} == _brute(baskets, 0.05)
    wanted = found.select("itemset")
    assert {tuple(r["itemset"]): r["count"] for r in itemsets.count_table(frame, wanted).collect()} == _brute(baskets, 0.05)


def test_equal_baskets_are_merged_with_their_number(spark):
    baskets = [["a", "b"]] * 700 + [["b"]] * 200 + [[]] * 100
    frame = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    found = itemsets.mine(frame, 0.1)
    assert {tuple(r["itemset"]): (int(r["sums"][0]), r["n"]) for r in found.collect()} == {("a",): (700, 1000), ("b",): (900, 1000), ("a", "b"): (700, 1000)}
