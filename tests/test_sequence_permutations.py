"""Permutations of sequences: exact odds of every way of drawing, whole counts in blocks and pieces, little shuffled."""

from itertools import permutations

import numpy as np
import pytest

from basketry.operators import sequences

RULES = [(["a"], ["b"]), (["b"], ["a"]), (["a", "b"], ["c"]), (["c"], ["c"]), (["a"], ["z"])]


def table(spark, rows):
    return spark.createDataFrame([(str(k), r) for k, r in enumerate(rows)], "sid string, elements array<array<string>>")


def rules(spark, some=RULES):
    return spark.createDataFrame(some, "antecedents array<string>, consequents array<string>")


def p_values(spark, rows, **options):
    out = sequences.sequential_rule_significance(rows, rules(spark), **options)
    return {("".join(r["antecedents"]), "".join(r["consequents"])): r["p_value"] for r in out.collect()}


def holds(order, a, c):
    first = lambda i: next(k for k, e in enumerate(order) if i in e)
    last = lambda i: max(k for k, e in enumerate(order) if i in e)
    return max(map(first, a)) < min(map(last, c))


def shuffled(spark):
    """Rows written to shuffles by all stages so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = context._gateway
    stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("cells", [1 << 20, 8, 300])
@pytest.mark.parametrize("order", [[["a"], ["b"], ["c"], ["a"]], [["a", "b"], ["c"], ["a"], ["b", "c"]], [["a"], ["a"], ["b"], ["c"], ["c"], ["b"]]])
def test_odds(monkeypatch, cells, order):
    monkeypatch.setattr(sequences, "CELLS", cells)
    odds = np.array([[holds(o, *r) for o in permutations(order)] for r in RULES[:4]]).mean(1)
    got = sequences._at_random(RULES[:4], order, 30, 3000, np.random.default_rng(7))
    spread = np.sqrt(30 * odds * (1 - odds) / 3000)
    assert got.shape == (4, 3000) and (abs(got.mean(1) - 30 * odds) <= 4.5 * spread).all()
    law = 30 * odds * (1 - odds)
    assert np.allclose(got.var(1), law, rtol=0.2)


def test_p_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [[["a"], ["b"], ["x"]]] * 30 + [[[str(i) for i in e] for e in rng.permutation([["a"], ["b"], ["c"], ["c"]])] for _ in range(60)] + [[], None, [["a", "b"]]]
    expected, made = {}, [r for r in rows if r]
    null = np.zeros((400, 4))
    for k in range(400):
        for r in made:
            o = [r[j] for j in rng.permutation(len(r))]
            null[k] += [all(any(i in e for e in o) for i in (*a, *c)) and holds(o, a, c) for a, c in RULES[:4]]
    for j, (a, c) in enumerate(RULES[:4]):
        n = sum(all(any(i in e for e in r) for i in (*a, *c)) and holds(r, a, c) for r in made)
        expected["".join(a), "".join(c)] = (1 + (null[:, j] >= n).sum()) / 401 if n else 1.0
    expected["a", "z"] = 1.0
    got = p_values(spark, table(spark, rows), n_permutations=400)
    assert got["a", "b"] < 0.01 and got["a", "z"] == 1
    assert all(abs(got[k] - v) < 0.15 for k, v in expected.items()) and set(got) == set(expected)
    # the rows' partitions do not change the result; blocks of rules and pieces of equal sequences draw anew
    assert p_values(spark, table(spark, rows).repartition(3), n_permutations=400) == got
    for name, value in (("COUNTERS", 900), ("PIECE", 40), ("CELLS", 60)):
        monkeypatch.setattr(sequences, name, value)
    again = p_values(spark, table(spark, rows), n_permutations=400)
    assert set(again) == set(expected) and all(abs(again[k] - v) < 0.15 for k, v in expected.items())
    with pytest.raises(ValueError):
        p_values(spark, table(spark, rows), n_permutations=0)


def test_permutations_are_not_shuffled(spark):
    rows = table(spark, [[["a"], ["b"], ["c"], ["a"]], [["b"], ["a"], ["c"]]] * 500)
    before = shuffled(spark)
    assert p_values(spark, rows, n_permutations=100)["a", "z"] == 1
    assert 0 < shuffled(spark) - before < 10_000  # 1,000 sequences of three items were 300,000 rows and more
