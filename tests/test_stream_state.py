"""A window and a monitor go on in a new process where the last one stopped."""

from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from basketry.streaming.windows import BatchWindow, Fraction, RuleDriftMonitor, read_basket_stream, run_basket_stream

BATCHES = [["a b c"] * 9 + ["a b"] * 5 + ["a"] * 3 + ["c d"] * 3, ["a b"] * 8 + ["b c"] * 5 + ["a b c"] * 4 + ["d"] * 3, ["d"] * 15 + ["c d"] * 9, ["a d"] * 6 + ["b d"] * 4 + ["c"] * 9]


def _brute(batches, num, den):
    lines = [x.split() for b in batches for x in b]
    count = Counter(c for i in lines for n in range(1, len(i) + 1) for c in combinations(sorted(i), n))
    return {k: v for k, v in count.items() if v * den >= num * len(lines)}


def _frame(spark, batch):
    return spark.createDataFrame([(x.split(),) for x in batch], "items array<string>")


def test_window_in_a_new_process(spark, tmp_path):
    folder = f"file://{tmp_path}/window"
    first = BatchWindow(Fraction(3, 10), 2, folder)
    for k in (0, 1):
        assert first.add(_frame(spark, BATCHES[k]), k)
    first.itemsets().collect()
    second = BatchWindow(Fraction(3, 10), 2, folder)  # nothing of the first object is used
    assert second.total == 40 and second.full
    assert not second.add(_frame(spark, BATCHES[1]), 1)  # sent again
    assert {tuple(r["itemset"]): r["count"] for r in second.itemsets().collect()} == _brute(BATCHES[:2], 3, 10)
    assert second.add(_frame(spark, BATCHES[2]), 2)
    third = BatchWindow(Fraction(3, 10), 2, folder)
    assert {tuple(r["itemset"]): r["count"] for r in third.itemsets().collect()} == _brute(BATCHES[1:3], 3, 10)
    assert not (tmp_path / "window" / "rows-0").exists()


def test_stream_stops_and_goes_on(spark, tmp_path):
    source, checkpoint = tmp_path / "in", f"file://{tmp_path}/checkpoint"
    source.mkdir()
    seen = {}

    def run():
        stream = read_basket_stream(spark, str(source), maxFilesPerTrigger=1)
        query = run_basket_stream(stream, BatchWindow(Fraction(3, 10), 2), lambda k, found, _: seen.update({k: {tuple(r["itemset"]): r["count"] for r in found.collect()}}), checkpoint=checkpoint, available_now=True)
        query.awaitTermination(180)
        assert query.exception() is None

    for k, batch in enumerate(BATCHES):
        (source / f"{k}.txt").write_text("\n".join(batch) + "\n")
        if k in (1, 3):
            before = set(seen)
            run()
    assert before == {1} and set(seen) == {1, 2, 3}
    orders = [_brute(list(pair), 3, 10) for pair in (BATCHES[0:2], BATCHES[2:4])]
    assert seen[1] == orders[0] and seen[3] == orders[1]


def test_monitor_in_a_new_process(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=k), ["A", "B"] if k < 60 or k % 2 else ["C", "B"]) for k in range(121)]
    frame = lambda part: spark.createDataFrame(part, "ts timestamp, items array<string>")
    whole = RuleDriftMonitor(timedelta(hours=20), min_supp=0.2, min_threshold=0.8)
    whole.update(frame(rows))
    folder = f"file://{tmp_path}/drift"
    for part in (rows[:50], rows[50:90], rows[90:]):
        monitor = RuleDriftMonitor(timedelta(hours=20), min_supp=0.2, min_threshold=0.8, folder=folder)
        monitor.update(frame(part))
    columns = ["window", "antecedents", "consequents", "support"]
    text = lambda m: sorted(map(str, m.rules_.select(*columns).collect()))
    assert monitor.n_windows == whole.n_windows == 6 and text(monitor) == text(whole)


def test_monitor_keeps_no_old_rules(spark, tmp_path):
    rows = [(k, ["A", "B"]) for k in range(60)]
    monitor = RuleDriftMonitor(10, min_supp=0.2, min_threshold=0.8, history=2, folder=f"file://{tmp_path}/drift")
    for k in range(0, 60, 10):
        monitor.update(spark.createDataFrame(rows[k : k + 10], "pos long, items array<string>"))
    assert monitor.n_windows == 6 and len(monitor.frames) == 2
    assert len(list((tmp_path / "drift").glob("rules-*"))) == 2
    assert {r["window"] for r in monitor.rules_.select("window").distinct().collect()} == {4, 5}
    with pytest.raises(ValueError, match="order"):
        monitor.update(spark.createDataFrame([(3, ["A"])], "pos long, items array<string>").where(F.col("pos") > 0))
