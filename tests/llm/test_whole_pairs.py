"""p1_pairs against brute force: nothing is left out."""

from itertools import combinations

from basketry.llm import queries as llm_queries


def test_p1_pairs(spark, tmp_path):
    baskets = ["abc", "ab", "ac", "d"]
    spark.createDataFrame([(k, list(b)) for k, b in enumerate(baskets)], "tid long, items array<string>").write.parquet(f"{tmp_path}/transactions.parquet")
    want = {(x, y, sum(x in b and y in b for b in baskets)) for x, y in combinations("abcd", 2) if any(x in b and y in b for b in baskets)}
    got = [(r["item_a"], r["item_b"], r["pair_count"]) for r in llm_queries.p1_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
