import numpy as np

from basketry.llm.quality import COUNTS, EXAMPLES, Kinds, Mixture, block_counts, document_quality, features, unnatural

WORDS = ["the", "is", "and", "la", "の"]


def test_block_counts():
    kinds = Kinds(WORDS)
    texts = ["", "The cat is 7.\n\n+x_y(1)\n+x_y(1)\n", " \n\t", "a\r\nb\r\n\r\nc"]
    doc, counts = block_counts(texts, kinds)
    assert doc.tolist() == [1, 1, 3, 3]
    table = [dict(zip(COUNTS, row)) for row in counts.tolist()]
    assert table[0]["words"] == 3 and table[0]["common"] == 2 and table[0]["ends"] == 1 and table[0]["digits"] == 1
    assert table[1]["lines"] == 2 and table[1]["new_lines"] == 1 and table[1]["odd_words"] == 4
    assert table[2]["lines"] == 2 and table[3]["lines"] == 1
    assert sum(t["chars"] for t in table[:2]) == sum(not c.isspace() for c in texts[1])


def test_mixture_recovers_two_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), rng.normal(6, 0.5, (250, 2))])
    m = Mixture.start(x.mean(0), x.std(0), np.array([[1.0, 1.0], [5.0, 5.0]]))
    for _ in range(50):
        m.step(m.sums(x, np.ones(len(x))), 1e-4)
    assert np.allclose(np.sort(m.weights), [1 / 3, 2 / 3], atol=0.02)
    assert np.allclose(np.sort(m.centres[:, 0] * m.scale[0] + m.mean[0]), [0, 6], atol=0.2)


def test_labelled_documents(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs, words, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "common_words", "text_labels"))
    few = labels.where("doc_id % 2 = 0")
    found = {r["doc_id"] for r in unnatural(docs, words, few).collect()}
    held = [(r["doc_id"], r["label"] == "prose") for r in labels.where("doc_id % 2 = 1").collect()]
    assert len(held) > 10 and sum((i not in found) == p for i, p in held) >= 0.95 * len(held)


def test_quality_cases(spark):
    words = spark.createDataFrame([("en", w) for w in ("the", "is", "a", "of")] + [("en", None)], "lang string, word string")
    rows = [(1, None), (2, ""), (3, " \n"), (4, EXAMPLES[0][1]), (4, EXAMPLES[0][1]), (None, "x"), (5, "one\n" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = document_quality(docs, words).collect()
    assert len(got) == len(rows)
    blank = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert all(r["kind"] == "blank" and r["prose_share"] is None and r["words"] == 0 and r["mean_word_length"] is None for r in blank)
    long = next(r for r in got if r["doc_id"] == 5)
    assert long["words"] == 20_000 and long["lines"] == 20_000 and long["repeated_share"] > 0.99
    assert document_quality(docs.limit(0), words).collect() == []
    assert unnatural(docs.where("doc_id < 4"), words).collect() == []
