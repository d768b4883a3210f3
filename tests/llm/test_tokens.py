import numpy as np
import pytest

from basketry.llm.bpe import DEFAULT_VOCABULARY, Encoder
from basketry.llm.packing import fill, pack, pack_histogram
from basketry.llm.tokens import count_tokens, encode_texts

ODD = [
    "", "'s't're'll 's \n's\n 's  's", "   ", " \n ", "a'", "'", "''s", "don't we've I'll 'tis x'd'd", "  x 　y", "日本語 テキスト́", "x" * 300, "ab" * 5000,
    "<|endoftext|> a <|endoftext|>", "\x1c\x1d a\x85b", "1²½Ⅷ٣ a٣", "é é 👩‍🔧", "\r\n\r\n a\r\n", "A​B", "hello hello", "'S 'T", " 'LL", "q" * 257 + " " + "q" * 257,
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(reference):
    ids, n = Encoder().encode(ODD)
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == reference(ODD)


def test_random_texts(reference):
    rng = np.random.default_rng(3)
    alphabet = list("aeintros  '\n.,0123_-(){}éßжの👍​\t")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(3000)]
    encoder = Encoder()
    for _ in range(2):  # the second time from the cache
        ids, n = encoder.encode(texts)
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == reference(texts)


def test_all_letters(reference):
    texts = ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x3200, 64)]
    ids, n = Encoder().encode(texts)
    ends = np.cumsum(n)
    got, want = [ids[e - k : e].tolist() for e, k in zip(ends, n)], reference(texts)
    assert [k for k in range(len(texts)) if got[k] != want[k]] == []


def test_documents(spark, sf, reference):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in encode_texts(rows).collect()}
    docs = rows.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], reference([r["text"] or "" for r in docs])))
    assert got == want
    counts = {r["doc_id"]: r["tokens"] for r in count_tokens(rows).collect()}
    assert counts == {k: len(v) for k, v in want.items()}


def test_null_repeated_and_clashing(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a b", "z"), (None, "a b", "z")], "doc_id int, text string, ids string")
    got = sorted((r["doc_id"] or 0, len(r["ids"])) for r in encode_texts(rows).collect())
    assert got == [(0, 2), (0, 2), (1, 0), (1, 0)]
    assert encode_texts(rows.limit(0)).collect() == []


def check_packing(sizes, packed, capacity):
    rows = packed.collect()
    used = {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
    assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
    for key, pieces in per.items():
        pieces.sort()
        assert [p for p, _ in pieces] == list(range(len(pieces)))
        assert sum(t for _, t in pieces) == sizes[key] and all(t == capacity for _, t in pieces[:-1])
    assert set(per) == {k for k, v in sizes.items() if v}
    return len(used)


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_pack(spark, capacity):
    rng = np.random.default_rng(capacity)
    sizes = {k: int(v) for k, v in enumerate(rng.integers(0, 3 * capacity // 2 + 2, 800))}
    rows = spark.createDataFrame(list(sizes.items()), "doc_id bigint, tokens bigint").repartition(5)
    n = check_packing(sizes, pack(rows, capacity=capacity), capacity)
    assert n <= 1.25 * -(-sum(sizes.values()) // capacity) + 1


def test_pack_hot_size_nulls_and_empty(spark):
    rows = spark.createDataFrame([(k, 700) for k in range(300)] + [(300 + k, 5) for k in range(50)], "doc_id bigint, tokens bigint")
    sizes = {r["doc_id"]: r["tokens"] for r in rows.collect()}
    check_packing(sizes, pack(rows), 2048)
    odd = spark.createDataFrame([(None, 3), (None, 3), (1, None), (2, 0)], "doc_id bigint, tokens bigint")
    assert [(r["doc_id"], r["tokens"]) for r in pack(odd).collect()] == [(None, 3), (None, 3)]
    assert pack(odd.limit(0)).collect() == []
    assert fill(pack(odd.limit(0))).first()["fill"] is None


def test_pack_histogram_uses_all():
    rng = np.random.default_rng(1)
    counts = np.zeros(129, np.int64)
    counts[1:] = rng.integers(0, 40, 128)
    plan = pack_histogram(counts, 128)
    used = np.zeros(129, np.int64)
    for n, sizes in plan:
        assert sum(sizes) <= 128
        for s in sizes:
            used[s] += n
    assert (used == counts).all()
    # containers are at least the total's share, and one for each piece of more than half
    least = max(-(-int((counts * np.arange(129)).sum()) // 128), int(counts[65:].sum()))
    assert sum(n for n, _ in plan) <= 1.05 * least
