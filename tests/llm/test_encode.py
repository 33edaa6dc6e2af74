import numpy as np
import pytest
from changeflow.llm import encode
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokens = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def enc():
    return encode.coder()


def joined(text, enc, at, monkeypatch):
    monkeypatch.setattr(encode, "cuts", lambda t: at)
    parts = encode.ChunkCoder(enc).encode(text)
    return [i for p in parts for i in p.tolist()]


PIECES = st.sampled_from(["don't", "'re", "'", "’", " ", "  ", "\n", "\r\n", "\t", " ", "​", "a", "ab", "Über", "é", "12", "3.5", "...", "?!", "中文字", "。", "ไทย", "ा", "हिन्दी", "🤪", "<|endoftext|>", "\x1c", "ﬁ", "x" * 30])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join), st.data())
def test_joins_at_any_place_give_the_ids_of_the_whole_text(text, data):
    enc = encode.coder()
    at = sorted(data.draw(st.sets(st.integers(1, max(1, len(text) - 1)), max_size=8))) if len(text) > 1 else []
    with pytest.MonkeyPatch.context() as m:
        assert joined(text, enc, [*at, len(text)] if text else [], m) == enc.encode_ordinary(text)


def test_a_chunk_is_encoded_once_and_forgetting_changes_nothing(enc):
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400)]
    page = " ".join(r.choice(words) for _ in range(2000))
    texts = [page, page + " More.", "Before it. " + page, page]
    for most in (encode.MOST_KEPT, 100):
        c = encode.ChunkCoder(enc, most)
        for t in texts:
            assert [i for p in c.encode(t) for i in p.tolist()] == enc.encode_ordinary(t)
        if most > 100:
            assert c.coded < 0.4 * c.chunks


def test_sizes_are_the_numbers_of_ids(spark, enc):
    df = spark.createDataFrame([(1, "Hello there. " * 99), (2, None), (None, ""), (1, "Hello there. " * 99)], "doc_id bigint, text string")
    n = len(enc.encode_ordinary("Hello there. " * 99))
    assert sorted((r.doc_id or 0, r.size) for r in encode.token_counts(df).collect()) == [(0, 0), (1, n), (1, n), (2, 0)]


def test_cuts_depend_on_content_only():
    import random

    r = random.Random(1)
    body = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(3000))
    assert encode.cuts("") == [] and encode.cuts("x") == [1] and encode.cuts(body)[-1] == len(body)
    chunks = lambda t: {t[a:b] for a, b in zip([0, *encode.cuts(t)], encode.cuts(t), strict=False)}
    one, two = chunks(body), chunks("Another beginning. " + body[:7000] + "!" + body[7000:])
    assert len(one & two) > 0.8 * len(one)
    assert all(b - a >= encode.LEAST for a, b in zip([0, *encode.cuts(body)], encode.cuts(body)[:-1], strict=False))


def test_all_rows_come_back(spark, enc):
    long = "word " * 60_000 + "中" * 20_000 + "x" * 20_000
    rows = [(1, "Hello <|endoftext|> world"), (2, None), (3, ""), (4, long), (4, long), (None, "null id"), (None, None), (5, " \n "), (6, "same"), (6, "same"), (6, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as ids", "1 as chunk", "'t' as text_key")
    got = encode.encode(df).collect()
    key = lambda d, ids: (d or -1, len(ids), ids[:5])
    assert sorted(key(r.doc_id, r.ids) for r in got) == sorted(key(d, enc.encode_ordinary(t or "")) for d, t in rows)
    assert next(r.ids for r in got if r.doc_id == 4) == enc.encode_ordinary(long)
    assert encode.encode(df.limit(0)).count() == 0


def test_small_batches_of_ids(spark, enc, monkeypatch):
    monkeypatch.setattr(encode, "BATCH_IDS", 50)
    parts = [np.arange(30, dtype=np.int32), np.arange(5, dtype=np.int32)]
    b = encode._id_batch([1, None, 2], [parts, [], [parts[1]]])
    assert b.column(1).to_pylist() == [[*range(30), *range(5)], [], [*range(5)]]


def test_copies_of_one_text_and_equal_rows_are_many_tasks(spark):
    text = "A line that is long enough to be the route of its text.\n" * 3
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    n = encode.together(df).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert n < 20_000 / 2
    same = spark.range(0, 20_000, 1, 8).select(F.lit(1).alias("doc_id"), F.lit(text).alias("text"))
    assert encode.together(same).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 20_000 / 2


def test_the_library_agrees(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.ids for r in encode.encode(docs).collect()} == want
