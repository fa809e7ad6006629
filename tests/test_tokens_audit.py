"""Tokens, padding, batches and overlap audits."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from textprov import tables
from textprov.operators import audit, batches, tokens

SF01 = "/root/testdata/sf0.01"


def test_vocab_and_encode(spark):
    df = spark.createDataFrame([(1, "b a a c"), (2, "a b"), (3, ""), (4, "zzz a")], "example_id long, text string")
    v = tokens.build_vocab(df, size=2)
    assert [(r.token, r.id, r.n) for r in v.orderBy("id").collect()] == [("a", 2, 4), ("b", 3, 2)]
    enc = {r.example_id: r for r in tokens.encode(df, v, vocab_size=2, max_len=3).collect()}
    assert enc[1].input_ids == [3, 2, 2] and enc[1].token_length == 4  # truncated, untruncated length
    assert enc[1].attention_mask == [1, 1, 1]
    assert enc[3].input_ids == [] and enc[3].token_length == 0
    assert enc[4].input_ids == [1, 2]  # unknown -> 1


def test_encode_is_a_map_over_rows(spark):
    """Rows that share an id stay apart; null texts, long texts and whole sequences."""
    df = spark.createDataFrame([(1, "a b", "x"), (1, "b c", "y"), (2, None, "z"), (3, "a " * 3000, "w")],
                               "example_id long, text string, extra string")
    v = tokens.build_vocab(spark.createDataFrame([("a a b",)], "text string"), size=2)
    enc = tokens.encode(df, v, vocab_size=2, carry=["extra"])
    assert "Exchange" not in enc._jdf.queryExecution().executedPlan().toString()
    got = {r.extra: r for r in enc.collect()}
    assert got["x"].input_ids == [2, 3] and got["y"].input_ids == [3, 1]
    assert got["z"].input_ids == [] and got["z"].attention_mask == []
    assert got["w"].input_ids == [2] * 3000 and got["w"].token_length == 3000


def test_pad_batches_exact(spark):
    df = spark.createDataFrame([(i, list(range(1, i + 2))) for i in range(10)], "example_id long, input_ids array<int>")
    b = batches.assign_batches(df, 4)
    p = batches.pad_batch(b, cap=6).collect()
    by_batch = {}
    for r in p:
        by_batch.setdefault(r.batch_id, []).append(r)
    assert sorted(len(v) for v in by_batch.values()) == [2, 4, 4]
    for rows in by_batch.values():
        m = min(max(len(r.input_ids) for r in rows), 6)
        for r in rows:
            k = min(len(r.input_ids), m)
            assert r.padded_ids == r.input_ids[:k] + [0] * (m - k)
            assert r.padded_mask == [1] * k + [0] * (m - k)


def test_batches_are_full_but_the_last(spark):
    df = spark.range(1000).withColumnRenamed("id", "example_id")
    b = batches.assign_batches(df, 64, bucket_rows=20)
    sizes = {r.batch_id: r.c for r in b.groupBy("batch_id").agg(F.count("*").alias("c")).collect()}
    assert sizes == {i: 64 if i < 15 else 40 for i in range(16)}


def test_subword_tokenizer_path(spark, tmp):
    from tokenizers import Tokenizer, models, pre_tokenizers
    vocab = {"[UNK]": 0, "a": 1, "b": 2}
    tok = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = os.path.join(tmp, "tok.json")
    tok.save(path)
    df = spark.createDataFrame([("a b c a",), ("",)], "text string")
    r = df.select(tokens.subword_lengths(F.col("text"), path).alias("n"),
                  tokens.subword_encode(F.col("text"), path, max_len=3).alias("e")).collect()
    assert r[0].n == 4 and r[0].e.input_ids == [1, 2, 0] and r[0].e.token_length == 4
    assert r[1].n == 0


def test_subword_texts_are_encoded_in_bounded_slices(monkeypatch):
    asked = []

    class Tok:
        def encode_batch(self, texts):
            asked.append(sum(map(len, texts)))
            return [t.split() for t in texts]
    monkeypatch.setattr(tokens, "SLICE_CHARS", 100)
    texts = ["a b " * (i % 7) for i in range(300)] + [None, "", "é " * 400, None]
    got = [e for enc in tokens._encoded(Tok(), pa.array(texts)) for e in enc]
    assert got == [(t or "").split() for t in texts]
    assert max(asked[:-1]) <= 100 + 24 and max(asked) <= 800 + 100     # a text that is longer goes by itself
    assert list(tokens._encoded(Tok(), pa.array([], pa.string()))) == []


def test_subword_lengths_and_ids_of_many_slices(spark, tmp):
    from tokenizers import Tokenizer, models, pre_tokenizers
    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = os.path.join(tmp, "tok.json")
    tok.save(path)
    texts = [None, "", "a " * 2_000_000, *["a b c"] * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    rows = df.select("i", tokens.subword_lengths(F.col("text"), path).alias("n"),
                     tokens.subword_encode(F.col("text"), path).alias("e")).orderBy("i").collect()
    want = [len((t or "").split()) for t in texts]
    assert [r.n for r in rows] == want and [r.e.token_length for r in rows] == want
    assert all(r.e.input_ids == [1, 2, 0] and r.e.attention_mask == [1, 1, 1] for r in rows[3:])
    assert len(rows[2].e.input_ids) == 2_000_000


def test_shingle_audit_finds_planted_passages(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"),
                                   (2, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "prefix words ONE two three four five six seven eight nine ten suffix"),
        (11, "one two three four five six seven eight"),
        (12, "unrelated text entirely with many words but none shared at all"),
    ], "doc_id long, text string")
    got = {(r.item_id, r.doc_id): r.containment for r in audit.shingle_overlap(docs, bench).collect()}
    assert got == {(1, 10): 1.0}  # doc 11 holds 1 of 3 shingles (< 0.5)
    assert audit.exact_matches(docs, bench).count() == 0


def test_benchmark_golden_sf001(spark):
    docs = tables.read(spark, SF01, "documents").select("doc_id", "text")
    bench = tables.read(spark, SF01, "benchmark").select("item_id", "text")
    # brute force: documents holding a whole benchmark passage as a substring
    items = [r.text for r in bench.collect()]
    holding = {r.doc_id for r in docs.collect() if any(t in r.text for t in items)}
    assert len(holding) == 26
    found = {r.doc_id for r in audit.shingle_overlap(docs, bench).collect()}
    assert holding <= found  # none missed
    assert audit.exact_matches(docs, bench).count() == 0


def test_batch_model_scores(spark):
    import numpy as np
    from textprov.operators import score
    df = spark.createDataFrame([(1, [5, 6, 7], 1), (2, [], 0), (3, list(range(600)), 1)],
                               "example_id long, input_ids array<int>, label int")

    def make():
        def predict(ids, mask):
            n = mask.sum(axis=1).astype(float)
            return np.stack([np.zeros_like(n), n - 2.5], axis=1)
        return predict
    got = {r.example_id: r for r in score.batch_model_scores(df, make, batch_size=2, max_len=512, whole=False).collect()}
    assert got[1].logit1 == 0.5 and got[1].pred == 1
    assert got[2].logit1 == -2.5 and got[2].pred == 0
    assert got[3].logit1 == 509.5  # truncated at 512


def test_batch_model_scores_whole_sequences(spark):
    """Windows over the whole sequence, weighted with their length; nothing behind the first window is dropped."""
    import numpy as np

    from textprov.operators import score

    def make():
        def predict(ids, mask):
            s = (ids * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
            return np.stack([np.zeros(len(s)), s], axis=1)
        return predict

    rows = [("a", [0] * 4 + [1] * 4 + [3] * 2), ("b", [2, 4]), ("b", [2, 4]), ("b", [6]), ("c", [])]
    df = spark.createDataFrame(rows, "example_id string, input_ids array<int>")
    got = sorted((r.example_id, round(r.logit1, 9)) for r in score.batch_model_scores(df, make, batch_size=2, max_len=4).collect())
    assert got == [("a", 1.0), ("b", 3.0), ("b", 3.0), ("b", 6.0), ("c", 0.0)]
