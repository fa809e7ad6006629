"""The pipeline's stages on the smallest tables: columns, kept rows and effects."""
import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textprov.llm.common import stored, table
from textprov.llm.pow2pack import END_ID, TOKENIZER

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == columns and out.count() <= docs.count()
        docs = out
    before, after = seen["line_dedup"]
    assert before.count() == after.count() and after.where("n_chars <> char_length(text)").count() == 0
    before, after = seen["near_dedup"]
    texts = [r["text"] for r in after.collect()]
    assert len(set(texts)) == len(texts)                       # no exact copy is left
    before, after = seen["decontaminate"]
    kept = {r["doc_id"] for r in after.collect()}
    items = [" ".join(r["text"].split()) for r in table(spark, SF, "benchmark").collect()]
    for r in before.collect():
        if any(i in " ".join(r["text"].split()) for i in items):
            assert r["doc_id"] not in kept
    before, after = seen["packing"]
    totals = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert set(totals) == {r["doc_id"] for r in before.collect()}
    assert_decodes(before, after)


def assert_decodes(docs, sequences):
    """The sequences of every document, put together again, are its text."""
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    ids = {}
    for r in sequences.orderBy("start").collect():
        assert len(r["ids"]) == r["length"] and r["start"] == len(ids.get(r["doc_id"], []))
        ids[r["doc_id"]] = ids.get(r["doc_id"], []) + r["ids"]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(ids) == set(texts)
    for k, t in texts.items():
        assert ids[k][-1] == END_ID and tok.decode(ids[k][:-1], skip_special_tokens=False) == t


def test_run_writes_whole_sequences_by_bucket(spark):
    out = corpus_pipeline.run(spark, SF)
    files = [f for f in out.inputFiles()]
    assert all(re.search(r"/bucket=\d+/", f) for f in files)
    kept = out.where("bucket IS NULL OR length <> pow(2, bucket) OR size(ids) <> length OR offset <> 0")
    assert out.count() > 0 and kept.count() == 0
    docs = table(spark, SF, "documents").join(out.select("doc_id").distinct(), "doc_id", "left_semi")
    # line dedup takes lines out, so a document's text is a part of what it was
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    ids = {}
    for r in out.orderBy("start").collect():
        ids[r["doc_id"]] = ids.get(r["doc_id"], []) + r["ids"]
    for r in docs.collect():
        lines = (r["text"] or "").split("\n")
        packed = tok.decode(ids[r["doc_id"]][:-1], skip_special_tokens=False)
        assert packed == "" or all(x in lines for x in packed.split("\n"))


def odd_documents(spark):
    """Null, empty, blank, repeated and very long rows beside ordinary ones, and columns with the operators' own names."""
    given = table(spark, SF, "documents").limit(60)
    rows = [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in [*ODD, (7, "long words of a text " * 50_000, "en", "a")]]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = given.unionByName(odd.select(*[F.col(c).cast(t) for c, t in given.dtypes]))
    return both.select("*", *[F.lit("x").alias(c) for c in ("score", "fp", "line", "ids", "key")])


def test_stages_take_odd_documents(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    kept = docs.collect()
    assert all(r["score"] == r["key"] == "x" for r in kept)
    assert not any(re.fullmatch(r"[\W\d_]*", r["text"] or "") for r in kept)     # no letter: language ID rejects it
    assert sum(r["doc_id"] == 5 for r in kept) <= 1                             # repeated rows: one stays


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0
