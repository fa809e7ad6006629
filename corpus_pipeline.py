"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Every stage works on all documents that the stage before kept and is written as
Parquet in between.  All but the last return the columns of ``documents``.

Defined results: a stage's null, empty, repeated and clashing cases are those of its operator; an
empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprov.llm import linespread, pow2pack, ppm, simtrie, windows
from textprov.llm.common import ready, stored, table
from textprov.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or with no clear language (score below 0.5) go."""
    ready(spark)
    return ppm.drop_rejected(docs, ppm.predictor(spark, ppm.fit(spark, ppm.training_rows(docs))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; every document stays, ``n_chars`` follows its text."""
    ready(spark)
    cut = linespread.dedup_lines(docs)
    out = cut.select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (4-word shingles, 4 bits) the document with the smallest id stays."""
    ready(spark)
    return simtrie.keep_one(docs, width=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ready(spark)
    return windows.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence of at most 2048 tokens, with its token ids."""
    import public_tokenizers
    ready(spark)
    return pow2pack.pack(docs, public_tokenizers.path(pow2pack.TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Code lengths, XXH64 fingerprints and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again; the last by length bucket."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    sequences = stage(spark, docs, sf_dir)
    path = scratch_path(spark, f"pipeline-{name}")
    pow2pack.write_buckets(sequences, path)
    return pow2pack.read_buckets(spark, path, sequences.schema)
