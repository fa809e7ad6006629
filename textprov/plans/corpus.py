"""Corpus preparation (entry A): ingest -> clean -> report -> tokens -> filter ->
de-duplicate -> split -> write, as one chain of DataFrame plans.

The corpus is written once (Parquet, partitioned by ``split``) because several
consumers read it; every stage before the write is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import text_hash
from ..operators import dedup, filters, reports, split
from ..operators.tokens import build_vocab, encode
from ..sources.readers import union_sources


def clean_corpus(*sources: DataFrame) -> DataFrame:
    """Union of the sources with missing columns as null, empty texts dropped."""
    u = union_sources(*sources)
    return u.withColumn("group_key", F.coalesce(F.col("group_key"), text_hash("text")))


def prepare(spark: SparkSession, corpus: DataFrame, out: str, min_tokens: int = filters.MIN_TOKENS,
            vocab_size: int = 30000, max_len: int | None = None, rare_policy: str = "merge_rare",
            dedupe: bool = True, leak_safe: bool = True, quarantine: list[DataFrame] | tuple = ()) -> dict:
    """Run the chain and write ``out`` partitioned by split; return small reports.

    ``leak_safe``: rows of one group (answers to one question) go to one split; else
    the exact stratified split by row.  The sources' quarantined records are
    written beside the splits (``<out>_quarantine``).
    """
    report = reports.corpus_report(corpus)
    x = dedup.dedup_exact(corpus, label="label") if dedupe else corpus
    v = build_vocab(x, size=vocab_size)
    x = encode(x, v, max_len=max_len, vocab_size=vocab_size,
               carry=[c for c in x.columns if c != "example_id"])
    kept = filters.min_tokens(x, min_tokens)
    s = split.group_split(kept) if leak_safe else split.stratified_split(kept, rare_policy=rare_policy)
    write_splits(s.drop("stratum"), out)
    back = spark.read.parquet(out)
    result = {"corpus_report": report, "split_report": reports.split_report(back), "splits": back}
    if quarantine:
        bad = quarantine[0]
        for q in quarantine[1:]:
            bad = bad.unionByName(q)
        bad.write.mode("overwrite").parquet(f"{out}_quarantine")
        result["quarantine"] = spark.read.parquet(f"{out}_quarantine")
    return result


def write_splits(df: DataFrame, out: str) -> None:
    """One Parquet folder per split (``split=train|val|test``)."""
    df.write.mode("overwrite").partitionBy("split").parquet(out)
