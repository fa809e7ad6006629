"""Overlap audits: corpus versus an external benchmark, splits versus each other.

Exact: equi join on the md5 of the normalised text.  Partial: word 8-gram
shingles.  Each document's shingle hashes are de-duplicated inside the row
(``array_distinct``, no shuffle), exploded and probed against the
benchmark's shingle set, which is broadcast only after its size is checked;
only matches leave the map side, and they are counted per (document, item)
with partial aggregation.  Never ``contains`` (a nested-loop join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, ws_tokens
from .joins import checked_broadcast

SHINGLE_WORDS = 8
BENCH_BROADCAST_ROWS = 1_000_000  # (item, hash): some 64 MB once broadcast


def normalise(col) -> Column:
    """Lower case, runs of white space as one space, stripped."""
    c = F.col(col) if isinstance(col, str) else col
    return py_strip(F.regexp_replace(F.lower(c), r"\s+", " "))


def with_shingles(df: DataFrame, keep: list[str], text: str = "text", k: int = SHINGLE_WORDS,
                  out: str = "_sh") -> DataFrame:
    """``keep`` columns plus one row per distinct k-word shingle hash of the lower-cased text.

    Each token is hashed once; the hash of the window starting at i combines
    the k token hashes at i..i+k-1 (k shifted slices zipped), so no window
    string is ever built.  The token hashes are materialised in their own
    projection: inlined into the lambda they would be recomputed per window.
    """
    x = df.select(*keep, F.transform(ws_tokens(F.lower(F.col(text))), lambda w: F.xxhash64(w)).alias("_hs"))
    m = F.greatest(F.size("_hs") - (k - 1), F.lit(0))
    z = F.arrays_zip(*[F.slice("_hs", j + 1, m).alias(f"w{j}") for j in range(k)])
    x = x.select(*keep, z.alias("_z"))
    hs = F.array_distinct(F.transform("_z", lambda s: F.xxhash64(*[s[f"w{j}"] for j in range(k)])))
    return x.select(*keep, F.explode(hs).alias(out))


def exact_matches(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id",
                  item_id: str = "item_id") -> DataFrame:
    d = docs.select(doc_id, F.md5(normalise("text")).alias("_nh"))
    b = bench.select(item_id, F.md5(normalise("text")).alias("_nh"))
    return d.join(b, "_nh").select(item_id, doc_id)


def shingle_overlap(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id",
                    item_id: str = "item_id", k: int = SHINGLE_WORDS,
                    min_containment: float = 0.5) -> DataFrame:
    """(item, doc) pairs where the doc holds >= ``min_containment`` of the item's shingles."""
    bs = with_shingles(bench, [item_id], "text", k)
    sizes = bs.groupBy(item_id).agg(F.count(F.lit(1)).cast("bigint").alias("n_item"))
    probe = checked_broadcast(bs, BENCH_BROADCAST_ROWS)
    ds = with_shingles(docs, [doc_id], "text", k)
    hits = (ds.join(probe, "_sh").groupBy(item_id, doc_id)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_shared")))
    out = hits.join(sizes, item_id)  # one row per benchmark item: small
    return (out.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))
               .filter(F.col("containment") >= min_containment)
               .select(item_id, doc_id, "n_shared", "n_item", "containment"))


def split_overlap(df: DataFrame, split_col: str = "split", text: str = "text") -> DataFrame:
    """Texts present in more than one split."""
    return (df.groupBy(F.md5(normalise(text)).alias("text_md5"))
            .agg(F.count_distinct(split_col).cast("bigint").alias("n_splits"),
                 F.count(F.lit(1)).cast("bigint").alias("n_rows"))
            .filter(F.col("n_splits") > 1))
