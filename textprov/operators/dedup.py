"""Exact de-duplication by text hash (absent in the reference; run before splits).

The group key is ``md5(text)``; per key the smallest id is kept (with ``label``, the
smallest of the rows that have a label, if any has).  Only key
columns (id, hash) are shuffled to find the rows to drop: the ``min``/``count``
aggregation combines map-side (a text repeated a billion times costs one
partial row per task), and the ids of the duplicated texts are matched by hash
(AQE splits a hot hash partition).  The full rows are then anti-joined with
the dropped ids: a broadcast (no shuffle of the texts) when the counted number
of dropped ids is under ``max_broadcast``, a shuffle join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import text_hash
from ..session import scratch_path


MAX_BROADCAST_IDS = 2_000_000  # (number): some 64 MB once broadcast


def dropped_ids(df: DataFrame, id_col: str = "example_id", text: str = "text", label: str | None = None) -> DataFrame:
    """Ids of rows whose text occurs with a smaller id; with ``label``, rows that have one come before those that have none."""
    k = df.select(F.col(id_col), text_hash(text).alias("_th"), *([F.col(label).isNotNull().alias("_has")] if label else []))
    keep = F.min(id_col)
    if label:
        keep = F.coalesce(F.min(F.when(F.col("_has"), F.col(id_col))), keep)
    dup = (k.groupBy("_th").agg(keep.alias("_keep"), F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > 1).select("_th", "_keep"))
    return k.join(dup, "_th").filter(F.col(id_col) != F.col("_keep")).select(id_col)


def dedup_exact(df: DataFrame, id_col: str = "example_id", text: str = "text",
                max_broadcast: int = MAX_BROADCAST_IDS, label: str | None = None) -> DataFrame:
    """Rows whose id is the smallest among identical texts (with ``label``: among those that have a label, if any has)."""
    # written once: every use of the result would hash all texts and shuffle the hashes again
    spark, found = df.sparkSession, dropped_ids(df, id_col, text, label)
    path = scratch_path(spark, "dropped_ids")
    found.write.parquet(path)
    drop = spark.read.schema(found.schema).parquet(path)
    n = drop.count()
    return df.join(F.broadcast(drop) if n <= max_broadcast else drop, id_col, "left_anti")


def duplicate_report(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts occurring more than once: rows and surplus rows per text hash."""
    return (df.groupBy(text_hash(text).alias("text_md5"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
            .filter(F.col("n_rows") > 1)
            .withColumn("n_surplus", (F.col("n_rows") - 1).cast("bigint")))


def label_conflicts(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Identical texts carrying different labels."""
    return (df.groupBy(text_hash(text).alias("text_md5"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.count_distinct(label).cast("bigint").alias("n_labels"),
                 F.min(label).cast("int").alias("min_label"),
                 F.max(label).cast("int").alias("max_label"))
            .filter(F.col("n_labels") > 1))
