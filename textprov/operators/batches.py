"""Fixed-size batches, ordinals and per-batch padding.

A batch is B consecutive rows of the whole table in a deterministic shuffled order:
``batch_id = floor(row_no / B)`` with the global row numbers of ``numbering``.  Every
batch but the last is full, and the number of tasks grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import BUCKET_ROWS, bucket_digits, number_rows


def assign_batches(df: DataFrame, batch_size: int, seed=42, id_col: str = "example_id",
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``batch_id`` (0-based) and ``ordinal`` (1-based in the batch)."""
    x = number_rows(df, seed, id_col, "_no", bucket_rows)
    return (x.withColumn("batch_id", F.floor(F.col("_no") / F.lit(batch_size)).cast("bigint"))
             .withColumn("ordinal", (F.pmod(F.col("_no"), F.lit(batch_size)) + 1).cast("int"))
             .drop("_no", "_bucket"))


def batch_counts(df: DataFrame, batch_size: int, by: str = "split") -> DataFrame:
    """``len(loader)`` per group: ceil(rows / B)."""
    return (df.groupBy(by).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .withColumn("n_batches", F.ceil(F.col("n") / F.lit(batch_size)).cast("bigint")))


def pad_batch(df: DataFrame, ids: str = "input_ids", cap: int | None = None,
              batch_col: str = "batch_id", pad_id: int = 0) -> DataFrame:
    """Pad ids to the batch maximum (at most ``cap``, if given), mask 1 on tokens and 0 on padding.

    The window is per batch: B rows, never a large partition.
    """
    m = F.max(F.size(ids)).over(Window.partitionBy(batch_col))
    return _padded(df.withColumn("seq_len", (m if cap is None else F.least(m, F.lit(cap))).cast("int")), ids, pad_id)


def _padded(x: DataFrame, ids: str, pad_id: int) -> DataFrame:
    keep = F.least(F.size(ids), F.col("seq_len"))
    pad = F.col("seq_len") - keep
    return (x.withColumn("padded_ids", F.concat(F.slice(ids, 1, F.col("seq_len")),
                                                F.array_repeat(F.lit(pad_id), pad)))
             .withColumn("padded_mask", F.concat(F.array_repeat(F.lit(1), keep),
                                                 F.array_repeat(F.lit(0), pad))))


def padded_batches(df: DataFrame, batch_size: int, ids: str = "input_ids", length: str = "token_length",
                   seed=42, id_col: str = "example_id", cap: int | None = None, pad_id: int = 0,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Batches of the whole table, padded: ``assign_batches`` and ``pad_batch`` with one shuffle of the arrays.

    Rows are shuffled by bucket of the order, which numbers them and holds nearly every batch whole, so
    the batch maximum needs no second exchange.  Batches that cross a bucket's border are the
    exception: their maxima come from a pass over ids and lengths alone (``length``: a column equal to the
    size of ``ids``) and meet the rows by bucket, where they already lie.
    """
    sizes = df.select(id_col, length)
    digits = bucket_digits(sizes.select(id_col).count(), bucket_rows)
    in_batch = F.floor(F.col("_no") / F.lit(batch_size)).cast("bigint")
    x = number_rows(df, seed, id_col, "_no", bucket_rows, digits).withColumn("batch_id", in_batch)
    most = F.max(length).over(Window.partitionBy("_bucket", "batch_id"))
    if digits:
        x = x.withColumn("_own", most).join(_crossing(sizes, length, in_batch, seed, id_col, bucket_rows, digits), "_bucket", "left")
        most = F.coalesce(F.try_element_at("_cross", F.col("batch_id")), F.col("_own"))
    x = x.withColumn("seq_len", (most if cap is None else F.least(most, F.lit(cap))).cast("int"))
    x = x.withColumn("ordinal", (F.pmod(F.col("_no"), F.lit(batch_size)) + 1).cast("int"))
    return _padded(x, ids, pad_id).drop("_bucket", "_no", "_own", "_cross")


def _crossing(sizes: DataFrame, length: str, in_batch, seed, id_col: str, bucket_rows: int, digits: int) -> DataFrame:
    """(bucket -> longest of each of its batches that lie in several buckets), one row per bucket, so that a join by
    bucket keeps the rows' partitioning."""
    by_no = number_rows(sizes, seed, id_col, "_no", bucket_rows, digits).select(
        "_bucket", in_batch.alias("batch_id"), F.col(length).alias("_len"))
    crossing = (by_no.groupBy("batch_id", "_bucket").agg(F.max("_len").alias("_len"))
                .groupBy("batch_id").agg(F.max("_len").alias("_len"), F.collect_list("_bucket").alias("_in"))  # at most B buckets
                .where(F.size("_in") > 1)
                .select(F.explode("_in").alias("_bucket"), "batch_id", F.col("_len").alias("_all")))
    # two batches as a rule
    return crossing.groupBy("_bucket").agg(F.map_from_entries(F.collect_list(F.struct("batch_id", "_all"))).alias("_cross"))
