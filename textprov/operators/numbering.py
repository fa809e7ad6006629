"""Global row numbers in a deterministic shuffled order, without a window over the whole table.

The order is that of ``md5(seed:id)``, then id.  Rows are dealt into buckets by the
leading hex digits of the hash, so that a bucket is a range of the order.  First
pass: rows per bucket (id column only, combined map-side) and prefix sums over the
buckets.  Second pass: numbers inside a bucket, plus the bucket's offset.  The number
of digits follows the row count, so a bucket holds at most some ``BUCKET_ROWS`` rows at
any size, and prefix sums run in two levels, over at most 65,537 rows each.

The result equals ``row_number() over (order by md5(seed:id), id) - 1``.  Ids are
expected to be unique; rows that share one lie in one bucket and are numbered in any
order.  Rows without an id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_md5

BUCKET_ROWS = 50_000
LEVEL_DIGITS = 4                # hex digits of one level of prefix sums
BROADCAST_BUCKETS = 1 << 20     # (short string, number): some 32 MB


def order_hash(seed, id_col: str) -> Column:
    """The hash that orders the rows; ``g`` sorts behind all hex digits."""
    return F.coalesce(seeded_md5(seed, id_col), F.lit("g"))


def bucket_digits(n: int, bucket_rows: int = BUCKET_ROWS) -> int:
    d = 0
    while n > bucket_rows * 16 ** d and d < 2 * LEVEL_DIGITS:
        d += 1
    return d


def bucket_offsets(ids: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, offset): rows in the buckets before; one row per bucket that has rows."""
    hist = ids.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    hist = hist.withColumn("_top", F.substring("_bucket", 1, LEVEL_DIGITS))
    before = Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    tops = (hist.groupBy("_top").agg(F.sum("_n").alias("_n"))
            .select("_top", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above")))
    inside = Window.partitionBy("_top").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return (hist.join(F.broadcast(tops), "_top")     # at most 65,537 rows
            .select("_bucket", (F.col("_above") + F.col("_inside")).cast("bigint").alias("_offset")))


def number_rows(df: DataFrame, seed=42, id_col: str = "example_id", out: str = "row_no",
                bucket_rows: int = BUCKET_ROWS, digits: int | None = None) -> DataFrame:
    """Add ``out`` (0-based) and ``_bucket``.  Rows of a bucket lie in one partition, in order.

    Full rows are shuffled once, by bucket; the first pass reads the id column alone.  ``digits`` can be
    given where the row count is known.
    """
    ids = df.select(id_col)
    if digits is None:
        digits = bucket_digits(ids.count(), bucket_rows)
    if digits:
        bucket = F.substring(order_hash(seed, id_col), 1, digits)
        offsets = bucket_offsets(ids, bucket)
        if 16 ** digits + 1 <= BROADCAST_BUCKETS:
            offsets = F.broadcast(offsets)
        rows = df.withColumn("_bucket", bucket).join(offsets, "_bucket")
    else:   # one bucket holds all rows and has none before it
        rows = df.withColumn("_bucket", F.lit("")).withColumn("_offset", F.lit(0))
    w = Window.partitionBy("_bucket").orderBy(order_hash(seed, id_col), F.col(id_col))
    return (rows.withColumn(out, (F.col("_offset") + F.row_number().over(w) - 1).cast("bigint"))
            .select(*[F.col(f"`{c}`") for c in df.columns], "_bucket", out))
