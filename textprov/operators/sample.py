"""Exact, seeded, reproducible samples and orders.

``sample_n`` takes exactly ``min(n, N)`` rows: the n smallest ``md5(seed:id)``.
For n up to ``topk_max`` this is a ``TakeOrderedAndProject`` (per-partition
top-n, then one task merges n rows from every partition, so n must stay
small); above it the cutoff method of :mod:`exact` needs no global sort and
no single task sees more than a histogram bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_md5
from .exact import first_q_filter
from .filters import in_domains
from .numbering import number_rows

TOPK_MAX = 1000


def sample_n(df: DataFrame, n: int, seed=42, id_col: str = "example_id",
             topk_max: int = TOPK_MAX) -> DataFrame:
    """Exactly ``min(n, count)`` rows without replacement, seeded."""
    if n <= topk_max:
        h = seeded_md5(seed, id_col)
        return df.orderBy(h, F.col(id_col)).limit(n)
    return df.filter(first_q_filter(df, n, seed, id_col))


def sample_quota(df: DataFrame, quota: DataFrame, seed=42, id_col: str = "example_id") -> DataFrame:
    """Sample whose size ``q`` is computed by Spark (one-row ``quota``, read as a scalar)."""
    q = quota.first()
    return sample_n(df, int(q["q"]) if q else 0, seed, id_col)


def pool_budget(df: DataFrame, budget: int, domains=None, seed=42,
                id_col: str = "example_id") -> DataFrame:
    """Keep every priority-domain row; fill up to ``budget`` by a seeded sample.

    The remainder is ``max(0, budget - #priority)`` (a priority set at or over
    the cap gets no further rows).  The count stays in Spark (no driver round
    trip): it feeds the quota of the exact sample.
    """
    pri = in_domains(domains)
    priority = df.filter(pri)
    rest = df.filter(~pri)
    quota = priority.agg(F.greatest(F.lit(budget) - F.count(F.lit(1)), F.lit(0))
                         .cast("bigint").alias("q"))
    return priority.unionByName(sample_quota(rest, quota, seed, id_col))


def first_n(df: DataFrame, n: int, order_col: str = "example_id") -> DataFrame:
    """Deterministic "first N rows": order by a stated key, then limit (top-n plan)."""
    return df.orderBy(F.col(order_col)).limit(n)


def epoch_order(df: DataFrame, seed=42, epoch: int = 0, id_col: str = "example_id",
                partitions: int | None = None) -> DataFrame:
    """Reproducible shuffle: rows in the order of ``md5(seed:epoch:id)`` with their ``row_no`` in the whole table,
    range partitioned by it."""
    x = number_rows(df, f"{seed}:{epoch}", id_col).drop("_bucket").withColumn("order_key", seeded_md5(f"{seed}:{epoch}", id_col))
    parts = partitions or df.sparkSession.sparkContext.defaultParallelism
    return x.repartitionByRange(parts, "row_no").sortWithinPartitions("row_no")
