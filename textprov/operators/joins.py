"""Join helpers: broadcast only behind a size bound, shuffle beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int, known_rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast when its row count is provably small.

    ``known_rows`` is a bound the caller can prove (a vocabulary of V ids, a
    table of strata); otherwise the plan is left to AQE, which converts a
    join to a broadcast at run time only when the *measured* size of the
    materialised side is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``,
    and keeps the sort-merge join otherwise.
    """
    if known_rows is not None and known_rows <= max_rows:
        return F.broadcast(df)
    return df


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Count ``df`` (one small job) and broadcast it only if it is under ``max_rows``.

    Use for inputs whose size is not bounded by construction (e.g. an external
    benchmark table).
    """
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df
