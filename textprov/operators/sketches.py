"""Mergeable quantiles: KLL sketches kept per part of the data and merged on demand.

``percentiles`` is exact and keeps every distinct value; a sketch keeps some multiples of ``k`` values
whatever the rows, is built map-side, can be stored, and sketches of new data are merged with the stored
ones without reading the old rows again.  Up to ``k`` values it is exact; beyond, the rank of
a returned value is off by at most ``rank_error(k)`` of the rows (with 99 % certainty).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 4096


def rank_error(k: int = K) -> float:
    """Two-sided normalised rank error of a KLL sketch, 99 % certain (the published fit)."""
    return 2.446 / k ** 0.9433


def build(df: DataFrame, by: list[str], col: str, k: int = K) -> DataFrame:
    """One sketch of ``col`` per value of ``by``: by, n, sketch.  Nulls take no part."""
    c = F.col(col).cast("bigint")
    return df.where(c.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(c, F.lit(k)).alias("sketch"))


def merge(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Sketches merged to the coarser key ``by`` (none: one sketch of all)."""
    aggs = [F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch")]
    return sketches.groupBy(*by).agg(*aggs) if by else sketches.agg(*aggs).where(F.col("n").isNotNull())


def quantile(p: float) -> Column:
    return F.kll_sketch_get_quantile_bigint("sketch", F.lit(p))


def quantiles(sketches: DataFrame, by: list[str], ps: tuple[int, ...]) -> DataFrame:
    """by, n, p (in percent), value: the least value that at least p percent of the rows do not exceed."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), quantile(p / 100.0).alias("value")) for p in ps])
    return sketches.select(*by, "n", F.explode(pairs).alias("q")).select(*by, "n", F.col("q.p").alias("p"), F.col("q.value").alias("value"))
