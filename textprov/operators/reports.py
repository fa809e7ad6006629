"""Corpus and length reports (counts, pivots, describe, percentiles).

All are aggregations with map-side partial aggregation; the outputs are
small (one row per group).  Exact percentiles use Spark's ``percentile``,
which keeps a value -> count map per group: cheap for token lengths (few
distinct integers).  ``approx=True`` switches to ``percentile_approx`` for
columns with many distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Percentiles of the length report and its thresholds
PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]
OVER_THRESHOLDS = [512, 1024]
UNDER_THRESHOLDS = [32, 64]


def corpus_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_total"),
                  F.count_if(F.col("label") == 0).cast("bigint").alias("n_human"),
                  F.count_if(F.col("label") == 1).cast("bigint").alias("n_ai"))


def label_pivot(df: DataFrame, by: str) -> DataFrame:
    """``by`` x label count matrix, missing cells 0 (pivot values given: no extra job)."""
    out = df.groupBy(by).pivot("label", [0, 1]).agg(F.count(F.lit(1)))
    return out.select(by, F.coalesce(F.col("0"), F.lit(0)).cast("bigint").alias("label_0"),
                      F.coalesce(F.col("1"), F.lit(0)).cast("bigint").alias("label_1"))


def corpus_report(df: DataFrame) -> DataFrame:
    """Total, per label, per source x label, per domain x label in one pass."""
    return (df.groupingSets([[], ["label"], ["source", "label"], ["domain", "label"]],
                            "source", "domain", "label")
            .agg(F.grouping_id("source", "domain", "label").cast("int").alias("gid"),
                 F.count(F.lit(1)).cast("bigint").alias("n")))


def _describe_aggs(c: Column, approx: bool, rounded: bool):
    pct = (F.percentile_approx(c, [0.25, 0.5, 0.75], 10000) if approx
           else F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    r = (lambda x: F.bround(x, 0)) if rounded else (lambda x: F.round(x, 6))
    return [F.count(c).cast("bigint").alias("count"),
            r(F.avg(c)).alias("mean"),
            r(F.stddev_samp(c)).alias("std"),
            F.min(c).cast("double").alias("min"),
            r(pct[0].cast("double")).alias("p25"),
            r(pct[1].cast("double")).alias("p50"),
            r(pct[2].cast("double")).alias("p75"),
            F.max(c).cast("double").alias("max")]


def describe(df: DataFrame, col: str = "token_length", by: str | None = None,
             approx: bool = False, rounded: bool = False) -> DataFrame:
    """pandas ``describe()`` (std with n-1, linear-interpolated quartiles)."""
    aggs = _describe_aggs(F.col(col), approx, rounded)
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def percentiles(df: DataFrame, col: str = "token_length", ps=PERCENTILES,
                approx: bool = False) -> DataFrame:
    """One row per percentile p (in percent) with its value."""
    fr = [p / 100.0 for p in ps]
    if approx:
        vals = F.percentile_approx(F.col(col), fr, 10000)
    else:
        vals = F.percentile(F.col(col), F.array(*[F.lit(x) for x in fr]))
    one = df.agg(vals.alias("v"))
    return (one.select(F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"),
                                    F.col("v").alias("value")).alias("z"))
            .select(F.explode("z").alias("z"))
            .select(F.col("z.p").cast("int").alias("p"),
                    F.round(F.col("z.value").cast("double"), 6).alias("value")))


def thresholds(df: DataFrame, col: str = "token_length") -> DataFrame:
    """Counts and percent shares over and under the fixed thresholds, one row each."""
    c = F.col(col)
    aggs = []
    conds = ([(f"gt_{t}", c > t) for t in OVER_THRESHOLDS]
             + [(f"lt_{t}", c < t) for t in UNDER_THRESHOLDS])
    for name, cond in conds:
        aggs.append(F.count_if(cond).cast("bigint").alias(f"n_{name}"))
        aggs.append(F.round(F.avg(cond.cast("double")) * 100.0, 6).alias(f"pct_{name}"))
    return df.agg(*aggs)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """pandas ``value_counts``: nulls excluded, descending count, then value."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy(F.desc("n"), F.asc(col)))


def split_report(df: DataFrame) -> DataFrame:
    """Rows and label shares per split."""
    return (df.groupBy("split")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.count_if(F.col("label") == 0).cast("bigint").alias("n_human"),
                 F.count_if(F.col("label") == 1).cast("bigint").alias("n_ai"),
                 F.round(F.avg((F.col("label") == 0).cast("double")) * 100.0, 6).alias("pct_human"),
                 F.round(F.avg((F.col("label") == 1).cast("double")) * 100.0, 6).alias("pct_ai")))
