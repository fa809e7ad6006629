"""Train / validation / test splits.

``stratified_split``: exact stratified 80/10/10 (largest-remainder quota per
stratum, rows taken in md5 order), the same for any partitioning.
``group_split``: leak-safe split by a group key, map-only (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..session import ensure_checkpoint_dir
from .exact import (MAX_BROADCAST_GROUPS, attach_cutoffs, cutoffs, largest_remainder_quota,
                    order_key, taken_expr)
from .joins import checked_broadcast

# 20 % held out, then half of it to test; seeds 42 and 43
TEST_FRACTION = 0.2
SECOND_FRACTION = 0.5
SEEDS = (42, 43)


def stratum_key(label: str = "label", source: str = "source") -> Column:
    """``label || '_' || source`` (null source gives a null stratum)."""
    return F.concat(F.col(label).cast("string"), F.lit("_"), F.col(source))


def rare_strata(df: DataFrame, stratum: str = "stratum", min_rows: int = 2) -> DataFrame:
    """Strata with fewer than ``min_rows`` rows (scikit-learn refuses them)."""
    return (df.groupBy(stratum).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .filter(F.col("n") < min_rows))


def apply_rare_policy(df: DataFrame, policy: str, stratum: str = "stratum",
                      label: str = "label", min_rows: int = 2) -> DataFrame:
    """``keep`` rare strata, raise on them (``error``), or ``merge_rare`` them into ``label_*``."""
    if policy == "keep":
        return df
    rare = rare_strata(df, stratum, min_rows).select(F.col(stratum).alias("_rare"))
    if policy == "error":
        bad = rare.limit(5).collect()
        if bad:
            raise ValueError(f"strata with fewer than {min_rows} rows: {[r[0] for r in bad]}")
        return df
    if policy == "merge_rare":
        # one row per rare stratum, broadcast only if they are few
        j = df.join(checked_broadcast(rare, MAX_BROADCAST_GROUPS), F.col(stratum).eqNullSafe(F.col("_rare")), "left")
        return j.withColumn(
            stratum,
            F.when(F.col("_rare").isNotNull(),
                   F.concat(F.col(label).cast("string"), F.lit("_*"))).otherwise(F.col(stratum))
        ).drop("_rare")
    raise ValueError(f"unknown policy {policy!r}")


def stratified_split(df: DataFrame, stratum: Column | None = None, id_col: str = "example_id",
                     test_fraction: float = TEST_FRACTION, second_fraction: float = SECOND_FRACTION,
                     seeds=SEEDS, rare_policy: str = "keep", materialize: bool = True) -> DataFrame:
    """Add ``stratum`` and ``split`` in {train, val, test}.

    Step 1 (seed 42): ceil(0.2 N) rows, stratified, are held out; step 2
    (seed 43): ceil(0.5 M) of those, stratified again, become ``test``, the rest
    ``val``.  Deterministic: independent of partitioning and retries.

    Only the (stratum, id) keys are read to find, per stratum and step, the
    cutoff (q-th smallest hash); they are checkpointed once so that both steps
    read them from the shared checkpoint folder instead of recomputing the
    input.  The full rows are then labelled in one map-side pass against the
    two cutoff tables (one row per stratum, broadcast).
    """
    st = stratum if stratum is not None else stratum_key()
    x = apply_rare_policy(df.withColumn("stratum", st), rare_policy)
    keys = x.select("stratum", id_col)
    if materialize:
        ensure_checkpoint_dir(df.sparkSession)
        keys = keys.checkpoint(eager=True)
    counts = keys.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    if materialize:
        counts = counts.checkpoint(eager=True)
    n_strata = counts.count()  # one row per stratum
    q1 = largest_remainder_quota(counts, "stratum", test_fraction, seeds[0]).select("stratum", "q")
    if materialize:  # one row per stratum: checkpointed so later plans do not re-derive it
        q1 = q1.checkpoint(eager=True)
    cut1 = cutoffs(keys, ["stratum"], q1, seeds[0], id_col, n_groups=n_strata)
    if materialize:
        cut1 = cut1.checkpoint(eager=True)
    held = (attach_cutoffs(keys, ["stratum"], cut1, n_groups=n_strata)
            .filter(taken_expr(seeds[0], id_col)).select("stratum", id_col))
    # the held rows of a stratum are exactly its step-1 quota
    q2 = largest_remainder_quota(q1.withColumnRenamed("q", "n"), "stratum", second_fraction,
                                 seeds[1]).select("stratum", "q")
    cut2 = cutoffs(held, ["stratum"], q2, seeds[1], id_col, n_groups=n_strata)
    if materialize:
        cut2 = cut2.checkpoint(eager=True)
    c1 = cut1.select(F.col("stratum").alias("_s1"), F.col("_cut_h").alias("_h1"), F.col("_cut_id").alias("_i1"))
    c2 = cut2.select(F.col("stratum").alias("_s2"), F.col("_cut_h").alias("_h2"), F.col("_cut_id").alias("_i2"))
    if n_strata <= MAX_BROADCAST_GROUPS:
        c1, c2 = F.broadcast(c1), F.broadcast(c2)
    j = (x.join(c1, F.col("stratum").eqNullSafe(F.col("_s1")), "left")
          .join(c2, F.col("stratum").eqNullSafe(F.col("_s2")), "left"))
    h1, h2 = order_key(seeds[0], id_col), order_key(seeds[1], id_col)
    idc = F.col(id_col)
    in1 = F.coalesce((h1 < F.col("_h1")) | ((h1 == F.col("_h1")) & (idc <= F.col("_i1"))), F.lit(False))
    in2 = F.coalesce((h2 < F.col("_h2")) | ((h2 == F.col("_h2")) & (idc <= F.col("_i2"))), F.lit(False))
    split = F.when(~in1, F.lit("train")).when(in2, F.lit("test")).otherwise(F.lit("val"))
    return j.withColumn("split", split).drop("_s1", "_h1", "_i1", "_s2", "_h2", "_i2")


def group_split(df: DataFrame, group_col: str = "group_key", seed=42,
                train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Whole groups go to one split: u = hash(seed:group) < 0.8 train, < 0.9 val, else test."""
    u = unit_hash(seed, group_col)
    return df.withColumn(
        "split",
        F.when(u < F.lit(train), F.lit("train"))
         .when(u < F.lit(train + val), F.lit("val"))
         .otherwise(F.lit("test")))
