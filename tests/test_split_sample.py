"""Splits and samples: golden numbers, properties, partition independence."""

import math

import pytest
from pyspark.sql import functions as F

from textprov import tables
from textprov.operators import sample, split

SF01 = "/root/testdata/sf0.01"


def _summary(s):
    return {r.split: (r.n, r.ids, r.strata, r.n1) for r in s.groupBy("split").agg(
        F.count("*").alias("n"), F.sum("example_id").alias("ids"),
        F.countDistinct("stratum").alias("strata"), F.sum("label").alias("n1")).collect()}


def test_split_golden(spark):
    s = split.stratified_split(tables.examples(spark, SF01))
    assert _summary(s) == {"train": (319, 163301, 37, 47), "val": (40, 16290, 26, 6),
                           "test": (40, 16864, 25, 5)}


def test_split_properties_and_partitioning(spark):
    ex = tables.examples(spark, SF01)
    a = {r.example_id: r.split for r in split.stratified_split(ex).collect()}
    ex64 = ex.repartition(64)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = {r.example_id: r.split for r in split.stratified_split(ex64).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
    n = ex.count()
    assert len(a) == n  # complete, and each id once (disjoint)
    held = sum(1 for v in a.values() if v != "train")
    assert held == math.ceil(0.2 * n)
    # per stratum: held-out count within one row of the exact share
    st = {r.example_id: r.stratum for r in ex.withColumn("stratum", split.stratum_key()).collect()}
    from collections import Counter
    tot, hc = Counter(st.values()), Counter(st[i] for i, v in a.items() if v != "train")
    for k, c in tot.items():
        assert abs(hc[k] - c * held / n) < 1.0


def test_rare_policies(spark):
    ex = tables.examples(spark, SF01).withColumn("stratum", split.stratum_key())
    assert split.rare_strata(ex).count() == 3
    with pytest.raises(ValueError):
        split.apply_rare_policy(ex, "error")
    merged = split.apply_rare_policy(ex, "merge_rare")
    assert split.rare_strata(merged).count() == 0
    s = split.stratified_split(tables.examples(spark, SF01), rare_policy="merge_rare")
    assert s.count() == 399


def test_group_split_keeps_groups_together(spark):
    c = tables.read(spark, SF01, "conversations")
    g = split.group_split(c, group_col="conv_id")
    assert g.groupBy("conv_id").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0


@pytest.mark.parametrize("n", [0, 1, 37, 398, 399, 1000])
def test_sample_n_paths_agree(spark, n):
    ex = tables.examples(spark, SF01).select("example_id")
    a = sorted(r[0] for r in sample.sample_n(ex, n).collect())
    b = sorted(r[0] for r in sample.sample_n(ex, n, topk_max=0).collect())
    assert a == b and len(a) == min(n, 399)


def test_pool_budget_overflow(spark):
    ex = tables.examples(spark, SF01).select("example_id", "domain")
    pri = ex.filter(F.col("domain").isin("en")).count()
    got = sample.pool_budget(ex, 100, domains=["en"])  # priority rows exceed the budget
    assert got.count() == pri
    got2 = sample.pool_budget(ex, 300, domains=["de"])
    assert got2.count() == 300
    assert got2.filter(F.col("domain") == "de").count() == ex.filter(F.col("domain") == "de").count()


def test_null_domain_is_not_priority(spark):
    df = spark.createDataFrame([(1, None), (2, "creative"), (3, "news")], "example_id long, domain string")
    got = sample.pool_budget(df, 1, domains=["creative"])
    assert sorted(r.example_id for r in got.collect()) == [2]


def test_single_cutoff_refinement_matches_sort(spark):
    """Force the refinement loop with a tiny bucket bound and compare with a sort."""
    from textprov.operators import exact
    df = spark.range(5000).withColumnRenamed("id", "example_id")
    for q in (1, 777, 4999, 5000):
        cut = exact.single_cutoff(df, q, 42, "example_id", digits=1, max_bucket_rows=10)
        want = (df.select("example_id", F.md5(F.concat(F.lit("42:"), F.col("example_id").cast("string"))).alias("h"))
                .orderBy("h", "example_id").collect()[q - 1])
        assert cut == (want.h, want.example_id)


def test_bucketed_join_has_no_exchange(spark):
    import io
    from contextlib import redirect_stdout
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the sort-merge join
    try:
        tables.bucket_inputs(spark, SF01, "textprov_test", n_buckets=4)
        ex = tables.bucketed_examples(spark, "textprov_test")
        buf = io.StringIO()
        with redirect_stdout(buf):
            ex.explain()
        plan = buf.getvalue()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert ex.count() == 399
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_grouped_cutoff_refinement_matches_sort(spark):
    """Tiny bucket bound forces several refinement levels per group."""
    from textprov.operators import exact
    df = spark.range(4000).select(F.col("id").alias("example_id"), (F.col("id") % 3).cast("string").alias("g"))
    quota = spark.createDataFrame([("0", 1), ("1", 700), ("2", 5000)], "g string, q long")
    cut = {r.g: (r._cut_h, r._cut_id) for r in
           exact.cutoffs(df, ["g"], quota, 42, "example_id", digits=1, n_groups=3, max_bucket_rows=5).collect()}
    h = F.md5(F.concat(F.lit("42:"), F.col("example_id").cast("string")))
    for g, q in (("0", 1), ("1", 700), ("2", 5000)):
        rows = df.filter(F.col("g") == g).select("example_id", h.alias("h")).orderBy("h", "example_id").collect()
        want = rows[min(q, len(rows)) - 1]
        assert cut[g] == (want.h, want.example_id)


def test_registered_sizes_are_the_references(spark):
    """The queries take the reference's sizes; cuts that bind are tested through the operators' parameter."""
    from textprov.operators import sample
    from textprov.plans import q_metrics, q_split
    assert (q_split.VAL_SUBSET, q_split.STORY_TARGET, q_metrics.FIRST_N_SCAN, q_metrics.MAX_MIRRORS) == (10_000, 3_000, 10_000, 1_000)
    df = spark.range(60).selectExpr("string(id + 100) AS example_id")
    assert sample.sample_n(df, 25).count() == 25 and sample.sample_n(df, 40, seed=1).count() == 40
    assert sorted(r.example_id for r in sample.first_n(df, 15).collect()) == [str(i) for i in range(100, 115)]
    # 40 rows of validation on the small tables: all of them
    assert q_split.q_val_subset(spark, "/root/testdata/sf0.01").count() == 40
