"""Mergeable quantiles, rank metrics on skewed scores, logistic regression with a warm start."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprov.operators import logistic, metrics, sketches


def test_merged_sketches_keep_their_rank_error(spark):
    rnd = random.Random(4)
    values = [int(rnd.lognormvariate(5, 2)) for _ in range(60_000)]
    df = spark.createDataFrame([(i % 7, i % 3, v) for i, v in enumerate(values)], "part int, grp int, v long").repartition(6)
    k = 256
    stored = sketches.build(df, ["part", "grp"], "v", k)
    got = {r.p: r for r in sketches.quantiles(sketches.merge(stored, [], k), [], (1, 25, 50, 90, 99)).collect()}
    ordered = np.sort(values)
    for p, r in got.items():
        low, high = np.searchsorted(ordered, [r.value, r.value + 1]) / len(values)
        assert r.n == len(values) and low - 2 * sketches.rank_error(k) <= p / 100 <= high + 2 * sketches.rank_error(k)
    assert len(sketches.merge(stored, ["grp"], k).collect()) == 3


def test_small_sketches_are_exact_and_empty_tables_give_nothing(spark):
    values = random.Random(1).sample(range(10_000), 999)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    got = {r.p: r.value for r in sketches.quantiles(sketches.build(df, [], "v"), [], (10, 50, 100)).collect()}
    ordered = sorted(values)
    assert got == {p: ordered[-(-p * 999 // 100) - 1] for p in (10, 50, 100)}
    none = sketches.build(df.limit(0).withColumn("g", F.lit(1)), ["g"], "v")
    assert none.collect() == [] and sketches.merge(none, []).collect() == []


def brute_auroc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_scores_close_to_one_are_spread_over_tasks(spark):
    rnd = random.Random(6)
    rows = [(1.0 - rnd.randint(1, 10**9) * 1e-15, rnd.randint(0, 1)) for _ in range(1500)] + [(None, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert min(s for s, _ in rows if s) > 1 - 1e-6
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        g = metrics.score_buckets(df)
        per = [r.n for r in g.groupBy("_cb").agg(F.count("*").alias("n")).collect()]
        assert len(per) >= 6 and max(per) < 600
        got = metrics.auroc(df).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.auroc == pytest.approx(brute_auroc([r for r in rows if r[0]]), abs=1e-6)


def test_cumulative_counts_per_group_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), rnd.choice([0.1, 0.5, 0.5000001, 1.5, -2.0, rnd.random()]), rnd.randint(0, 1)) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = metrics.score_cumulative(df, by=["g"], n_groups=2).collect()
    assert len(got) == len({(g, s) for g, s, _ in rows})
    for r in got:
        below = [y for g, s, y in rows if g == r.g and s < r.score]
        assert (r.c0_below, r.c1_below) == (below.count(0), below.count(1))


def texts(spark, seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.randint(0, 1)
        words = [rnd.choice(["alpha", "beta", "gamma", "delta"] + (["human", "warm"] if y == 0 else ["machine", "cold"])) for _ in range(rnd.randint(0, 30))]
        rows.append((i, " ".join(words) if words else None, y))
    return spark.createDataFrame(rows, "example_id long, text string, label int").repartition(4)


def test_warm_start_ends_in_the_same_optimum_with_fewer_passes(spark):
    first, more = texts(spark, 1, 300), texts(spark, 1, 330)
    kw = {"features": 64, "reg": 0.05}
    before = logistic.fit(first, **kw)
    cold, warm = logistic.fit(more, **kw), logistic.fit(more, start=before, **kw)
    assert np.abs(cold.w - warm.w).max() < 1e-6 and abs(cold.loss - warm.loss) < 1e-12
    assert warm.passes < cold.passes
    again = logistic.fit(more, start=warm, **kw)
    assert again.passes <= 2 and np.abs(again.w - warm.w).max() < 1e-6
    s = logistic.score(more, warm)
    assert s.where("(pred = 1) <> (score > 0.5)").count() == 0
    right = s.where("pred = label").count() / 330
    assert right > 0.85


def test_gradient_equals_differences(spark):
    df = logistic.bags(texts(spark, 3, 40), 16, ("label",)).cache()
    w = np.random.default_rng(0).normal(size=17)
    f, g, n = logistic.gradient(df, w)
    assert n == 40
    for i in (0, 7, 15, 16):
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert (logistic.gradient(df, up)[0] - logistic.gradient(df, down)[0]) / 2e-5 == pytest.approx(g[i], abs=1e-5)


def test_one_class_and_no_rows(spark):
    one = texts(spark, 2, 20).withColumn("label", F.lit(1))
    w = logistic.fit(one, features=16, reg=0.1)
    assert np.isfinite(w.w).all() and logistic.score(one, w).where("pred = 0").count() == 0
    none = logistic.fit(one.limit(0), features=16)
    assert (none.w == 0).all()
    with pytest.raises(ValueError):
        logistic.fit(one, start=none, features=32)
