"""Metrics: the published confusion matrix as golden input, AUROC against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from textprov.operators import metrics


def _rows_from_confusion(spark, tn, fp, fn, tp):
    parts = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    df = None
    for lab, pred, n in parts:
        x = spark.range(n).select(F.lit(lab).alias("label"), F.lit(pred).alias("pred"))
        df = x if df is None else df.unionByName(x)
    return df


def test_golden_confusion(spark):
    df = _rows_from_confusion(spark, 959, 89, 25, 903)
    m = metrics.eval_metrics(df).first()
    assert (m.tn, m.fp, m.fn, m.tp, m.n) == (959, 89, 25, 903, 1976)
    assert m.accuracy == pytest.approx(0.942308, abs=1e-6)
    assert m.f1 == pytest.approx(0.940625, abs=1e-6)
    assert m.recall == pytest.approx(0.973060, abs=1e-6)
    assert m.recall_human == pytest.approx(0.915076, abs=1e-6)
    rep = {r["class"]: r for r in metrics.class_report(metrics.confusion(df)).collect()}
    assert rep["Human"].recall == pytest.approx(0.915076, abs=1e-6)
    assert rep["AI"].recall == pytest.approx(0.973060, abs=1e-6)
    assert rep["accuracy"].f1 == pytest.approx(0.942308, abs=1e-6)
    assert rep["Human"].support == 1048 and rep["AI"].support == 928


def _brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    tot = 0.0
    for p in pos:
        for n in neg:
            tot += 1.0 if p > n else 0.5 if p == n else 0.0
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
def test_auroc_equals_brute_force_with_ties(spark, seed):
    rnd = random.Random(seed)
    pairs = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "score double, label int")
    got = metrics.auroc(df).first().auroc
    assert got == pytest.approx(round(_brute_auc(pairs), 6), abs=1e-6)
    flipped = df.select((F.lit(1.0) - F.col("score")).alias("score"), "label")
    assert metrics.auroc(flipped).first().auroc == pytest.approx(1 - got, abs=2e-6)


def test_auroc_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 1)], "score double, label int")
    assert metrics.auroc(df).first().auroc is None


def test_threshold_sweep_brute_force(spark):
    rnd = random.Random(5)
    pairs = [(round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "score double, label int")
    sweep = {r.threshold: r for r in metrics.threshold_sweep(df).collect()}
    for t in {s for s, _ in pairs}:
        tp = sum(1 for s, y in pairs if s > t and y == 1)
        fp = sum(1 for s, y in pairs if s > t and y == 0)
        assert (sweep[t].tp, sweep[t].fp) == (tp, fp)
    best = metrics.best_threshold(metrics.threshold_sweep(df)).first()
    accs = {t: sum(1 for s, y in pairs if (s > t) == (y == 1)) / len(pairs) for t in sweep}
    top = max(accs.values())
    assert best.threshold == min(t for t, a in accs.items() if abs(a - top) < 1e-12)


def test_auroc_grouped_equals_ungrouped(spark):
    rnd = random.Random(9)
    pairs = [(g, round(rnd.random(), 3), rnd.randint(0, 1)) for g in (1, 2) for _ in range(200)]
    df = spark.createDataFrame(pairs, "g int, score double, label int")
    by = {r.g: r.auroc for r in metrics.auroc(df, by=["g"]).collect()}
    for g in (1, 2):
        assert by[g] == metrics.auroc(df.filter(F.col("g") == g)).first().auroc


def test_softmax_argmax_cross_entropy(spark):
    import math
    df = spark.createDataFrame([(0.0, 2.0, 1), (3.0, 3.0, 0), (800.0, -800.0, 1)],
                               "logit0 double, logit1 double, label int")
    rows = df.select(metrics.softmax_score().alias("p"), metrics.argmax_pred().alias("a"),
                     metrics.cross_entropy().alias("ce")).collect()
    assert rows[0].p == pytest.approx(1 / (1 + math.exp(-2)))
    assert rows[1].a == 0  # tie goes to class 0
    assert rows[2].ce == pytest.approx(1600.0)  # no overflow


def test_oracle_golden_numbers_sf001(spark):
    from textprov.plans import q_metrics
    sc = q_metrics.scored(spark, "/root/testdata/sf0.01")
    cm = metrics.confusion(sc).first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (248, 93, 21, 37)
    assert metrics.auroc(sc).first().auroc == pytest.approx(0.803418, abs=1e-6)
    best = metrics.best_threshold(metrics.threshold_sweep(sc)).first()
    assert (best.threshold, best.accuracy) == (0.7, pytest.approx(0.907268, abs=1e-6))
    fp = {r.domain: r.n_fp for r in metrics.error_slices(sc).collect()}
    assert fp == {"en": 53, "es": 15, "fr": 14, "de": 11}
