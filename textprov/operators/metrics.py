"""Evaluation metrics as aggregations over ``scores JOIN labels``.

Everything is a built-in aggregate.  Rank statistics (AUROC, threshold
sweep) first collapse rows to distinct scores, then take running sums in two
levels: over ranges of scores that follow the data (Spark's range partitioning)
and in a window inside each range over its distinct scores, so no window ever
holds all distinct scores in one task, however close to each other they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .joins import bounded_broadcast

CLASS_NAMES = ("Human", "AI")  # fixed values: report names of class 0 and 1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softmax_score(l0="logit0", l1="logit1") -> Column:
    """P(class 1) = exp(l1) / (exp(l0) + exp(l1)), overflow-free."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(l0) - _c(l1)))


def argmax_pred(l0="logit0", l1="logit1") -> Column:
    """Argmax; a tie goes to class 0."""
    return (_c(l1) > _c(l0)).cast("int")


def cross_entropy(l0="logit0", l1="logit1", label="label") -> Column:
    """log-sum-exp minus the logit of the true class."""
    a, b = _c(l0), _c(l1)
    lse = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    return lse - F.when(_c(label) == 1, b).otherwise(a)


def with_scores(df: DataFrame) -> DataFrame:
    return (df.withColumn("score", softmax_score())
              .withColumn("pred", argmax_pred())
              .withColumn("loss", cross_entropy()))


def val_loss(df: DataFrame, batch_col: str | None = None) -> DataFrame:
    """Mean cross-entropy: per row, or as the mean of per-batch means."""
    x = df.withColumn("_ce", cross_entropy())
    if batch_col is None:
        return x.agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                     F.round(F.avg("_ce"), 6).alias("loss"))
    per = x.groupBy(batch_col).agg(F.avg("_ce").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return per.agg(F.sum("_n").cast("bigint").alias("n"),
                   F.count(F.lit(1)).cast("bigint").alias("n_batches"),
                   F.round(F.avg("_m"), 6).alias("loss"))


def confusion(df: DataFrame, label="label", pred="pred", by: list[str] | None = None) -> DataFrame:
    lab, pr = _c(label), _c(pred)
    aggs = [F.count_if((lab == 0) & (pr == 0)).cast("bigint").alias("tn"),
            F.count_if((lab == 0) & (pr == 1)).cast("bigint").alias("fp"),
            F.count_if((lab == 1) & (pr == 0)).cast("bigint").alias("fn"),
            F.count_if((lab == 1) & (pr == 1)).cast("bigint").alias("tp")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0 for an empty denominator (scikit-learn's zero_division)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return cm.select(
        "*",
        n.alias("n"),
        F.round(_ratio(tp + tn, n), 6).alias("accuracy"),
        F.round(_ratio(tp, tp + fp), 6).alias("precision"),
        F.round(_ratio(tp, tp + fn), 6).alias("recall"),
        F.round(_ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn), 6).alias("f1"),
        F.round(_ratio(tn, tn + fp), 6).alias("recall_human"),
    )


def eval_metrics(df: DataFrame, label="label", pred="pred") -> DataFrame:
    return metrics_from_confusion(confusion(df, label, pred))


def class_report(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per class, accuracy, macro and weighted means."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def f1(p, r):
        return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))

    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("bigint").alias("support"))

    def wavg(a, b):
        return _ratio(a * s0 + b * s1, n)

    rows = F.array(
        row(CLASS_NAMES[0], p0, r0, f1(p0, r0), s0),
        row(CLASS_NAMES[1], p1, r1, f1(p1, r1), s1),
        row("accuracy", F.lit(None), F.lit(None), _ratio(tp + tn, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1(p0, r0) + f1(p1, r1)) / 2, n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f1(p0, r0), f1(p1, r1)), n),
    )
    out = cm.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


def score_buckets(df: DataFrame, score="score", label="label", by: list[str] | None = None) -> DataFrame:
    """Per (group, distinct score): n0, n1 and the bucket ``_cb``, a range of the scores.

    The buckets are the ranges that Spark's range partitioning makes of the distinct scores, from samples of them, so
    each holds about the same number however close the scores lie.  They are written with the rows:
    what is computed from them afterwards is exact whatever the ranges are.  Rows without a score take no part.
    """
    by = list(by or [])
    s, lab = _c(score), _c(label)
    g = (df.where(s.isNotNull()).groupBy(*by, s.alias("score"))
         .agg(F.count_if(lab == 0).cast("bigint").alias("n0"),
              F.count_if(lab == 1).cast("bigint").alias("n1")))
    path = scratch_path(df.sparkSession, "score_buckets")
    g.repartitionByRange(*by, "score").withColumn("_cb", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def score_cumulative(df: DataFrame, score="score", label="label", by: list[str] | None = None,
                     n_groups: int | None = None) -> DataFrame:
    """Per (group, distinct score): n0, n1 and counts of each class strictly below it.

    Also carries the group totals ``tot0``, ``tot1``.  Sums run in two levels: over the buckets, and over the
    scores inside a bucket.
    """
    by = list(by or [])
    g = score_buckets(df, score, label, by)
    bt = g.groupBy(*by, "_cb").agg(F.sum("n0").alias("_b0"), F.sum("n1").alias("_b1"))
    # at most one row per shuffle partition and group: a bounded window
    wb = Window.partitionBy(*by).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*by)
    bt = bt.select(*by, "_cb",
                   F.coalesce(F.sum("_b0").over(wb), F.lit(0)).alias("_c0b"),
                   F.coalesce(F.sum("_b1").over(wb), F.lit(0)).alias("_c1b"),
                   F.sum("_b0").over(wall).alias("tot0"),
                   F.sum("_b1").over(wall).alias("tot1"))
    # a bucket is a stretch of (group, score), so there are fewer pairs than buckets and groups together
    known = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + (n_groups if by else 1) if (not by or n_groups) else None
    g = g.join(bounded_broadcast(bt, 2_000_000, known_rows=known), [*by, "_cb"])  # <= ~60 MB
    wi = Window.partitionBy(*by, "_cb").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return g.select(*by, "score", "n0", "n1",
                    (F.col("_c0b") + F.coalesce(F.sum("n0").over(wi), F.lit(0))).alias("c0_below"),
                    (F.col("_c1b") + F.coalesce(F.sum("n1").over(wi), F.lit(0))).alias("c1_below"),
                    "tot0", "tot1")


def auroc(df: DataFrame, score="score", label="label", by: list[str] | None = None,
          n_groups: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL when a class is missing."""
    by = list(by or [])
    g = score_cumulative(df, score, label, by=by, n_groups=n_groups)
    aggs = [F.sum(F.col("n1") * (F.col("c0_below") + F.lit(0.5) * F.col("n0"))).alias("_u"),
            F.max("tot0").alias("tot0"), F.max("tot1").alias("tot1")]
    agg = g.groupBy(*by).agg(*aggs) if by else g.agg(*aggs)
    return agg.select(
        *by,
        F.col("tot0").cast("bigint").alias("n_neg"), F.col("tot1").cast("bigint").alias("n_pos"),
        F.when((F.col("tot0") > 0) & (F.col("tot1") > 0),
               F.round(F.col("_u") / (F.col("tot0").cast("double") * F.col("tot1")), 6))
         .alias("auroc"))


def auroc_by(df: DataFrame, by: list[str], score="score", label="label",
             n_groups: int | None = None) -> DataFrame:
    return auroc(df, score, label, by=by, n_groups=n_groups)


def threshold_sweep(df: DataFrame, score="score", label="label") -> DataFrame:
    """For each distinct score t: confusion and metrics of ``pred = score > t``."""
    g = score_cumulative(df, score, label)
    tn = F.col("c0_below") + F.col("n0")
    fn = F.col("c1_below") + F.col("n1")
    fp = F.col("tot0") - tn
    tp = F.col("tot1") - fn
    n = F.col("tot0") + F.col("tot1")
    return g.select(F.col("score").alias("threshold"),
                    tn.cast("bigint").alias("tn"), fp.cast("bigint").alias("fp"),
                    fn.cast("bigint").alias("fn"), tp.cast("bigint").alias("tp"),
                    F.round(_ratio(tp + tn, n), 6).alias("accuracy"),
                    F.round(_ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn), 6).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest accuracy, smallest threshold on ties (a top-1, no global sort)."""
    return sweep.orderBy(F.desc("accuracy"), F.asc("threshold")).limit(1)


def error_slices(df: DataFrame, by: str = "domain") -> DataFrame:
    """False positives per slice: count, rate among negatives, share of all FPs."""
    fp = (F.col("label") == 0) & (F.col("pred") == 1)
    g = df.groupBy(by).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                           F.count_if(F.col("label") == 0).cast("bigint").alias("n_neg"),
                           F.count_if(fp).cast("bigint").alias("n_fp"))
    total = F.sum("n_fp").over(Window.partitionBy())  # one row per slice: small
    return (g.withColumn("fpr", F.round(_ratio(F.col("n_fp"), F.col("n_neg")), 6))
             .withColumn("fp_share", F.round(_ratio(F.col("n_fp"), total), 6))
             .orderBy(F.desc("n_fp"), F.asc(by)))


def ensemble(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean score over models per example; pred = mean > threshold (label kept when present)."""
    extra = [F.max("label").alias("label")] if "label" in scores.columns else []
    return (scores.groupBy("example_id")
            .agg(F.avg("score").alias("score"), F.count(F.lit(1)).cast("bigint").alias("n_models"), *extra)
            .withColumn("pred", (F.col("score") > F.lit(threshold)).cast("int")))
