"""Queries: scoring, metrics, threshold sweep, error slices, mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..operators import batches, filters, metrics, sample
from .catalog import EXAMPLES_CTE, SCORES_CTE, SPLIT_CTE, batch_sql, h32, query, smd5


# First-N scan size and mirrors per round (reference parameters)
FIRST_N_SCAN = 10_000
MAX_MIRRORS = 1_000


def scored(spark, d):
    """examples with the deterministic model's score columns (added in place, no join)."""
    return tables.with_oracle_scores(tables.examples(spark, d))


@query("score_table", f"""
WITH {SCORES_CTE}
SELECT 'hash7' AS model_id, example_id, score, pred FROM scored""")
def q_score_table(spark, d):
    sc = tables.oracle_scores(tables.examples(spark, d).select("example_id", "label"))
    return sc.select("model_id", "example_id", "score", "pred")


@query("score_join", f"""
WITH {SCORES_CTE}
SELECT example_id, label, domain, score, pred FROM scored""")
def q_score_join(spark, d):
    """The score table joined to the examples by id."""
    ex = tables.examples(spark, d)
    scores = tables.oracle_scores(ex.select("example_id", "label")).select("example_id", "score", "pred")
    return ex.select("example_id", "label", "domain").join(scores, "example_id")


@query("softmax_score", f"""
WITH {SCORES_CTE}
SELECT example_id, round(1.0 / (1.0 + exp(0.0 - (4.0 * score - 2.0))), 6) AS prob,
       CAST((4.0 * score - 2.0) > 0.0 AS INTEGER) AS argmax
FROM scored""")
def q_softmax_score(spark, d):
    s = scored(spark, d)
    return s.select("example_id", F.round(metrics.softmax_score(), 6).alias("prob"),
                    metrics.argmax_pred().alias("argmax"))


_CE_SQL = ("greatest(0.0, 4.0 * score - 2.0) + ln(1.0 + exp(-abs(0.0 - (4.0 * score - 2.0))))"
           " - CASE WHEN label = 1 THEN 4.0 * score - 2.0 ELSE 0.0 END")


VAL_SCORED_CTE = SPLIT_CTE + f""",
scored AS (SELECT *, round(CAST(0.7 AS DOUBLE) * {h32(7, 'example_id')} / 4294967296.0
                           + CAST(0.3 AS DOUBLE) * label, 2) AS score FROM splits WHERE split = 'val')"""


def scored_val(spark, d):
    """Validation split with the deterministic model's scores."""
    from .q_split import split_examples
    return tables.with_oracle_scores(split_examples(spark, d)).filter(F.col("split") == "val")


@query("val_loss", f"""
WITH {VAL_SCORED_CTE}
SELECT count(*) AS n, round(avg({_CE_SQL}), 6) AS loss FROM scored""")
def q_val_loss(spark, d):
    """Mean cross-entropy over the validation split (row mean)."""
    return metrics.val_loss(scored_val(spark, d))


@query("val_loss_batches", f"""
WITH {VAL_SCORED_CTE},
b AS (SELECT *, {batch_sql(64)} FROM scored),
per AS (SELECT batch_id, avg({_CE_SQL}) AS m, count(*) AS c FROM b GROUP BY batch_id)
SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS n_batches, round(avg(m), 6) AS loss FROM per""")
def q_val_loss_batches(spark, d):
    """Validation loss as the mean of per-batch means (batches of 64), the reference's way."""
    b = batches.assign_batches(scored_val(spark, d), 64)
    return metrics.val_loss(b, batch_col="batch_id")


@query("confusion", f"""
WITH {SCORES_CTE}
SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
       count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp
FROM scored""")
def q_confusion(spark, d):
    return metrics.confusion(scored(spark, d))


def _metrics_sql(src: str) -> str:
    def r(a, b):
        return f"round(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 6)"
    return f"""SELECT tn, fp, fn, tp, tn + fp + fn + tp AS n,
       {r('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {r('tp', 'tp + fp')} AS precision,
       {r('tp', 'tp + fn')} AS recall, {r('2 * tp', '2 * tp + fp + fn')} AS f1,
       {r('tn', 'tn + fp')} AS recall_human
FROM (SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp
      FROM {src}) cm"""


@query("eval_metrics", f"WITH {SCORES_CTE}\n" + _metrics_sql("scored"))
def q_eval_metrics(spark, d):
    return metrics.eval_metrics(scored(spark, d))


@query("class_report", f"""
WITH {SCORES_CTE},
cm AS (SELECT CAST(count(*) FILTER (WHERE label = 0 AND pred = 0) AS DOUBLE) AS tn,
              CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS DOUBLE) AS fp,
              CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS DOUBLE) AS fn,
              CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS DOUBLE) AS tp FROM scored),
pr AS (SELECT *, CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0,
              CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0,
              CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1,
              CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r1,
              tn + fp AS s0, tp + fn AS s1 FROM cm),
f AS (SELECT *, CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2.0 * p0 * r0 / (p0 + r0) END AS f0,
             CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2.0 * p1 * r1 / (p1 + r1) END AS f1, s0 + s1 AS n FROM pr),
rows AS (
  SELECT 'Human' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
  UNION ALL SELECT 'AI', p1, r1, f1, s1 FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) / n END, n FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
  UNION ALL SELECT 'weighted avg', CASE WHEN n = 0 THEN 0.0 ELSE (p0 * s0 + p1 * s1) / n END,
                   CASE WHEN n = 0 THEN 0.0 ELSE (r0 * s0 + r1 * s1) / n END,
                   CASE WHEN n = 0 THEN 0.0 ELSE (f0 * s0 + f1 * s1) / n END, n FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rows""")
def q_class_report(spark, d):
    return metrics.class_report(metrics.confusion(scored(spark, d)))


_CUM_SQL = SCORES_CTE + """,
g AS (SELECT score, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1
      FROM scored GROUP BY score),
c AS (SELECT score, n0, n1,
             coalesce(sum(n0) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0_below,
             coalesce(sum(n1) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c1_below,
             sum(n0) OVER () AS tot0, sum(n1) OVER () AS tot1 FROM g)"""


@query("auroc", f"""
WITH {_CUM_SQL}
SELECT CAST(max(tot0) AS BIGINT) AS n_neg, CAST(max(tot1) AS BIGINT) AS n_pos,
       CASE WHEN max(tot0) > 0 AND max(tot1) > 0
            THEN round(sum(n1 * (c0_below + 0.5 * n0)) / (CAST(max(tot0) AS DOUBLE) * max(tot1)), 6) END AS auroc
FROM c""")
def q_auroc(spark, d):
    return metrics.auroc(scored(spark, d))


_SWEEP_SQL = _CUM_SQL + """,
sw AS (SELECT score AS threshold, c0_below + n0 AS tn, tot0 - (c0_below + n0) AS fp,
              c1_below + n1 AS fn, tot1 - (c1_below + n1) AS tp FROM c)"""


@query("threshold_sweep", f"""
WITH {_SWEEP_SQL}
SELECT threshold, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tp AS BIGINT) AS tp,
       round(CASE WHEN tn + fp + fn + tp = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp) END, 6) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1
FROM sw""")
def q_threshold_sweep(spark, d):
    return metrics.threshold_sweep(scored(spark, d))


@query("best_threshold", f"""
WITH {_SWEEP_SQL},
m AS (SELECT threshold, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
             CAST(tp AS BIGINT) AS tp,
             round(CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp), 6) AS accuracy,
             round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1
      FROM sw)
SELECT * FROM m ORDER BY accuracy DESC, threshold ASC LIMIT 1""")
def q_best_threshold(spark, d):
    return metrics.best_threshold(metrics.threshold_sweep(scored(spark, d)))


@query("error_slices", f"""
WITH {SCORES_CTE},
g AS (SELECT domain, count(*) AS n, count(*) FILTER (WHERE label = 0) AS n_neg,
             count(*) FILTER (WHERE label = 0 AND pred = 1) AS n_fp FROM scored GROUP BY domain)
SELECT domain, n, n_neg, n_fp,
       round(CASE WHEN n_neg = 0 THEN 0.0 ELSE CAST(n_fp AS DOUBLE) / n_neg END, 6) AS fpr,
       round(CASE WHEN sum(n_fp) OVER () = 0 THEN 0.0 ELSE CAST(n_fp AS DOUBLE) / sum(n_fp) OVER () END, 6) AS fp_share
FROM g""")
def q_error_slices(spark, d):
    return metrics.error_slices(scored(spark, d))


@query("ensemble", f"""
WITH {EXAMPLES_CTE},
m AS (SELECT example_id, label, round(CAST(0.7 AS DOUBLE) * {h32(7, 'example_id')} / 4294967296.0 + CAST(0.3 AS DOUBLE) * label, 2) AS score FROM examples
      UNION ALL
      SELECT example_id, label, round(CAST(0.7 AS DOUBLE) * {h32(11, 'example_id')} / 4294967296.0 + CAST(0.3 AS DOUBLE) * label, 2) FROM examples),
e AS (SELECT example_id, min(label) AS label, CAST(avg(score) > 0.5 AS INTEGER) AS pred FROM m GROUP BY example_id)
""" + _metrics_sql("e"))
def q_ensemble(spark, d):
    ex = tables.examples(spark, d).select("example_id", "label")
    s7 = tables.with_oracle_scores(ex, 7)
    s11 = tables.with_oracle_scores(ex, 11)
    return metrics.eval_metrics(metrics.ensemble(s7.unionByName(s11)))


# --- mining ---------------------------------------------------------------------

@query("false_positives", f"""
WITH {SCORES_CTE}
SELECT example_id, score FROM scored WHERE label = 0 AND pred = 1""")
def q_false_positives(spark, d):
    return filters.false_positives(scored(spark, d)).select("example_id", "score")


@query("fp_texts", f"""
WITH {SCORES_CTE}
SELECT example_id, text FROM examples
WHERE example_id IN (SELECT example_id FROM scored WHERE label = 0 AND pred = 1)
  AND text IS NOT NULL AND text <> ''""")
def q_fp_texts(spark, d):
    """Texts of the mined rows: the examples whose id is among the false positives of the score table."""
    ex = tables.examples(spark, d)
    mined = filters.false_positives(tables.oracle_scores(ex.select("example_id", "label"))
                                    .join(ex.select("example_id", "label"), "example_id")).select("example_id")
    return filters.has_text(ex.select("example_id", "text").join(mined, "example_id", "left_semi"))


@query("false_positives_first_n", f"""
WITH {SCORES_CTE},
first_n AS (SELECT * FROM scored ORDER BY example_id LIMIT {FIRST_N_SCAN})
SELECT example_id, score FROM first_n WHERE label = 0 AND pred = 1""")
def q_false_positives_first_n(spark, d):
    """False positives among the first ``FIRST_N_SCAN`` rows by id (the cut is the feature)."""
    s = sample.first_n(scored(spark, d), FIRST_N_SCAN)
    return filters.false_positives(s).select("example_id", "score")


@query("cap_mirrors", f"""
WITH {SCORES_CTE}
SELECT example_id FROM scored WHERE label = 0 AND pred = 1
ORDER BY {smd5(1, 'example_id')}, example_id LIMIT {MAX_MIRRORS}""")
def q_cap_mirrors(spark, d):
    """False positives capped at the mirrors-per-round limit, seeded by the round."""
    fp = filters.false_positives(scored(spark, d)).select("example_id")
    return sample.sample_n(fp, MAX_MIRRORS, seed=1)



@query("threshold_tuned", f"""
WITH {SPLIT_CTE},
sc AS (SELECT *, round(CAST(0.7 AS DOUBLE) * {h32(7, 'example_id')} / 4294967296.0
                       + CAST(0.3 AS DOUBLE) * label, 2) AS score FROM splits),
g AS (SELECT score, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1
      FROM sc WHERE split = 'val' GROUP BY score),
c AS (SELECT score, n0, n1,
             coalesce(sum(n0) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0_below,
             coalesce(sum(n1) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c1_below,
             sum(n0) OVER () AS tot0, sum(n1) OVER () AS tot1 FROM g),
sw AS (SELECT score AS threshold,
              round(CAST((tot1 - (c1_below + n1)) + (c0_below + n0) AS DOUBLE) / (tot0 + tot1), 6) AS accuracy FROM c),
best AS (SELECT threshold FROM sw ORDER BY accuracy DESC, threshold ASC LIMIT 1),
t AS (SELECT label, CAST(score > (SELECT threshold FROM best) AS INTEGER) AS pred FROM sc WHERE split = 'test')
SELECT (SELECT threshold FROM best) AS threshold, m.* FROM ({_metrics_sql('t')}) m""")
def q_threshold_tuned(spark, d):
    """Threshold chosen on the validation split, metrics reported on the test split."""
    from .q_split import split_examples
    s = tables.with_oracle_scores(split_examples(spark, d))
    best = metrics.best_threshold(metrics.threshold_sweep(s.filter(F.col("split") == "val"))).first()
    t = float(best["threshold"])  # one scalar to the driver
    test = s.filter(F.col("split") == "test").withColumn("pred", (F.col("score") > F.lit(t)).cast("int"))
    return metrics.eval_metrics(test).select(F.lit(t).alias("threshold"), "*")
