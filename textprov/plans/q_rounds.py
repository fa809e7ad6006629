"""Queries: round log and decisions, pool build / merge / append, model fit, loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions.hashing import hash32
from ..operators import logistic, score
from ..session import scratch_path
from ..sources.snapshots import SnapshotTable
from . import rounds
from .catalog import EXAMPLES_CTE, SPLIT_CTE, ntok_sql, query, smd5, stable_id_sql, strip_sql
from .q_generate import MIRROR_SQL, PROMPT_GRID_CTE
from .q_split import split_examples

D = "CAST({} AS DOUBLE)".format

LOG_CTE = EXAMPLES_CTE + f""",
r AS (SELECT example_id, label, rnd FROM examples, (SELECT unnest(range(1, 6)) AS rnd) t),
s AS (SELECT *, round(({D(0.7)} - {D(0.1)} * rnd)
                      * CAST(('0x' || substr(md5(CAST(rnd + 6 AS VARCHAR) || ':' || CAST(example_id AS VARCHAR)), 1, 8)) AS BIGINT)
                      / 4294967296.0 + ({D(0.3)} + {D(0.1)} * rnd) * label, 2) AS score FROM r),
p AS (SELECT *, 4.0 * score - 2.0 AS l1, CAST(score > 0.5 AS INTEGER) AS pred FROM s),
per AS (SELECT rnd, avg(greatest(0.0, l1) + ln(1.0 + exp(-abs(l1))) - CASE WHEN label = 1 THEN l1 ELSE 0.0 END) AS loss,
               avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS acc,
               count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
               count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) AS n FROM p GROUP BY rnd),
g AS (SELECT rnd, score, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM p GROUP BY rnd, score),
c AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY rnd ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0b,
             sum(n0) OVER (PARTITION BY rnd) AS t0, sum(n1) OVER (PARTITION BY rnd) AS t1 FROM g),
au AS (SELECT rnd, CASE WHEN max(t0) > 0 AND max(t1) > 0 THEN round(sum(n1 * (c0b + 0.5 * n0)) / (CAST(max(t0) AS DOUBLE) * max(t1)), 6) END AS auroc
       FROM c GROUP BY rnd),
log AS (SELECT CAST(per.rnd AS INTEGER) AS round, round(loss, 6) AS val_loss, round(acc, 6) AS val_accuracy,
               round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS val_f1,
               au.auroc AS val_auroc,
               CAST(n + coalesce(sum(fp) OVER (ORDER BY per.rnd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pool_size,
               CAST(fp AS BIGINT) AS n_fp
        FROM per JOIN au ON per.rnd = au.rnd)"""


def log_table(spark, d):
    return rounds.synthetic_log(tables.examples(spark, d))


@query("round_log", f"WITH {LOG_CTE}\nSELECT * FROM log")
def q_round_log(spark, d):
    return log_table(spark, d)


@query("convergence", f"""
WITH {LOG_CTE}
SELECT round, val_loss, lag(val_loss) OVER (ORDER BY round) AS prev_loss,
       round(lag(val_loss) OVER (ORDER BY round) - val_loss, 9) AS delta,
       (abs(lag(val_loss) OVER (ORDER BY round) - val_loss) < 0.001 AND round > 1) AS converged
FROM log""")
def q_convergence(spark, d):
    return rounds.convergence(log_table(spark, d))


@query("checkpoint_flags", f"""
WITH {LOG_CTE},
f AS (SELECT round, val_loss, min(val_loss) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before,
             lag(val_loss) OVER (ORDER BY round) AS prev FROM log)
SELECT round, val_loss, best_before, val_loss < coalesce(best_before, 'inf'::DOUBLE) AS is_new_best,
       coalesce(val_loss < prev, true) AS better_than_prev FROM f""")
def q_checkpoint_flags(spark, d):
    return rounds.checkpoint_flags(log_table(spark, d))


@query("best_round", f"""
WITH {LOG_CTE}
SELECT round, val_loss, val_accuracy, val_f1, val_auroc FROM log ORDER BY val_loss, round LIMIT 1""")
def q_best_round(spark, d):
    return rounds.best_round(log_table(spark, d))


@query("resume_round", f"""
WITH {LOG_CTE}
SELECT CAST(coalesce(max(round), 0) + 1 AS INTEGER) AS next_round, min(val_loss) AS best_loss,
       count(*) AS rounds_done FROM log""")
def q_resume_round(spark, d):
    return rounds.resume_round(log_table(spark, d))


@query("pool_project", f"""
WITH {SPLIT_CTE}
SELECT example_id, label, source, domain FROM splits WHERE split = 'train'
ORDER BY {smd5(42, 'example_id')}, example_id LIMIT {rounds.BASE_SAMPLE}""")
def q_pool_project(spark, d):
    """Base sample of the train split (the reference's 50,000) with the pool's keep-list."""
    from ..operators import sample
    train = split_examples(spark, d).filter(F.col("split") == "train")
    base = sample.sample_n(train, rounds.BASE_SAMPLE)
    return rounds.project_pool(base, keep=("example_id", "input_ids", "label", "source", "domain"))


def _pool(spark, d):
    from .q_generate import creative_rows
    train = split_examples(spark, d).filter(F.col("split") == "train")
    return rounds.build_pool(train, creative_rows(spark, d), base_sample=rounds.BASE_SAMPLE,
                             budget=rounds.POOL_BUDGET, priority_domains=["creative"])


POOL_CTE = SPLIT_CTE + ", " + PROMPT_GRID_CTE + f""",
base AS (SELECT example_id, text, label, source, domain FROM splits WHERE split = 'train'
         ORDER BY {smd5(42, 'example_id')}, example_id LIMIT {rounds.BASE_SAMPLE}),
req AS (SELECT batch_id, md5('creative:' || string_agg(CAST(example_id AS VARCHAR), ',' ORDER BY ordinal) || ':v1') AS request_id
        FROM pg GROUP BY batch_id),
human AS (SELECT {stable_id_sql("'stories'", 'doc_id')} AS example_id, {strip_sql('text')} AS text, 0 AS label FROM documents
          WHERE doc_id IN (SELECT example_id FROM s)),
ai AS (SELECT CAST(('0x' || substr(md5(req.request_id || ':' || CAST(pg.ordinal - 1 AS VARCHAR)), 1, 15)) AS BIGINT) AS example_id,
              pg.prompt, 1 AS label FROM pg JOIN req ON pg.batch_id = req.batch_id)"""


@query("pool_merge", f"""
WITH {POOL_CTE}
SELECT 'base' AS origin, source, CAST(label AS INTEGER) AS label, count(*) AS n FROM base GROUP BY source, label
UNION ALL SELECT 'creative', 'stories', 0, count(*) FROM human
UNION ALL SELECT 'creative', 'generated_creative', 1, count(*) FROM ai""")
def q_pool_merge(spark, d):
    """Train sample plus creative rows (human stories and generated stories)."""
    from .q_generate import creative_rows
    from ..operators import sample
    train = split_examples(spark, d).filter(F.col("split") == "train")
    base = sample.sample_n(train, rounds.BASE_SAMPLE).withColumn("origin", F.lit("base"))
    cr = creative_rows(spark, d).withColumn("origin", F.lit("creative"))
    m = base.select("example_id", "label", "source", "domain", "origin").unionByName(
        cr.select("example_id", "label", "source", "domain", "origin"))
    return m.groupBy("origin", "source", "label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("pool_build", f"""
WITH {POOL_CTE},
cre AS (SELECT example_id, label, 'creative' AS domain, CAST({ntok_sql('text')} AS INTEGER) AS ntok FROM human
        WHERE length({strip_sql('text')}) > 100
        UNION ALL
        SELECT example_id, label, 'creative', CAST(4 * {ntok_sql('prompt')} AS INTEGER) FROM ai),
rest AS (SELECT example_id, CAST(label AS INTEGER) AS label, domain, CAST({ntok_sql('text')} AS INTEGER) AS ntok,
                row_number() OVER (ORDER BY {smd5(42, 'example_id')}, example_id) AS rn
         FROM base WHERE length({strip_sql('text')}) > 100)
SELECT example_id, label, 'creative' AS origin, domain, ntok AS token_length, ntok AS n_ids FROM cre
UNION ALL
SELECT example_id, label, 'base', domain, ntok, ntok FROM rest
WHERE rn <= greatest({rounds.POOL_BUDGET} - (SELECT count(*) FROM cre), 0)""")
def q_pool_build(spark, d):
    """Pool: train sample + creative, length filter, budget keeping creative whole, encoded."""
    p = rounds.encode_pool(_pool(spark, d), vocab_size=5000)
    return p.select("example_id", "label", "origin", "domain", "token_length",
                    F.size("input_ids").cast("int").alias("n_ids"))


@query("pool_append", f"""
WITH {SPLIT_CTE},
base AS (SELECT example_id, text, label FROM splits WHERE split = 'train'
         ORDER BY {smd5(42, 'example_id')}, example_id LIMIT {rounds.BASE_SAMPLE}),
{MIRROR_SQL.replace(EXAMPLES_CTE + ",", "", 1)}
SELECT 0 AS round, 'base' AS origin, CAST(label AS INTEGER) AS label, count(*) AS n FROM base
WHERE length({strip_sql('text')}) > 100 GROUP BY label
UNION ALL SELECT 1, 'mirror', 1, count(*) FROM reps""")
def q_pool_append(spark, d):
    """Versioned pool: the initial rows are one version, the mirrors of round 1 the next; both are read by version."""
    from .q_generate import mirror_job
    base = scratch_path(spark, "pool_append")
    train = split_examples(spark, d).filter(F.col("split") == "train")
    pool = rounds.build_pool(train, None, budget=rounds.POOL_BUDGET)
    table = SnapshotTable(spark, f"{base}/pool")
    first = table.append(pool, ("pool", 0))
    m = mirror_job(spark, d, round_no=1).select(
        "example_id", "text", "label", "source", "domain", F.lit("mirror").alias("origin"),
        "round", "parent_id")
    for _ in range(2):      # the second run finds the transaction committed
        last = table.append(m.select(*[F.col(f.name).cast(f.dataType) for f in pool.schema.fields]), ("mirrors", 1))
    added = table.read(last).where("round > 0")
    back = table.read(first).unionByName(added)
    return back.groupBy("round", "origin", "label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("fit_score")
def q_fit_score(spark, d):
    """Spark ML text classifier fitted on the train split, scored on val and test."""
    s = split_examples(spark, d)
    model = score.fit(s.filter(F.col("split") == "train"))
    held = s.filter(F.col("split") != "train")
    return score.score(model, held, model_id="lr").select("example_id", "label", "score", "pred")


@query("warm_start")
def q_warm_start(spark, d):
    """Round 1 fits half of the train split, round 2 all of it from round 1's weights; val scored by the second."""
    s = split_examples(spark, d)
    train = s.filter(F.col("split") == "train")
    first = logistic.fit(train.filter(F.pmod(hash32("half", "example_id"), F.lit(2)) == 0))
    weights = logistic.fit(train, start=first)
    return logistic.score(s.filter(F.col("split") == "val"), weights, "round2").select("example_id", "label", "score", "pred")


@query("round_summary")
def q_round_summary(spark, d):
    """Two rounds of the mining loop on the train split, validated on val."""
    s = split_examples(spark, d)
    base = scratch_path(spark, "rounds")
    loop = rounds.MiningLoop(spark, base, max_rounds=2)
    train = s.filter(F.col("split") == "train")
    loop.init_pool(rounds.build_pool(train, None))
    return loop.run(s.filter(F.col("split") == "val")).select(
        "round", "pool_size", "n_fp", "n_mirrors")
