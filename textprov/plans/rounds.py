"""The mining loop: fit, evaluate, log, decide, mine, generate, append.

State lives in versioned tables under one base folder (in the shared checkpoint
folder by default), so a killed job resumes where it stopped:

  pool              training pool: a version with the initial rows, one more for the
                    mirrors of each round; round k trains on the rounds before it
  round_log         one metrics row per finished round
  replies/...       generator replies, keyed by member; a re-run sends only the members
                    without a final reply
  models/round=k    fitted models
  scored/...        validation and pool as scored in a round, written once

A version exists once its manifest is committed, and each write is a transaction
(``pool`` 0, ``mirrors`` k, ``round`` k): what a killed run left unfinished does not
count, and what it finished is not written again.

Each round re-reads the pool from storage, so the plan does not grow with
the number of rounds.  Decisions (converged? any false positives?) need one
small aggregate row per round on the driver.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_id
from ..functions.text import parse_numbered, split_parts, truncate_chars
from ..operators import filters, generate, metrics, requests, sample, score
from ..operators.tokens import build_vocab, encode
from ..sources.snapshots import SnapshotTable
from ..tables import ROUND_LOG_SCHEMA

# Convergence threshold on the change of validation loss,
# default number of rounds, mirrors per round, pool budget
CONVERGENCE = 0.001
MAX_ROUNDS = 5
MAX_MIRRORS = None  # all false positives; a caller may pass a number
POOL_BUDGET = 60000
BASE_SAMPLE = 50000
POOL_COLUMNS = ["example_id", "text", "label", "source", "domain", "origin", "round", "parent_id"]


def build_pool(train: DataFrame, creative: DataFrame | None = None, base_sample: int = BASE_SAMPLE,
               budget: int = POOL_BUDGET, priority_domains=None) -> DataFrame:
    """Seeded sample of the train split + creative rows, length filter, budget.

    Only rows of the train split enter the pool (the reference sampled the
    unsplit corpus in one variant, leaking validation rows into training).
    """
    base = sample.sample_n(train, base_sample).withColumn("origin", F.lit("base"))
    parts = base
    if creative is not None:
        parts = parts.unionByName(creative.withColumn("origin", F.lit("creative")), allowMissingColumns=True)
    parts = filters.pool_text(parts)
    pool = sample.pool_budget(parts, budget, domains=priority_domains)
    return pool.withColumn("round", F.lit(0)).withColumn(
        "parent_id", F.lit(None).cast("bigint")).select(*POOL_COLUMNS)


def project_pool(df: DataFrame, keep=("input_ids", "attention_mask", "label", "text", "source", "domain")):
    """Keep-list projection that ignores absent columns."""
    return df.select(*[c for c in keep if c in df.columns])


def encode_pool(pool: DataFrame, vocab_size: int = 30000) -> DataFrame:
    """Pool rows with ids and masks (vocabulary from the pool itself); the pool's
    columns go through the encoding shuffle instead of a join back."""
    v = build_vocab(pool, size=vocab_size)
    return encode(pool, v, vocab_size=vocab_size, carry=[c for c in pool.columns if c != "example_id"])


def convergence(log: DataFrame, threshold: float = CONVERGENCE) -> DataFrame:
    """delta = previous loss - loss; converged when |delta| < threshold after round 1.

    The log has one row per round, so an unpartitioned window is tiny.
    """
    w = Window.orderBy("round")
    x = log.withColumn("prev_loss", F.lag("val_loss").over(w))
    return x.select("round", "val_loss", "prev_loss",
                    F.round(F.col("prev_loss") - F.col("val_loss"), 9).alias("delta"),
                    ((F.abs(F.col("prev_loss") - F.col("val_loss")) < F.lit(threshold))
                     & (F.col("round") > 1)).alias("converged"))


def checkpoint_flags(log: DataFrame) -> DataFrame:
    """New best (versus every earlier round) and better-than-previous flags."""
    w = Window.orderBy("round")
    before = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return log.select("round", "val_loss", before.alias("best_before"),
                      (F.col("val_loss") < F.coalesce(before, F.lit(float("inf")))).alias("is_new_best"),
                      F.coalesce(F.col("val_loss") < F.lag("val_loss").over(w), F.lit(True))
                      .alias("better_than_prev"))


def best_round(log: DataFrame) -> DataFrame:
    """The round of minimum validation loss; the earliest on ties."""
    best = F.min_by(F.struct("round", "val_loss", "val_accuracy", "val_f1", "val_auroc"),
                    F.struct("val_loss", "round"))
    return log.agg(best.alias("b"), F.min("val_loss").alias("_m")).select("b.*")


def resume_round(log: DataFrame) -> DataFrame:
    """Next round to run and the best loss so far (1 and NULL on an empty log)."""
    return log.agg((F.coalesce(F.max("round"), F.lit(0)) + 1).cast("int").alias("next_round"),
                   F.min("val_loss").alias("best_loss"),
                   F.count(F.lit(1)).cast("bigint").alias("rounds_done"))


def evaluate(scored: DataFrame) -> dict:
    """Loss, accuracy, F1, AUROC of a scored table (three one-row aggregates)."""
    m = metrics.eval_metrics(scored).select("accuracy", "f1", "n").first()
    loss = metrics.val_loss(scored).select("loss").first()
    au = metrics.auroc(scored).select("auroc").first()
    return {"accuracy": m["accuracy"], "f1": m["f1"], "n": m["n"], "loss": loss["loss"],
            "auroc": au["auroc"]}


class MiningLoop:
    """Driver of the rounds; every stage reads and writes tables."""

    def __init__(self, spark: SparkSession, base: str, generator_prompts=None, generator_texts=None,
                 max_rounds: int = MAX_ROUNDS, max_mirrors: int | None = MAX_MIRRORS,
                 threshold: float = CONVERGENCE, model_kw: dict | None = None):
        self.spark = spark
        self.base = base.rstrip("/")
        self.gen_prompts = generator_prompts or generate.StubPromptWriter()
        self.gen_texts = generator_texts or generate.StubTextWriter()
        # real generators back off between retries; the offline stubs need not
        self.sleep = time.sleep if generator_prompts or generator_texts else generate.no_wait
        self.max_rounds = max_rounds
        self.max_mirrors = max_mirrors
        self.threshold = threshold
        self.model_kw = model_kw or {}

    # storage ------------------------------------------------------------
    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.base}/{name}")

    def pool(self, before: int | None = None, version: int | None = None) -> DataFrame:
        """The initial pool and the mirrors of the rounds before ``before`` (of all rounds, if not given)."""
        p = self.table("pool").read(version).select(*POOL_COLUMNS)
        return p if before is None else p.filter(F.col("round") < before)

    def log(self) -> DataFrame:
        return self.table("round_log").read(schema=ROUND_LOG_SCHEMA)

    def init_pool(self, pool: DataFrame) -> None:
        """The first version; an existing pool is reused (resume)."""
        self.table("pool").append(pool.select(*POOL_COLUMNS), ("pool", 0))

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Written once and read back, so that no later use computes it again."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # one round ---------------------------------------------------------------
    def run_round(self, k: int, val: DataFrame, prev: float | None = None) -> dict:
        """Fit, evaluate, decide, and only then mine: a converged round generates nothing."""
        t0 = time.time()
        pool = self.pool(before=k)  # what a killed run left of this round does not count
        model = score.fit(pool, **self.model_kw)
        model.write().overwrite().save(f"{self.base}/models/round={k}")
        ev = evaluate(self.written(score.score(model, val, model_id=f"round{k}", round_no=k), f"scored/val/round={k}"))
        converged = prev is not None and abs(prev - float(ev["loss"])) < self.threshold
        n_fp = n_mirrors = 0
        if not converged:
            fp = self.false_positives(k, model, pool)
            n_fp = fp.count()
            if n_fp:
                n_mirrors = self.mine(k, fp)
        row = (k, f"round{k}", float(ev["loss"]), float(ev["accuracy"]), float(ev["f1"]),
               None if ev["auroc"] is None else float(ev["auroc"]),
               int(pool.count()), int(n_fp), int(n_mirrors), (time.time() - t0) / 60.0,
               f"{self.base}/models/round={k}")
        self.table("round_log").append(self.spark.createDataFrame([row], ROUND_LOG_SCHEMA), ("round", k))
        return {"round": k, "val_loss": row[2], "n_fp": n_fp, "n_mirrors": n_mirrors, "converged": converged}

    def false_positives(self, k: int, model, pool: DataFrame) -> DataFrame:
        """False positives of the pool, joined with their texts by id; parents of earlier mirrors are not mirrored twice."""
        sp = self.written(score.score(model, pool, model_id=f"round{k}", round_no=k), f"scored/pool/round={k}")
        fp = filters.has_text(pool.join(filters.false_positives(sp).select("example_id"),
                                        "example_id", "left_semi"))
        parents = pool.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("example_id"))
        return fp.join(parents, "example_id", "left_anti")

    def ask(self, kind: str, members: DataFrame, content: str, gen, size: int, header: str, item, parse) -> tuple[DataFrame, DataFrame]:
        """(keyed members, stored replies) after the members without a final reply have been sent."""
        keyed = members.withColumn("member_key", requests.member_key(kind, F.col("example_id"), F.col(content)))
        table = self.table(f"replies/{kind}")
        todo = requests.pending(keyed, requests.replies_of(table))
        if not todo.isEmpty():
            requests.store(table, requests.send(requests.form(todo, size, header, item, seed=kind), gen, parse, self.sleep))
        return keyed, requests.replies_of(table)

    def mine(self, k: int, fp: DataFrame) -> int:
        """Add the mirrors of round ``k`` to the pool; a round that has added its mirrors adds none."""
        pool = self.table("pool")
        if not pool.committed(("mirrors", k)):
            mined = fp.select("example_id", truncate_chars("text", generate.PROMPT_INPUT_CHARS).alias("text"))
            capped = mined if self.max_mirrors is None else sample.sample_n(mined, self.max_mirrors, seed=k)
            members, stored = self.ask("prompts", capped, "text", self.gen_prompts, generate.MIRROR_BATCH, generate.PROMPT_HEADER,
                                       F.format_string('[%d]\n"""%s"""', "ordinal", "text"), parse_numbered)
            prompts = requests.filled(members, stored).select("example_id", F.col("reply").alias("prompt"))
            members, stored = self.ask("texts", prompts, "prompt", self.gen_texts, generate.MIRROR_BATCH,
                                       generate.TEXT_HEADER.replace("{words}", "100-400"),
                                       F.format_string("[%d] %s", "ordinal", "prompt"),
                                       lambda reply: split_parts(reply, generate.MIN_PART_CHARS))
            texts = requests.filled(members, stored, short="drop")
            rows = texts.select(stable_id(F.lit("mirror"), "member_key").alias("example_id"), F.col("reply").alias("text"),
                                F.lit(1).alias("label"), F.lit("mirror").alias("source"), F.lit("mirror").alias("domain"),
                                F.lit("mirror").alias("origin"), F.lit(k).alias("round"), F.col("example_id").alias("parent_id"))
            pool.append(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.pool().schema.fields]), ("mirrors", k))
        return self.pool().filter((F.col("round") == k) & (F.col("origin") == "mirror")).count()

    # the loop ----------------------------------------------------------------
    def run(self, val: DataFrame) -> DataFrame:
        """Rounds up to ``max_rounds``, convergence or no false positive; a finished loop stays finished."""
        log = self.log()
        state = resume_round(log).first()
        prev = None
        if state["rounds_done"]:
            last = convergence(log, self.threshold).join(log.select("round", "n_fp"), "round").orderBy(F.desc("round")).first()
            if last["converged"] or last["n_fp"] == 0:
                return log
            prev = last["val_loss"]
        for k in range(int(state["next_round"]), self.max_rounds + 1):
            r = self.run_round(k, val, prev)
            if r["converged"] or r["n_fp"] == 0:
                break
            prev = r["val_loss"]
        return self.log()

    def best_model(self) -> str | None:
        """Path of the model with the least validation loss (None before the first round)."""
        best = best_round(self.log()).first()
        return None if best is None or best["round"] is None else f"{self.base}/models/round={best['round']}"


def synthetic_log(ex: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """Round log of a family of deterministic scorers that improve by round.

    Round r scores ``round((0.7 - 0.1 r) u_r + (0.3 + 0.1 r) label, 2)`` with
    ``u_r = hash32((6 + r) : id) / 2^32``; loss, accuracy, F1 and AUROC are
    computed per round on the examples, pool size grows by the false
    positives of earlier rounds (one mirror each).
    """
    x = ex.select("example_id", "label", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    key = F.concat((F.col("round") + 6).cast("string"), F.lit(":"), F.col("example_id").cast("string"))
    x = x.withColumn("_u", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0))
    a = F.lit(0.7) - F.lit(0.1) * F.col("round")
    b = F.lit(0.3) + F.lit(0.1) * F.col("round")
    x = x.withColumn("score", F.round(a * F.col("_u") + b * F.col("label").cast("double"), 2))
    x = (x.withColumn("logit0", F.lit(0.0)).withColumn("logit1", F.lit(4.0) * F.col("score") - F.lit(2.0))
          .withColumn("pred", (F.col("score") > F.lit(0.5)).cast("int")))
    per = x.groupBy("round").agg(
        F.avg(metrics.cross_entropy()).alias("val_loss"),
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("val_accuracy"),
        F.count_if((F.col("label") == 1) & (F.col("pred") == 1)).alias("_tp"),
        F.count_if((F.col("label") == 0) & (F.col("pred") == 1)).alias("n_fp"),
        F.count_if((F.col("label") == 1) & (F.col("pred") == 0)).alias("_fn"),
        F.count(F.lit(1)).alias("_n"))
    au = metrics.auroc_by(x, ["round"], n_groups=rounds)
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    out = per.join(F.broadcast(au), "round")  # one row per round
    return out.select(
        F.col("round").cast("int").alias("round"),
        F.round("val_loss", 6).alias("val_loss"), F.round("val_accuracy", 6).alias("val_accuracy"),
        F.round(F.when(2 * F.col("_tp") + F.col("n_fp") + F.col("_fn") == 0, F.lit(0.0))
                .otherwise(2.0 * F.col("_tp") / (2 * F.col("_tp") + F.col("n_fp") + F.col("_fn"))), 6).alias("val_f1"),
        F.col("auroc").alias("val_auroc"),
        (F.col("_n") + F.coalesce(F.sum("n_fp").over(w), F.lit(0))).cast("bigint").alias("pool_size"),
        F.col("n_fp").cast("bigint").alias("n_fp"))
