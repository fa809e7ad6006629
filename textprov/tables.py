"""Canonical tables and their derivation from the given input tables.

Mapping of the driver tables onto the canonical ``examples`` table:

  examples = documents JOIN labels USING (doc_id)
    example_id = doc_id, label = 1 - quality (1 = machine text),
    source = source, domain = lang, group_key = md5(text), origin = 'base'
  conversations give question/answer records: role user -> 0, assistant -> 1,
    system turns are the question, group_key = conv_id

Scores for oracle checks are a deterministic function of the id and label:
  u = hash32('7:' || example_id) / 2^32, score = round(0.7 u + 0.3 label, 2),
  logit1 = 4 score - 2, logit0 = 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.hashing import text_hash, unit_hash

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

EXAMPLES_SCHEMA = T.StructType([
    T.StructField("example_id", T.LongType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("domain", T.StringType(), True),
    T.StructField("generator", T.StringType(), True),
    T.StructField("group_key", T.StringType(), True),
    T.StructField("origin", T.StringType(), True),
    T.StructField("round", T.IntegerType(), True),
    T.StructField("parent_id", T.LongType(), True),
])

SCORES_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType(), False),
    T.StructField("round", T.IntegerType(), True),
    T.StructField("example_id", T.LongType(), False),
    T.StructField("logit0", T.DoubleType(), True),
    T.StructField("logit1", T.DoubleType(), True),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("pred", T.IntegerType(), True),
])

ROUND_LOG_SCHEMA = T.StructType([
    T.StructField("round", T.IntegerType(), False),
    T.StructField("model_id", T.StringType(), True),
    T.StructField("val_loss", T.DoubleType(), True),
    T.StructField("val_accuracy", T.DoubleType(), True),
    T.StructField("val_f1", T.DoubleType(), True),
    T.StructField("val_auroc", T.DoubleType(), True),
    T.StructField("pool_size", T.LongType(), True),
    T.StructField("n_fp", T.LongType(), True),
    T.StructField("n_mirrors", T.LongType(), True),
    T.StructField("time_minutes", T.DoubleType(), True),
    T.StructField("model_path", T.StringType(), True),
])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples: documents that carry a label."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("example_id"),
                    "text",
                    (F.lit(1) - F.col("quality")).cast("int").alias("label"),
                    "source",
                    F.col("lang").alias("domain"),
                    F.lit(None).cast("string").alias("generator"),
                    text_hash("text").alias("group_key"),
                    F.lit("base").alias("origin"),
                    F.lit(0).alias("round"),
                    F.lit(None).cast("bigint").alias("parent_id")))


def labelled_features(spark: SparkSession, sf_dir: str, features: dict, keep_empty: bool = True) -> DataFrame:
    """Labelled examples with columns computed from the text *before* the join.

    Catalyst prunes unused columns but does not push computed expressions
    below a join, so a feature such as a token count is evaluated on
    ``documents`` first: only the small feature columns cross the shuffle of
    the join, never the text.  ``features`` maps names to columns over
    ``documents``; ``keep_empty=False`` drops texts that are empty after strip.
    """
    from .operators.filters import nonempty
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    if not keep_empty:
        docs = nonempty(docs)
    docs = docs.select(F.col("doc_id").alias("example_id"), "source", F.col("lang").alias("domain"),
                       *[c.alias(n) for n, c in features.items()])
    labels = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("example_id"), (F.lit(1) - F.col("quality")).cast("int").alias("label"))
    return docs.join(labels, "example_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as unlabelled corpus rows (label null)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return docs.select(F.col("doc_id").alias("example_id"), "text",
                       F.lit(None).cast("int").alias("label"), "source",
                       F.col("lang").alias("domain"))


def with_oracle_scores(ex: DataFrame, seed: int = 7) -> DataFrame:
    """``ex`` plus score, logits and pred of the deterministic stand-in model (no join)."""
    score = F.round(F.lit(0.7) * unit_hash(seed, "example_id")
                    + F.lit(0.3) * F.col("label").cast("double"), 2)
    return (ex.withColumn("score", score)
              .withColumn("logit0", F.lit(0.0))
              .withColumn("logit1", F.lit(4.0) * F.col("score") - F.lit(2.0))
              .withColumn("pred", (F.col("score") > F.lit(0.5)).cast("int")))


def oracle_scores(ex: DataFrame, model_id: str = "hash7", seed: int = 7) -> DataFrame:
    """Deterministic stand-in model output with ties and AUROC strictly inside (0.5, 1)."""
    score = F.round(F.lit(0.7) * unit_hash(seed, "example_id")
                    + F.lit(0.3) * F.col("label").cast("double"), 2)
    return (ex.select("example_id", "label", score.alias("score"))
            .select(F.lit(model_id).alias("model_id"), F.lit(0).alias("round"), "example_id",
                    F.lit(0.0).alias("logit0"),
                    (F.lit(4.0) * F.col("score") - F.lit(2.0)).alias("logit1"),
                    "score",
                    (F.col("score") > F.lit(0.5)).cast("int").alias("pred")))


def bucket_inputs(spark: SparkSession, sf_dir: str, database: str, n_buckets: int = 64) -> None:
    """Write ``documents`` and ``labels`` once as tables bucketed and sorted by doc_id.

    Jobs that join them repeatedly (every stage keyed by example id) then read
    co-partitioned tables: the sort-merge join needs no exchange on either side.
    ``n_buckets`` should give buckets of a few hundred MB of documents.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in ("documents", "labels"):
        (read(spark, sf_dir, name).write.mode("overwrite").bucketBy(n_buckets, "doc_id")
         .sortBy("doc_id").saveAsTable(f"{database}.{name}"))


def bucketed_examples(spark: SparkSession, database: str) -> DataFrame:
    """``examples`` from the bucketed tables of :func:`bucket_inputs` (no shuffle for the join)."""
    docs = spark.table(f"{database}.documents").select("doc_id", "text", "source", "lang")
    labels = spark.table(f"{database}.labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("example_id"), "text",
                    (F.lit(1) - F.col("quality")).cast("int").alias("label"), "source",
                    F.col("lang").alias("domain"), text_hash("text").alias("group_key")))
