"""Scoring: a Spark ML text classifier in place of the neural network.

``fit`` trains ``RegexTokenizer -> HashingTF -> IDF -> LogisticRegression``
(distributed; no driver-side data).  ``score`` turns the model output into the
``scores`` table: ``logit0 = 0``, ``logit1 = margin`` so that the softmax of
the logits equals the model's probability, ``pred = score > 0.5``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUM_FEATURES = 1 << 18


def pipeline(num_features: int = NUM_FEATURES, reg: float = 0.01, max_iter: int = 50) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\s+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
        LogisticRegression(featuresCol="_features", labelCol="_label", regParam=reg, maxIter=max_iter),
    ])


def fit(train: DataFrame, **kw) -> PipelineModel:
    data = train.select("text", F.col("label").cast("double").alias("_label"))
    return pipeline(**kw).fit(data)


def score(model: PipelineModel, df: DataFrame, model_id: str = "lr", round_no: int = 0,
          keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """``scores`` rows for ``df`` (needs ``example_id``, ``text``)."""
    cols = ["example_id", "text"] + [c for c in keep if c in df.columns]
    out = model.transform(df.select(*cols))
    raw = vector_to_array("rawPrediction")
    prob = vector_to_array("probability")
    return out.select(F.lit(model_id).alias("model_id"), F.lit(round_no).alias("round"),
                      "example_id", *[c for c in keep if c in df.columns],
                      F.lit(0.0).alias("logit0"), raw[1].alias("logit1"),
                      prob[1].alias("score"), (prob[1] > F.lit(0.5)).cast("int").alias("pred"))


def batch_model_scores(df: DataFrame, make_predict_fn, batch_size: int = 64, max_len: int = 512,
                       ids: str = "input_ids", model_id: str = "batch_model", round_no: int = 0,
                       whole: bool = True) -> DataFrame:
    """Score ``input_ids`` with a Python model in Arrow batches (``predict_batch_udf``).

    ``make_predict_fn()`` runs once per Python worker and returns
    ``predict(ids: ndarray[B, max_len], mask: ndarray[B, max_len]) -> ndarray[B, 2]``
    (logits).  With ``whole``, a sequence is cut in consecutive windows of ``max_len`` ids (the last is padded inside the
    JVM, so every batch has a fixed shape), and its logits are the windows' means weighted with their lengths; else its
    first window alone is scored.
    """
    import numpy as np
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    def make():
        predict = make_predict_fn()

        def run(x, m):
            out = np.asarray(predict(x.astype(np.int64), m.astype(np.int64)), dtype=np.float64)
            return out.reshape(len(x), 2)
        return run

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[max_len], [max_len]])
    # the model sees one window a row, and partial sums meet per sequence; equal sequences with the same id
    # are pooled together and given back as often as they came
    key = ["example_id", *[c for c in ("label",) if c in df.columns], "_seq"]
    last = F.floor((F.greatest(F.size(ids), F.lit(1)) - 1) / F.lit(max_len)).cast("int") if whole else F.lit(0)
    win = (df.withColumn("_seq", F.xxhash64(ids)).select(*key, F.col(ids).alias("_all"), F.explode(F.sequence(F.lit(0), last)).alias("_at"))
           .select(*key, (F.col("_at") == 0).cast("long").alias("_first"), F.slice("_all", F.col("_at") * max_len + 1, F.lit(max_len)).alias("_ids")))
    n, gap = F.size("_ids"), F.lit(max_len) - F.size("_ids")
    padded = F.concat(F.col("_ids"), F.array_repeat(F.lit(0), gap))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), gap))
    # an empty sequence has one empty window, which counts as it is
    x = (win.withColumn("_logits", udf(padded.cast("array<int>"), mask.cast("array<int>")))
         .withColumn("_w", F.greatest(n, F.lit(1)).cast("double")))
    mean = [(F.sum(F.col("_logits")[k] * F.col("_w")) / F.sum("_w")).alias(f"_l{k}") for k in (0, 1)]
    x = x.groupBy(*key).agg(F.sum("_first").alias("_times"), *mean).withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    l0, l1 = F.col("_l0"), F.col("_l1")
    cols = [c for c in ("label",) if c in df.columns]
    return x.select(F.lit(model_id).alias("model_id"), F.lit(round_no).alias("round"), "example_id", *cols,
                    l0.alias("logit0"), l1.alias("logit1"),
                    (F.lit(1.0) / (F.lit(1.0) + F.exp(l0 - l1))).alias("score"),
                    (l1 > l0).cast("int").alias("pred"))


def hashed_bag_model(vocab_size: int = 1 << 16, seed: int = 7):
    """A deterministic linear bag-of-ids model (weights from a seeded generator), for tests
    and as the default stand-in for a trained network."""
    def make():
        import numpy as np
        w = np.random.default_rng(seed).normal(0.0, 1.0, vocab_size)

        def predict(ids, mask):
            s = (w[ids % vocab_size] * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
            return np.stack([np.zeros_like(s), s], axis=1)
        return predict
    return make
