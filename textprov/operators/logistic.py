"""Logistic regression by aggregated gradients, started from given weights.

The rows are hashed once to bags of feature counts and written; every pass computes loss and gradient
inside Arrow batches and sums the gradients per feature, combined in each task and then by one
aggregation, so that what reaches the driver is a vector of ``features`` numbers whatever the rows.  The
driver holds a few such vectors (limited-memory BFGS).  The objective is strongly convex:

  mean over rows of log(1 + exp(-s z)) + reg / 2 * |w|^2,   z = w x + b,  s = +1 for label 1, -1 for label 0

so every start ends in the same optimum, and a start near it (the weights of the round before, with the
curvature that fit has seen) takes fewer passes.

Defined results: null texts are empty texts; rows without a label are left out; one class alone, or
no row, gives the weights that minimise the objective (without rows: the start).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ws_tokens
from ..session import scratch_path

FEATURES = 1 << 12
REG = 0.01
TOLERANCE = 1e-10       # of the gradient's norm
MEMORY = 12             # pairs that the driver keeps
MAX_PASSES = 500


@dataclass
class Weights:
    w: np.ndarray       # the last one is the bias
    passes: int = 0
    loss: float = float("nan")
    steps: list = field(default_factory=list)   # the curvature that the fit has seen, for a fit that starts here

    @property
    def features(self) -> int:
        return len(self.w) - 1


def bags(df: DataFrame, features: int = FEATURES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the text's words as feature numbers, square roots of counts scaled to unit length."""
    words = F.transform(ws_tokens(F.lower(F.coalesce("text", F.lit("")))), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    return df.select(*keep, F.array_sort(words).alias("feats"))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, its feature, its value) of a batch's bags."""
    feats = batch.column(batch.schema.get_field_index("feats"))
    flat, ends = feats.values.to_numpy(zero_copy_only=False).astype(np.int64), feats.offsets.to_numpy().astype(np.int64)
    flat = flat[ends[0]:ends[-1]]
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    if not len(flat):
        return row, flat, np.empty(0)
    first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]))
    row, feat, value = row[first], flat[first], np.sqrt(np.diff(first, append=len(flat)))
    size = np.sqrt(np.bincount(row, value * value, minlength=len(ends) - 1))
    return row, feat, value / size[row]


def _margins(batch: pa.RecordBatch, w: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    entries = _rows(batch)
    row, feat, value = entries
    return entries, np.bincount(row, w[feat] * value, minlength=batch.num_rows) + w[-1]


def gradient(data: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Sum of losses and of gradients over the rows (``feats``, ``label``), and their number: one pass."""
    size = len(w)
    shared = data.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total, loss, n = shared.value, np.zeros(size), 0.0, 0
        for batch in batches:
            (row, feat, value), z = _margins(batch, weights)
            y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
            s = 2 * y - 1
            loss += float(np.logaddexp(0, -s * z).sum())
            g = -s / (1 + np.exp(np.clip(s * z, -700, 700)))
            total[:-1] += np.bincount(feat, g[row] * value, minlength=size - 1)
            total[-1] += g.sum()
            n += batch.num_rows
        if n:   # entries beyond the features: the loss and the number of rows
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [size, size + 1]), pa.int64()),
                                              pa.array(np.append(total[at], [loss, n]), pa.float64())], names=["at", "value"])
    sums = data.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    shared.unpersist()
    out = np.zeros(size + 2)
    for r in sums:
        out[r["at"]] = r["value"]
    return out[size], out[:size], int(out[size + 1])


def fit(train: DataFrame, start: Weights | None = None, features: int = FEATURES, reg: float = REG,
        tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES) -> Weights:
    """Weights for ``text`` -> ``label``, from ``start`` or from zero."""
    if start is not None and start.features != features:
        raise ValueError("the start has another number of features")
    path = scratch_path(train.sparkSession, "bags")
    bags(train.where(F.col("label").isNotNull()), features, ("label",)).write.parquet(path)
    data = train.sparkSession.read.parquet(path)
    passes = 0

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal passes
        passes += 1
        loss, g, n = gradient(data, w)
        pull = np.append(reg * w[:-1], 0.0)
        if not n:
            return 0.0, np.zeros_like(w)
        # the bias is held by a pull far too small to see, so that one class alone has an optimum
        pull[-1] = 1e-6 * w[-1]
        return loss / n + 0.5 * reg * float(w[:-1] @ w[:-1]) + 0.5e-6 * w[-1] ** 2, g / n + pull

    w = np.zeros(features + 1) if start is None else start.w.copy()
    f, g = evaluate(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = [] if start is None else list(start.steps)
    while np.linalg.norm(g) > tolerance and passes < max_passes:
        d = -_two_loops(g, steps)
        if d @ g >= 0:
            steps, d = [], -g
        t = 1.0
        while True:
            w2 = w + t * d
            f2, g2 = evaluate(w2)
            # near the optimum losses no longer differ in double precision: there the slope decides
            if f2 <= f + 1e-4 * t * (d @ g) or abs(g2 @ d) <= 0.9 * abs(g @ d) and f2 <= f + 1e-12 * abs(f) or passes >= max_passes:
                break
            t *= 0.5
        if (w2 - w) @ (g2 - g) > 0:
            steps = [*steps[-MEMORY + 1:], (w2 - w, g2 - g)]
        w, f, g = w2, f2, g2
    return Weights(w, passes, f, steps)


def _two_loops(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction of limited-memory BFGS."""
    q, alphas = g.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q -= a * y
        alphas.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(alphas)):
        q += (a - (y @ q) / (s @ y)) * s
    return q


def score(df: DataFrame, weights: Weights, model_id: str = "logistic", keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """``scores`` rows: model_id, example_id, kept columns, logit0, logit1, score, pred."""
    cols = ["example_id", *[c for c in keep if c in df.columns]]
    shared = df.sparkSession.sparkContext.broadcast(weights.w)
    data = bags(df, weights.features, tuple(cols))
    types = dict(data.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, z = _margins(batch, shared.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(cols))], pa.array(z)], names=[*cols, "logit1"])
    out = data.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in cols) + ", logit1 double")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit1")))
    return out.select(F.lit(model_id).alias("model_id"), *cols, F.lit(0.0).alias("logit0"), "logit1", p.alias("score"),
                      (F.col("logit1") > 0).cast("int").alias("pred"))
