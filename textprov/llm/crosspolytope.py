"""Approximate nearest neighbours by cross-polytope hashing.

A vector's direction goes through three rounds of random signs and a fast
Hadamard transform and hashes to the nearest signed axis.  Several tables use
independent signs; a query probes the axes nearest to it in each.  Candidates
are reranked by the exact inner product of the original vectors in double
precision.

Equal vectors are one entry with their smallest ids.  Vectors of different
length are kept apart in bands of similar length (factor 2^(1/4)), so that the hash,
which sees directions only, serves the inner product too.  A bucket with more
than ``chunk`` entries is split into chunks that are searched side by side.
A task returns the best of one query in one chunk, so results stay bounded.

Defined results: vectors null, zero or holding null or non-finite components
take no part; vectors of different dimension never meet; ties go to the smaller
id; repeated rows count each by itself; no candidates gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP = 20
TABLES = 12
PROBES = 12
CHUNK = 4000
SEED = 17


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation of the rows: (Hadamard x random signs) three times."""
    n, size = len(x), padded(x.shape[1])
    out = np.zeros((n, size))
    out[:, :x.shape[1]] = x
    rng = np.random.default_rng([seed, table, size])
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], size)
        h = 1
        while h < size:
            y = out.reshape(n, -1, 2, h)
            out = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
            h *= 2
        out /= np.sqrt(size)
    return out


def nearest_axes(x: np.ndarray, table: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, probes): signed axes, nearest first; axis j is j, its opposite j + size."""
    y = rotate(x, table, seed)
    both = np.concatenate([y, -y], axis=1)
    probes = min(probes, both.shape[1])
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    part = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>, dim, band) of the vectors that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return (df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where("v IS NOT NULL AND id IS NOT NULL").where(~bad)
            .withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
            .select("id", "v", F.size("v").alias("dim"), F.round(F.log2("norm") * 4).cast("int").alias("band")))


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP,
           tables: int = TABLES, probes: int = PROBES, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each query among the rows of
    ``df`` but the one with its own id."""
    # the first top + 1 ids of each different vector: row_number <= k is cut in every task before the shuffle
    by_vec = Window.partitionBy("dim", "band", "v").orderBy("id")
    index = stored(valid(df, id_col, vec_col).withColumn("_n", F.row_number().over(by_vec)).where(f"_n <= {top + 1}")
                   .groupBy("dim", "band", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    wanted = stored(valid(queries, id_col, vec_col), "queries")
    # at most (dimensions x bands) rows, far fewer than rows
    bands = index.select("dim", "band").distinct()
    wanted = wanted.select("id", "v", "dim").join(F.broadcast(bands) if bands.limit(100_001).count() <= 100_000 else bands, "dim")

    def hashed(n_probes):
        def run(batches):
            for pdf in batches:
                for dim, part in pdf.groupby("dim", sort=False):
                    x = np.stack(part["v"].to_numpy())
                    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    axes = np.stack([nearest_axes(unit, t, n_probes, seed) for t in range(tables)], axis=1)
                    yield part.assign(axes=[a.tolist() for a in axes])
        return run

    cells = F.posexplode("axes").alias("t", "probe")
    def located(frame, n, extra):
        rows = frame.mapInPandas(hashed(n), f"{extra}, v array<double>, dim int, band int, axes array<array<int>>")
        return rows.select(*[e.split()[0] for e in extra.split(", ")], "v", "dim", "band", cells)

    entries = located(index.select("ids", "v", "dim", "band"), 1, "ids array<long>").withColumn("axis", F.col("probe")[0]).drop("probe")
    cell = ["dim", "band", "t", "axis"]
    # cells: tables x 2 x dimension per band, whatever the number of rows
    parts = stored(entries.groupBy(*cell).count().select(*cell, F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "cells")
    side = F.broadcast(parts) if parts.limit(1_000_001).count() <= 1_000_000 else parts
    entries = (entries.join(side, cell).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts"))
    asked = (located(wanted.select("id", "v", "dim", "band"), probes, "id long")
             .select("id", "v", "dim", "band", "t", F.explode("probe").alias("axis"))
             .join(side, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    group = [*cell, "part"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "score": [], "ids": []}
        if len(left) and len(right):
            q, x = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            ids = right["ids"].to_numpy()
            first = np.array([i[0] for i in ids])
            k = min(len(x), 2 * top + 1)
            for lo in range(0, len(q), 256):
                rough = q[lo:lo + 256] @ x.T
                near = np.argpartition(-rough, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(len(x)), (len(rough), 1))
                for i, cand in enumerate(near):
                    exact = (x[cand] * q[lo + i]).sum(axis=1)
                    order = np.lexsort((first[cand], -exact))[:top + 1]
                    out["query_id"] += [left["id"].iat[lo + i]] * len(order)
                    out["score"] += exact[order].tolist()
                    out["ids"] += [ids[j].tolist() for j in cand[order]]
        return pd.DataFrame(out).astype({"ids": object})

    found = (asked.groupBy(*group).cogroup(entries.groupBy(*group))
             .applyInPandas(best, "query_id long, score double, ids array<long>"))
    pairs = (found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
             .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(f"rank <= {top}").select("query_id", F.col("rank").cast("int"), "vec_id", "score")
