"""Groups of near-copies by MinHash bands and connected components, for audits and leak-safe splits.

Two texts are near if the Jaccard similarity of their 5-word shingle sets (lower-cased, white-space words)
is at least 0.8.  Texts with equal sets are one class, and only its smallest id goes on.  80 minima
in 20 bands of 4 bring near texts together: a pair right at 0.8 shares a band with probability 0.99997.
In a band's bucket every member is compared, exactly, with the bucket's smallest and its
largest id only, so a bucket of n texts costs 2 n comparisons and never n^2, and no task gathers
one.  Nothing is linked unseen; what can be missed is a link between two texts that are near each other but
near neither end of any bucket they share, and that no chain of links replaces.

Defined results: texts without a word, and null texts, are near nothing; texts under five words have their whole
sequence as one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ws_tokens
from ..session import scratch_path

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
MAX_ROUNDS = 60


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingle_sets(df: DataFrame, id_col: str, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, sorted distinct shingle hashes) of the texts that have a word."""
    words = df.select(F.col(id_col).alias("id"), F.transform(ws_tokens(F.lower(F.col(text))), lambda w: F.xxhash64(w)).alias("w"))
    words = words.where(F.size("w") > 0)
    m = F.greatest(F.size("w") - (width - 1), F.lit(1))
    z = words.select("id", F.arrays_zip(*[F.slice("w", j + 1, m).alias(f"w{j}") for j in range(width)]).alias("z"))
    one = F.transform("z", lambda s: F.xxhash64(*[F.coalesce(s[f"w{j}"], F.lit(0)) for j in range(width)]))
    return z.select("id", F.array_sort(F.array_distinct(one)).alias("sh"))


def band_keys(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, band, bucket) of each set's MinHash bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        for batch in batches:
            found = np.empty((batch.num_rows, bands), np.int64)
            sh = batch.column(1)
            flat, ends = sh.values.to_numpy(zero_copy_only=False).view(np.uint64), sh.offsets.to_numpy()
            for i in range(batch.num_rows):
                x = flat[ends[i]:ends[i + 1]]
                least = np.array([(x * a[k] + b[k] ^ (x * a[k] + b[k] >> np.uint64(32))).min() for k in range(bands * rows)])
                key = np.zeros(bands, np.uint64)
                for r in range(rows):
                    key = (key ^ least[r::rows]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                found[i] = key.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), bands))),
                 pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)), pa.array(found.ravel())],
                names=["id", "band", "bucket"])
    return sets.select("id", "sh").mapInArrow(run, "id long, band int, bucket long")


def near_links(df: DataFrame, id_col: str = "example_id", text: str = "text", width: int = WIDTH,
               similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) with a > b: verified links whose components are the groups."""
    sets = _written(shingle_sets(df, id_col, text, width), "near_sets")
    keyed = sets.select("id", F.md5(F.array_join("sh", ",")).alias("k"))
    first = keyed.groupBy("k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = keyed.join(first.where("n > 1"), "k").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = sets.join(first.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    keys = _written(band_keys(reps), "near_bands")
    ends = keys.groupBy("band", "bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    pairs = keys.join(ends, ["band", "bucket"]).select("id", F.explode(F.array("lo", "hi")).alias("end")).where("id <> end")
    pairs = pairs.select(F.greatest("id", "end").alias("a"), F.least("id", "end").alias("b")).distinct()
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("sh").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity"))
    return copies.select("a", "b", F.lit(1.0).alias("similarity")).unionByName(both.where(F.col("similarity") >= similarity))


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b).

    Every round takes the least label of the neighbours and then the label's own label; each is written, so a lost
    executor costs one round.
    """
    e = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = _written(e.where("a <> b").distinct(), "near_edges")
    labels = _written(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "near_labels")
    for _ in range(MAX_ROUNDS):
        least = (e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen")))
        step = labels.join(least, "node").select("node", F.least("root", "seen").alias("via"), F.col("root").alias("was"))
        own = labels.select(F.col("node").alias("via"), F.col("root").alias("next"))
        after = _written(step.join(own, "via").select("node", F.least("via", "next").alias("root"), "was"), "near_labels")
        if after.where("root <> was").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
    raise RuntimeError("groups did not settle")


def near_groups(df: DataFrame, id_col: str = "example_id", text: str = "text", width: int = WIDTH,
                similarity: float = SIMILARITY) -> DataFrame:
    """(id, group_id) of every row: the smallest id of its group, its own if it is near nothing."""
    groups = connected(near_links(df, id_col, text, width, similarity))
    return (df.select(id_col).join(groups.withColumnRenamed("node", id_col), id_col, "left")
            .select(id_col, F.coalesce("root", F.col(id_col)).alias("group_id")))
