"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

# Rows of two or three numbers: at most some 64 MB once broadcast.
BROADCAST_ROWS = 1_000_000


def ready(spark: SparkSession) -> None:
    """Shared folder and package for the Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: computed once, lineage cut,
    whole after the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if the (stored) table has at most ``max_rows`` rows; else it is shuffled."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fold(key, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % F.lit(modulus), F.lit(0))


def ascii_lower(col) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns, for rows that share an id.  Maps, which have no hash, count by their JSON."""
    def plain(c: str, t: str) -> Column:
        col = F.col(f"`{c}`")
        if "map<" in t:
            return F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})
        return col.cast("string") if t == "void" else col
    return F.xxhash64(*[plain(c, t) for c, t in df.dtypes])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names differ by more than case)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base = "_" + base
    return base
