"""Deterministic hash expressions shared by Spark and the SQL oracle.

Every "random" choice in the package (samples, split order, shuffles, batch
shards) is a function of ``md5(seed || ':' || id)`` so that a recompute after a
lost executor gives the same rows, and DuckDB can reproduce the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seeded_md5(seed, key) -> Column:
    """Hex md5 of ``'<seed>:' || key``; compares lexicographically as a number."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def hash32(seed, key) -> Column:
    """First 32 bits of :func:`seeded_md5` as a BIGINT in [0, 2^32)."""
    return F.conv(F.substring(seeded_md5(seed, key), 1, 8), 16, 10).cast("bigint")


def unit_hash(seed, key) -> Column:
    """Uniform value in [0, 1) from :func:`hash32`."""
    return hash32(seed, key) / F.lit(4294967296.0)


def hex_bucket(hex_col: Column, digits: int) -> Column:
    """Integer value of the first ``digits`` hex digits (histogram bucket)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")


def stable_id(*parts) -> Column:
    """60-bit id from md5 of the parts joined with ':' (never positional)."""
    joined = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def text_hash(text) -> Column:
    """md5 of a text, used as the key of exact duplicates and group keys."""
    return F.md5(_c(text))
