"""Row filters of the corpus pipeline (length rules, token rules, mining).

Each is a plain ``DataFrame.filter`` on built-in expressions, so Catalyst
pushes what it can (e.g. ``token_length >= 64`` on a stored column) into the
Parquet scan and the rest runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_SPACE_CLASS, stripped_len

# Fixed values (length rules of the reference; boundaries differ per source):
#   non-empty after strip; CSV text length >= 50; essay text length > 50;
#   story 200 < length < 8000; pool text length > 100; token_length >= 64;
#   priority domains kept whole by the pool budget:
#   creative, reviews, online_content, encyclopedic, books
MIN_CSV_CHARS = 50
MIN_ESSAY_CHARS = 50
STORY_MIN_EXCLUSIVE = 200
STORY_MAX_EXCLUSIVE = 8000
MIN_POOL_CHARS = 100
MIN_TOKENS = 64
PRIORITY_DOMAINS = ["creative", "reviews", "online_content", "encyclopedic", "books"]
NON_SPACE_RE = "(?U)[^" + PY_SPACE_CLASS[1:-1] + "]"


def nonempty(df: DataFrame, text: str = "text") -> DataFrame:
    """Keep texts that are non-empty after strip (null texts drop).

    Same rows as ``length(strip(text)) > 0``, but the regex stops at the
    first non-space character instead of rewriting the whole text.
    """
    return df.filter(F.regexp_like(F.col(text), F.lit(NON_SPACE_RE)))


def min_chars(df: DataFrame, n: int, strict: bool, text: str = "text") -> DataFrame:
    """``len(strip) >= n`` (``strict=False``) or ``> n`` (``strict=True``)."""
    ln = stripped_len(text)
    return df.filter(ln > n if strict else ln >= n)


def csv_text(df: DataFrame, text: str = "text") -> DataFrame:
    return min_chars(df, MIN_CSV_CHARS, strict=False, text=text)


def essay_text(df: DataFrame, text: str = "text") -> DataFrame:
    return min_chars(df, MIN_ESSAY_CHARS, strict=True, text=text)


def story_text(df: DataFrame, text: str = "text") -> DataFrame:
    ln = stripped_len(text)
    return df.filter((ln > STORY_MIN_EXCLUSIVE) & (ln < STORY_MAX_EXCLUSIVE))


def pool_text(df: DataFrame, text: str = "text") -> DataFrame:
    return min_chars(df, MIN_POOL_CHARS, strict=True, text=text)


def min_tokens(df: DataFrame, n: int = MIN_TOKENS, col: str = "token_length") -> DataFrame:
    """Filter on the untruncated token length."""
    return df.filter(F.col(col) >= n)


def in_domains(domains=None, col: str = "domain") -> Column:
    """Null-safe membership: a null domain is *not* priority (pandas ``isin``)."""
    return F.coalesce(F.col(col).isin(list(domains or PRIORITY_DOMAINS)), F.lit(False))


def false_positives(scored: DataFrame) -> DataFrame:
    """Human rows (label 0) predicted as machine text (pred 1)."""
    return scored.filter((F.col("label") == 0) & (F.col("pred") == 1))


def has_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.col(text).isNotNull() & (F.col(text) != F.lit("")))


def filter_report(df: DataFrame, keep: Column) -> DataFrame:
    """One pass: rows before, kept and removed by a predicate."""
    return df.agg(F.count(F.lit(1)).alias("n_before"),
                  F.count_if(keep).alias("n_after"),
                  F.count_if(~keep | keep.isNull()).alias("n_removed"))
