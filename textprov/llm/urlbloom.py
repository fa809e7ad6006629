"""URL filters: blocked Bloom filter of listed canonical URLs, then an exact hash join.

The filter is a table of blocks of eight 32-bit words.  A canonical URL hashes
to one block and sets one bit in each word; a URL whose eight bits are not all
set is certainly not listed.  Only possible hits reach the exact join with the
list, which removes the false positives.  All steps are DataFrame expressions.

Defined results: null URL or no ``://`` gives empty host and path and no rule; it is never
listed.  Repeated rows are judged alike, repeated list entries count once, an
empty list allows every URL that no rule blocks.  Ties between rules of one
length go to the smaller rule text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small_side, stored

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
WORDS = 8
BITS_PER_URL = 16


def _rest(url) -> Column:
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    i = F.locate("://", u)
    return F.when(i > 0, u.substr(i + 3, F.length(u))).otherwise(F.lit(""))


def host_of(url) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url) -> Column:
    """Host without ``www.`` or ``m.`` and default port, path without a trailing slash; no scheme,
    query or fragment.  Null where the URL has no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(host != "", F.concat(host, path))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rhost, rpath in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rhost + rpath).alias("rule"))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    # five bits of a second, independent hash for each of the eight words
    h = F.xxhash64(F.lit("bits"), key)
    return F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * word).bitwiseAND(F.lit(31)).cast("int"))


def build_filter(listed: DataFrame, blocks: int, col: str = "canonical") -> DataFrame:
    """Table (block, w0..w7): the set bits, OR-ed per block (partial aggregation, no hot key)."""
    key = F.col(col)
    return (listed.select(_block(key, blocks).alias("block"), *[_bit(key, i).alias(f"w{i}") for i in range(WORDS)])
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def listed_urls(listed: DataFrame, url_col: str = "url") -> DataFrame:
    return (listed.select(canonical(url_col).alias("canonical")).where(F.col("canonical").isNotNull())
            .distinct())


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          url_col: str = "url", key_col: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, listed) per row of ``pages``.

    ``listed`` holds the listed URLs in ``url_col``.  The rule's verdict wins; without a rule a
    listed URL is blocked and every other allowed.  The filter's table is broadcast while it has
    at most a million blocks (some 80 MB), else joined by block; a hot URL is split by the
    skew join, as the list side holds every URL once.
    """
    urls = stored(listed_urls(listed, url_col), "listed")
    n = urls.count()
    blocks = max(1, -(-n * BITS_PER_URL // (WORDS * 32)))
    bloom = stored(build_filter(urls, blocks), "bloom")
    canon = canonical(url_col)
    rows = pages.select(F.col(key_col).alias("_key"), host_of(url_col).alias("host"), path_of(url_col).alias("path"),
                        canon.alias("canonical"))
    # URLs without a host get blocks of their own, which the filter never holds, spread over the tasks
    probe = rows.withColumn("block", F.when(F.col("canonical").isNotNull(), _block(F.col("canonical"), blocks))
                            .otherwise(-1 - F.pmod(F.xxhash64("_key"), F.lit(1 << 20))))
    possible = F.lit(True)
    for i in range(WORDS):
        bit = _bit(F.col("canonical"), i)
        possible = possible & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    tested = (probe.join(small_side(bloom), "block", "left")
              .withColumn("_maybe", F.coalesce(possible, F.lit(False)))
              .select("_key", "host", "path", "canonical", "_maybe"))
    hits = (tested.where("_maybe").join(urls.withColumn("listed", F.lit(True)), "canonical", "left")
            .withColumn("listed", F.coalesce("listed", F.lit(False))))
    rest = tested.where("NOT _maybe").withColumn("listed", F.lit(False))
    rule = rule_column(F.col("host"), F.col("path"), rules)
    return (hits.unionByName(rest).withColumn("_r", rule)
            .select(F.col("_key").alias(key_col), "host", "path", F.col("_r.rule").alias("rule"),
                    F.coalesce("_r.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "listed"))
