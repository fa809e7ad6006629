"""Line dedup by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it occurs on, merged by
aggregation.  Lines whose estimate is close to the threshold get an exact
distinct count, so the decision does not depend on the sketch's error.
Lines on ``min_sites`` sites or more are boilerplate and are cut from every
document but the first that holds them (smallest document key, then position),
so that no text leaves the corpus altogether.

DataFrame functions only.  Lines travel as two 64-bit hashes, not as text; the
aggregation is partial, so a line in a third of all rows stays one row per task.

Defined results: null text stays null; blank lines are never boilerplate; a
null site counts as one site of its own; identical repeated rows are treated
alike (all of them keep the line if one does); an empty table gives an empty
result; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

MIN_SITES = 5
LG_K = 12


def _key(id_col: str, text_col: str, site_col: str) -> Column:
    """Document key: the id first, so that the first document is the one with the smallest id."""
    i, t, s = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{site_col}`")
    return F.struct(i.alias("id"), F.xxhash64(t, s).alias("h"))


def _lines(text_col: str) -> Column:
    """Array of (a, b) hashes of the trimmed lines; blank lines null."""
    return F.expr(f"""transform(split(`{text_col}`, '\\n', -1), l -> if(trim(BOTH ' \\t\\r' FROM l) = '', null,
        named_struct('a', xxhash64(trim(BOTH ' \\t\\r' FROM l)), 'b', xxhash64(1, trim(BOTH ' \\t\\r' FROM l)))))""")


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(doc, site, pos, a, b): one row per non-blank line."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(f"`{site_col}`").cast("string")), F.lit("-"))
    return (docs.where(F.col(f"`{text_col}`").isNotNull())
            .select(_key(id_col, text_col, site_col).alias("doc"), site.alias("site"),
                    F.posexplode(_lines(text_col)).alias("pos", "k"))
            .where("k IS NOT NULL").select("doc", "site", "pos", "k.a", "k.b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(a, b, first): line hashes on ``min_sites`` sites or more, with their first place.

    Four standard errors of the sketch (1.04 / sqrt(2^lg_k)) around the threshold, one site at
    least, are decided by exact distinct counts.
    """
    band = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = stored(
        lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"),
                                    F.min(F.struct("doc", "pos")).alias("first"))
        .select("a", "b", F.hll_sketch_estimate("sketch").alias("sites"), "first")
        .where(F.col("sites") >= min_sites - band), "spread")
    sure = spread.where(F.col("sites") > min_sites + band)
    near = spread.where(F.col("sites") <= min_sites + band)
    exact = (lines.select("a", "b", "site").join(near.select("a", "b"), ["a", "b"], "left_semi")
             .distinct().groupBy("a", "b").count().where(F.col("count") >= min_sites).select("a", "b"))
    return stored(sure.select("a", "b", "first").unionByName(
        near.join(exact, ["a", "b"], "left_semi").select("a", "b", "first")), "boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, id_col: str = "doc_id",
                text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with cross-site boilerplate lines cut from the text, plus ``_lines_removed``.

    The texts are shuffled once, to meet the positions to cut (an array per document, at most its
    own line count).
    """
    lines = line_table(docs, id_col, text_col, site_col)
    bad = boilerplate(lines, min_sites, lg_k)
    cut = (lines.join(bad, ["a", "b"])
           .where(~F.col("doc").eqNullSafe(F.col("first.doc"))
                  | (F.col("pos") != F.col("first.pos")))
           .groupBy("doc").agg(F.collect_set("pos").alias("_cut"))
           .select(F.col("doc.id").alias("_id"), F.col("doc.h").alias("_h"), "_cut"))
    own, h = fresh(docs, "_id"), fresh(docs, "_h")
    keyed = docs.withColumns({own: F.col(f"`{id_col}`"), h: _key(id_col, text_col, site_col)["h"]}).alias("d")
    joined = keyed.join(cut.alias("c"), F.col(f"d.`{h}`").eqNullSafe(F.col("c._h")) & F.col(f"d.`{own}`").eqNullSafe(F.col("c._id")), "left")
    text = F.expr(f"""if(c._cut IS NULL, d.`{text_col}`, array_join(
        filter(split(d.`{text_col}`, '\\n', -1), (l, i) -> NOT array_contains(c._cut, i)), '\\n'))""")
    cols = [text.alias(text_col) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*cols, F.greatest(F.size("c._cut"), F.lit(0)).alias(fresh(docs, "_lines_removed")))
