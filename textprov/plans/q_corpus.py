"""Queries: text rules, filters, length reports, corpus reports, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions import text as tx
from ..operators import dedup, filters, reports, sketches
from ..operators.split import stratum_key
from ..session import scratch_path
from .catalog import EXAMPLES_CTE, ntok_sql, query, strip_sql


def _docs(spark, d, *cols):
    return tables.read(spark, d, "documents").select(*cols)


def _doc_tokens(spark, d):
    return _docs(spark, d, "doc_id", "text", "source", "lang").withColumn(
        "token_length", tx.ws_token_count("text"))


def _ex_tokens(spark, d):
    return tables.labelled_features(spark, d, {"token_length": tx.ws_token_count("text")})


DOC_TOK = f"doc_tok AS (SELECT doc_id, source, lang, {ntok_sql()} AS token_length FROM documents)"
EX_TOK = EXAMPLES_CTE + f", ex_tok AS (SELECT *, {ntok_sql()} AS token_length FROM examples)"


# --- text rules and filters ----------------------------------------------------

@query("py_strip", f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(length({strip_sql('text')}) AS BIGINT) AS n_stripped
FROM documents""")
def q_py_strip(spark, d):
    return _docs(spark, d, "doc_id", "text").select(
        "doc_id", tx.py_len("text").cast("bigint").alias("n_chars"),
        tx.stripped_len("text").cast("bigint").alias("n_stripped"))


def _len_filter(name, pred_sql, fn):
    @query(name, f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents
WHERE {pred_sql}""")
    def q(spark, d):
        return fn(_docs(spark, d, "doc_id", "text")).select(
            "doc_id", tx.py_len("text").cast("bigint").alias("n_chars"))
    return q


_S = f"length({strip_sql('text')})"
_len_filter("filter_nonempty", f"{_S} > 0", filters.nonempty)
_len_filter("filter_len_csv", f"{_S} >= 50", filters.csv_text)
_len_filter("filter_len_essay", f"{_S} > 50", filters.essay_text)
_len_filter("filter_story", f"{_S} > 200 AND {_S} < 8000", filters.story_text)
_len_filter("filter_pool", f"{_S} > 100", filters.pool_text)


@query("token_length", f"SELECT doc_id, CAST({ntok_sql()} AS INTEGER) AS token_length FROM documents")
def q_token_length(spark, d):
    return _doc_tokens(spark, d).select("doc_id", F.col("token_length").cast("int"))


@query("filter_tokens", f"""
WITH {DOC_TOK}
SELECT doc_id, CAST(token_length AS INTEGER) AS token_length FROM doc_tok WHERE token_length >= 64""")
def q_filter_tokens(spark, d):
    return filters.min_tokens(_doc_tokens(spark, d)).select("doc_id", F.col("token_length").cast("int"))


@query("filter_report", f"""
WITH {DOC_TOK}
SELECT count(*) AS n_before, count(*) FILTER (WHERE token_length >= 64) AS n_after,
       count(*) FILTER (WHERE NOT (token_length >= 64)) AS n_removed
FROM doc_tok""")
def q_filter_report(spark, d):
    return filters.filter_report(_doc_tokens(spark, d), F.col("token_length") >= 64)


@query("first_nonempty", """
SELECT conv_id,
       coalesce(nullif(min_by(text, turn) FILTER (WHERE role = 'system'), ''),
                nullif(min_by(text, turn) FILTER (WHERE role = 'user'), ''),
                nullif(min_by(text, turn) FILTER (WHERE role = 'assistant'), ''), '') AS text
FROM conversations GROUP BY conv_id""")
def q_first_nonempty(spark, d):
    c = tables.read(spark, d, "conversations")

    def first(role):
        return F.min_by(F.when(F.col("role") == role, F.col("text")),
                        F.when(F.col("role") == role, F.col("turn")))
    g = c.groupBy("conv_id").agg(first("system").alias("s"), first("user").alias("u"),
                                 first("assistant").alias("a"))
    return g.select("conv_id", tx.first_nonempty("s", "u", "a").alias("text"))


@query("label_from_generator", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS label
FROM conversations WHERE role <> 'system'""")
def q_label_from_generator(spark, d):
    c = tables.read(spark, d, "conversations").filter(F.col("role") != "system")
    return c.select("conv_id", "turn", tx.label_from_generator("role", human_value="user").alias("label"))


@query("strata", f"""
WITH {EXAMPLES_CTE}
SELECT CAST(label AS VARCHAR) || '_' || source AS stratum, count(*) AS n
FROM examples GROUP BY 1""")
def q_strata(spark, d):
    return (tables.examples(spark, d).groupBy(stratum_key().alias("stratum"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


@query("prompt_input", """
SELECT doc_id, substr(text, 1, 1000) AS prompt_text, substr(text, 1, 200) AS fallback_text
FROM documents""")
def q_prompt_input(spark, d):
    return _docs(spark, d, "doc_id", "text").select(
        "doc_id", tx.truncate_chars("text", 1000).alias("prompt_text"),
        tx.truncate_chars("text", 200).alias("fallback_text"))


# --- length reports --------------------------------------------------------------

def _describe_sql(src, by=None, rounded=False):
    r = (lambda e: f"round_even({e}, 0)") if rounded else (lambda e: f"round({e}, 6)")
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""SELECT {sel}count(token_length) AS count, {r('avg(token_length)')} AS mean,
       {r('stddev_samp(token_length)')} AS std, CAST(min(token_length) AS DOUBLE) AS min,
       {r('quantile_cont(token_length, 0.25)')} AS p25, {r('quantile_cont(token_length, 0.5)')} AS p50,
       {r('quantile_cont(token_length, 0.75)')} AS p75, CAST(max(token_length) AS DOUBLE) AS max
FROM {src}{grp}"""


@query("token_describe", f"WITH {DOC_TOK}\n" + _describe_sql("doc_tok"))
def q_token_describe(spark, d):
    return reports.describe(_doc_tokens(spark, d))


@query("token_percentiles", f"WITH {DOC_TOK}\n" + "\nUNION ALL\n".join(
    f"SELECT {p} AS p, round(quantile_cont(token_length, {p / 100.0}), 6) AS value FROM doc_tok"
    for p in reports.PERCENTILES))
def q_token_percentiles(spark, d):
    return reports.percentiles(_doc_tokens(spark, d))


@query("token_sketch", f"WITH {DOC_TOK}\n" + "\nUNION ALL\n".join(
    f"SELECT source, count(*) AS n, {p} AS p, quantile_disc(token_length, {p / 100.0}) AS value FROM doc_tok GROUP BY source"
    for p in (25, 50, 90, 99)))
def q_token_sketch(spark, d):
    """Token length quantiles per source out of stored KLL sketches per (source, language), merged."""
    path = scratch_path(spark, "token_sketches")
    sketches.build(_doc_tokens(spark, d), ["source", "lang"], "token_length").write.parquet(path)
    per_source = sketches.merge(spark.read.parquet(path), ["source"])
    return sketches.quantiles(per_source, ["source"], (25, 50, 90, 99))


@query("token_describe_source", f"WITH {DOC_TOK}\n" + _describe_sql("doc_tok", "source", True))
def q_token_describe_source(spark, d):
    return reports.describe(_doc_tokens(spark, d), by="source", rounded=True)


@query("token_describe_label", f"WITH {EX_TOK}\n" + _describe_sql("ex_tok", "label", True))
def q_token_describe_label(spark, d):
    return reports.describe(_ex_tokens(spark, d), by="label", rounded=True)


@query("token_thresholds", f"""
WITH {DOC_TOK}
SELECT count(*) FILTER (WHERE token_length > 512) AS n_gt_512,
       round(avg(CASE WHEN token_length > 512 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_gt_512,
       count(*) FILTER (WHERE token_length > 1024) AS n_gt_1024,
       round(avg(CASE WHEN token_length > 1024 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_gt_1024,
       count(*) FILTER (WHERE token_length < 32) AS n_lt_32,
       round(avg(CASE WHEN token_length < 32 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_lt_32,
       count(*) FILTER (WHERE token_length < 64) AS n_lt_64,
       round(avg(CASE WHEN token_length < 64 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_lt_64
FROM doc_tok""")
def q_token_thresholds(spark, d):
    return reports.thresholds(_doc_tokens(spark, d))


# --- corpus reports --------------------------------------------------------------

@query("corpus_counts", f"""
WITH {EXAMPLES_CTE}
SELECT count(*) AS n_total, count(*) FILTER (WHERE label = 0) AS n_human,
       count(*) FILTER (WHERE label = 1) AS n_ai FROM examples""")
def q_corpus_counts(spark, d):
    return reports.corpus_counts(tables.examples(spark, d))


def _pivot_sql(by):
    return f"""
WITH {EXAMPLES_CTE}
SELECT {by}, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1
FROM examples GROUP BY {by}"""


@query("pivot_source_label", _pivot_sql("source"))
def q_pivot_source_label(spark, d):
    return reports.label_pivot(tables.examples(spark, d), "source")


@query("pivot_domain_label", _pivot_sql("domain"))
def q_pivot_domain_label(spark, d):
    return reports.label_pivot(tables.examples(spark, d), "domain")


@query("corpus_report", f"""
WITH {EXAMPLES_CTE}
SELECT source, domain, label, CAST(grouping(source, domain, label) AS INTEGER) AS gid, count(*) AS n
FROM examples GROUP BY GROUPING SETS ((), (label), (source, label), (domain, label))""")
def q_corpus_report(spark, d):
    return reports.corpus_report(tables.examples(spark, d))


@query("domain_dist", f"""
WITH {EXAMPLES_CTE}
SELECT domain, count(*) AS n FROM examples WHERE domain IS NOT NULL GROUP BY domain""")
def q_domain_dist(spark, d):
    return reports.value_counts(tables.examples(spark, d), "domain")


@query("corpus_token_report", f"""
WITH {EX_TOK}
SELECT source, label, count(*) AS n, round(avg(token_length), 6) AS mean_tokens,
       CAST(min(token_length) AS INTEGER) AS min_tokens, CAST(max(token_length) AS INTEGER) AS max_tokens,
       count(*) FILTER (WHERE token_length >= 64) AS n_kept
FROM ex_tok WHERE length({strip_sql('text')}) > 0 GROUP BY source, label""")
def q_corpus_token_report(spark, d):
    return flagship(spark, d)


def flagship(spark, d):
    """documents JOIN labels -> strip filter -> tokens -> source x label token report.

    The strip filter and the token count run on ``documents`` before the join.
    """
    x = tables.labelled_features(spark, d, {"token_length": tx.ws_token_count("text")},
                                 keep_empty=False)
    return (x.groupBy("source", "label")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.round(F.avg("token_length"), 6).alias("mean_tokens"),
                 F.min("token_length").cast("int").alias("min_tokens"),
                 F.max("token_length").cast("int").alias("max_tokens"),
                 F.count_if(F.col("token_length") >= 64).cast("bigint").alias("n_kept")))


# --- de-duplication --------------------------------------------------------------

@query("dedup_exact", """
SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)""")
def q_dedup_exact(spark, d):
    return dedup.dedup_exact(_docs(spark, d, "doc_id", "text"), id_col="doc_id").select("doc_id")


@query("duplicate_report", """
SELECT md5(text) AS text_md5, count(*) AS n_rows, count(*) - 1 AS n_surplus
FROM documents GROUP BY md5(text) HAVING count(*) > 1""")
def q_duplicate_report(spark, d):
    return dedup.duplicate_report(_docs(spark, d, "text"))


@query("label_conflicts", f"""
WITH {EXAMPLES_CTE}
SELECT md5(text) AS text_md5, count(*) AS n_rows, count(DISTINCT label) AS n_labels,
       CAST(min(label) AS INTEGER) AS min_label, CAST(max(label) AS INTEGER) AS max_label
FROM examples GROUP BY md5(text) HAVING count(DISTINCT label) > 1""")
def q_label_conflicts(spark, d):
    return dedup.label_conflicts(tables.examples(spark, d))
