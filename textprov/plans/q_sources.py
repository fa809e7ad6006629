"""Queries: source readers over files that Spark lays out from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..session import scratch_path
from ..sources import readers, staging, writers
from .catalog import EXAMPLES_CTE, h32, ntok_sql, query, stable_id_sql, strip_sql

QA_SQL = """q AS (SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'system') AS question
       FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, floor(turn / 64) AS part, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS label,
             row_number() OVER (PARTITION BY conv_id, floor(turn / 64), role ORDER BY turn) - 1 AS pos, text
      FROM conversations WHERE role IN ('user', 'assistant')),
qa AS (SELECT a.conv_id, CAST(a.part AS BIGINT) AS part, CAST(a.label AS INTEGER) AS label, CAST(a.pos AS INTEGER) AS answer_pos,
              CASE WHEN coalesce(q.question, '') <> '' THEN q.question || chr(10) || a.text ELSE a.text END AS text
       FROM a JOIN q ON a.conv_id = q.conv_id)"""

CSV_SQL = EXAMPLES_CTE + f""",
csvrows AS (SELECT example_id AS doc_id, CAST(label AS INTEGER) AS label,
                   CASE WHEN label = 0 THEN 'human' ELSE 'gen_' || source END AS generator,
                   {strip_sql('text')} AS stext FROM examples)"""

POLY_SQL = EXAMPLES_CTE + f""",
poly AS (SELECT 'student_essays_' || domain AS domain, CAST(label AS INTEGER) AS label,
                {strip_sql('text')} AS stext FROM examples)"""


def qa_rows(spark, d, broken_every=None):
    path = writers.write_qa_jsonl(tables.read(spark, d, "conversations"), scratch_path(spark, "qa_jsonl"),
                                  broken_every=broken_every)
    return readers.read_qa_jsonl(spark, path)


def csv_rows(spark, d, keep_unknown=False):
    path = writers.write_labelled_csv(tables.examples(spark, d), scratch_path(spark, "labelled_csv"), keep_unknown)
    return readers.read_labelled_csv(spark, path)


def poly_rows(spark, d):
    root = writers.write_poly_json(spark, tables.examples(spark, d), scratch_path(spark, "essays"))
    return readers.read_poly_json(spark, root)


@query("src_qa_jsonl", f"""
WITH {QA_SQL}
SELECT conv_id, part, label, answer_pos, text FROM qa""")
def q_src_qa_jsonl(spark, d):
    rows, _ = qa_rows(spark, d)
    return rows.select(F.col("record_id").alias("conv_id"), F.col("record_part").alias("part"),
                       "label", "answer_pos", "text")


@query("src_csv", f"""
WITH {CSV_SQL}
SELECT doc_id, CASE WHEN generator = 'human' THEN 0 ELSE 1 END AS label, generator,
       CAST(length(stext) AS BIGINT) AS n_chars
FROM csvrows WHERE length(stext) >= 50""")
def q_src_csv(spark, d):
    r = csv_rows(spark, d)
    return r.select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "generator",
                    F.length("text").cast("bigint").alias("n_chars"))


@query("src_zip_csv", f"""
WITH {CSV_SQL}
SELECT md5(stext) AS text_md5, CASE WHEN generator = 'human' THEN 0 ELSE 1 END AS label, generator,
       CAST(length(stext) AS BIGINT) AS n_chars
FROM csvrows WHERE length(stext) >= 50""")
def q_src_zip_csv(spark, d):
    """CSV members of zip archives, one task per member."""
    root = writers.write_zipped_csv(tables.examples(spark, d), scratch_path(spark, "zipped_csv"))
    return readers.read_zipped_csv(spark, root).select(F.md5("text").alias("text_md5"), "label", "generator",
                                                       F.length("text").cast("bigint").alias("n_chars"))


@query("src_poly_json", f"""
WITH {POLY_SQL}
SELECT domain, label, md5(stext) AS text_md5, CAST(length(stext) AS BIGINT) AS n_chars
FROM poly WHERE length(stext) > 50""")
def q_src_poly_json(spark, d):
    rows, _ = poly_rows(spark, d)
    return rows.select("domain", "label", F.md5("text").alias("text_md5"),
                       F.length("text").cast("bigint").alias("n_chars"))


@query("path_label", """
SELECT page_id,
       CASE WHEN position('gpt' IN parts[len(parts)]) > 0 THEN 1 ELSE 0 END AS label,
       CASE WHEN len(parts) > 1 THEN parts[2] ELSE 'unknown' END AS domain
FROM (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://(.*)$', 1), '/') AS parts FROM pages) p""")
def q_path_label(spark, d):
    """The path rule (label from the last part, domain from the second) on page URLs."""
    p = tables.read(spark, d, "pages").select("page_id", "url")
    parts = F.split(F.regexp_extract("url", r"^[a-z]+://(.*)$", 1), "/")
    return p.select("page_id", readers.label_from_path(parts).alias("label"),
                    readers.domain_from_path(parts).alias("domain"))


@query("scan_corpus", """
SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def q_scan_corpus(spark, d):
    """Parquet scan with column pruning (only three columns are read)."""
    return tables.read(spark, d, "documents").select(
        "doc_id", "source", F.length("text").cast("bigint").alias("n_chars"))


@query("quarantine", f"""
SELECT count(*) FILTER (WHERE {h32('broken', "conv_id || ':' || part")} % 7 <> 0) AS n_good_records,
       count(*) FILTER (WHERE {h32('broken', "conv_id || ':' || part")} % 7 = 0) AS n_quarantined,
       count(DISTINCT conv_id) FILTER (WHERE {h32('broken', "conv_id || ':' || part")} % 7 <> 0) AS n_record_ids
FROM (SELECT DISTINCT conv_id, CAST(floor(turn / 64) AS BIGINT) AS part FROM conversations WHERE role IN ('user', 'assistant')) c""")
def q_quarantine(spark, d):
    """Broken JSON lines are kept aside in a quarantine table; the rest is read."""
    path = writers.write_qa_jsonl(tables.read(spark, d, "conversations"),
                                  scratch_path(spark, "qa_broken"), broken_every=7)
    return readers.qa_record_counts(spark, path)


@query("corpus_union", f"""
WITH {QA_SQL}, {CSV_SQL}, {POLY_SQL.replace(EXAMPLES_CTE + ",", "", 1)},
u AS (SELECT 'qa' AS source, label, CAST(NULL AS VARCHAR) AS generator, text FROM qa
      UNION ALL SELECT 'news', CASE WHEN generator = 'human' THEN 0 ELSE 1 END, generator, stext
                FROM csvrows WHERE length(stext) >= 50
      UNION ALL SELECT 'essays', label, NULL, stext FROM poly WHERE length(stext) > 50)
SELECT source, label, count(*) AS n, count(generator) AS n_with_generator
FROM u WHERE length({strip_sql('text')}) > 0 GROUP BY source, label""")
def q_corpus_union(spark, d):
    qa, _ = qa_rows(spark, d)
    poly, _ = poly_rows(spark, d)
    u = readers.union_sources(qa, csv_rows(spark, d), poly)
    return u.groupBy("source", "label").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                            F.count("generator").cast("bigint").alias("n_with_generator"))


@query("corpus_prep", f"""
WITH {QA_SQL}, {CSV_SQL}, {POLY_SQL.replace(EXAMPLES_CTE + ",", "", 1)},
u AS (SELECT {stable_id_sql("'qa'", 'conv_id', 'part', 'label', 'answer_pos', 'md5(answer)')} AS id,
             label, text, CAST(conv_id AS VARCHAR) AS group_key FROM (
        SELECT qa.*, CASE WHEN coalesce(q.question, '') <> '' THEN substr(qa.text, length(q.question) + 2) ELSE qa.text END AS answer
        FROM qa JOIN q ON q.conv_id = qa.conv_id) x
      UNION ALL SELECT 0, CASE WHEN generator = 'human' THEN 0 ELSE 1 END, stext, md5(stext) FROM csvrows WHERE length(stext) >= 50
      UNION ALL SELECT 0, label, stext, md5(stext) FROM poly WHERE length(stext) > 50),
k AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY id, label) AS rn FROM u WHERE length({strip_sql('text')}) > 0),
s AS (SELECT label, CASE WHEN {h32(42, 'group_key')} / 4294967296.0 < 0.8 THEN 'train'
                         WHEN {h32(42, 'group_key')} / 4294967296.0 < 0.9 THEN 'val' ELSE 'test' END AS split
      FROM k WHERE rn = 1 AND {ntok_sql('text')} >= 64)
SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 0) AS n_human, count(*) FILTER (WHERE label = 1) AS n_ai,
       round(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_human,
       round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_ai
FROM s GROUP BY split""")
def q_corpus_prep(spark, d):
    """Entry A end to end: three sources, staged -> clean -> dedup -> tokens -> >= 64 -> split -> write.

    The corpus is made of all three sources or not at all: a source that failed, or left records in quarantine, is raised
    (``SourcesNotWhole``) once the others have their stages."""
    from . import corpus
    out = scratch_path(spark, "corpus")
    # each source has a stage of its own: beside a failing reader the others are still staged
    parts = staging.stage_all(spark, f"{out}_stages", {"qa": lambda: qa_rows(spark, d),
                                                       "news": lambda: csv_rows(spark, d, keep_unknown=True),
                                                       "essays": lambda: poly_rows(spark, d)})
    staging.whole(parts)
    c = corpus.clean_corpus(*[p.rows for p in parts.values()])
    res = corpus.prepare(spark, c, out, vocab_size=5000, quarantine=[p.quarantine for p in parts.values()])
    return res["split_report"]
