"""Queries: splits, rare strata, split overlap audit, seeded samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..operators import audit, dedup, near, reports, sample, split
from .catalog import EXAMPLES_CTE, SPLIT_CTE, h32, query, row_no_sql, smd5, strip_sql, ws_tokens_sql


# Validation subset size and human story target of the reference
VAL_SUBSET = 10_000
STORY_TARGET = 3_000


def split_examples(spark, d):
    return split.stratified_split(tables.examples(spark, d))


@query("stratified_split", f"WITH {SPLIT_CTE}\nSELECT example_id, split FROM splits")
def q_stratified_split(spark, d):
    return split_examples(spark, d).select("example_id", "split")


@query("split_report", f"""
WITH {SPLIT_CTE}
SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 0) AS n_human,
       count(*) FILTER (WHERE label = 1) AS n_ai,
       round(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_human,
       round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_ai
FROM splits GROUP BY split""")
def q_split_report(spark, d):
    return reports.split_report(split_examples(spark, d))


@query("rare_strata", f"""
WITH {EXAMPLES_CTE}
SELECT CAST(label AS VARCHAR) || '_' || source AS stratum, count(*) AS n
FROM examples GROUP BY 1 HAVING count(*) < 2""")
def q_rare_strata(spark, d):
    ex = tables.examples(spark, d).withColumn("stratum", split.stratum_key())
    return split.rare_strata(ex)


@query("group_split", f"""
SELECT conv_id, turn,
       CASE WHEN {h32(42, 'conv_id')} / 4294967296.0 < 0.8 THEN 'train'
            WHEN {h32(42, 'conv_id')} / 4294967296.0 < 0.9 THEN 'val' ELSE 'test' END AS split
FROM conversations WHERE role <> 'system'""")
def q_group_split(spark, d):
    c = tables.read(spark, d, "conversations").filter(F.col("role") != "system")
    return split.group_split(c, group_col="conv_id").select("conv_id", "turn", "split")


@query("audit_split_overlap", f"""
WITH {SPLIT_CTE},
n AS (SELECT split, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS text_md5 FROM splits)
SELECT text_md5, count(DISTINCT split) AS n_splits, count(*) AS n_rows
FROM n GROUP BY text_md5 HAVING count(DISTINCT split) > 1""")
def q_audit_split_overlap(spark, d):
    """Texts that the split by row leaves in several splits (the leak-safe split leaves none)."""
    return audit.split_overlap(split_examples(spark, d))


@query("leak_safe_split", f"""
WITH {EXAMPLES_CTE},
k AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY example_id) AS rn FROM examples)
SELECT example_id, CASE WHEN {h32(42, 'group_key')} / 4294967296.0 < 0.8 THEN 'train'
                        WHEN {h32(42, 'group_key')} / 4294967296.0 < 0.9 THEN 'val' ELSE 'test' END AS split
FROM k WHERE rn = 1""")
def q_leak_safe_split(spark, d):
    """Exact copies go, then whole groups go to one split."""
    return split.group_split(dedup.dedup_exact(tables.examples(spark, d))).select("example_id", "split")


NEAR_CTE = f"""{EXAMPLES_CTE},
nt AS (SELECT example_id, {ws_tokens_sql('lower(text)')} AS t FROM examples WHERE len({ws_tokens_sql('lower(text)')}) > 0),
sh AS (SELECT DISTINCT example_id, array_to_string(t[i:i + 4], ' ') AS s
       FROM nt, LATERAL (SELECT unnest(range(1, greatest(len(nt.t) - 4, 1) + 1)) AS i) r),
sz AS (SELECT example_id, count(*) AS n FROM sh GROUP BY example_id),
sim AS (SELECT x.example_id AS a, y.example_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.example_id <> y.example_id GROUP BY 1, 2),
link AS (SELECT a, b FROM sim JOIN sz p ON p.example_id = a JOIN sz q ON q.example_id = b WHERE CAST(c AS DOUBLE) / (p.n + q.n - c) >= 0.8),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
grp AS (SELECT example_id, least(example_id, coalesce(min(b), example_id)) AS group_id
        FROM examples LEFT JOIN reach ON reach.a = example_id GROUP BY example_id)"""


@query("audit_near_overlap", f"WITH RECURSIVE {NEAR_CTE}\nSELECT example_id, group_id FROM grp")
def q_audit_near_overlap(spark, d):
    """Groups of near-copies: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return near.near_groups(tables.examples(spark, d).select("example_id", "text"))


@query("near_safe_split", f"""
WITH RECURSIVE {NEAR_CTE}
SELECT example_id, CASE WHEN {h32(42, 'group_id')} / 4294967296.0 < 0.8 THEN 'train'
                        WHEN {h32(42, 'group_id')} / 4294967296.0 < 0.9 THEN 'val' ELSE 'test' END AS split FROM grp""")
def q_near_safe_split(spark, d):
    """Whole groups of near-copies go to one split."""
    groups = near.near_groups(tables.examples(spark, d).select("example_id", "text"))
    return split.group_split(groups, group_col="group_id").select("example_id", "split")


@query("sample_n", f"""
WITH {EXAMPLES_CTE}
SELECT example_id FROM examples ORDER BY {smd5(42, 'example_id')}, example_id LIMIT 100""")
def q_sample_n(spark, d):
    return sample.sample_n(tables.examples(spark, d), 100).select("example_id")


@query("sample_n_large", f"""
WITH {EXAMPLES_CTE}
SELECT example_id FROM examples ORDER BY {smd5(42, 'example_id')}, example_id LIMIT 150""")
def q_sample_n_large(spark, d):
    # same contract through the boundary-bucket path used above the top-k limit
    return sample.sample_n(tables.examples(spark, d), 150, topk_max=0).select("example_id")


@query("pool_budget", f"""
WITH {EXAMPLES_CTE},
pri AS (SELECT example_id, domain FROM examples WHERE coalesce(domain IN ('de', 'es', 'fr'), false)),
rest AS (SELECT example_id, domain FROM examples WHERE NOT coalesce(domain IN ('de', 'es', 'fr'), false)),
quota AS (SELECT greatest(250 - count(*), 0) AS q FROM pri)
SELECT example_id, domain FROM pri
UNION ALL
SELECT example_id, domain FROM (
  SELECT example_id, domain, row_number() OVER (ORDER BY {smd5(42, 'example_id')}, example_id) AS rn FROM rest) r
WHERE rn <= (SELECT q FROM quota)""")
def q_pool_budget(spark, d):
    ex = tables.examples(spark, d).select("example_id", "domain")
    return sample.pool_budget(ex, 250, domains=["de", "es", "fr"])


@query("val_subset", f"""
WITH {SPLIT_CTE}
SELECT example_id FROM splits WHERE split = 'val'
ORDER BY {smd5(42, 'example_id')}, example_id LIMIT {VAL_SUBSET}""")
def q_val_subset(spark, d):
    """Validation subset of ``VAL_SUBSET`` rows, taken in seeded hash order."""
    v = split_examples(spark, d).filter(F.col("split") == "val")
    return sample.sample_n(v, VAL_SUBSET).select("example_id")


@query("story_sample", f"""
SELECT doc_id FROM documents
WHERE length({strip_sql('text')}) > 200 AND length({strip_sql('text')}) < 8000
ORDER BY {smd5(42, 'doc_id')}, doc_id LIMIT {STORY_TARGET}""")
def q_story_sample(spark, d):
    """Stories of 200 < length < 8000, seeded sample of ``STORY_TARGET``."""
    from ..operators import filters
    docs = filters.story_text(tables.read(spark, d, "documents").select("doc_id", "text"))
    return sample.sample_n(docs, STORY_TARGET, id_col="doc_id").select("doc_id")


@query("epoch_order", f"""
WITH {EXAMPLES_CTE}
SELECT example_id, md5('42:0:' || CAST(example_id AS VARCHAR)) AS order_key, {row_no_sql('example_id', '42:0')} AS row_no FROM examples""")
def q_epoch_order(spark, d):
    return sample.epoch_order(tables.examples(spark, d).select("example_id")).select("example_id", "order_key", "row_no")

