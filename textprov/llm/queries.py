"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (brown, bytepair, crosspolytope, dialogue, feistel, linespread, phrases, pow2pack, ppm, simtrie,
               textratio, urlbloom, windows)
from .common import fold, ready, table

#: Host labels whose pages make the list of listed URLs (the tables hold no list of their own).
LISTED_LABELS = r"(^|\.)(spam-farm|ads-track)\."

#: Key of the registered query, whose tables are invented; a site passes its own.
QUERY_KEY = "key of the registered query"


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_held_out(table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return crosspolytope.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predict = ppm.predictor(spark, ppm.fit(spark, ppm.training_rows(docs)))
    return (ppm.identify(docs.select("doc_id", "text"), predict)
            .select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"))


def op4_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlbloom.judge(pages, pages.where(urlbloom.host_of("url").rlike(LISTED_LABELS)))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return (linespread.dedup_lines(docs)
            .select("doc_id", "text", F.col("_lines_removed").cast("long").alias("lines_removed")))


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simtrie.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "hamming", "similarity")


def op8_pow2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pow2pack.digests(pow2pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(pow2pack.TOKENIZER)))


def op9_text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textratio.extract(table(spark, sf_dir, "pages"))


def op10_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (feistel.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=QUERY_KEY)
            .select("doc_id", "text", F.col("_pii_values").cast("long").alias("pii_values"), F.col("_pii_kinds").alias("pii_kinds")))


def op11_misra_gries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_coalescence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.summaries(dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations"))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks, pattern = public_tokenizers.path(bytepair.RANK_FILE), public_tokenizers.PATTERN
    coded = bytepair.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return bytepair.digests(bytepair.decode(coded, ranks, pattern))


OPERATORS = (op1_brown, op2_cross_polytope, op3_ppm, op4_url_bloom, op5_line_spread, op6_simhash_trie,
             op7_simhash_windows, op8_pow2_pack, op9_text_ratio, op10_feistel, op11_misra_gries,
             op12_coalescence, op13_byte_bpe)

ORACLE = {
    "op4_url_bloom": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '')
                 || regexp_replace(path, '/+$', '') END AS canonical FROM h),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)(spam-farm|ads-track)\.')),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT c.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM c JOIN r ON (c.host = r.rhost OR ends_with(c.host, '.' || r.rhost)) AND starts_with(c.path, r.rpath) GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN m ON c.page_id = m.page_id LEFT JOIN l ON c.canonical = l.canonical""",
    "op5_line_spread": r"""
WITH x AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM x),
b AS (SELECT k, min((doc_id, pos)) AS first FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('s' || source, '-')) >= 5),
c AS (SELECT k.*, (b.k IS NOT NULL AND (k.doc_id, k.pos) <> b.first) AS cut FROM k LEFT JOIN b ON k.k = b.k),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '') AS text, count(*) FILTER (WHERE cut) AS n
      FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text, coalesce(g.n, 0) AS lines_removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op11_misra_gries": r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j.j, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN (VALUES (1), (2)) AS j(j) ON j.j < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j.j], ' ') AND l.k = j.j
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j.j + 1:], ' ') AND r.k = c.k - j.j),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT x.* FROM least x LEFT JOIN longer o ON o.lang = x.lang AND o.part = x.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}


def queries() -> dict:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        return run
    return {fn.__name__: wrap(fn) for fn in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {k: v.strip() for k, v in ORACLE.items()}
