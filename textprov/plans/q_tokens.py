"""Queries: vocabulary, encoding, padding, batch counts, overlap audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..operators import audit, batches, tokens
from .catalog import EXAMPLES_CTE, SPLIT_CTE, batch_sql, query, ws_tokens_sql

VOCAB_SIZE = 1000

VOCAB_CTE = f"""vcount AS (SELECT token, count(*) AS n
  FROM (SELECT unnest({ws_tokens_sql('text')}) AS token FROM documents) t GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id, n
  FROM vcount ORDER BY n DESC, token LIMIT {VOCAB_SIZE})"""

ENCODE_CTE = f"""{EXAMPLES_CTE}, {VOCAB_CTE},
tok AS (SELECT example_id, label, {ws_tokens_sql('text')} AS toks FROM examples),
pos AS (SELECT example_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS p FROM tok),
ids AS (SELECT pos.example_id, list(coalesce(vocab.id, 1) ORDER BY pos.p) AS input_ids
        FROM pos LEFT JOIN vocab ON pos.token = vocab.token GROUP BY pos.example_id),
enc AS (SELECT tok.example_id, tok.label, CAST(len(tok.toks) AS INTEGER) AS token_length,
               coalesce(ids.input_ids, []) AS input_ids,
               list_transform(coalesce(ids.input_ids, []), lambda x: 1) AS attention_mask
        FROM tok LEFT JOIN ids ON tok.example_id = ids.example_id)"""


def vocab(spark, d):
    return tokens.build_vocab(tables.read(spark, d, "documents"), size=VOCAB_SIZE)


def encoded(spark, d, carry=()):
    ex = tables.examples(spark, d)
    return tokens.encode(ex, vocab(spark, d), vocab_size=VOCAB_SIZE, carry=carry)


@query("build_vocab", f"WITH {VOCAB_CTE}\nSELECT token, id, n FROM vocab")
def q_build_vocab(spark, d):
    return vocab(spark, d)


@query("encode_tokens", f"WITH {ENCODE_CTE}\nSELECT example_id, token_length, input_ids, attention_mask FROM enc")
def q_encode_tokens(spark, d):
    return encoded(spark, d)


@query("subword_lengths")
def q_subword_lengths(spark, d, tokenizer="byte_bpe_50k.json"):
    """Subword token counts of whole texts by a public tokenizer's file."""
    import public_tokenizers
    docs = tables.read(spark, d, "documents")
    return docs.select("doc_id", tokens.subword_lengths(F.col("text"), public_tokenizers.path(tokenizer)).alias("n_tokens"))


@query("join_tokens", f"WITH {ENCODE_CTE}\nSELECT example_id, label, token_length FROM enc")
def q_join_tokens(spark, d):
    """Examples with their token columns: the label rides along the encoding shuffle."""
    return encoded(spark, d, carry=["label"]).select("example_id", "label", "token_length")


@query("pad_batches", f"""
WITH {ENCODE_CTE},
b AS (SELECT *, {batch_sql(8)} FROM enc),
b3 AS (SELECT *, CAST(max(len(input_ids)) OVER (PARTITION BY batch_id) AS INTEGER) AS seq_len FROM b)
SELECT example_id, batch_id, seq_len,
       list_resize(input_ids[1:seq_len], seq_len, 0) AS padded_ids,
       list_resize(list_transform(input_ids[1:seq_len], lambda x: 1), seq_len, 0) AS padded_mask
FROM b3""")
def q_pad_batches(spark, d):
    """Batches of 8 over the whole table in shuffled order, padded; the id arrays are shuffled once."""
    p = batches.padded_batches(encoded(spark, d), 8)
    return p.select("example_id", "batch_id", "seq_len", "padded_ids", "padded_mask")


@query("batch_counts", f"""
WITH {SPLIT_CTE}
SELECT split, count(*) AS n, CAST(ceil(count(*) / 16.0) AS BIGINT) AS n_batches FROM splits GROUP BY split""")
def q_batch_counts(spark, d):
    from .q_split import split_examples
    return batches.batch_counts(split_examples(spark, d), 16)


@query("request_batches", f"""
WITH {EXAMPLES_CTE}
SELECT example_id, {batch_sql(10)} FROM examples""")
def q_request_batches(spark, d):
    ex = tables.examples(spark, d).select("example_id")
    return batches.assign_batches(ex, 10).select("example_id", "batch_id", "ordinal")


# --- overlap audits ------------------------------------------------------------------

_NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query("audit_bench_exact", f"""
SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b
  ON md5(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g'))) = md5(trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))""")
def q_audit_bench_exact(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", "text")
    bench = tables.read(spark, d, "benchmark").select("item_id", "text")
    return audit.exact_matches(docs, bench)


def _shingles_sql(tbl, idc):
    return f"""(SELECT DISTINCT {idc}, array_to_string(t[i:i + 7], ' ') AS sh
   FROM (SELECT {idc}, {ws_tokens_sql('lower(text)')} AS t FROM {tbl}) x,
        LATERAL (SELECT unnest(range(1, len(x.t) - 6)) AS i) r)"""


@query("audit_bench_shingle", f"""
WITH bs AS {_shingles_sql('benchmark', 'item_id')},
ds AS {_shingles_sql('documents', 'doc_id')},
sizes AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
hits AS (SELECT bs.item_id, ds.doc_id, count(*) AS n_shared FROM ds JOIN bs ON ds.sh = bs.sh GROUP BY bs.item_id, ds.doc_id)
SELECT hits.item_id, doc_id, n_shared, n_item, round(CAST(n_shared AS DOUBLE) / n_item, 6) AS containment
FROM hits JOIN sizes ON hits.item_id = sizes.item_id
WHERE round(CAST(n_shared AS DOUBLE) / n_item, 6) >= 0.5""")
def q_audit_bench_shingle(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", "text")
    bench = tables.read(spark, d, "benchmark").select("item_id", "text")
    return audit.shingle_overlap(docs, bench)


@query("audit_bench_docs", f"""
WITH bs AS {_shingles_sql('benchmark', 'item_id')},
ds AS {_shingles_sql('documents', 'doc_id')},
sizes AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
hits AS (SELECT bs.item_id, ds.doc_id, count(*) AS n_shared FROM ds JOIN bs ON ds.sh = bs.sh GROUP BY bs.item_id, ds.doc_id)
SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_pairs
FROM hits JOIN sizes ON hits.item_id = sizes.item_id WHERE n_shared = n_item""")
def q_audit_bench_docs(spark, d):
    """Documents holding a whole benchmark passage (all its shingles)."""
    docs = tables.read(spark, d, "documents").select("doc_id", "text")
    bench = tables.read(spark, d, "benchmark").select("item_id", "text")
    o = audit.shingle_overlap(docs, bench, min_containment=1.0)
    return o.agg(F.count_distinct("doc_id").cast("bigint").alias("n_docs"),
                 F.count(F.lit(1)).cast("bigint").alias("n_pairs"))


@query("batch_score")
def q_batch_score(spark, d):
    """Encoded examples scored by a Python model in Arrow batches of 64 windows, over whole texts (model forward)."""
    from ..operators import score
    enc = encoded(spark, d, carry=["label"])
    return score.batch_model_scores(enc, score.hashed_bag_model(), whole=True).select(
        "example_id", "label", "score", "pred")
