"""Tokens: lengths, vocabulary, ids, masks.

Default tokenizer: white-space words, computed with built-in expressions.
Vocabulary: distributed word count (map-side partial aggregation, so very
frequent words cost one partial row per task), top-V by (count desc, token)
as a ``TakeOrderedAndProject``; ids 0 = padding, 1 = unknown, 2.. = vocabulary.

Encoding is a map: texts are split by Spark, and an Arrow iterator UDF looks up
the token arrays in the broadcast vocabulary (at most ``MAX_VOCAB`` rows), a
whole batch at a time.  Nothing is exploded, joined or shuffled.

``subword_lengths`` / ``subword_encode`` run a ``tokenizers`` tokenizer file
inside an Arrow iterator UDF (loaded once per task), for users who bring a
pretrained subword vocabulary; a batch's texts are encoded in slices of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ws_tokens

PAD_ID, UNK_ID, FIRST_ID = 0, 1, 2
MAX_VOCAB = 1_000_000  # largest vocabulary that is broadcast
MAX_LEN = 512  # fixed value: sequence cap of the encoder


def build_vocab(df: DataFrame, text: str = "text", size: int = 30000, lower: bool = False) -> DataFrame:
    """(token, id, n): the ``size`` most frequent tokens."""
    src = F.lower(F.col(text)) if lower else F.col(text)
    # explode the raw split and drop empty pieces after it (a codegen'd filter,
    # cheaper than filtering inside the array)
    counts = (df.select(F.explode(F.split(src, r"\s+")).alias("token")).filter(F.col("token") != "")
              .groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    # ``size`` rows at most: a bounded single-partition window
    w = Window.orderBy(F.desc("n"), F.asc("token"))
    return top.select("token", (F.row_number().over(w) + FIRST_ID - 1).cast("int").alias("id"), "n")


def encode(df: DataFrame, vocab: DataFrame, id_col: str = "example_id", text: str = "text",
           max_len: int | None = None, vocab_size: int = MAX_VOCAB, carry: list[str] | tuple = ()) -> DataFrame:
    """The ``tokens`` table: id, ``token_length`` (untruncated), ``input_ids`` and ``attention_mask``
    (whole sequences; the first ``max_len`` tokens if given), plus the ``carry`` columns of ``df``.

    A map over the rows: rows that share an id stay apart.  ``vocab`` must hold at most
    ``vocab_size`` rows, and ``vocab_size`` at most ``MAX_VOCAB``.
    """
    if vocab_size > MAX_VOCAB:
        raise ValueError(f"a vocabulary of over {MAX_VOCAB} tokens is not broadcast")
    rows = vocab.select("token", "id").limit(vocab_size + 1).collect()
    if len(rows) > vocab_size:
        raise ValueError(f"the vocabulary holds more than {vocab_size} tokens")
    shared = df.sparkSession.sparkContext.broadcast(([r["token"] for r in rows], [r["id"] for r in rows]))

    def lookup(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, numbers = shared.value
        known, ids = pa.array(tokens, pa.string()), pa.array(numbers, pa.int32())
        for arr in it:
            at = pc.index_in(arr.flatten().cast(pa.string()), value_set=known)
            found = pc.fill_null(ids.take(at), UNK_ID)
            ends = pc.cumulative_sum(pc.list_value_length(arr).cast(pa.int32()))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            yield pa.ListArray.from_arrays(offsets, found)

    carry = [c for c in carry if c not in (id_col, "token_length")]
    toks = df.select(id_col, *carry, ws_tokens(text).alias("_t"))
    seq = F.col("_t") if max_len is None else F.slice("_t", 1, max_len)
    ids = F.arrow_udf(lookup, "array<int>")(F.coalesce(seq, F.array().cast("array<string>")))
    out = toks.select(id_col, *carry, F.size("_t").cast("int").alias("token_length"), ids.alias("input_ids"))
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def token_length(text: str = "text") -> Column:
    return F.size(ws_tokens(text))


# --- subword tokenizers through Arrow batches -----------------------------------

#: Characters encoded at a time: the tokenizer's record of a token takes some hundred bytes.
SLICE_CHARS = 1 << 20


def _load(path: str):
    # Spark's tasks use the cores already; threads of a worker would only add memory
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer  # imported on the worker
    return Tokenizer.from_file(path)


def _encoded(tok, texts: pa.Array) -> Iterator[list]:
    """Encodings of the texts (null: empty) in order, of some ``SLICE_CHARS`` characters or one text at a time."""
    group = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_CHARS
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for lo, hi in zip(bounds, bounds[1:]):
        if lo < hi:
            yield tok.encode_batch([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])


def subword_lengths(col: Column, tokenizer_path: str) -> Column:
    """Untruncated token count with a ``tokenizers`` JSON file, in Arrow batches, some ``SLICE_CHARS`` at a time."""
    def lengths(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _load(tokenizer_path)
        for texts in it:
            yield pa.array([len(e) for enc in _encoded(tok, texts) for e in enc], pa.int32())
    return F.arrow_udf(lengths, "int")(col)


def subword_encode(col: Column, tokenizer_path: str, max_len: int | None = None) -> Column:
    """``struct<token_length, input_ids, attention_mask>`` of whole texts, or cut at ``max_len`` if given."""
    schema = T.StructType([T.StructField("token_length", T.IntegerType()),
                           T.StructField("input_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("attention_mask", T.ArrayType(T.IntegerType()))])

    def encoded(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _load(tokenizer_path)
        for texts in it:
            for enc in _encoded(tok, texts):
                yield pa.StructArray.from_arrays(
                    [pa.array([len(e) for e in enc], pa.int32()), pa.array([e.ids[:max_len] for e in enc], pa.list_(pa.int32())),
                     pa.array([e.attention_mask[:max_len] for e in enc], pa.list_(pa.int32()))],
                    names=["token_length", "input_ids", "attention_mask"])
    return F.arrow_udf(encoded, schema)(col)
