"""Packing by power-of-two decomposition.

Every document's token sequence is cut into pieces whose lengths are powers of
two (the binary digits of its length, largest first, after full sequences of
the maximum length).  A piece is a training sequence by itself: no sequence
crosses documents, and none is padded, because every length is a power of two.
Equal lengths go to one bucket, so that a batch has one shape.

The work is a map over the documents; no shuffle, and a row's pieces depend on
its text alone.

The product are the ids themselves, written by bucket; checksums are derived from it.

Defined results: null text is packed as the empty text (the end id alone);
repeated rows are packed each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ_LEN = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
CACHE_WORDS = 100_000
SLICE_BYTES = 2 << 20
#: Character classes of bytes: letter, digit, other, space, other white space; 9: not in the fast path.
LETTER, DIGIT, OTHER, SPACE, WHITE, REST = 0, 1, 2, 3, 4, 9


def _classes() -> np.ndarray:
    c = np.full(256, REST, np.uint8)
    for b in range(128):
        ch = chr(b)
        if ch.isalpha():
            c[b] = LETTER
        elif ch.isdigit():
            c[b] = DIGIT
        elif ch == " ":
            c[b] = SPACE
        elif ch in "\t\n\v\f\r":
            c[b] = WHITE
        elif not 0x1C <= b <= 0x1F and ch != "'":
            c[b] = OTHER
    c[0x80:0xC0] = LETTER   # second bytes, checked against their first byte
    c[0xC3] = LETTER        # U+00C0 to U+00FF: letters but for two signs
    return c


CLASS = _classes()


def cut_points(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of the texts that begin at ``begin`` in ``data`` (no empty texts),
    and which texts hold bytes that these rules do not cover.

    Rules of the public byte-level vocabulary: a run of letters, of digits or of other signs is
    a pre-token, with one space before it if there is one; of white space before a word the last
    character stands apart (a space joins the word).
    """
    c = CLASS[data]
    prev, nxt = np.roll(c, 1), np.roll(c, -1)
    pbyte = np.roll(data, 1)
    second = (data & 0xC0) == 0x80
    bad = (c == REST) | (second & (pbyte != 0xC3)) | ((pbyte == 0xC3) & ((data == 0x97) | (data == 0xB7) | ~second))
    first = np.zeros(len(data), bool)
    first[begin] = True
    last = np.roll(first, -1)
    last[-1] = True
    bad[begin] = (c[begin] == REST) | second[begin]
    white, before = c >= SPACE, prev >= SPACE
    start = np.where(white, ~before | ((nxt < SPACE) & ~last), (prev != c) & (prev != SPACE)) | first
    return np.flatnonzero(start), np.logical_or.reduceat(bad, begin)


class Encoder:
    """Token ids of many texts at a time; one per Python worker.

    The vocabulary merges inside a pre-token only, so a text's ids are those of its pre-tokens.
    Pre-tokens are cut by array rules, and each different one is merged once and kept in
    a bounded cache.  Texts with characters outside the rules, or with a special token's
    string, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        added = self.tok.get_added_tokens_decoder()
        ranks = {bytes(byte_of[ch] for ch in t): i for t, i in vocab.items() if i not in added}
        self.special = [t.content for t in added.values()]
        self.merge = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks,
                                       special_tokens={})._encode_single_piece
        self.cache: dict[bytes, list[int]] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cache, out = self.cache, []
        for w in words.to_pylist():
            ids = cache.get(w)
            if ids is None:
                ids = self.merge(w)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[w] = ids
            out.append(ids)
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), "<u4", int(size.sum()))
        return flat, size

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids per text, in order."""
        out: list[np.ndarray | None] = [None] * len(texts)
        raw, where = [], []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.empty(0, "<u4")
            elif any(s in t for s in self.special):
                out[i] = self.whole(t)
            else:
                raw.append(t.encode())
                where.append(i)
        if not raw:
            return out
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(b) for b in raw])
        begin = np.concatenate([[0], ends[:-1]])
        start, bad = cut_points(data, begin)
        offsets = np.append(start, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pc.dictionary_encode(words)
        flat, size = self._pieces(coded.dictionary)
        code = coded.indices.to_numpy()
        at = np.cumsum(size) - size
        n = size[code]
        stop = np.cumsum(n)
        ids = flat[np.repeat(at[code] - (stop - n), n) + np.arange(int(stop[-1]))]
        total = np.concatenate([[0], stop])
        lo = total[np.searchsorted(start, begin)]
        hi = np.append(lo[1:], total[-1])
        for k, i in enumerate(where):
            out[i] = self.whole(texts[i]) if bad[k] else ids[lo[k]:hi[k]]
        return out


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def piece_lengths(n: int, seq_len: int = SEQ_LEN) -> list[int]:
    """Full sequences first, then the binary digits of the rest, largest first."""
    out = [seq_len] * (n // seq_len)
    rest = n % seq_len
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, bucket, ids.

    ``sequence_id`` numbers the sequences (task and position in it); ``offset`` is 0, as a
    sequence holds one piece; ``bucket`` is the binary logarithm of the length.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    key_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            group = np.cumsum(sizes) // SLICE_BYTES
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if lo < hi:
                    texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                    yield pieces(batch.column(0).slice(lo, hi - lo), enc(texts), end)
        enc.cache.clear()   # the worker may go on with other work
        pa.default_memory_pool().release_unused()

    def pieces(keys: pa.Array, encoded: list[np.ndarray], end: np.ndarray) -> pa.RecordBatch:
        at, start, length, total = [], [], [], []
        for i, arr in enumerate(encoded):
            pos, n = 0, len(arr) + 1
            for size in piece_lengths(n, seq_len):
                at.append(i)
                start.append(pos)
                length.append(size)
                total.append(n)
                pos += size
        # pieces follow each other as the ids do, so all of them are one array cut at the pieces' ends
        flat = np.concatenate([x for arr in encoded for x in (arr, end)]).view("<i4")
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(at, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["key", "start", "length", "doc_tokens", "ids"])

    out = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(
        run, f"key {key_type}, start long, length long, doc_tokens long, ids array<int>")
    return out.select(F.col("key").alias(id_col), "start", "length", "doc_tokens",
                      F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                      F.log2("length").cast("int").alias("bucket"), "ids")


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in the ids' place."""
    return pieces.withColumn("ids_crc32", ids_crc32("ids")).drop("ids")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder per length bucket: a batch read from a folder has one shape."""
    pieces.write.partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
