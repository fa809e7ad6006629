"""Byte-level BPE by longest matches and backtracking.

A pre-token's bytes are read as Latin-1, so that one character is one byte, and an
Aho-Corasick automaton of the whole vocabulary gives the longest token at every
position in one pass.  The encoder takes the longest token, asks whether merging
could have left it beside the token before it, and else tries the next shorter
token at the same place; where none fits, the token before it is taken back and
the position is marked dead.  A position dies once at most, so the work is linear
in the piece.  Whether two tokens can stand side by side depends on the pair alone
and is memoised.  The result equals the merges in order of rank.

Both directions are maps over the documents: no shuffle, a row's ids depend on its
text alone, and texts go through in slices of bounded size.

Defined results: a null text is encoded as the empty text (no ids, no bytes); texts of
any length are encoded whole; repeated rows count each by itself; other columns may
have any name and are not read; an empty table gives an empty result; bytes of a
string column that are no UTF-8 are replaced, as the library does with such strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Bounds of what a worker remembers: pre-tokens of at most PIECE_BYTES, and token pairs.
MEMO_PIECES, PIECE_BYTES, MEMO_PAIRS = 200_000, 64, 500_000
#: Texts are encoded in slices of about so many characters and ids are returned so many at a time.
SLICE_CHARS = 1 << 20
#: Longer texts are cut into pre-tokens one by one instead of all at once.
LONG_CHARS = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(r) for a, r in map(bytes.split, f) if a}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain merging in order of rank, only with ranks under ``below``: for single tokens."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Memo(dict):
    """A dictionary that fills itself by ``find``, in two generations: at ``most`` entries the present one
    becomes the former, and what is asked for again comes over from there."""

    def __init__(self, find, most: int, keeps=None):
        super().__init__()
        self.find, self.most, self.keeps, self.former = find, most, keeps, {}

    def __missing__(self, key):
        value = self.former.get(key)
        if value is None:
            value = self.find(key)
            if self.keeps is not None and not self.keeps(key):
                return value
        if len(self) >= self.most:
            self.former = dict(self)
            super().clear()
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.former = {}


class BytePair:
    """Encoder and decoder of one rank file and split pattern; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.split = regex.compile(pattern)
        self.rank_of = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.length = [len(b) for b in self.bytes_of]
        # The last merge of each token; a token that merging its own bytes never makes is no part of any
        # encoding, but a piece that equals it has its id.
        self.halves: list[tuple[int, int] | None] = [None] * size
        made = [False] * size
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                made[r] = True
                continue
            parts = merge_by_rank(b, ranks, below=r)
            if len(parts) == 2 and made[ranks[parts[0]]] and made[ranks[parts[1]]]:
                self.halves[r] = (ranks[parts[0]], ranks[parts[1]])
                made[r] = True
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * size          # the longest token that is a proper prefix
        for b, r in ranks.items():
            if made[r]:
                self.automaton.add_word(b.decode("latin-1"), r)
                for n in range(len(b) - 1, 0, -1):
                    p = ranks.get(b[:n], -1)
                    if p >= 0 and made[p]:
                        self.shorter[r] = p
                        break
        self.automaton.make_automaton()
        self.beside = Memo(self._beside, MEMO_PAIRS)
        self.pieces = Memo(self._piece, MEMO_PIECES, lambda w: len(w) <= PIECE_BYTES)

    def _beside(self, pair: tuple[int, int]) -> bool:
        """Do merges in order of rank leave these two tokens side by side?

        The merges of both are undone from the border outwards, the later one first.  If at any
        time the two pieces at the border make a token of lower rank than the merge that was just
        undone on either side, merging would have joined them across the border.
        """
        left, right = pair
        limit = len(self.bytes_of)
        while True:
            joined = self.rank_of.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < limit:
                return False
            cut_left, cut_right = self.halves[left], self.halves[right]
            if cut_left is None and cut_right is None:
                return True
            # Of equal ranks the left one was merged first, so the right one is undone first.
            if cut_right is None or (cut_left is not None and left > right):
                limit, left = left, cut_left[1]
            else:
                limit, right = right + 1, cut_right[0]

    def _piece(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        whole = self.rank_of.get(raw)
        return (whole,) if whole is not None else tuple(self.backtrack(raw))

    def backtrack(self, raw: bytes) -> list[int]:
        n = len(raw)
        longest = [-1] * (n + 1) if n < 4096 else np.full(n + 1, -1, np.int32)
        length, shorter, beside = self.length, self.shorter, self.beside
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end - length[token]] = token     # by start less one; ends ascend, so the longest is written last
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, last, token = 0, -1, int(longest[-1])
        while at < n:
            while token >= 0:
                end = at + length[token]
                if alive[end] and (last < 0 or beside[last, token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = end, token, int(longest[end - 1])
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def words(self, text: str) -> Iterable[str]:
        return self.split.findall(text) if len(text) <= LONG_CHARS else (m.group() for m in self.split.finditer(text))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.words(text))))

    def encode_array(self, text: str) -> np.ndarray:
        """Ids as int32, without a list of all of them for a very long text."""
        if len(text) <= LONG_CHARS:
            return np.fromiter(self.encode(text), np.int32)
        parts, words = [], iter(self.words(text))
        while some := list(islice(words, 1 << 16)):
            parts.append(np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, some)), np.int32))
        return np.concatenate(parts)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


CODERS: dict[tuple[str, str], BytePair] = {}


def coder(path: str, pattern: str) -> BytePair:
    """One per worker process, file and pattern."""
    if (path, pattern) not in CODERS:
        CODERS[path, pattern] = BytePair(read_ranks(path), pattern)
    return CODERS[path, pattern]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows of about ``most`` together; a larger row is a run by itself or ends one."""
    if len(sizes):
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        bounds = [0, *cut.tolist(), len(sizes)]
        yield from zip(bounds[:-1], bounds[1:])


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(rank_path, pattern)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            for lo, hi in _slices(sizes, SLICE_CHARS):
                found = [bpe.encode_array(t) if t else np.empty(0, np.int32) for t in texts.slice(lo, hi - lo).to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], names=["key", "ids"])
        bpe.pieces.clear()  # the worker may go on with other work
        bpe.beside.clear()

    key_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("body"))
    return rows.mapInArrow(run, f"key {key_type}, ids array<int>").withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, bytes binary) of every row's ids; null ids count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(rank_path, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            for lo, hi in _slices(sizes, SLICE_CHARS // 2):
                part = batch.slice(lo, hi - lo)
                ids = part.column(1)
                flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                text = pa.array([bpe.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, text], names=["key", "ids", "bytes"])

    key_type = dict(encoded.dtypes)[id_col]
    rows = encoded.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{ids_col}`").alias("ids"))
    return rows.mapInArrow(run, f"key {key_type}, ids array<int>, bytes binary").withColumnRenamed("key", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                          F.sha2("bytes", 256).alias("decoded_sha256"))
