"""Byte-level BPE: backtracking against the library and against merging by rank, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from textprov.llm import bytepair

from .conftest import ODD

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    ranks = bytepair.read_ranks(public_tokenizers.path(request.param))
    return (bytepair.coder(public_tokenizers.path(request.param), public_tokenizers.PATTERN),
            tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks)


def strings(ranks, seed, n):
    rnd, tokens = random.Random(seed), sorted(ranks)
    wide = [(32, 126), (0xA0, 0x24F), (0x4E00, 0x4F00), (0x1F600, 0x1F640), (9, 13), (0x2028, 0x2029), (0x300, 0x36F)]
    for i in range(n):
        kind = i % 4
        if kind == 0:
            yield "".join(rnd.choice("abcdeilnorst ") for _ in range(rnd.randint(0, 50)))
        elif kind == 1:
            yield "".join(chr(rnd.randint(*rnd.choice(wide))) for _ in range(rnd.randint(0, 30)))
        elif kind == 2:
            yield b"".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 9))).decode("utf-8", "replace")
        else:
            yield "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 70)))


def test_equals_the_library_and_decodes(both):
    own, library, ranks = both
    for s in strings(ranks, 3, 4000):
        ids = own.encode(s)
        assert ids == library.encode_ordinary(s), repr(s)
        assert own.decode(ids) == s.encode()


def test_backtracking_equals_merging_by_rank(both):
    own, _, ranks = both
    for s in strings(ranks, 4, 1200):
        if s:
            assert own.backtrack(s.encode()) == [ranks[p] for p in bytepair.merge_by_rank(s.encode(), ranks)], repr(s)


def test_every_token_and_long_pieces(both):
    own, library, ranks = both
    assert all(own.backtrack(b) == [r] for b, r in ranks.items())
    for s in ("a" * 100_000, "abcde" * 20_000, "é" * 30_000, " " * 50_000 + "x"):
        assert own.encode(s) == library.encode_ordinary(s)


def test_very_long_text_piece_by_piece(both, monkeypatch):
    own, library, _ = both
    monkeypatch.setattr(bytepair, "LONG_CHARS", 1000)
    text = "Words and numbers 123 in a long text, it's all here.\n" * 4000
    assert own.encode_array(text).tolist() == library.encode_ordinary(text)


def test_memo_is_bounded_and_right():
    memo = bytepair.Memo(lambda k: k * 2, 10)
    assert [memo[i % 37] for i in range(500)] == [i % 37 * 2 for i in range(500)]
    assert len(memo) <= 10 and len(memo.former) <= 10


def test_unreachable_tokens_and_pieces():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 260}
    own = bytepair.BytePair(ranks, r"\S+|\s+")
    library = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    for _ in range(3000):
        s = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12)))
        assert own.encode(s) == library.encode_ordinary(s), s


def expected(rows, library):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def job(df):
    path = public_tokenizers.path(bytepair.RANK_FILE)
    coded = bytepair.encode(df, path, public_tokenizers.PATTERN)
    return sorted(map(tuple, bytepair.digests(bytepair.decode(coded, path, public_tokenizers.PATTERN)).collect()), key=str)


def test_job_equals_the_library(spark):
    ranks = bytepair.read_ranks(public_tokenizers.path(bytepair.RANK_FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert job(df) == expected([(r.doc_id, r.text) for r in df.collect()], library)


def test_null_empty_long_repeated_and_clashing(spark, docs):
    ranks = bytepair.read_ranks(public_tokenizers.path(bytepair.RANK_FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*ODD, (9, "long text " * 300_000, "en", "a"), (10, "<|endoftext|> is ordinary", "en", "a")]
    df = docs(rows).select("*", *[F.lit("x").alias(c) for c in ("key", "ids", "bytes", "body")])
    assert job(df) == expected([(r[0], r[1]) for r in rows], library)
    assert job(docs(rows).limit(0)) == []
