"""Collocations: summaries against exact counts, the job against plain Python."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprov.llm import phrases
from textprov.llm.phrases import Summary

from .conftest import ODD


def grams(rows):
    """Counter of (lang, words) over plain Python."""
    found = Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    found[lang or "und", tuple(w[i:i + k])] += 1
    return found


def by_hand(rows, threshold, top):
    f = grams(rows)
    n = Counter()
    for (lang, w), c in f.items():
        n[lang] += c if len(w) == 1 else 0
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= threshold}
    out = {}
    for (lang, w), a in cand.items():
        if len(w) == 2 and any(len(x) == 3 and lg == lang and w in (x[:2], x[1:]) and 100 * b >= 50 * a for (lg, x), b in cand.items()):
            continue
        cuts = [(Fraction(10**6 * a * a, f[lang, w[:k]] * f[lang, w[k:]]).__floor__(), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), a, left, right, n[lang], -s)
                  for lang, x in out.items() for i, (s, _, p, a, left, right) in enumerate(sorted(x)[:top]))


def job(df, **more):
    return sorted(map(tuple, phrases.collocations(df, **more).collect()))


def texts(seed, n=150):
    rnd = random.Random(seed)
    words = ["a", "B", "cc", "Dd", "é", "ça", "x\x1cy", "zz", "'s", "w v"]
    return [("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!"]) for _ in range(rnd.randint(0, 60))),
             rnd.choice(["en", "fr", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("threshold,top,slack", [(2, 40, 1), (5, 1000, 2), (10, 7, 1)])
def test_job_equals_plain_python(spark, threshold, top, slack):
    rows = texts(threshold)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert job(df, threshold=threshold, top=top, slack=slack, part_bytes=500) == by_hand(rows, threshold, top)


def test_summaries_keep_every_frequent_key():
    rnd = np.random.default_rng(1)
    for round_no in range(30):
        keys = rnd.zipf(1.3, 20_000).astype(np.uint64) % np.uint64(5000)
        mass, threshold = len(keys), 10
        parts = []
        for chunk in np.array_split(keys, 7):               # bounded summaries of their own, merged afterwards
            s = Summary(mass // threshold + 1)
            for some in np.array_split(chunk, 5):
                s.add(some)
                s.settle()
            parts.append(s)
        merged = Summary(mass // threshold + 1)
        for s in parts:
            merged.add(s.keys, s.counts)
            merged.settle()
        merged.lost += sum(s.lost for s in parts)
        real = Counter(keys.tolist())
        assert merged.lost < threshold and len(merged.keys) <= merged.capacity
        assert {k for k, c in real.items() if c >= threshold} <= set(merged.reaching(threshold).tolist())
        for k, c in zip(merged.keys.tolist(), merged.counts.tolist()):
            assert c <= real[k] <= c + merged.lost


def test_tight_capacity_still_gives_all(spark):
    """Many rare n-grams: the summaries overflow, nothing frequent is lost."""
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choice([f"rare{rnd.randint(0, 10**6)}", "hot", "cold"]) for _ in range(400)), "en") for _ in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    _, _, stats = phrases.survivors(phrases.rows_of(df), threshold=20, slack=1, part_bytes=60_000)
    assert any(lost > 0 for _, _, lost in stats)
    assert job(df, threshold=20, slack=1, part_bytes=60_000) == by_hand(rows, 20, 2000)


def test_partitions_of_the_hash_range():
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64 - 1, 10_000, dtype=np.uint64))
    for parts in (1, 2, 3, 7, 26, 1000):
        p = phrases.part_of(keys, parts)
        top = (keys >> np.uint64(64 - phrases.PART_BITS)).astype(np.int64)
        starts = [phrases.part_start(i, parts) for i in range(parts + 1)]
        assert starts[0] == 0 and starts[-1] == 1 << phrases.PART_BITS
        assert (np.searchsorted(starts, top, side="right") - 1 == p).all()


def test_score_is_exact(spark):
    rows = [(10**9 + 7, 10**9 + 9, 10**12 + 39), (99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999), (10, 10, 10), (3, 7, 11)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("*", phrases.score("a", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [10**6 * a * a // (left * right) for a, left, right in rows]


def test_long_texts_are_cut_at_piece_borders_only(spark, monkeypatch):
    rows = [("one two three, four five " * 40, "en"), ("no border " * 300, "en"), (None, None), ("", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 256)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"body": [t or "" for t, _ in rows], "lang": [g or "und" for _, g in rows]})
    got = Counter()
    for part, langs in phrases.slices(iter([batch])):
        got += grams([(t.decode(), g) for t, g in zip(part.to_pylist(), langs.to_pylist())])
    assert got == grams(rows)
    assert job(df, threshold=3) == by_hand(rows, 3, 2000)


def test_null_empty_repeated_clashing(spark, docs):
    rows = [*ODD, *[(20, "the same phrase here", "en", "a")] * 12, (21, "long words " * 200_000, None, "a")]
    df = docs(rows).select("*", *[F.lit("x").alias(c) for c in ("body", "phrase", "words", "n")])
    assert job(df) == by_hand([(r[1], r[2]) for r in rows], 10, 2000)
    assert job(docs(rows).limit(0)) == []


def test_summaries_are_merged_by_stretches(monkeypatch):
    """Sums of sorted counters are right however short the stretches, and few counters are sorted at a time."""
    rng = np.random.default_rng(5)
    parts = []
    for n in (5000, 1, 0, 700, 4000):
        keys = np.unique(rng.integers(0, 6000, n).astype(np.uint64) << np.uint64(50))
        parts.append((keys, rng.integers(1, 9, len(keys))))
    want = {}
    for keys, counts in parts:
        for k, c in zip(keys.tolist(), counts.tolist()):
            want[k] = want.get(k, 0) + c
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kw: sizes.append(len(a)) or sort(a, *args, **kw))
    for stretch in (1, 37, 1 << 17):
        monkeypatch.setattr(phrases, "STRETCH", stretch)
        sizes.clear()
        keys, counts = phrases.merged(parts)
        assert keys.tolist() == sorted(want) and dict(zip(keys.tolist(), counts.tolist())) == want
        assert stretch > 37 or max(sizes) < len(want) / 10
    summary = phrases.Summary()
    summary.add(parts[0][0])
    summary.settle()
    sizes.clear()
    monkeypatch.setattr(phrases, "STRETCH", 37)
    summary.add(parts[4][0])
    summary.settle()
    assert max(sizes) < len(want) / 10 and set(summary.keys.tolist()) == set(parts[0][0].tolist()) | set(parts[4][0].tolist())
