"""The operators on Spark against brute force, with nulls, empties, repeats, empty tables and clashing names."""
import collections
import dataclasses
import datetime
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textprov.llm import (brown, crosspolytope, feistel, linespread, pow2pack, ppm, queries, simtrie, textratio, urlbloom,
                          windows)

from .conftest import ODD

SF = "/root/testdata/sf0.001"
KEY = "a test key"


def words(t):
    return (t or "").encode().lower().split()


def test_brown_base_and_counts(spark, docs):
    rows = ODD + [(10 + i, f"the cat w{i % 4} sat", "en", "a") for i in range(20)]
    got = brown.score_held_out(docs(rows), head=10, classes=3).collect()
    assert len(got) == len(rows)
    c = collections.Counter()
    for i, t, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), b" "])
    n, v = sum(c.values()), len(c)
    by_id = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        r, toks = by_id[i], [*words(t), b" "]
        assert r["n_tokens"] == len(toks) and r["n_known"] == sum(c[w] > 0 for w in toks) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks))
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["score"] < 0


def test_brown_beats_the_base_on_held_out_text(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = brown.score_held_out(d).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def by_hand(model, rare, text):
    """Score of a text from the model's parts, word by word."""
    head = {w: i for i, w in enumerate(model.vocab.head.to_pylist())}
    far = {r["word"]: (r["n"], r["cls"]) for r in rare}
    k, total = len(model.size) - 1, 0.0
    h = k
    for w in [x.decode() for x in words(text)] + [None]:
        if w is None:
            return total + model.move[h, k]
        n, c = (int(model.vocab.count[head[w]]), int(model.cls[head[w]])) if w in head else far.get(w, (0, None))
        if n:
            total += model.move[h, c] + math.log10(n / model.size[c])
        else:
            ends = w.encode()[-2:]
            total += model.new[int.from_bytes(ends, "big") % brown.SPELLINGS]
        h = c if w in head else k + 1


@pytest.mark.parametrize("head", [5, 1000])
def test_brown_against_brute_force(spark, docs, head):
    """Counts, class table, transitions and scores, with words in the head, outside it and new ones."""
    lines = [f"the {a} {b} on the {c} x{i}" for i, (a, b, c) in enumerate(
        (a, b, c) for a in ("cat", "dog") for b in ("sat", "lay", "stood") for c in ("mat", "rug", "bed", "cat"))]
    train = docs([(i, t, "en", "a") for i, t in enumerate(lines + lines[:5])] + ODD)
    model, rare = brown.fit(train, head=head, classes=4)
    far = rare.collect()
    texts = lines + lines[:5] + [r[1] for r in ODD]
    c = collections.Counter(w.decode() for t in texts for w in words(t))
    names = model.vocab.head.to_pylist()
    assert dict(zip(names, model.vocab.count.tolist())) | {r["word"]: r["n"] for r in far} == c and len(names) == min(head, len(c))
    # transitions: classes as context for the head, one class for the rest
    cls = {w: int(model.cls[i]) for i, w in enumerate(names)}
    pred = cls | {r["word"]: r["cls"] for r in far}
    k, table = 4, np.zeros((6, 5))
    for t in texts:
        h = k
        for w in [x.decode() for x in words(t)]:
            table[h, pred[w]] += 1
            h = cls.get(w, k + 1)
        table[h, k] += 1
    assert np.array_equal(table.sum(axis=0), model.size)
    n = table.sum()
    new = (sum(v == 1 for v in c.values()) + 0.5) / (n + 1)
    share = table.sum(axis=0) / n
    want = (1 - new) * (table + brown.PRIOR * share) / (table.sum(axis=1, keepdims=True) + brown.PRIOR)
    assert np.allclose(10 ** model.move, want)
    # all next words together have probability 1, whatever stands before
    known = sum(10 ** model.move[:, pred[w]] * c[w] / model.size[pred[w]] for w in c)
    assert np.allclose(known + 10 ** model.move[:, k] + (10 ** model.new).sum(), 1)
    asked = ODD + [(i, f"{t} unseen é the x3 x4 zz the", "en", "a") for i, t in enumerate(lines)]
    got = sorted(r["score"] for r in brown.score(docs(asked), model, rare).collect())
    assert got == pytest.approx(sorted(by_hand(model, far, r[1]) for r in asked))


def test_brown_exchange_finds_the_classes_of_a_made_up_language(spark, docs):
    """Words of four kinds follow each other in a cycle; rare words of the same kinds join them."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"{'abcd'[j % 4]}{int(rng.zipf(1.3)) % 40}" for j in range(40))
    model, rare = brown.fit(docs([(i, text(), "en", "a") for i in range(300)]), head=60, classes=4, rounds=30)
    kinds = collections.defaultdict(collections.Counter)
    for w, c in zip(model.vocab.head.to_pylist(), model.cls):
        kinds[int(c)][w[0]] += 1
    for r in rare.collect():
        kinds[r["cls"]][r["word"][0]] += 1
    assert sum(max(k.values()) for k in kinds.values()) >= 0.9 * sum(sum(k.values()) for k in kinds.values())


def test_brown_classes_follow_the_vocabulary(spark, docs):
    assert [brown.class_count(n) for n in (0, 1000, 10 ** 6, 10 ** 9)] == [2, 20, 200, 2000]
    model, _ = brown.fit(docs([(i, f"w{i} v{i % 50} u", "en", "a") for i in range(500)]), rounds=2)
    assert len(model.size) - 1 == brown.class_count(551)


def test_brown_neighbours_lie_in_small_partitions(spark):
    """A task holds the neighbour sums of a small share of the head's words (here under some 60 MB with their copies)."""
    words, classes = 1 << 15, 270
    pairs = spark.createDataFrame([(1, 2, 3), (2, 1, 1), (words, 1, 2)], "before int, after int, n long")
    near = brown.neighbours(pairs, words, classes)
    parts = near.rdd.getNumPartitions()
    assert (words + 2) * 2 * (classes + 2) / parts <= 1.1e6
    assert sorted((r.unit, r.next, r.other, r.n) for r in near.collect()) == sorted(
        [(1, True, [2], [3]), (2, False, [1], [3]), (2, True, [1], [1]), (1, False, [2], [1]),
         (1, False, [words], [2])])


def test_brown_pairs_and_rare_words_travel_in_buckets(spark, docs):
    """One row for each bucket instead of one for each pair or word; the sums are those of all texts."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 300) % 900) for _ in range(40)] + ["", None]
    d = docs([(i, t, "en", "a") for i, t in enumerate(texts)]).coalesce(2).select("text")
    counts = collections.Counter(w for t in texts for w in words(t))
    head = sorted(counts, key=lambda w: (-counts[w], w))[:40]
    vocab = brown.Vocabulary(pa.array([w.decode() for w in head], pa.large_string()), np.array([counts[w] for w in head]))
    pairs, far = collections.Counter(), collections.Counter()
    for t in texts:
        units = [head.index(w) if w in head else 40 for w in words(t)]
        pairs.update(zip([41, *units], [*units, 41]))
        far.update((w.decode(), 3 if b == 41 else 4 if b == 40 else b % 3)
                   for w, u, b in zip(words(t), units, [41, *units]) if u == 40)
    sent = brown.unit_pairs(d, vocab)
    assert sent.count() <= 2 * 42 < len(pairs)
    got = collections.Counter()
    for r in brown.neighbours(sent, 40, 3).collect():
        for o, n in zip(r.other, r.n):
            got[(r.unit, o, True) if r.next else (o, r.unit, False)] += n
    want = {(a, b, True): n for (a, b), n in pairs.items() if a < 40 or b >= 40}
    assert got == want | {(a, b, False): n for (a, b), n in pairs.items() if b < 40}
    cls, table = np.append(np.arange(40) % 3, [4, 3]), rng.integers(1, 50, (5, 5)).astype(float)
    rare = brown.rare_classes(d, vocab, cls, table, 3, 8 * brown.WORDS)
    assert "ObjectHashAggregate" not in rare._jdf.queryExecution().toString()
    rows = rare.collect()
    assert {(r["word"], h): n for r in rows for h, n in zip(r["h"], r["hn"])} == far
    assert len(rows) == len({w for w, _ in far}) and all(r["n"] == sum(r["hn"]) for r in rows)
    f = lambda x: x * np.log(np.maximum(x, 1))
    t, size = table[:, :3], table[:, :3].sum(axis=0)
    for r in rows:
        n = np.array(r["hn"])[:, None]
        gain = (f(t[r["h"]] + n) - f(t[r["h"]])).sum(axis=0) - f(size + r["n"]) + f(size)
        assert gain[r["cls"]] == pytest.approx(gain.max())


def test_brown_joins_only_words_that_are_not_looked_up(spark, docs):
    rows = docs([(i, f"the a{i % 3} b{i % 9} c{i % 30} d{i} the", "en", "a") for i in range(60)] + ODD)
    model, rare = brown.fit(rows, head=4, classes=3)
    assert {r["word"]: (r["n"], r["cls"]) for r in rare.collect()} == {
        r["word"]: (r["n"], r["cls"]) for r in model.often.to_pylist()}
    assert {r["n"] for r in brown.most_frequent(rare, 12).to_pylist()} == {
        n for n in {r["n"] for r in rare.collect()} if rare.where(f"n >= {n}").count() <= 12}
    assert len(brown.most_frequent(rare, 0)) == 0
    asked = docs([(i, f"the a1 b{i} c2 d5 new{i}", "en", "a") for i in range(9)] + ODD)
    some = dataclasses.replace(model, often=brown.most_frequent(rare, 12))
    none = dataclasses.replace(model, often=model.often.slice(0, 0))
    scores = [sorted(tuple(r)[1:] for r in brown.score(asked, m, rare).collect()) for m in (model, some, none)]
    assert np.allclose(scores[0], scores[1]) and np.allclose(scores[0], scores[2])


def test_brown_without_training_rows_and_with_a_very_long_text(spark, docs):
    model, rare = brown.fit(docs(ODD).limit(0))
    r = brown.score(docs([(1, "a b", "en", "a")]), model, rare).first()
    assert r["n_tokens"] == 3 and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    rows = docs([(1, long, "en", "a"), (3, "w1 w2", "en", "a")])
    model, rare = brown.fit(rows, head=100, rounds=1)
    got = {r["doc_id"]: r for r in brown.score(rows, model, rare).collect()}
    assert got[1]["n_tokens"] == got[1]["n_known"] == 400_001 and got[3]["n_known"] == 3


def test_brown_empty_table(spark, docs):
    assert brown.score_held_out(docs(ODD).limit(0)).count() == 0


def test_cross_polytope(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = [(100001, None), (100002, [0.0] * 64), (100003, [float("nan")] * 64), (100004, [1.0] * 63 + [None]),
           (100020, [3.0] + [0.0] * 63), (100040, [3.0] + [0.0] * 63), (100041, [3.0] + [0.0] * 63), (100060, [1.0, 2.0])]
    x = e.select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    got = crosspolytope.search(x, x.where("vec_id % 20 = 0")).toPandas()
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in x.collect()
            if r.embedding and len(r.embedding) == 64 and r.vec_id not in (100002, 100003, 100004)]
    ids, v = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    hit = total = 0
    for i, q in rows:
        if i % 20 == 0:
            s = v @ q
            best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
            mine = got[got.query_id == i].sort_values("rank")
            assert len(mine) == 20 and mine["rank"].tolist() == list(range(1, 21))
            assert np.allclose(mine.score, [v[np.flatnonzero(ids == k)[0]] @ q for k in mine.vec_id], atol=1e-12)
            key = list(zip(-mine.score, mine.vec_id))
            assert key == sorted(key)
            hit += len(set(mine.vec_id) & set(ids[best]))
            total += 20
    assert hit / total >= 0.9
    assert set(got[got.query_id == 100020].head(2).vec_id) == {100040, 100041}
    assert 100060 not in set(got.query_id)
    assert crosspolytope.search(x.limit(0), x.limit(0)).count() == 0


def test_ppm(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = ppm.predictor(spark, ppm.fit(spark, ppm.training_rows(d)))
    r = ppm.identify(d, p).where(F.expr("crc32(string(doc_id)) % 4 = 2")).select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert r >= 0.97
    got = ppm.identify(docs(ODD), p).collect()
    assert len(got) == len(ODD)
    for g in got:
        if g["text"] is None or not re.search(r"[^\W\d_]", g["text"]):
            assert (g["lang_pred"], g["_score"]) == ("und", 0.0)
        else:
            assert g["lang_pred"] in ("en", "fr", "de", "es") and 0 <= g["_score"] <= 1
    nothing = ppm.predictor(spark, ppm.fit(spark, docs(ODD).limit(0)))
    assert {r["lang_pred"] for r in ppm.identify(docs(ODD), nothing).collect()} == {"und"}
    kept = ppm.drop_rejected(docs(ODD), p)
    assert kept.columns == docs(ODD).columns and kept.where("text IS NULL OR text = ''").count() == 0


def test_ppm_learns_every_language(spark):
    """70 languages of an alphabet of their own: the rarest is learned, its tree is the one it has when alone."""
    def text(i, k):
        return "".join(chr(0x4E00 + 40 * i + (7 * k + j * j) % 40) for j in range(60))
    rows = [(100 * i + k, text(i, k), f"l{i:02d}") for i in range(70) for k in range(2 + (i < 69))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm.fit(spark, d)
    assert len(model.langs) == 70
    out = ppm.identify(d, ppm.predictor(spark, model)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in out)
    alone = ppm.fit(spark, d.where("lang = 'l69'")).models[0].value
    assert np.array_equal(alone.cost, model.models[-1].value.cost)


def test_url_rules_and_filter(spark):
    urls = ["http://A.example.NET/en/1?q", "http://example.net/de", "https://x.net", "http://example.com/de/x", "http://b.org/fr/",
            "http://notexample.com/de/", "no scheme", None, "http://m.bad.com/p/", "https://bad.com/p?x#y", "http://bad.com/q", "http://net/",
            "http://ok.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("http://bad.com/p",), ("http://bad.com:80/p/",), (None,)], "url string")
    got = {r["page_id"]: r for r in urlbloom.judge(pages, listed).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == ["example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None,
                                                         None, None, None, "net/", None]
    assert [got[i]["verdict"] for i in range(len(urls))] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "allow",
                                                            "block", "block", "allow", "block", "allow"]
    assert (got[0]["host"], got[0]["path"], got[7]["host"], got[7]["path"]) == ("a.example.net", "/en/1", "", "")
    empty = urlbloom.judge(pages, listed.limit(0))
    assert empty.where("listed").count() == 0 and empty.count() == len(urls)


def test_filter_has_no_false_negatives_and_few_positives(spark):
    listed = spark.range(5000).selectExpr("concat('h/', id) AS canonical")
    blocks = 5000 * urlbloom.BITS_PER_URL // 256 + 1
    bloom = urlbloom.build_filter(listed, blocks)
    probe = spark.range(20000).selectExpr("concat('h/', id) AS canonical")
    ok = F.lit(True)
    for i in range(urlbloom.WORDS):
        b = urlbloom._bit(F.col("canonical"), i)
        ok = ok & (F.col(f"w{i}").bitwiseAND(b) == b)
    hits = probe.withColumn("block", urlbloom._block(F.col("canonical"), blocks)).join(bloom, "block").where(ok).select("canonical")
    ids = {int(r[0][2:]) for r in hits.collect()}
    assert ids >= set(range(5000)) and len(ids) < 5000 + 150


def test_line_spread(spark, docs):
    rows = [(50 + i, f"own line {i}\n  shared line \n\nnear {i % 2}", "en", f"s{i}") for i in range(8)]
    rows += [(20 + i, "one site only", "en", "s1") for i in range(9)] + [(90, "shared line", "en", None)] + ODD
    out = linespread.dedup_lines(docs(rows), min_sites=5)
    assert out.columns == [*docs(rows).columns, "_lines_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[50]["text"] == "own line 0\n  shared line \n\nnear 0" and got[50]["_lines_removed"] == 0
    assert got[53]["text"] == "own line 3\n\nnear 1" and got[53]["_lines_removed"] == 1   # near: 4 sites each
    assert got[90]["text"] == "" and got[25]["text"] == "one site only" and got[1]["text"] is None
    assert linespread.dedup_lines(docs(rows).limit(0)).count() == 0


def test_simhash_trie_against_all_pairs(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = simtrie.near_duplicates(d).toPandas()
    fp = dict(zip(got.doc_id, (int(x, 16) for x in got.fingerprint)))
    vals = np.array(sorted(set(fp.values())), np.uint64)
    near = np.bitwise_count(vals[:, None] ^ vals[None, :]) <= 4
    root = {int(v): int(v) for v in vals}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i, j in zip(*np.nonzero(near)):
        a, b = find(int(vals[i])), find(int(vals[j]))
        root[max(a, b)] = min(a, b)
    low = {}
    for i, v in fp.items():
        low[find(v)] = min(low.get(find(v), i), i)
    assert {i: low[find(v)] for i, v in fp.items()} == dict(zip(got.doc_id, got.component_id))


def test_simhash_odd_rows(spark, docs):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simtrie.near_duplicates(docs(ODD)).collect()}
    assert got[(1, "0" * 16)] == got[(2, "0" * 16)] == got[(3, "0" * 16)] == 1
    kept = simtrie.keep_one(docs(ODD))
    assert kept.columns == docs(ODD).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 5]
    assert simtrie.keep_one(docs(ODD).limit(0)).count() == 0


def test_small_chunks_lose_nothing(spark):
    base = 0x0123456789ABCDEF
    vals = [base ^ (1 << b) for b in range(40)] + [base, 0, 3]
    prints = spark.createDataFrame([(v,) for v in vals], "fp long")
    from textprov.llm.components import components
    for chunk in (5, 50_000):
        roots = components(simtrie.link_table(prints, chunk=chunk)).collect()
        assert len({r["root"] for r in roots}) == 2 and len(roots) == len(vals)


def test_copies_of_a_fingerprint_do_not_follow_their_number(spark):
    """With p levels a fingerprint has 2 x (1 + p + p (p - 1) / 2) rows at most; the links stay the same."""
    from textprov.llm.components import components
    rng = np.random.default_rng(4)
    vals = np.unique(rng.integers(-2**63, 2**63, 4000, dtype=np.int64))
    some = rng.permutation(vals)[:300]
    near = some ^ (np.int64(1) << rng.integers(0, 63, 300)) ^ (np.int64(1) << rng.integers(0, 63, 300))
    prints = spark.createDataFrame([(int(v),) for v in {*vals.tolist(), *near.tolist()}], "fp long")
    n = prints.count()
    assert [simtrie.levels(x) for x in (0, 1, 1_600_000, 1_600_001, 10**8, 10**12)] == [5, 5, 5, 6, 11, 18]
    want = None
    for chunk in (50_000, 64):
        p = simtrie.levels(n, chunk)
        rows = simtrie.subtree_rows(prints, chunk=chunk).count()
        assert p == (5 if chunk > 64 else 7) and rows <= 2 * (1 + p + p * (p - 1) // 2) * n
        got = {(r["node"], r["root"]) for r in components(simtrie.link_table(prints, chunk=chunk)).collect()}
        want = want or got
        assert got == want and len(got) == 2 * int((near != some).sum())  # equal bits flipped twice: no link


def test_classes_of_frequent_fingerprints(spark):
    """Broadcast and shuffled classes are the same, null ids and hot fingerprints included."""
    rows = [(i, 0 if i % 3 else i << 20) for i in range(1, 300)] + [(None, 0), (None, 5), (7, 0)]
    prints = spark.createDataFrame(rows, "id long, fp long")
    got = [sorted(map(tuple, simtrie.with_class(prints, hot_keys=k).select("id", "fp", "component_id").collect()), key=str)
           for k in (1, 20, 10_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert {r[2] for r in got[0] if r[1] in (0, 5)} == {1}


def test_keep_one_of_repeated_rows_and_maps(spark):
    """Of identical rows one stays; rows that differ only in a map are different."""
    df = spark.createDataFrame([(1, "a b c d e", {"k": 2}), (1, "a b c d e", {"k": 1}), (2, "v w x y z", {}), (2, "v w x y z", {}),
                                (3, "a b c d e", None)], "doc_id long, text string, m map<string,int>")
    kept = sorted(r["doc_id"] for r in simtrie.keep_one(df).collect())
    assert kept == [1, 2]


def test_windows_against_every_window(spark):
    """Every (document, item) whose best window reaches 0.8, by brute force, and no other."""
    def split(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    item = [f"q{i}" for i in range(30)]
    near = item.copy()
    near[29] = "other"
    far = item.copy()
    far[10] = far[20] = "other"
    rows = [(1, "before it " + " ".join(item) + " after it"), (2, "x " * 50 + " ".join(near) + " y" * 9), (3, " ".join(far)),
            (4, " ".join(item[:28])), (5, None), (6, ""), (7, " ".join(item).upper().replace(" ", ",  ")), (7, " ".join(item)),
            (None, " ".join(item)), (8, "a b c"), (9, "nothing of the kind at all in here")]
    bench = [(100, " ".join(item)), (101, "a b c"), (102, None), (103, "..."), (104, " ".join(item))]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = set()
    for i, t in rows:
        w = split(t)
        for k, x in bench:
            x = split(x)
            if not x or not w:
                continue
            s = min(5, len(x))

            def grams(u):
                if len(u) < s:
                    return collections.Counter([tuple(u)])
                return collections.Counter(tuple(u[j:j + s]) for j in range(len(u) - s + 1))
            best = 0
            for at in range(max(1, len(w) - len(x) + 1)):
                p, q = grams(w[at:at + len(x)]), grams(x)
                best = max(best, sum((p & q).values()) / sum((p | q).values()))
            if best >= 0.8:
                want.add((i, k))
    got = {(r["doc_id"], r["item_id"]) for r in windows.matches(d, b).collect()}
    assert got == want and (1, 100) in want and (2, 100) in want and (3, 100) not in want and (8, 101) in want
    kept = windows.drop_contaminated(d, b)
    bad = {i for i, _ in want}
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in bad)
    assert windows.drop_contaminated(d, b.limit(0)).count() == len(rows) and windows.matches(d.limit(0), b).count() == 0


def test_simhash_votes_of_long_items(spark):
    """Over 65,535 votes on one bit do not spill into another; small cases by hand."""
    cases = {1: [-1] * 70_000, 2: [1] * 40_000 + [2] * 39_999, 3: [5, 6, 8], 4: [1, 2]}
    want = {1: -1, 2: 1, 3: 4, 4: 0}
    one = F.expr("case id when 1 then array_repeat(-1L, 70000) when 2 then concat(array_repeat(1L, 40000), array_repeat(2L, 39999)) "
                 "when 3 then array(5L, 6L, 8L) else array(1L, 2L) end")
    got = spark.range(1, 5).withColumn("s", one).select("id", F.size("s").alias("n"), F.expr(windows.simhash_sql("s")).alias("f")).collect()
    assert {r["id"]: r["f"] for r in got} == want and {r["id"]: r["n"] for r in got} == {i: len(c) for i, c in cases.items()}


def test_windows_on_the_tables(spark):
    found = queries.queries()["op7_simhash_windows"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        for i, t in texts.items():
            if " ".join(item["text"].split()) in " ".join(t.split()):
                assert (i, item["item_id"]) in {(r["doc_id"], r["item_id"]) for r in found}


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    path = public_tokenizers.path(pow2pack.TOKENIZER)
    rows = [*ODD, (30, "long text, " * 3000, "en", "a")]
    got = pow2pack.pack(docs(rows), path).collect()
    tok = pow2pack.Encoder(path).tok
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
    assert len({r["sequence_id"] for r in got}) == len(got)
    sums = [(r["doc_id"], r["start"], r["length"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got]
    digest = pow2pack.digests(pow2pack.pack(docs(rows), path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, digest), key=str) == sorted(sums, key=str)
    for i, t, *_ in rows:
        if i != 5:
            parts = sorted(by[i], key=lambda r: r["start"])
            ids = [x for r in parts for x in r["ids"]]
            assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 1] and parts[0]["doc_tokens"] == len(ids)
            assert [r["start"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts]])[:-1].tolist()
    assert pow2pack.pack(docs(rows).limit(0), path).count() == 0


def test_text_ratio_table(spark):
    p = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>Hi&eacute; x</p>"), (3, "u", "<p>Hi&eacute; x</p>")],
                              "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in textratio.extract(p).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "Hié x", 5), (3, "Hié x", 5)]
    assert textratio.extract(p.limit(0)).count() == 0


def luhn(n):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(n)))) % 10 == 0


def test_feistel_links_and_formats(spark, docs):
    rows = [(11, "card 4041894974608795, again 4041-8949-7460-8795 and 1234567890123456", "en", "a"),
            (12, "4041894974608795; +1 (988) 555-2485 or (988) 555-2485", "en", "a"),
            (13, "ip 42.144.35.254 v3.0.1 born 1987-04-30, not 1987-02-30, 30.04.1987", "en", "a"),
            (14, "bosbt.42@mail8.example.com 123-45-6789 password=b7db7aa4a5fcc78305", "en", "a")] + ODD
    out = feistel.pseudonymise(docs(rows), key=KEY)
    assert out.columns == [*docs(rows).columns, "_pii_values", "_pii_kinds"]
    got = {r["doc_id"]: r for r in out.collect()}
    card = re.search(r"card (\d{16}), again ([\d-]{19}) and 1234567890123456$", got[11]["text"])
    assert luhn(card[1]) and card[1] != "4041894974608795" and card[2].replace("-", "") == card[1]
    assert got[12]["text"].startswith(card[1] + "; +1 (") and re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4}) or \1$", got[12]["text"])
    assert all(x not in got[12]["text"] for x in ("555-2485", "4041894974608795"))
    day = re.search(r"born (\S+), not 1987-02-30, (\S+)$", got[13]["text"])
    assert datetime.date.fromisoformat(day[1]) == datetime.datetime.strptime(day[2], "%d.%m.%Y").date() != datetime.date(1987, 4, 30)
    assert "42.144.35.254" not in got[13]["text"] and "v3.0.1" in got[13]["text"]
    assert re.fullmatch(r"[a-z]{5}\.\d\d@mail8\.example\.com \d{3}-\d\d-\d{4} password=[a-z0-9]{18}", got[14]["text"])
    assert got[14]["_pii_kinds"] == "email,secret,ssn" and got[14]["_pii_values"] == 3
    for i, t, *_ in ODD:
        assert got[i]["text"] == t and got[i]["_pii_values"] == 0
    other = {r["doc_id"]: r["text"] for r in feistel.pseudonymise(docs(rows), key="it's another").collect()}
    assert other[11] != got[11]["text"]


@pytest.mark.parametrize("text, kinds, kept", [
    ("card 4111 1111 1111 1111 12/25", ["card"], "12/25"),
    ("4111111111111111 123", ["card"], " 123"),
    ("no 7 4111-1111-1111-1111", ["card"], "no 7 "),
    ("4111 1111 1111 1111 5500-0000-0000-0004", ["card", "card"], " "),
    ("id 1234 378282246310005 3782 822463 10005 77", ["card", "card"], " 77"),
    ("555-123-4567 555-123-4568", ["phone", "phone"], " "),
    ("123-45-6789 234-56-7890", ["ssn", "ssn"], " "),
    ("4111 1111 1111 1111 123-45-6789 555-123-4567 10.0.0.1 15/01/2024", ["card", "ssn", "phone", "ip", "date"], "/"),
    ("+1 555 123 4567 4111 1111 1111 1111", ["phone", "card"], "+1 "),
    ("1-555-123-4567 99", ["phone"], " 99"),
    ("020 7946 0958, 06 12 34 56 78", ["phone", "phone"], ", "),
    ("on 2024/01/15 or 30 April 1987 or April 3, 1987", ["date", "date", "date"], " or "),
    ("2024/02/30 31 April 1987", [], "31 April"),
    ("DE89 3704 0044 0532 0130 00 GB82WEST12345698765432", ["iban", "iban"], "GB"),
    ("DE88 3704 0044 0532 0130 00", [], "DE88"),
    ("api-key: abcdef0123456789", ["secret"], "api-key: "),
    ("ghp_0123456789abcdefghijABCDEFGHIJ456789 sk-live-abcdefghij0123456789", ["secret", "secret"], " sk-live-"),
    ("41-11 1111 111111 11, 41111 11111 111111", ["card", "card"], ", "),
    ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 4111111111111111x 1234 5678 9012 3456", [], "4111111111111111x"),
])
def test_feistel_adjacent_values(spark, text, kinds, kept):
    """A value next to another number is found, in order, and neither hides the other."""
    df = spark.createDataFrame([(text,)], "text string")
    out = feistel.pseudonymise(df, key=KEY).first()
    assert out["_pii_kinds"] == ",".join(sorted(set(kinds))) and out["_pii_values"] == len(kinds)
    assert kept in out["text"] and all(x not in out["text"] for x in text.split() if len(x) > 10 and x not in kept) and (out["text"] != text) == bool(kinds)


def test_feistel_is_a_permutation(spark):
    """No two dates and no two short numbers share a pseudonym; every pseudonym stays in its format."""
    days = spark.range(0, 73049, 7).select(F.expr("string(date_add(DATE'1900-01-01', int(id)))").alias("text"))
    out = [r["text"] for r in feistel.pseudonymise(days, key=KEY).collect()]
    assert len(set(out)) == len(out) and all(1900 <= datetime.date.fromisoformat(x).year <= 2099 for x in out)
    nums = spark.range(20000).select(F.expr("concat('123-45-', lpad(id % 9999 + 1, 4, '0'))").alias("text")).distinct()
    out = [r["text"] for r in feistel.pseudonymise(nums, key=KEY).collect()]
    assert len(set(out)) == 9999


def _peer(value, kind, sizes, key=KEY, rounds=8):
    """The network over two numbers, written anew."""
    import hashlib
    a, b = value
    for i in range(1, rounds + 1):
        k = int(hashlib.sha512(f"{key}|{kind}|{i}|{b if i % 2 else a}".encode()).hexdigest()[:12], 16)
        a, b = ((a + k) % sizes[0], b) if i % 2 else (a, (b + k) % sizes[1])
    return a, b


def test_feistel_stays_among_valid_values(spark):
    """Social security numbers, hosts and reserved addresses: valid again, all different, equal to a second network."""
    rng = np.random.default_rng(8)
    areas = [x for x in range(1, 900) if x != 666]
    ssn = {(int(rng.choice(areas)), int(rng.integers(1, 100)), int(rng.integers(1, 10000))) for _ in range(1500)} | {
        (1, 1, 1), (665, 99, 9999), (667, 1, 1), (899, 99, 9999)}
    ips = {tuple(map(int, rng.integers(0, 256, 4))) for _ in range(1500)} | {(0, 0, 0, 0), (126, 1, 2, 3), (128, 0, 0, 1),
                                                                              (223, 255, 255, 255), (224, 0, 0, 1), (255, 255, 255, 255), (127, 0, 0, 1)}
    texts = ["%03d-%02d-%04d" % x for x in ssn] + [".".join(map(str, x)) for x in ips]
    out = {r["t"]: r["text"] for r in feistel.pseudonymise(spark.createDataFrame([(t, t) for t in texts], "t string, text string"), key=KEY).collect()}
    assert len(set(out.values())) == len(texts)
    special = lambda o: o in (0, 127) or o > 223
    hosts, kept = [x for x in range(256) if not special(x)], [x for x in range(256) if special(x)]
    for x in ssn:
        a, b = _peer((areas.index(x[0]), (x[1] - 1) * 9999 + x[2] - 1), "ssn", (898, 99 * 9999))
        assert out["%03d-%02d-%04d" % x] == "%03d-%02d-%04d" % (areas[a], b // 9999 + 1, b % 9999 + 1)
    for x in ips:
        group = kept if special(x[0]) else hosts
        a, b = _peer((group.index(x[0]) * 256 + x[1], x[2] * 256 + x[3]), "ip", (len(group) * 256, 65536))
        assert out[".".join(map(str, x))] == f"{group[a // 256]}.{a % 256}.{b // 256}.{b % 256}"


def test_feistel_ibans_validate_and_link(spark):
    rows = [("DE89370400440532013000",), ("DE89 3704 0044 0532 0130 00",), ("FR1420041010050500013M02606",), (None,), ("",), ("x " * 200_000,)]
    out = [r["text"] for r in feistel.pseudonymise(spark.createDataFrame(rows, "text string"), key=KEY).collect()]
    number = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4]))
    assert number(out[0]) % 97 == number(out[2]) % 97 == 1 and out[0][:2] == "DE" and out[2][:2] == "FR"
    assert out[1].replace(" ", "") == out[0] != rows[0][0] and [len(x) for x in out[1].split(" ")] == [4, 4, 4, 4, 4, 2]
    assert out[3:] == [None, "", "x " * 200_000]
    assert feistel.pseudonymise(spark.createDataFrame(rows, "text string").limit(0), key=KEY).count() == 0
