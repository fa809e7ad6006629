"""SimHash near-dedup by a binary trie self-join.

Fingerprints are 64-bit SimHashes of word shingles.  The distinct ones form a
binary trie; node pairs are traversed together from the top, their differing
bits add up, and a pair is dropped as soon as its budget is exceeded.  Of 64 bits
with at most ``radius`` differing, one half holds at most radius // 2 of them, so the trie is
walked twice, once with either half on top and that smaller budget for the upper
half.  The upper levels are walked by Spark, as many as it takes for subtrees of ``CHUNK`` fingerprints
on average: a fingerprint goes to the pairs of subtrees whose prefixes are close enough, and each
pair is finished in one task.  So p levels cost 2 x (1 + p + p (p - 1) / 2) copies of a fingerprint
at a radius of 4, whatever their number (134 at 10^8).  A subtree that is denser than the average
and has more than ``CHUNK`` fingerprints is split, and its chunks are paired.

A task returns a spanning forest of the links that it finds, never all pairs, and
components of the whole are found by stars on the shared folder.

Defined results: null or wordless text has fingerprint 0 and links like any other; repeated
rows and copies share a fingerprint; a null id counts after every other for the
component id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_hash, stored
from .components import components

WIDTH = 4
RADIUS = 4
SEED = 42
PREFIX = 5           # least number of levels that Spark walks
MOST_PREFIX = 18     # and most: 2^19 subtrees are broadcast with their sizes
CHUNK = 50_000
HOT_KEYS = 10_000    # at most so many fingerprints are frequent ones, joined by broadcast
BITS = 64
PAIRS_AT_ONCE = 1 << 20
LEAF = 4


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    """XXH64 of the shingles, repeats included; fewer words than ``width``: the whole sequence."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size)
    start = (stop - size).tolist()
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], SEED) for a, b in zip(start, (stop[width - 1:] - 1).tolist())]


def fingerprints_of(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """uint64 per text: a bit is 1 if set in over half of the hashes."""
    out = np.zeros(len(texts), np.uint64)
    shift = np.arange(BITS, dtype=np.uint64)
    for i, t in enumerate(texts):
        h = shingle_hashes(t, width)
        if h:
            a = np.array(h, "<u8")
            ones = np.zeros(BITS, np.int64)
            for lo in range(0, len(a), 8192):  # memory stays bounded for very long texts
                ones += np.unpackbits(a[lo:lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.bitwise_or.reduce((2 * ones > len(a)).astype(np.uint64) << shift)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = WIDTH):
    """Column expression: the fingerprint as signed long."""
    def run(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in col:
            texts = [(t or "").encode() for t in arr.to_pylist()]
            yield pa.array(fingerprints_of(texts, width).view(np.int64), pa.int64())

    return F.arrow_udf(run, "long")(F.col(f"`{text_col}`").cast("string"))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable node of 0..n-1 over the edges (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class _Trie:
    """Levels of the binary trie of sorted distinct keys: child node per bit, down to nodes of at most LEAF keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []   # (first key, size, child[node, bit])
        lo = np.zeros(min(1, len(keys)), np.int64)
        hi = np.full(min(1, len(keys)), len(keys), np.int64)
        for d in range(BITS):
            bit = (keys >> np.uint64(BITS - 1 - d) & np.uint64(1)).astype(np.int64)
            ones = np.concatenate([[0], np.cumsum(bit)])
            mid = hi - (ones[hi] - ones[lo])
            has0, has1 = mid > lo, hi > mid
            child = np.full((len(lo), 2), -1, np.int64)
            both = np.stack([has0, has1], axis=1)
            child[both] = np.arange(int(both.sum()))
            self.levels.append((lo, hi - lo, child))
            nlo = np.stack([lo, mid], axis=1)[both]
            nhi = np.stack([mid, hi], axis=1)[both]
            lo, hi = nlo, nhi
            if len(lo) == 0 or (hi - lo).max() <= LEAF:  # the few keys of a leaf are compared at once
                break
        self.levels.append((lo, hi - lo, np.empty((0, 2), np.int64)))


def trie_links(x: np.ndarray, y: np.ndarray | None, upper: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (as value pairs) of the links within x, or between x and y (sorted distinct uint64).

    ``upper`` is the budget of the first 32 bits, ``radius`` that of all 64.
    """
    same = y is None
    keys = x if same else np.concatenate([x, y])
    left, right = _Trie(x), None
    right = left if same else _Trie(y)
    depth = min(len(left.levels), len(right.levels)) - 1
    half = np.uint64(BITS // 2)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def finish(i: np.ndarray, j: np.ndarray) -> None:
        """Exact test of the key pairs below the nodes (ranges are given as single keys)."""
        nonlocal held
        diff = x[i] ^ right.keys[j]
        ok = (np.bitwise_count(diff) <= radius) & (np.bitwise_count(diff >> half) <= upper)
        if same:
            ok &= i < j
        if ok.any():
            links.append((i[ok], j[ok] if same else j[ok] + len(x)))
            held += int(ok.sum())

    def spread(la, lb, a, b) -> None:
        """All key pairs below small nodes: in bounded blocks."""
        n = la[1][a] * lb[1][b]
        cut = np.cumsum(n)
        done = 0
        while done < len(a):
            upto = max(done + 1, int(np.searchsorted(cut, (cut[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
            aa, bb, nn = a[done:upto], b[done:upto], n[done:upto]
            k = np.arange(int(nn.sum())) - np.repeat(np.cumsum(nn) - nn, nn)
            width = np.repeat(lb[1][bb], nn)
            finish(np.repeat(la[0][aa], nn) + k // width, np.repeat(lb[0][bb], nn) + k % width)
            done = upto

    def links_so_far() -> None:
        """Keep a forest only, so that memory does not follow the number of links."""
        nonlocal held
        if held > 4 * PAIRS_AT_ONCE:
            i, j = np.concatenate([p[0] for p in links]), np.concatenate([p[1] for p in links])
            root = _forest(i, j, len(keys))
            node = np.flatnonzero(root != np.arange(len(keys)))
            links[:] = [(root[node], node)]
            held = len(node)

    if len(x) and len(right.keys):
        zero = np.zeros(1, np.int64)
        stack = [(0, zero, zero, np.zeros(1, np.int64))]
        while stack:
            d, a, b, diff = stack.pop()
            la, lb = left.levels[d], right.levels[d]
            small = la[1][a] * lb[1][b] <= LEAF * LEAF if d < depth else np.ones(len(a), bool)
            if small.any():
                spread(la, lb, a[small], b[small])
                links_so_far()
                a, b, diff = a[~small], b[~small], diff[~small]
            if not len(a):
                continue
            if len(a) > PAIRS_AT_ONCE:
                for lo in range(0, len(a), PAIRS_AT_ONCE // 4):
                    part = slice(lo, lo + PAIRS_AT_ONCE // 4)
                    stack.append((d, a[part], b[part], diff[part]))
                continue
            budget = upper if d < BITS // 2 else radius
            na, nb, nd = [], [], []
            for p in (0, 1):
                for q in (0, 1):
                    ca, cb, cd = la[2][a, p], lb[2][b, q], diff + (p != q)
                    ok = (ca >= 0) & (cb >= 0) & (cd <= budget)
                    if same:
                        ok &= ca <= cb  # a pair and its mirror are one
                    na.append(ca[ok])
                    nb.append(cb[ok])
                    nd.append(cd[ok])
            stack.append((d + 1, np.concatenate(na), np.concatenate(nb), np.concatenate(nd)))
    if not links:
        return keys[:0], keys[:0]
    i, j = np.concatenate([p[0] for p in links]), np.concatenate([p[1] for p in links])
    root = _forest(i, j, len(keys))
    node = np.flatnonzero(root != np.arange(len(keys)))
    return keys[root[node]], keys[node]


def levels(n: int, chunk: int = CHUNK) -> int:
    """Levels that Spark walks for ``n`` distinct fingerprints: 2^levels subtrees of ``chunk`` each hold them all."""
    return min(MOST_PREFIX, max(PREFIX, (max(1, -(-n // chunk)) - 1).bit_length()))


def subtree_rows(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(turn, lo, hi, right, key): every fingerprint once per pair of subtrees (or their chunks) that it has to meet."""
    upper = radius // 2
    prefix = levels(prints.count(), chunk)
    masks = [m for m in range(1 << prefix) if m.bit_count() <= upper]
    turned = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")).withColumn(
        "key", F.when(F.col("turn") == 0, F.col("fp")).otherwise(
            F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))))
    turned = turned.withColumn("top", F.shiftrightunsigned("key", BITS - prefix).cast("int"))
    # 2 x 2^prefix rows: how many chunks a subtree is split into
    parts = stored(turned.groupBy("turn", "top").count()
                   .select("turn", "top", F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "subtrees")
    mine, other = parts, parts.select("turn", F.col("top").alias("other"), F.col("parts").alias("others"))
    rows = (turned.join(F.broadcast(mine), ["turn", "top"])
            .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.array(*[F.col("top").bitwiseXOR(F.lit(m)) for m in masks])))
            .join(F.broadcast(other), ["turn", "other"])
            .withColumn("opart", F.explode(F.sequence(F.lit(0), F.col("others") - 1))))
    me, they = F.struct(F.col("top").alias("t"), F.col("part").alias("p")), F.struct(F.col("other").alias("t"), F.col("opart").alias("p"))
    rows = rows.select("turn", F.least(me, they).alias("lo"), F.greatest(me, they).alias("hi"), (me > they).alias("right"), "key")
    return rows.select("turn", (F.col("lo.t") * F.lit(1 << 40) + F.col("lo.p")).alias("lo"),
                       (F.col("hi.t") * F.lit(1 << 40) + F.col("hi.p")).alias("hi"), "right", "key")


def link_table(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): spanning edges of all pairs of distinct fingerprints (column ``fp``, long) within ``radius`` bits."""
    upper = radius // 2

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        key, is_right = pdf["key"].to_numpy().view(np.uint64), pdf["right"].to_numpy()
        x = np.unique(key[~is_right])
        if pdf["lo"].iat[0] == pdf["hi"].iat[0]:
            a, b = trie_links(x, None, upper, radius)
        else:
            a, b = trie_links(x, np.unique(key[is_right]), upper, radius)
        if pdf["turn"].iat[0]:
            a, b = a << np.uint64(32) | a >> np.uint64(32), b << np.uint64(32) | b >> np.uint64(32)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return subtree_rows(prints, radius, chunk).groupBy("turn", "lo", "hi").applyInPandas(finish, "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n, component_id) from rows (id, fp): rows of the fingerprint, smallest id reachable over links of at
    most ``radius`` bits."""
    uniq = stored(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "prints")
    roots = components(link_table(uniq.select("fp"), radius))
    linked = uniq.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "rep")
    low = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = linked.select("fp", "root").join(low, "root").select("fp", "component_id")
    return uniq.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id"))


def with_class(prints: DataFrame, radius: int = RADIUS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``prints`` (stored rows with id and fp) with ``component_id``.

    A fingerprint that more than one in ``hot_keys`` rows share is frequent: fewer than ``hot_keys`` fingerprints can
    be, so their classes are broadcast and their rows are not shuffled.  The other rows meet their class by a shuffle.
    """
    found = stored(classes(prints, radius), "classes")
    bound = prints.count() // hot_keys
    hot = found.where(F.col("n") > bound).select("fp", "component_id")
    cold = found.where(F.col("n") <= bound).select("fp", "component_id")
    return (prints.join(F.broadcast(hot), "fp")
            .unionByName(prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``."""
    prints = stored(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprints(docs, text_col, width).alias("fp")), "docprints")
    return (with_class(prints, radius)
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each group the row with the smallest id stays (null ids last,
    then the smallest row hash; of identical rows one)."""
    prints = stored(docs.select(F.col(f"`{id_col}`").alias("id"), row_hash(docs).alias("row"),
                                fingerprints(docs, text_col, width).alias("fp")), "docprints")
    # identical rows share id, hash and fingerprint
    each = with_class(prints, radius).groupBy("component_id", "id", "row").agg(F.count("*").alias("copies"))
    keep = each.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row", "copies")).alias("k"))
    keep = stored(keep.select(F.col("k.id").alias("kept_id"), F.col("k.row").alias("kept_row"), F.col("k.copies").alias("copies")), "kept")
    row = fresh(docs, "_row")
    rows = docs.withColumn(row, row_hash(docs)).alias("d").join(
        keep.alias("k"), (F.col(f"d.`{row}`") == F.col("k.kept_row")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.kept_id")))
    rows = rows.select("d.*")
    if keep.where("copies > 1").limit(1).count():  # only then are there texts to compare again
        rows = rows.dropDuplicates([id_col, row])
    return rows.drop(row)
