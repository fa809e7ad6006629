"""Benchmark decontamination by SimHash windows.

Every benchmark item is compared with windows of its own size (in words):

1. Screen.  A window can reach the similarity only if most of its shingles
   occur in the benchmark at all (k of m, from the threshold).  A bit map of the
   benchmark's shingle hashes marks such shingles inside each row; false marks only cost work.
   It is enough to look at windows that begin at a marked shingle: moving a window there loses no
   common shingle.
2. SimHash.  The different surviving windows and the items get 64-bit SimHashes of their shingles.
3. Multi-index.  The 64 bits are cut into ``radius`` + 1 blocks; windows and items of
   one size that agree in a block are compared, which finds every pair within ``radius`` bits.
4. Check.  Weighted Jaccard similarity of the shingles (weight: number of
   occurrences) must reach the threshold.

Everything is DataFrame and SQL expressions; the pass over the documents is a map without
shuffle, and a passage in many documents is compared once.

Words are runs of letters and digits of the lower-cased text.  Items with fewer
words than a shingle are one shingle; so is a window of that size.  A document with
fewer words than an item is one window.

Defined results: null or wordless texts and items match nothing; repeated items are
reported each with its own id; repeated documents each; an empty benchmark gives no
match; extra columns are ignored by ``matches`` and passed through by ``drop_contaminated``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_hash, small_side, stored

WIDTH = 5
THRESHOLD = 0.8
RADIUS = 18
MAP_BITS = (16, 23)   # binary logarithm of the bit map's size, least and most


def words_sql(col: str) -> str:
    return f"filter(split(lower({col}), '[^\\\\p{{L}}\\\\p{{N}}]+', -1), w -> w <> '')"


def hashes_sql(words: str, width: int) -> str:
    """Hashes of the shingles of an array of words (one for the whole if it is shorter)."""
    parts = ", ".join(f"element_at({words}, i + {j})" for j in range(width))
    return (f"case when size({words}) = 0 then cast(array() as array<bigint>) "
            f"when size({words}) < {width} then array(xxhash64(array_join({words}, ' '))) "
            f"else transform(sequence(1, size({words}) - {width} + 1), i -> xxhash64({parts})) end")


def shingles_sql(words: str, width: int) -> str:
    """The shingles themselves."""
    return (f"case when size({words}) = 0 then cast(array() as array<string>) "
            f"when size({words}) < {width} then array(array_join({words}, ' ')) "
            f"else transform(sequence(1, size({words}) - {width} + 1), i -> array_join(slice({words}, i, {width}), ' ')) end")


def let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def simhash_sql(hashes: str) -> str:
    """A bit is 1 if set in over half of the hashes (each occurrence votes).

    Two votes are counted in one long (32 bits each), so an item of any length keeps exact counts.
    """
    sums = (f"transform(sequence(0, 31), g -> aggregate({hashes}, 0L, (s, h) -> "
            "s + (shiftrightunsigned(h, g) & 4294967297L)))")  # 0x0000000100000001
    return let(sums, "v", f"""aggregate(sequence(0, 63), 0L, (f, b) ->
        if(2 * (shiftrightunsigned(v[b % 32], 32 * int(b / 32)) & 4294967295L) > size({hashes}), f | shiftleft(1L, b), f))""")


def similarity_sql(a: str, b: str) -> str:
    """Weighted Jaccard of two arrays of shingles, weight = occurrences."""
    return f"""aggregate(array_distinct(concat({a}, {b})), named_struct('n', 0, 'd', 0), (t, x) -> {let(
        f'size(filter({a}, y -> y = x))', 'p', let(f'size(filter({b}, y -> y = x))', 'q',
        "named_struct('n', t.n + least(p, q), 'd', t.d + greatest(p, q))"))}, t -> t.n / t.d)"""


def _prepared_items(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (bench.select(F.col(f"`{id_col}`").alias("item_id"), F.expr(words_sql(f"`{text_col}`")).alias("words"))
            .where(F.size("words") > 0).withColumn("size", F.size("words")))


def _needed(m: int, mm: int, threshold: float) -> int:
    """Common shingles that an item of m and a window of mm need: k / (m + mm - k) >= threshold."""
    return math.ceil(threshold * (m + mm) / (1 + threshold) - 1e-9)


def _starts_sql(ms: list[int], width: int, threshold: float, bits: int, bitmap: str) -> str:
    """Possible window starts in the word array ``w``: array<struct<h, at, base, hits, n, text>>.

    ``at`` is the place of the marked shingle ``h``, ``hits`` the places of this and the following marks,
    ``n`` the document's number of shingles, ``text`` the words from ``base`` that any window may need.
    """
    bit = (f"(shiftrightunsigned({bitmap}[int(shiftrightunsigned(s[i], {64 - bits + 6}))], "
           f"int(shiftrightunsigned(s[i], {64 - bits}) & 63)) & 1L) = 1L")
    marked = f"filter(sequence(0, size(s) - 1), i -> {bit})"
    # any window holds at least `few` marks, of which the first ones leave at most `gaps` places unmarked
    few = max(1, min(math.ceil(threshold * m - 1e-9) for m in ms))
    gaps = max(m - _needed(m, m, threshold) for m in ms)
    dense = (f"filter(sequence(0, size(p) - 1), x -> x + {few - 1} < size(p) and "
             f"p[x + {few - 1}] - p[x] <= {few - 1 + gaps})")
    most = max(ms)
    start = let(f"greatest(0, least(p[x], size(s) - {most}))", "c", f"""named_struct('h', s[p[x]], 'at', p[x], 'base', c,
        'hits', slice(p, x + 1, {most}), 'n', size(s),
        'text', array_join(slice(w, c + 1, p[x] - c + {most + width - 1}), ' '))""")
    none = "cast(array() as array<struct<h:bigint,at:int,base:int,hits:array<int>,n:int,text:string>>)"
    return let(hashes_sql("w", width), "s", f"if(size(s) < {few}, {none}, " + let(
        marked, "p", f"if(size(p) < {few}, {none}, " + let(dense, "q", f"if(size(q) = 0, {none}, transform(q, x -> {start}))") + ")") + ")")


def _bitmap(items: DataFrame, width: int) -> tuple[int, str]:
    """(binary logarithm of the size, SQL of the bit map as an array of longs): 64 bits a shingle, within MAP_BITS."""
    hashes = items.select(F.explode(F.expr(hashes_sql("words", width))).alias("h")).distinct()
    n = hashes.count()
    bits = min(max(MAP_BITS[0], (64 * max(n, 1) - 1).bit_length()), MAP_BITS[1])
    cells = 1 << (bits - 6)
    rows = (hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("x"))
            .groupBy(F.shiftrightunsigned("x", 6).alias("cell"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(x & 63))")).alias("v")).collect())   # at most 2^17 longs
    cell = [0] * cells
    for r in rows:
        cell[r["cell"]] = r["v"]
    return bits, f"cast(split('{','.join(map(str, cell))}', ',') as array<bigint>)"


def matches(docs: DataFrame, bench: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS,
            id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
            item_text_col: str = "text") -> DataFrame:
    """(doc_id, row, item_id, start, n_words, hamming, similarity): the best window of each document row and item.

    ``row`` is the hash of the whole row; ``start`` counts words from 0.
    """
    items = stored(_prepared_items(bench, item_id_col, item_text_col), "items")
    # a benchmark's sizes are few: texts of one size share a window
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    parts = None
    for w in sorted({min(width, n) for n in sizes}):
        own = [n for n in sizes if min(width, n) == w]
        bits, bitmap = _bitmap(items.where(F.col("size").isin(own)), w)
        some = items.where(F.col("size").isin(own))
        begun = docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), row_hash(docs).alias("row"),
            F.explode(F.expr(let(words_sql(f"coalesce(`{text_col}`, '')"), "w", let(bitmap, "bm", _starts_sql(
                [max(1, n - w + 1) for n in own], w, threshold, bits, "bm"))))).alias("v")).select("doc_id", "row", "v.*")
        # a window that begins at one of the item's shingles: only the sizes of items that hold it
        held = stored(some.select(F.explode(F.expr(hashes_sql("words", w))).alias("h"), "size",
                                  F.greatest(F.lit(1), F.col("size") - w + 1).alias("m")).distinct(), "shingles")
        found = (begun.join(small_side(held), "h")
                 .withColumn("mm", F.least("m", "n"))
                 .withColumn("k", F.ceil(F.lit(threshold) * (F.col("m") + F.col("mm")) / F.lit(1 + threshold) - 1e-9).cast("int"))
                 .withColumn("start", F.least(F.col("at"), F.col("n") - F.col("mm")))
                 .where("k <= mm AND size(hits) >= k AND hits[k - 1] < start + mm")
                 .select("doc_id", "row", F.lit(w).alias("width"), "size", "start", F.expr(
                     f"array_join(slice(split(text, ' '), start - base + 1, mm + {w - 1}), ' ')").alias("window")))
        parts = found if parts is None else parts.unionByName(found)
    empty = ("doc_id " + dict(docs.dtypes)[id_col] + ", row long, item_id " + dict(bench.dtypes)[item_id_col] +
             ", start int, n_words int, hamming int, similarity double")
    if parts is None:
        return docs.sparkSession.createDataFrame([], empty)
    places = stored(parts, "windows")

    def printed(df: DataFrame, words: str, name: str) -> DataFrame:
        h = "case width " + " ".join(f"when {w} then {hashes_sql(words, w)}" for w in range(1, width + 1)) + " end"
        s = "case width " + " ".join(f"when {w} then {shingles_sql(words, w)}" for w in range(1, width + 1)) + " end"
        return stored(df.withColumn("fp", F.expr(let(h, "s", simhash_sql("s")))).withColumn("shingles", F.expr(s)).drop(words), name)

    def blocked(df: DataFrame) -> DataFrame:
        cut = [64 * i // (radius + 1) for i in range(radius + 2)]
        keys = ", ".join(f"named_struct('n', {i}, 'k', shiftrightunsigned(shiftleft(fp, {64 - hi}), {64 - hi + lo}))"
                         for i, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo)
        return df.withColumn("b", F.explode(F.expr(f"array({keys})"))).select("*", "b.n", "b.k").drop("b", "shingles")

    win = printed(places.select("width", "size", "window").distinct().withColumn("ww", F.split("window", " ")), "ww", "prints")
    item = printed(items.withColumn("width", F.least(F.lit(width), F.col("size"))), "words", "itemprints")
    bits = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    close = (blocked(win).alias("a").join(blocked(item).alias("b"), (F.col("a.size") == F.col("b.size")) & (F.col("a.n") == F.col("b.n"))
                                          & (F.col("a.k") == F.col("b.k")) & (bits <= radius))
             .select("a.size", "a.window", "b.item_id", bits.alias("hamming")).distinct())
    sure = stored(close.join(win.select("size", "window", F.col("shingles").alias("sa")), ["size", "window"])
                  .join(item.select("item_id", "size", F.col("shingles").alias("sb")).distinct(), ["item_id", "size"])
                  .withColumn("similarity", F.expr(similarity_sql("sa", "sb"))).where(F.col("similarity") >= threshold)
                  .select("size", "window", "item_id", "hamming", "similarity").distinct(), "verified")
    best = F.max_by(F.struct("start", F.col("size").alias("n_words"), "hamming", "similarity"),
                    F.struct("similarity", -F.col("hamming"), -F.col("start")))
    return (places.join(small_side(sure, 100_000), ["size", "window"]).groupBy("doc_id", "row", "item_id").agg(best.alias("m"))
            .select("doc_id", "row", "item_id", "m.start", "m.n_words", "m.hamming", "m.similarity"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that match no item.  The keys to drop are broadcast while they are few, else shuffled."""
    bad = stored(matches(docs, bench, id_col=id_col, text_col=text_col, **options).select("doc_id", "row").distinct(), "contaminated")
    row = fresh(docs, "_row")
    keyed = docs.withColumn(row, row_hash(docs)).alias("d")
    bad = small_side(bad).alias("c")
    return keyed.join(bad, (F.col(f"d.`{row}`") == F.col("c.row")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col("c.doc_id")),
                      "left_anti").drop(row)
