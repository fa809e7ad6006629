"""Phrase collocation mining with mergeable Misra-Gries summaries.

First pass: every n-gram (two and three words, per language) is hashed to 64 bits, and the hash range is cut into
partitions.  A task sums what it sees and sends each partition its part as a summary; a
partition's summaries are merged into one of bounded capacity.  When a summary is over capacity, the
count next below the capacity is taken from all counters and those without a rest go.  The capacity
exceeds the partition's mass divided by the threshold, so all such losses together stay under the
threshold: an n-gram that occurs often enough always keeps a counter.  What survives marks a bit map.

Second pass: the n-grams whose bit is set are counted exactly, by their words, with all words and
the number of words per language.  Scores are exact integers (decimals of 38 digits).

A partition's share of the text is the same at any size of the corpus: their number follows the bytes.  The
bit map has a fixed greatest size; with more survivors it lets more rare n-grams through to
the exact count, which drops them there.

Defined results: null texts are empty, null languages ``und``; repeated rows count each by itself;
texts of any length are read whole, cut at piece borders only; ties go by the phrase's UTF-8 bytes; extra
columns may have any name and are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored

# Fixed values of the rules: word and piece separators, share of a longer phrase's count that drops a shorter one.
BLANKS = b"\x20\x09"
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
CONTAINED_PERCENT = 50
MILLION = 1_000_000

#: Least count, phrases returned per language, counters per unit of mass over threshold.
THRESHOLD, TOP, SLACK = 10, 2000, 2
#: Text bytes per hash partition, per slice of work, and summed hashes held by a task before they are sent.
PART_BYTES, SLICE_BYTES, HELD = 32 << 20, 2 << 20, 2_000_000
#: Keys of the longest summary that are merged with the others' at a time.
STRETCH = 1 << 17
#: Leading hash bits that tell the partition, and bounds of the bit map (2^28 bits are 32 MB).
PART_BITS, MIN_MAP_BITS, MAX_MAP_BITS = 20, 23, 28

KIND = np.zeros(256, np.uint8)      # 0: of a word, 1: blank, 2: end of a piece
KIND[list(BLANKS)] = 1
KIND[list(PIECE_ENDS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Words:
    """The words of some texts: ``code`` into ``names``, ``lang`` of each, ``run2`` / ``run3``: where two or three
    consecutive words of one piece begin."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        joined = pc.binary_join_element_wise(texts, pa.scalar(b"\n", pa.binary()), pa.scalar(b"", pa.binary()))
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, 4 * joined.offset)
        data = LOWER[np.frombuffer(joined.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]]
        kind = KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, stop = edge[0::2], edge[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = pc.dictionary_encode(words)
        self.names, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.lang = langs[np.searchsorted(ends[1:] - ends[0], start, side="right")]
        same = piece[1:] == piece[:-1]
        self.run2 = np.flatnonzero(same)
        self.run3 = np.flatnonzero(same[1:] & same[:-1])

    def hashes(self, lang_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the n-grams of two and of three words, per language."""
        import xxhash
        of = np.fromiter(map(xxhash.xxh3_64_intdigest, self.names.cast(pa.binary()).to_pylist()), np.uint64, len(self.names))
        h = of[self.code] ^ lang_hash[self.lang]
        two = mixed(h[:-1] * K1 + h[1:] * K2) if len(h) > 1 else h[:0]
        three = mixed(two[self.run3] * K3 + h[self.run3 + 2] * K1)
        return two[self.run2], three


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K3
    x = (x ^ (x >> np.uint64(29))) * K2
    return x ^ (x >> np.uint64(32))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, languages) of bounded bytes; longer texts are cut behind the end of a piece."""
    piece_end = re.compile(b"[" + re.escape(PIECE_ENDS) + b"]")
    for batch in batches:
        texts, langs = batch.column(0).cast(pa.binary()), batch.column(1)
        sizes = pc.binary_length(texts).to_numpy()
        if len(sizes) and sizes.max() > SLICE_BYTES:
            parts, of = [], []
            for i, raw in enumerate(texts.to_pylist()):
                at = 0
                while (cut := piece_end.search(raw, at + SLICE_BYTES)) is not None:
                    parts.append(raw[at:cut.end()])
                    at = cut.end()
                parts.append(raw[at:])
                of += [i] * (len(parts) - len(of))
            texts, langs = pa.array(parts, pa.binary()), langs.take(pa.array(of))
            sizes = pc.binary_length(texts).to_numpy()
        group = np.cumsum(sizes) // SLICE_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo < hi:
                yield texts.slice(lo, hi - lo), langs.slice(lo, hi - lo)


def rows_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
                       F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"))


def merged(sorted_parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counters (sorted keys, counts), by stretches of the keys, so that few of them are copied and sorted at a time."""
    longest = max((k for k, _ in sorted_parts), key=len)
    cuts = longest[STRETCH::STRETCH]
    bounds = [[0, *np.searchsorted(k, cuts).tolist(), len(k)] for k, _ in sorted_parts]
    out_keys, out_counts = [longest[:0]], [np.empty(0, np.int64)]
    for i in range(len(cuts) + 1):
        here = [(k[b[i]:b[i + 1]], c[b[i]:b[i + 1]]) for (k, c), b in zip(sorted_parts, bounds)]
        keys = np.concatenate([k for k, _ in here])
        if not len(keys):
            continue
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out_keys.append(keys[first])
        out_counts.append(np.add.reduceat(np.concatenate([c for _, c in here])[order], first))
    return np.concatenate(out_keys), np.concatenate(out_counts)


class Summary:
    """Misra-Gries counters of 64-bit hashes, as sorted arrays; ``lost`` is what was taken from each at most."""

    def __init__(self, capacity: int | None = None):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray | None]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Occurrences, or another summary's counters; they are merged once they are worth a sort."""
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting >= max(1 << 20, len(self.keys) // 2):
            self.settle()

    def settle(self) -> None:
        if not self.n_waiting:
            return
        plain = [k for k, c in self.waiting if c is None]
        if plain:
            keys = np.concatenate(plain)
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            summed = [(keys[first], np.diff(first, append=len(keys)))]
        else:
            summed = []
        summed += [(k, c) for k, c in self.waiting if c is not None]
        self.waiting, self.n_waiting = [], 0
        if len(self.keys) or len(summed) > 1:
            self.keys, self.counts = merged([(self.keys, self.counts), *summed])
        else:
            self.keys, self.counts = summed[0]
        if self.capacity is not None and len(self.keys) > self.capacity:
            spare = len(self.counts) - self.capacity - 1
            take = int(np.partition(self.counts, spare)[spare])
            stay = self.counts > take
            self.keys, self.counts = self.keys[stay], self.counts[stay] - take
            self.lost += take

    def reaching(self, threshold: int) -> np.ndarray:
        """Keys that may have occurred ``threshold`` times."""
        self.settle()
        return self.keys[self.counts + self.lost >= threshold]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(64 - PART_BITS)) * np.uint64(parts) >> np.uint64(PART_BITS)).astype(np.int64)


def part_start(part: int, parts: int) -> int:
    """The least value of the leading hash bits that belongs to ``part``."""
    return -((-part << PART_BITS) // parts)


def _summaries(parts: int):
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def sent(summary: Summary) -> Iterator[pa.RecordBatch]:
        summary.settle()
        keys, counts = summary.keys, summary.counts
        bounds = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
        there = np.flatnonzero(np.diff(bounds))
        for some in np.array_split(there, max(1, len(there) // 64)):
            spans = [(int(p), slice(bounds[p], bounds[p + 1])) for p in some]
            if spans:
                which = [p for p, _ in spans]
                mass = [int(counts[s].sum()) for _, s in spans]
                none = [None] * len(spans)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((which, [0] * len(spans), mass, none, none), schema.types)], schema=schema)
                bodies = [keys[s].tobytes() for _, s in spans], [counts[s].astype("<u4").tobytes() for _, s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((which, [1] * len(spans), [0] * len(spans), *bodies), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        summary = Summary()
        for texts, langs in slices(batches):
            coded = pc.dictionary_encode(langs)
            lang_hash = np.array([xxhash.xxh3_64_intdigest(x, 1) for x in coded.dictionary.to_pylist()], np.uint64)
            for keys in Words(texts, coded.indices.to_numpy()).hashes(lang_hash):
                summary.add(keys)
            if len(summary.keys) >= HELD:
                yield from sent(summary)
                summary = Summary()
        yield from sent(summary)
    return run


def _merged(parts: int, threshold: int, slack: float, map_bits: int):
    """Per partition: capacity from its mass (which comes first), then its summaries; out comes its stretch of the bit map."""
    def stretch(part: int, summary: Summary, mass: int) -> pa.RecordBatch:
        lo, hi = (part_start(p, parts) << (map_bits - PART_BITS) for p in (part, part + 1))
        found = summary.reaching(threshold)
        bits = np.zeros(hi - lo, np.uint8)
        bits[(found >> np.uint64(64 - map_bits)).astype(np.int64) - lo] = 1
        return pa.RecordBatch.from_arrays([pa.array([lo >> 3], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary()),
                                           pa.array([mass], pa.int64()), pa.array([len(found)], pa.int64()),
                                           pa.array([summary.lost], pa.int64())], names=["at", "bits", "mass", "survivors", "lost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, Summary()
        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.column(0)[i].as_py()
                if p != part:
                    if part is not None:
                        yield stretch(part, summary, mass)
                    part, mass, summary = p, 0, Summary()
                if batch.column(1)[i].as_py() == 0:
                    mass += batch.column(2)[i].as_py()
                else:
                    summary.capacity = int(slack * mass / threshold) + 1
                    summary.add(np.frombuffer(batch.column(3)[i].as_buffer(), "<u8"),
                                np.frombuffer(batch.column(4)[i].as_buffer(), "<u4").astype(np.int64))
        if part is not None:
            yield stretch(part, summary, mass)
    return run


def survivors(rows: DataFrame, threshold: int = THRESHOLD, slack: float = SLACK, part_bytes: int = PART_BYTES) -> tuple[np.ndarray, int, list]:
    """The bit map of n-grams that may occur ``threshold`` times, its bits, and (mass, survivors, lost) per partition.

    ``rows`` are (body, lang).  What comes to the driver is the map alone, at most 2^MAX_MAP_BITS bits.
    """
    if slack < 1:
        raise ValueError("the capacity must exceed the mass over the threshold")
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = min(1 << PART_BITS, size // part_bytes + 1)
    map_bits = min(MAX_MAP_BITS, max(MIN_MAP_BITS, int(size).bit_length()))
    sent = rows.mapInArrow(_summaries(parts), "part int, kind int, mass long, keys binary, counts binary")
    by_part = sent.repartitionById(parts, "part").sortWithinPartitions("part", "kind")   # one partition each
    found = by_part.mapInArrow(_merged(parts, threshold, slack, map_bits), "at long, bits binary, mass long, survivors long, lost long").collect()
    marks = np.zeros(1 << map_bits >> 3, np.uint8)
    for r in found:
        marks[r["at"]:r["at"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return marks, map_bits, [(r["mass"], r["survivors"], r["lost"]) for r in found]


def _counted(marks, map_bits: int):
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def sums(lang: np.ndarray, codes: list[np.ndarray], n_names: int, n_langs: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Different (language, codes) and how often each."""
        if n_langs * n_names ** len(codes) < 1 << 62:
            key = lang.astype(np.int64)
            for c in codes:
                key = key * n_names + c
            key, n = np.unique(key, return_counts=True)
            out = []
            for _ in codes:
                key, c = np.divmod(key, n_names)
                out.append(c)
            return key, out[::-1], n
        rows, n = np.unique(np.stack([lang, *codes], axis=1), axis=0, return_counts=True)
        return rows[:, 0], [rows[:, i] for i in range(1, rows.shape[1])], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        bits = np.frombuffer(marks.value, np.uint8)
        shift = np.uint64(64 - map_bits)

        def marked(h: np.ndarray) -> np.ndarray:
            at = (h >> shift).astype(np.int64)
            return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

        for texts, langs in slices(batches):
            coded = pc.dictionary_encode(langs)
            lang_names = coded.dictionary
            lang_hash = np.array([xxhash.xxh3_64_intdigest(x, 1) for x in lang_names.to_pylist()], np.uint64)
            w = Words(texts, coded.indices.to_numpy())
            if not len(w.code):
                continue
            two, three = w.hashes(lang_hash)
            starts = [np.arange(len(w.code)), w.run2[marked(two)], w.run3[marked(three)]]
            for size, at in enumerate(starts, 1):
                lang, codes, n = sums(w.lang[at], [w.code[at + i] for i in range(size)], len(w.names), len(lang_names))
                words = [w.names.take(pa.array(c)) for c in codes]
                phrase = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.string()))
                yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(lang)), pa.array(np.full(len(n), size, np.int32)),
                                                  phrase, pa.array(n)], schema=schema)
            lang, n = np.unique(w.lang, return_counts=True)
            yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(lang)), pa.array(np.zeros(len(n), np.int32)),
                                              pa.array([""] * len(n), pa.string()), pa.array(n)], schema=schema)
    return run


def counts(docs: DataFrame, threshold: int = THRESHOLD, slack: float = SLACK, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, words, phrase, n): exact counts of all words and phrases of two and three words that occur ``threshold``
    times, and with words = 0 the number of words per language.  Written to the shared folder."""
    rows = rows_of(docs)
    marks, map_bits, _ = survivors(rows, threshold, slack, part_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(marks.tobytes())
    counted = rows.mapInArrow(_counted(shared, map_bits), "lang string, words int, phrase string, n long")
    exact = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    out = stored(exact.where((F.col("n") >= threshold) | (F.col("words") == 0)), "phrase-counts")
    shared.unpersist()
    return out


def score(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (left right)) of three columns, exact for counts of up to 14 digits."""
    a, left, right = (f"CAST({c} AS DECIMAL(14, 0))" for c in (a, left, right))
    return F.expr(f"(CAST({MILLION} AS DECIMAL(7, 0)) * {a} * {a}) DIV ({left} * {right})")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, slack: float = SLACK,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found = counts(docs, threshold, slack, part_bytes)
    words = small_side(found.where("words = 1").select("lang", F.col("phrase").alias("word"), F.col("n").alias("f")))
    totals = found.where("words = 0").select("lang", "n")

    def part(i: int) -> Column:
        return F.split_part("phrase", F.lit(" "), F.lit(i))

    pairs = found.where("words = 2").select("lang", "phrase", F.col("n").alias("a"), part(1).alias("w1"), part(2).alias("w2"))
    pairs = (pairs.join(words.select("lang", F.col("word").alias("w1"), F.col("f").alias("l")), ["lang", "w1"])
             .join(words.select("lang", F.col("word").alias("w2"), F.col("f").alias("r")), ["lang", "w2"])
             .select("lang", "phrase", "a", "l", "r"))
    triples = found.where("words = 3").select(
        "lang", "phrase", F.col("n").alias("a"), F.concat_ws(" ", part(1), part(2)).alias("head"),
        F.concat_ws(" ", part(2), part(3)).alias("tail"))
    heads = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f_head"), F.col("l").alias("f_first"))
    tails = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f_tail"), F.col("r").alias("f_last"))
    cut = triples.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    cut = cut.withColumn("s1", score("a", "f_first", "f_tail")).withColumn("s2", score("a", "f_head", "f_last"))
    late = F.col("s2") < F.col("s1")
    three = cut.select("lang", "phrase", "a", F.when(late, F.col("f_head")).otherwise(F.col("f_first")).alias("l"),
                       F.when(late, F.col("f_last")).otherwise(F.col("f_tail")).alias("r"), F.least("s1", "s2").alias("score"))
    longer = (triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    two = (pairs.join(longer, ["lang", "phrase"], "left")
           .where(F.col("longer").isNull() | (100 * F.col("longer") < CONTAINED_PERCENT * F.col("a")))
           .select("lang", "phrase", "a", "l", "r", score("a", "l", "r").alias("score")))
    candidates = stored(two.unionByName(three), "phrase-candidates")
    # In two steps, so that no task sorts a whole language: the first ones of each part, then of those.
    salts = int((candidates.count() / top) ** 0.5) + 1
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return (best.join(small_side(totals), "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
