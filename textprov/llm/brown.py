"""LM scoring by a Brown class-based bigram model.

Exchange clustering gives every word of the training rows a class; their number follows the
vocabulary (twice the cube root of the number of different words).  A token's probability is

    (1 - U) x P(class | class before) x P(word | class)

with the class transitions smoothed towards the class frequencies.  U is the share of the training tokens
that occur once (the chance that the next token is new); an unseen word has U x P(spelling unit of its last two
bytes | new word), where the share of a unit is that of the different words in training.  A
text's score is the sum over its words and its end, which has a class of its own.

All counts and all exchange rounds are Spark jobs.  A round has two: one sums the table of class
pairs, the other decides, for half of the ``head`` most frequent words at a time, which class raises the
likelihood most, from the counts of each word's neighbours by class; these lie in partitions by word, so a
round shuffles nothing but the sums.  Pairs and rare words are summed by numpy in each task and travel as rows of many
(one per bucket of words), which Spark shuffles and sorts by bucket.  The round with the highest likelihood counts.  Every other word then takes the class with the
highest gain in a job grouped by word.  As context, words outside the head share one class (a model with one
class map for the word predicted and a coarser one for the word before), so a text's rare words need only
one join with the stored table (word, n, class).  Driver and tasks hold the head (a lookup of
``HEAD`` words, so that they need no shuffle) and the class table; for the scores also the counts and classes of
the ``OFTEN`` next words, so that only the others are joined.

Defined results: null or empty text is the end alone; a null id is in training; repeated
rows are scored each by itself and count each in training; with no training row every count is
0 and all words are new; words of equal count enter the head in byte order, equal gains go to the smaller class; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_side, stored

SPELLINGS = 509
HEAD = 1 << 15
OFTEN = 7 << 15    # words outside the head that a text's score looks up without a shuffle, at most
ROUNDS = 6         # of half of the head's words each
PART_TOKENS = 1 << 25  # tokens whose pairs come to one of these tasks
PART_SUMS = 1 << 20  # sums (word, side, class) that a task of a round may hold
BLOCK = 8192       # neighbours of a word in one row, at most
ENTRIES = 1024     # neighbour counts by class that are weighed at once
GROUPED = 1 << 21  # pairs that a task sums at once
BUCKETS = 1 << 12  # of the head's words, whose neighbours are summed together
WORDS = 1 << 13    # outside the head, in a bucket
PAIRS = "bucket int, key array<long>, n array<long>"
SMALL = 8          # counts up to here have their gains in a table
TABLE_CELLS = 1 << 21  # cells of that table, at most (16 MB); it keeps count 1 in any case
PRIOR = 2.0        # weight of the class frequencies in a transition
SLICE_BYTES = 4 << 20


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and the number of words of each text."""
    # kernels are given whole arrays: on slices of a longer array they have returned foreign bytes
    texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    n = np.zeros(len(texts), np.int64)
    if len(flat):
        n = np.bincount(pc.list_parent_indices(lists).filter(keep).to_numpy(), minlength=len(texts))
    return flat.filter(keep), n


def slices(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with some ``SLICE_BYTES`` of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy()
    group = np.cumsum(size) // SLICE_BYTES
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]]).tolist()
    for lo, hi in zip(bounds, bounds[1:]):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column ``text``; counted per slice before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                seen = pc.value_counts(tokens(part.column(0))[0])
                yield pa.RecordBatch.from_arrays([seen.field("values").cast(pa.string()), seen.field("counts")], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_sql(word: str) -> str:
    """Spelling unit of a word: its last two bytes as a number."""
    return f"int(conv(hex(substring(encode({word}, 'UTF-8'), -2, 2)), 16, 10) % {SPELLINGS})"


def spellings(words: pa.Array) -> np.ndarray:
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8).astype(np.int64)
    last = data[ends[1:] - 1]
    before = np.where(ends[1:] - ends[:-1] > 1, data[np.maximum(ends[1:] - 2, 0)], 0)
    return (before * 256 + last) % SPELLINGS


@dataclass
class Vocabulary:
    """The most frequent words, looked up without a shuffle; a unit is a place here, ``rare`` or ``end``."""
    head: pa.Array
    count: np.ndarray

    @property
    def rare(self) -> int:
        return len(self.count)

    @property
    def end(self) -> int:
        return len(self.count) + 1

    def place(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(token -> different word, unit of each different word, the different words)."""
        coded = pc.dictionary_encode(words)
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.head), self.rare).to_numpy()
        return coded.indices.to_numpy(), place.astype(np.int64), coded.dictionary

    def placed(self, parts: Iterator[pa.RecordBatch], col: int) -> Iterator[tuple]:
        """(part, words of each text, *place()) of each part; some parts share a look-up, which prepares all words here."""
        held = []
        for part in itertools.chain(parts, [None]):
            if part is not None:
                words, n = tokens(part.column(col))
                held.append((part, n, pc.dictionary_encode(words)))
            if held and (part is None or len(held) == 4):
                found = pc.index_in(pa.chunked_array([c.dictionary for *_, c in held]), value_set=self.head)
                found, lo = pc.fill_null(found, self.rare).to_numpy().astype(np.int64), 0
                for of, n, coded in held:
                    hi = lo + len(coded.dictionary)
                    yield of, n, coded.indices.to_numpy(), found[lo:hi], coded.dictionary
                    lo = hi
                held = []


def class_count(types: int) -> int:
    """Classes for a vocabulary of that many different words."""
    return max(2, round(2 * types ** (1 / 3)))


def _chain(unit: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units with the end after each text; the unit before each (the end, at a text's start); text starts."""
    stop = np.cumsum(n)
    cur = np.insert(unit, stop, end)
    begin = np.concatenate([[0], (stop + np.arange(1, len(n) + 1))[:-1]])
    prev = np.roll(cur, 1)
    prev[begin] = end
    return cur, prev, begin


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of each."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n[order], first) if len(key) else n


def _sided(pair: np.ndarray, n: np.ndarray, size: int, words: int) -> pa.RecordBatch:
    """Both sides of different unit pairs (before x size + after) in one row per bucket: (bucket, key, n), key being
    (2 x place + next) x size + other with the units' places in order of their buckets.  The pairs of the two units
    that are no words stay once."""
    before, after = pair // size, pair % size
    unit, nxt = np.append(before, after), np.repeat([1, 0], len(pair))
    other, n = np.append(after, before), np.append(n, n)
    keep = (unit < words) | (nxt == 1) & (other >= words)
    per = -(-size // BUCKETS)
    key = ((((unit % BUCKETS) * per + unit // BUCKETS) * 2 + nxt) * size + other)[keep]
    order = np.argsort(key)
    key = key[order]
    bucket = key // (per * 2 * size)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = pa.array(np.append(first, len(bucket)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(key)),
         pa.ListArray.from_arrays(ends, pa.array(n[keep][order], pa.int64()))], names=["bucket", "key", "n"])


def unit_pairs(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(bucket, key, n): counts of adjacent units, as ``_sided`` lays them out; counted per ``GROUPED`` tokens before the
    shuffle."""
    shared, size = texts.sparkSession.sparkContext.broadcast(vocab), vocab.end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        held = []
        for batch in batches:
            for part in slices(batch, 0):
                words, n = tokens(part.column(0))
                code, place, _ = v.place(words)
                cur, prev, _ = _chain(place[code], n, v.end)
                held.append(prev * size + cur)
                if sum(map(len, held)) > GROUPED:
                    yield _sided(*np.unique(np.concatenate(held), return_counts=True), size, v.rare)
                    held = []
        if held:
            yield _sided(*np.unique(np.concatenate(held), return_counts=True), size, v.rare)

    return texts.select("text").mapInArrow(run, PAIRS)


def neighbours(pairs: DataFrame, words: int, classes: int, part_sums: int = PART_SUMS, n_tokens: int = 0) -> DataFrame:
    """(unit, next, other, n): each word's neighbours after it (next) and before it, in blocks, all of a word in one
    partition.  ``pairs`` comes from ``unit_pairs``, or has rows (before, after, n)."""
    size = words + 2
    per = -(-size // BUCKETS)

    def sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, n = (batch.column(i).to_numpy() for i in range(3))
            yield _sided(*_summed(before.astype(np.int64) * size + after, n), size, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, n = -1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            keys, counts = batch.column(1), batch.column(2)
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now:
                    yield from blocks(*_summed(np.concatenate(key), np.concatenate(n)))
                    now, key, n = bucket, key[:0], n[:0]
                key.append(keys[i].values.to_numpy())
                n.append(counts[i].values.to_numpy())
                if sum(map(len, key[1:])) > max(GROUPED, 2 * len(key[0])):
                    key, n = ([x] for x in _summed(np.concatenate(key), np.concatenate(n)))
        yield from blocks(*_summed(np.concatenate(key), np.concatenate(n)))

    def blocks(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        side, other = key // size, key % size
        # long lists are cut at every ``BLOCK`` units
        first = np.flatnonzero(np.diff(side * size + other // BLOCK, prepend=-1))
        place = side // 2
        side = (place % per * BUCKETS + place // per) * 2 + side % 2
        if len(first):
            ends, side = pa.array(np.append(first, len(side)), pa.int32()), side[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array((side // 2).astype(np.int32)), pa.array(side % 2 == 1), pa.ListArray.from_arrays(ends, pa.array(other.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(n))], names=["unit", "next", "other", "n"])

    if "bucket" not in pairs.columns:
        pairs = pairs.select("before", "after", F.col("n").cast("long")).mapInArrow(sided, PAIRS)
    # buckets are summed one by one, so a task holds the neighbours of a few words; what it reads follows ``PART_TOKENS``
    parts = max(-(-size * 2 * (classes + 2) // part_sums), -(-n_tokens // PART_TOKENS))
    return (pairs.repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "unit int, next boolean, other array<int>, n array<long>").checkpoint())


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit, next, other, n) of each neighbour in the batch."""
    other, n = batch.column(2), batch.column(3)
    row = pc.list_parent_indices(other).to_numpy()
    return (batch.column(0).to_numpy().astype(np.int64)[row], batch.column(1).to_numpy(zero_copy_only=False)[row],
            other.flatten().to_numpy(), n.flatten().to_numpy().astype(float))


def class_table(near: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    """Counts of (class before, class after); the classes after the words' are the end's and the rare words'."""
    words, d = len(cls) - 2, classes + 2
    shared = near.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total = shared.value, np.zeros(d * d)
        for batch in batches:
            unit, nxt, other, n = _entries(batch)
            keep = nxt | (other >= words)          # every pair once
            a, b = c[unit[keep]], c[other[keep]]
            total += np.bincount(np.where(nxt[keep], a * d + b, b * d + a), weights=n[keep], minlength=d * d)
        yield lines(total.reshape(d, d))

    def lines(part: np.ndarray) -> pa.RecordBatch:
        a = np.flatnonzero(part.any(axis=1))
        counts = pa.array(part[a].astype(np.int64).ravel())
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * d, pa.int32()), counts)],
                                          names=["before", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            np.add.at(total, batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, d))
        yield lines(total)

    # whole lines of the table are shuffled and summed, not single counts
    kind = "before int, n array<long>"
    got = near.mapInArrow(run, kind).repartition("before").mapInArrow(add, kind).toArrow()
    shared.unpersist()
    table = np.zeros((d, d))
    if got.num_rows:
        table[got["before"].to_numpy()] = got["n"].combine_chunks().flatten().to_numpy().reshape(-1, d)
    return table


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    return float(_plogp(table).sum() - _plogp(table.sum(axis=1)).sum() - _plogp(table.sum(axis=0)).sum())


def gains(after: np.ndarray, before: np.ndarray, own: np.ndarray, cls: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """(words, classes): likelihood with the word in each class, less that without the word.

    ``after`` and ``before`` are each word's neighbour counts by class without pairs of the word with itself, which
    ``own`` counts; ``table`` holds all words, each in its class ``cls``.
    """
    m, k = len(cls), classes
    at = np.arange(m)
    freq = after.sum(axis=1) + own
    out = np.zeros((m, k))
    for counts, reverse, t in ((after, before, table[:k].T), (before, after, table[:, :k])):
        # t[d, b]: the cell of neighbour class d and the word's class b
        w, d = np.nonzero(counts)
        x, own_class = counts[w, d], cls[w]
        gain = t[d] + x[:, None]
        gain *= np.log(gain)
        gain -= _plogp(t)[d]
        # the word itself is taken out: of the cell of its own class, and of the row where the neighbours have that class
        same = np.flatnonzero(d == own_class)
        ws, xs = w[same], x[same]
        row = t[d[same]] - reverse[ws, :k]
        row[np.arange(len(same)), cls[ws]] -= xs + own[ws]
        rest = t[d, own_class] - x
        gain[np.arange(len(w)), own_class] = _plogp(rest + x) - _plogp(rest)
        gain[same] = _plogp(row + xs[:, None]) - _plogp(row)
        if len(w):
            first = np.flatnonzero(np.diff(w, prepend=-1))
            out[w[first]] += np.add.reduceat(gain, first, axis=0)
    # the cell (b, b) gains from both sides at once
    w, b = np.nonzero((after[:, :k] > 0) & (before[:, :k] > 0) | (own > 0)[:, None])
    r, s, o = after[w, b], before[w, b], own[w]
    diag = table[b, b] - np.where(b == cls[w], r + s + o, 0)
    out[w, b] += _plogp(diag + r + s + o) - _plogp(diag + r) - _plogp(diag + s) + _plogp(diag)
    size = table[:, :k].sum(axis=0)
    change = _plogp(size + freq[:, None]) - _plogp(size)
    change[at, cls] = _plogp(size[cls]) - _plogp(size[cls] - freq)
    return out - 2 * change


def _moves(near: DataFrame, cls: np.ndarray, table: np.ndarray, classes: int, half: int) -> np.ndarray:
    """Classes after each word of one half has gone to its best class."""
    words, d = len(cls) - 2, classes + 2
    shared = near.sparkSession.sparkContext.broadcast((cls, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = shared.value
        held, wide = [], 2 * d + 1
        for batch in batches:
            unit, nxt, other, n = _entries(batch)
            turn = (unit < words) & (unit // classes % 2 == half)
            unit, nxt, other, n = unit[turn], nxt[turn], other[turn], n[turn]
            # pairs of a word with itself lie on both sides and count once
            kind = np.where(other == unit, np.where(nxt, 2 * d, -1), np.where(nxt, 0, d) + c[other])
            unit, row = np.unique(unit, return_inverse=True)
            held.append((unit, np.bincount((row * wide + kind)[kind >= 0], weights=n[kind >= 0], minlength=len(unit) * wide)))
        # no more than some ``PART_SUMS`` sums
        different = np.unique(np.concatenate([np.zeros(0, np.int64), *[unit for unit, _ in held]]))
        sums = np.zeros((len(different), wide))
        for unit, n in held:
            sums[np.searchsorted(different, unit)] += n.reshape(-1, wide)
        # words are decided together while their entries' gains fit a processor's cache
        for lo, hi in _runs(np.cumsum((sums > 0).sum(axis=1)) // ENTRIES):
            dense = sums[lo:hi]
            a = c[different[lo:hi]]
            g = gains(dense[:, :d], dense[:, d:2 * d], dense[:, 2 * d], a, t, classes)
            best = g.argmax(axis=1)
            at = np.arange(hi - lo)
            go = g[at, best] > g[at, a] + 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(different[lo:hi][go]), pa.array(best[go])], names=["unit", "class"])

    got = near.mapInArrow(run, "unit long, class long").toPandas()      # at most one row for each word of the head
    shared.unpersist()
    cls = cls.copy()
    cls[got["unit"].to_numpy(np.int64)] = got["class"].to_numpy(np.int64)
    return cls


def _runs(block: np.ndarray) -> Iterator[tuple[int, int]]:
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist()
    return ((lo, hi) for lo, hi in zip(bounds, bounds[1:]) if lo < hi)


def exchange(near: DataFrame, words: int, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class table) by exchange clustering of the neighbour counts."""
    cls = np.concatenate([np.arange(words) % classes, [classes + 1, classes]])
    table = class_table(near, cls, classes)
    best = (likelihood(table), cls, table)
    still = 0
    for i in range(rounds):
        moved = _moves(near, cls, table, classes, i % 2)
        still = still + 1 if (moved == cls).all() else 0
        if still == 2:
            break
        if still:
            continue
        cls, table = moved, class_table(near, moved, classes)
        # words that move at once may spoil each other's gain: the best round counts
        best = max(best, (likelihood(table), cls, table), key=lambda b: b[0])
    return best[1], best[2]


def steps(table: np.ndarray) -> np.ndarray:
    """[n - 1, cell]: what x log x of each cell gains when n is added, for small n."""
    old = _plogp(table)
    return np.stack([_plogp(table + n) - old for n in range(1, 1 + max(1, min(SMALL, TABLE_CELLS // max(1, table.size))))])


def gain_rows(step: np.ndarray, table: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(entries, classes): gain of adding ``n`` to the cells of row ``h``; most counts are small and need no logarithm."""
    out = step[np.minimum(n, len(step)) - 1, h]
    many = np.flatnonzero(n > len(step))
    if len(many):
        t = table[h[many]]
        out[many] = _plogp(t + n[many, None]) - _plogp(t)
    return out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places from each start on, ``n`` of them, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def word_bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket of each (not empty) word, by its bytes."""
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
    odd = np.random.default_rng(1).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = np.add.reduceat(data * odd[place % 64], ends[:-1] - ends[0])
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def rare_classes(texts: DataFrame, vocab: Vocabulary, cls: np.ndarray, table: np.ndarray, classes: int, types: int) -> DataFrame:
    """(word, n, cls, h, hn) of each word outside the head: its count, its class, and its counts by class before."""
    buckets, d = types // WORDS + 1, classes + 2
    shared = texts.sparkSession.sparkContext.broadcast((vocab, cls, table))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, c, _ = shared.value
        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                words, n = tokens(part.column(0))
                code, place, different = v.place(words)
                cur, prev, _ = _chain(place[code], n, v.end)
                far = np.flatnonzero(place == v.rare)
                row = np.zeros(len(place), np.int64)
                row[far] = np.arange(len(far))
                held.append((different.take(pa.array(far)), row[code[place[code] == v.rare]], c[prev[cur == v.rare]], None))
                rows += len(held[-1][1])
                if rows > GROUPED // 4:
                    yield from bucketed(*joined(held))
                    held, rows = [], 0
        if rows:
            yield from bucketed(*joined(held))

    def joined(held: list) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(words, word's place, h, n) with the sums of all that is held; without n, each entry counts once."""
        coded = pc.dictionary_encode(pa.chunked_array([w for w, *_ in held])).combine_chunks()
        start = np.cumsum([0] + [len(w) for w, *_ in held])
        place = coded.indices.to_numpy().astype(np.int64)
        key = np.concatenate([place[row + lo] * d + h for lo, (_, row, h, _) in zip(start, held)])
        if held[0][3] is None:
            key, n = np.unique(key, return_counts=True)
        else:
            key, n = _summed(key, np.concatenate([n for *_, n in held]))
        return coded.dictionary, key // d, key % d, n

    def bucketed(words: pa.Array, row: np.ndarray, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row per bucket: its words, how many entries each has, and the entries."""
        bucket = word_bucket(words, buckets)
        order = np.argsort(bucket, kind="stable")
        entries = np.bincount(row, minlength=len(words))
        at = _ranges((np.cumsum(entries) - entries)[order], entries[order])
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = np.append(first, len(order))
        lists, inner = pa.array(ends, pa.int32()), pa.array(np.append(0, np.cumsum(entries[order]))[ends], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[order][first]), pa.ListArray.from_arrays(lists, words.take(pa.array(order)).cast(pa.string())),
             pa.ListArray.from_arrays(lists, pa.array(entries[order], pa.int32())), pa.ListArray.from_arrays(inner, pa.array(h[at], pa.int32())),
             pa.ListArray.from_arrays(inner, pa.array(n[at], pa.int64()))], names=["bucket", "word", "entries", "h", "n"])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value[2][:, :classes]
        size, step = t.sum(axis=0), steps(t)
        for word, row, h, n in sums(batches):
            first = np.searchsorted(row, np.arange(len(word)))
            own, ends = np.zeros(len(word), np.int32), np.append(first, len(h))
            for lo, hi in _runs(ends[1:] // ENTRIES):
                part = slice(ends[lo], ends[hi])
                gain = np.add.reduceat(gain_rows(step, t, h[part], n[part]), first[lo:hi] - ends[lo], axis=0)
                total = np.add.reduceat(n[part], first[lo:hi] - ends[lo])[:, None].astype(float)
                own[lo:hi] = (gain - _plogp(size + total) + _plogp(size)).argmax(axis=1)
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [word, pa.array(np.add.reduceat(n, first)), pa.array(own), pa.ListArray.from_arrays(ends, pa.array(h.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(n))], names=["word", "n", "cls", "h", "hn"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, word's place, h, n) of one bucket after the other."""
        now, held, rows = -1, [], 0
        for batch in batches:
            _, words, entries, h, n = batch.columns
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if held and (bucket != now or rows > GROUPED):
                    whole = joined(held)
                    if bucket != now:
                        yield whole
                    held = [whole] if bucket == now else []
                    rows = 0
                now = bucket
                row = np.repeat(np.arange(len(words[i].values)), entries[i].values.to_numpy())
                held.append((words[i].values, row, h[i].values.to_numpy(), n[i].values.to_numpy()))
                rows += len(row)
        if held:
            yield joined(held)

    # the words of a bucket are summed together; a task holds one bucket, which has some ``WORDS`` words however large the corpus is
    grouped = (texts.select("text").mapInArrow(contexts, "bucket long, word array<string>, entries array<int>, h array<int>, n array<long>")
               .repartition("bucket").sortWithinPartitions("bucket"))
    return grouped.mapInArrow(assigned, "word string, n long, cls int, h array<int>, hn array<long>")


@dataclass
class Model:
    vocab: Vocabulary
    cls: np.ndarray          # unit -> class as context
    move: np.ndarray         # (class before, class or end) -> log10 of (1 - U) P(class | class before)
    size: np.ndarray         # tokens of each class
    new: np.ndarray          # spelling unit -> log10 of U P(unit | new word)
    tokens: int              # N
    types: int               # V
    end_count: int
    often: pa.Table          # (word, n, cls) of the most frequent words outside the head


def most_frequent(rare: DataFrame, limit: int = OFTEN) -> pa.Table:
    """(word, n, cls) of the words above the lowest count that at most ``limit`` words reach."""
    # one row for each different count: no more than the head's last word has occurrences
    by_n = rare.groupBy("n").agg(F.count("*").alias("v")).toPandas().sort_values("n", ascending=False)
    reached = by_n["n"][by_n["v"].cumsum() <= limit]
    least = int(reached.iloc[-1]) if len(reached) else None
    got = rare.where(F.lit(False) if least is None else F.col("n") >= least).select("word", "n", "cls").toArrow()
    return got.set_column(0, "word", got["word"].cast(pa.large_string())).combine_chunks()


def fit(docs: DataFrame, text_col: str = "text", head: int = HEAD, classes: int | None = None,
        rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """Model of all rows of ``docs`` and the stored table (word, n, cls, ...) of all words outside its head."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = stored(word_counts(texts), "words")
    n_docs = docs.count()
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(head).toPandas()
    vocab = Vocabulary(pa.array(top["word"], pa.large_string()), top["n"].to_numpy(np.int64))
    k = classes or class_count(total["v"])
    near = neighbours(unit_pairs(texts, vocab), vocab.rare, k, n_tokens=int(total["n"] or 0))
    cls, table = exchange(near, vocab.rare, k, rounds)
    rare = stored(rare_classes(texts, vocab, cls, table, k, total["v"]), "rare")
    # the rare words' tokens go to their classes
    full = table[:, :k + 1].copy()
    pairs = rare.select("cls", F.explode(F.arrays_zip("h", "hn")).alias("p")).groupBy("p.h", "cls").agg(F.sum("p.hn").alias("n"))
    for r in pairs.collect():                      # at most (classes + 2) x classes rows
        full[r["h"], r["cls"]] += r["n"]
    size = full.sum(axis=0)
    n_tokens = int(total["n"] or 0) + n_docs
    share = size / n_tokens if n_tokens else np.eye(k + 1)[k]
    new = (total["once"] + 0.5) / (n_tokens + 1)
    # at most SPELLINGS rows
    spelled = counts.groupBy(F.expr(spelling_sql("word")).alias("u")).agg(F.count("*").alias("v")).collect()
    units = np.full(SPELLINGS, 0.5)
    for r in spelled:
        units[r["u"]] += r["v"]
    with np.errstate(divide="ignore"):             # a class without words is never met
        move = np.log10((1 - new) * (full + PRIOR * share) / (full.sum(axis=1, keepdims=True) + PRIOR))
    return Model(vocab, cls, move, size, np.log10(new * units / units.sum()), n_tokens, int(total["v"]) + (n_docs > 0), n_docs,
                 most_frequent(rare)), rare


def score(docs: DataFrame, model: Model, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per row, over whole texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    key_type = dict(docs.dtypes)[id_col]
    k = len(model.size) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        # the looked-up words outside the head are units here, which share the rare words' class as context
        head, often = m.vocab.rare, len(m.often)
        v = Vocabulary(pa.concat_arrays([m.vocab.head, *m.often["word"].chunks]), np.append(m.vocab.count, m.often["n"].to_numpy()))
        before = np.concatenate([m.cls[:head], np.full(often, k + 1), [k + 1, k]])
        own = np.concatenate([m.cls[:head], m.often["cls"].to_numpy(), [k, k]])
        log_count = np.log10(np.append(v.count + 1.0, [1.0, m.end_count + 1.0]))
        # P(word | class) by unit: the end is alone in its class, the rare words come from their table
        emit = np.zeros(v.end + 1)
        emit[:v.rare] = np.log10(v.count / m.size[own[:v.rare]])
        for batch in batches:
            for part, n, code, place, different in v.placed(slices(batch, 2), 2):
                cur, prev, begin = _chain(place[code], n, v.end)
                far = cur == v.rare
                logp = np.where(far, 0.0, m.move[before[prev], own[cur]] + emit[cur])
                add = lambda w: np.add.reduceat(w, begin)
                known = add((~far & ((cur != v.end) | (m.end_count > 0))).astype(np.int64))
                rows = np.arange(len(n))
                # a text's own row carries a word that no text can hold (it begins with a space), so it is spread like the others
                yield emitted(part, rows, pa.array([f" {i}" for i in rows]), rows * 0, rows * 0, rows * 0.0, n + 1, known,
                              add(log_count[cur]), add(logp))
                # words that are not looked up: once per text and class before, with their number
                doc = np.repeat(rows, n)[far[cur != v.end]]
                word, h, types = code[place[code] == v.rare], before[prev[far]], max(1, len(different))
                pair, times = np.unique((doc * types + word) * (k + 2) + h, return_counts=True)
                doc, word = pair // (k + 2) // types, pair // (k + 2) % types
                nil = np.zeros(len(pair))
                yield emitted(part, doc, different.take(pa.array(word)), pair % (k + 2), times, m.new[spellings(different)][word],
                              nil, nil, nil, nil)

    def emitted(part, row, word, h, times, new, n_tokens, known, base, model_score) -> pa.RecordBatch:
        at = pa.array(row, pa.int64())
        f64 = lambda x: pa.array(np.asarray(x, float), pa.float64())
        i64 = lambda x: pa.array(np.asarray(x, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(at), part.column(1).take(at), word.cast(pa.string()), pa.array(np.asarray(h, np.int32)), i64(times),
             f64(new), i64(n_tokens), i64(known), f64(base), f64(model_score)],
            names=["rid", "key", "word", "h", "times", "new", "n_tokens", "known", "base", "model"])

    # the row number is the same in every run of a task, as it depends on the scan alone
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("key"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = rows.mapInArrow(run, f"rid long, key {key_type}, word string, h int, times long, new double, n_tokens long, known long, "
                                 "base double, model double")
    # (class before, class) -> log10 of P(class | class before) / tokens of the class
    h, c = np.nonzero(np.broadcast_to(model.size[:k] > 0, (k + 2, k)))
    moves = small_side(spark.createDataFrame(pa.table({"h": pa.array(h, pa.int32()), "cls": pa.array(c, pa.int32()),
                                                       "move": model.move[h, c] - np.log10(model.size[c])})))
    joined = parts.join(rare.select("word", "n", "cls"), "word", "left").join(moves, ["h", "cls"], "left").select(
        "rid", "key", "n_tokens", (F.col("known") + F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        (F.col("base") + F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("base"),
        (F.col("model") + F.col("times") * F.coalesce(F.col("move") + F.log10(F.col("n").cast("double")), "new")).alias("model"))
    room = float(np.log10(model.tokens + model.types + 1))
    out = joined.groupBy("rid", "key").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "model")])
    return out.select(F.col("key").alias(id_col), "n_tokens", F.col("known").alias("n_known"),
                      F.lit(model.tokens).cast("long").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * F.lit(room)).alias("base_score"), F.col("model").alias("score"))


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2,
                   **options) -> DataFrame:
    """Fit on the rows outside the held-out fold, score all rows; adds ``held_out`` and ``perplexity``."""
    model, rare = fit(docs.where(fold(id_col, modulus) != held), text_col, **options)
    out = score(docs, model, rare, id_col, text_col)
    return out.select(id_col, (fold(id_col, modulus) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                      "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
