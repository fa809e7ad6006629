"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree: contexts of up to
``ORDER`` bytes with the counts of the byte that followed.  A byte is coded in the longest context
that the language has seen; a byte new to a context costs its escape probability
(distinct / (total + distinct)) and is coded in the next shorter one, without the
bytes already excluded, down to equal odds over 256 bytes.  The statistics are
frozen after the fit, so a code length is a sum over positions and is looked up
in a table of exact costs (context x byte x language).  The language with the shortest
code of the whole text wins; the score is its posterior under equal priors.

The fit takes a sample of labelled rows, bounded by ``SAMPLE_DOCS`` documents a language
(those with the smallest hashes), and learns every language with a labelled row.  Each
language has a tree of its own of at most ``MAX_CONTEXTS`` contexts that it holds ``MIN_COUNT``
times, so no language displaces another's; trees are built and sent one by one, and a worker that
meets more than ``HELD`` languages does not keep their tables.  Counting and prediction run on
Spark, over whole texts.

Defined results: text null or without a letter gives ``und`` with score 0; with no labelled row
every document is ``und``; ties go to the smaller language name; repeated rows are
judged alike; language, source and id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, fresh, stored

ORDER = 3
SAMPLE_DOCS = 1500
MAX_CONTEXTS = 12_000  # a language
HELD = 16              # tables of some 12 MB that a worker keeps
MIN_COUNT = 4
UND = "und"
SLICE_BYTES = 1 << 19


def sample(labelled: DataFrame, per_lang: int = SAMPLE_DOCS, text_col: str = "text", lang_col: str = "lang",
           id_col: str = "doc_id") -> DataFrame:
    """(lang, text): about ``per_lang`` documents of each language.

    Documents whose hash is below per_lang / n: one count, then one filter; no group is gathered.
    """
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`")
    u = F.pmod(F.xxhash64(F.lit("ppm"), F.col(f"`{id_col}`").cast("string"), F.length(text)), F.lit(1 << 30)) / float(1 << 30)
    rows = (labelled.where(F.col(f"`{lang_col}`").isNotNull() & text.isNotNull())
            .select(lang.alias("lang"), text.cast("string").alias("text"), u.alias("u")))
    # one row a language
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "ppm-languages")
    return rows.join(F.broadcast(counts), "lang").where(F.col("u") < F.lit(float(per_lang)) / F.col("n")).select("lang", "text")


def _padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ``order`` zero bytes before each text; the places of true bytes; starts of the texts among those."""
    pad = b"\0" * order
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + order) - size
    place = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    return data, place, np.cumsum(size) - size


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of ``SLICE_BYTES`` together at most; a longer text stands alone."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE_BYTES):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): counts of every byte with the ``order`` bytes before it, as one integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                for lo, hi in _slices(texts):
                    data, place, _ = _padded(texts[lo:hi], order)
                    gram = np.zeros(len(place), np.int64)
                    for back in range(order, -1, -1):
                        gram = gram << 8 | data[place - back]
                    value, n = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(value), pa.string()), pa.array(value, pa.int64()), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"])
    return (rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    """Contexts are nodes 0..n-1; node of a place by two tables; cost[node, byte, language] in bits."""
    langs: list[str]
    order: int
    child: list[np.ndarray]   # child[k][node of order k, byte before] -> node of order k + 1, or -1
    cost: np.ndarray

    def nodes(self, data: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Longest known context before each place, stepping to older bytes."""
        node = np.zeros(len(place), np.int32)
        live = node
        for k in range(self.order):
            nxt = self.child[k][np.maximum(live, 0), data[place - 1 - k]]
            nxt = np.where(live >= 0, nxt, -1)
            node = np.where(nxt >= 0, nxt, node)
            live = nxt
        return node

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): code length of each whole text in bits."""
        out = np.zeros((len(texts), len(self.langs)))
        full = [i for i, t in enumerate(texts) if t]
        if full:
            out[full] = self.padded_bits(*_padded([texts[i] for i in full], self.order))
        return out

    def padded_bits(self, data: np.ndarray, place: np.ndarray, begin: np.ndarray) -> np.ndarray:
        row = self.nodes(data, place).astype(np.int64) * 256 + data[place]
        return np.add.reduceat(self.cost[row], begin, axis=0, dtype=np.float64)


def build(counts: dict[str, dict[int, int]], order: int = ORDER, max_contexts: int = MAX_CONTEXTS,
          min_count: int = MIN_COUNT) -> Model:
    """Context trees from the counts (lang -> gram -> n), costs in float32 bits; the bounds hold for each language."""
    langs = sorted(counts)
    # stat[k][context of k bytes] -> (byte x language) counts
    gram = np.array(sorted({g for c in counts.values() for g in c}), np.int64)
    n = np.array([[counts[x].get(g, 0) for x in langs] for g in gram.tolist()], np.float64).reshape(len(gram), len(langs))
    child = []
    # order 0 first: costs of a longer context need those of the shorter one
    level_nodes: list[dict[int, int]] = [{0: 0}]
    total_nodes = 1
    room = [max_contexts - 1] * len(langs)
    for k in range(1, order + 1):
        ctx = gram >> 8 & ((1 << 8 * k) - 1)
        value, inv = np.unique(ctx, return_inverse=True)
        chosen = np.zeros(len(value), bool)
        for j in range(len(langs)):
            seen = np.bincount(inv, weights=n[:, j], minlength=len(value))
            own = np.flatnonzero(seen >= min_count)
            own = own[np.argsort(-seen[own], kind="stable")][:max(0, room[j])]
            room[j] -= len(own)
            chosen[own] = True
        good = np.flatnonzero(chosen)
        # a context enters only below its shorter one (the newest bytes)
        parents = level_nodes[-1]
        mask = (1 << 8 * (k - 1)) - 1
        nodes: dict[int, int] = {}
        table = np.full((max(parents.values(), default=0) + 1, 256), -1, np.int32)
        for g in sorted(good.tolist()):
            v = int(value[g])
            p = parents.get(v & mask)
            if p is not None:
                nodes[v] = total_nodes
                table[p, v >> 8 * (k - 1)] = total_nodes
                total_nodes += 1
        child.append(table)
        level_nodes.append(nodes)
    table = np.zeros((total_nodes, 256, len(langs)), np.float64)
    for k, nodes in enumerate(level_nodes):
        if not nodes:
            continue
        keys = np.array(sorted(nodes), np.int64)
        ctx = gram >> 8 & ((1 << 8 * k) - 1)
        at = np.searchsorted(keys, ctx)
        inside = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == ctx)
        stat = np.zeros((len(keys), 256, len(langs)), np.float32)
        np.add.at(stat, (at[inside], gram[inside] & 255), n[inside])
        for i, key in enumerate(keys.tolist()):
            lower = np.full((256, len(langs)), 1 / 256) if k == 0 else table[level_nodes[k - 1][key & ((1 << 8 * (k - 1)) - 1)]]
            c = stat[i].astype(np.float64)
            total, kinds = c.sum(axis=0), (c > 0).sum(axis=0)
            rest = np.where(c > 0, 0.0, lower)
            left = rest.sum(axis=0)
            known = total > 0
            denominator = np.where(known, total + kinds, 1)
            escape = np.where(known & (left > 0), kinds / denominator, 0)
            seen_p = np.where(known & (left <= 0), 1 / np.maximum(total, 1), 1 / denominator)
            table[nodes[key]] = np.where(known, c * seen_p + rest * np.where(left > 0, escape / np.where(left > 0, left, 1), 0), lower)
    return Model(langs, order, child, (-np.log2(np.maximum(table, 1e-30))).astype(np.float32).reshape(-1, len(langs)))


@dataclass
class Fitted:
    """Languages by name, and the model of each on the shared side."""
    langs: list[str]
    models: list[Broadcast]
    order: int

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): code length of each whole text in bits."""
        out = np.zeros((len(texts), len(self.langs)))
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        padded = _padded([texts[i] for i in full], self.order)
        for j, shared in enumerate(self.models):
            out[full, j] = shared.value.padded_bits(*padded)[:, 0]
            if len(self.models) > HELD:
                vars(shared).pop("_value", None)   # read again from the worker's disk at the next use
        return out


def fit(spark: SparkSession, labelled: DataFrame, per_lang: int = SAMPLE_DOCS, text_col: str = "text",
        lang_col: str = "lang", id_col: str = "doc_id", order: int = ORDER) -> Fitted | None:
    """Frozen statistics of the sample; None without labelled text.  The driver holds one language at a time."""
    counts = stored(gram_counts(sample(labelled, per_lang, text_col, lang_col, id_col), order), "ppm-grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    models = []
    for lang in langs:
        own = counts.where(F.col("lang") == lang).select("gram", "n").toPandas()
        models.append(spark.sparkContext.broadcast(build({lang: dict(zip(own["gram"].tolist(), own["n"].tolist()))}, order)))
    return Fitted(langs, models, order) if langs else None


def predictor(spark: SparkSession, model: Fitted | None):
    """Column function text -> struct<lang, score, bits_per_byte> by the frozen model."""
    def run(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model
        for arr in col:
            texts = [(t or "").encode() for t in arr.to_pylist()]
            lang, score, rate = [], [], []
            for lo, hi in _slices(texts):
                bits = m.bits(texts[lo:hi]) if m is not None else np.zeros((hi - lo, 1))
                best = bits.argmin(axis=1)
                least = bits[np.arange(hi - lo), best]
                odds = np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
                lang += [m.langs[b] if m is not None else UND for b in best]
                score += (1 / odds if m is not None else 0 * odds).tolist()
                rate += [x / max(1, len(t)) for x, t in zip(least.tolist(), texts[lo:hi])]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                                             names=["lang", "score", "rate"])

    udf = F.arrow_udf(run, "struct<lang:string,score:double,rate:double>")

    def predict(text: Column) -> Column:
        letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
        return F.when(letters, udf(F.when(letters, text))).otherwise(
            F.struct(F.lit(UND).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("rate")))
    return predict


def identify(docs: DataFrame, predict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (underscores in front where ``docs`` has such columns)."""
    tmp = fresh(docs, "_p")
    p = docs.withColumn(tmp, predict(F.col(f"`{text_col}`").cast("string")))
    return p.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{tmp}.lang").alias(fresh(docs, "lang_pred")),
                    F.col(f"{tmp}.score").alias(fresh(docs, "score")))


def drop_rejected(docs: DataFrame, predict, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is known with at least ``min_score``."""
    tmp = fresh(docs, "_p")
    p = docs.withColumn(tmp, predict(F.col(f"`{text_col}`").cast("string")))
    return p.where((F.col(f"{tmp}.lang") != UND) & (F.col(f"{tmp}.score") >= min_score)).drop(tmp)


def training_rows(docs: DataFrame, id_col: str = "doc_id", modulus: int = 4, held: int = 2) -> DataFrame:
    """Rows outside the held-out fold."""
    return docs.where(fold(id_col, modulus) != held)
