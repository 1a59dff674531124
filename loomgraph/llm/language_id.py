"""Language ID (operator 1): averaged hashed subword embeddings with a linear softmax, trained in numpy by SGD.

A text is its lower-cased words, each between two boundary marks; its subwords are the 1- to 3-grams of these, hashed into
``BUCKETS`` rows of an embedding matrix. The mean of a text's subword rows goes through a linear softmax. The confidence is
calibrated by a temperature fitted on training documents that were set aside, and a text is rejected if its calibrated
confidence is under a threshold taken from the same documents. As the classifier is linear, bucket rows times output matrix
give one small table of logits by bucket, which is what the workers look up: about 1 MB with four languages, whatever the input.

Training uses at most ``PER_LANG`` labelled rows of each language, those with the least hashes of doc_id; this bound is a
parameter, and what the driver gets of each is a share for each bucket. Every document is read whole, in training and in prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import common as C

BUCKETS, DIM, PER_LANG = 1 << 16, 16, 400
EPOCHS, RATE = 12, 0.5
UNKNOWN = "und"
_GRAMS = (1, 2, 3)

_CODES = np.arange(0x110000, dtype=np.uint32)
_LETTER: list[np.ndarray] = []


def _letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter; its lower case (itself where lower-casing gives more than one)."""
    if not _LETTER:
        is_letter, low = np.zeros(0x110000, bool), _CODES.copy()
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            x = chr(c)
            if x.isalpha():
                is_letter[c] = True
                y = x.lower()
                if len(y) == 1:
                    low[c] = ord(y)
        _LETTER.extend([is_letter, low])
    return _LETTER[0], _LETTER[1]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all subwords of all texts, and where each text's begin (one more entry than texts)."""
    is_letter, low = _letter_table()
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 1 for t in texts])
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    c = np.where(is_letter[cp], low[cp], np.uint32(32)).astype(np.uint64)
    c = np.concatenate([np.full(1, 32, np.uint64), c])
    blank = c == 32
    # Runs of blanks count once: a blank stays if a letter follows or precedes it.
    near = ~blank
    keep = near.copy()
    keep[:-1] |= near[1:]
    keep[1:] |= near[:-1]
    at = np.searchsorted(np.flatnonzero(keep), off + 0)
    c = c[keep]
    blank = c == 32
    out, where = [], []
    for n in _GRAMS:
        if len(c) < n:
            continue
        h = c[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[k : len(c) - n + 1 + k]
        ok = ~blank[: len(h)]
        if n > 1:
            ok = ~(blank[: len(h)] & blank[n - 1 : n - 1 + len(h)])
            for k in range(1, n - 1):
                ok &= ~blank[k : k + len(h)]
        i = np.flatnonzero(ok)
        out.append((C.mix(h[i]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        where.append(np.searchsorted(i, at))
    if not out:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    total = np.sum(where, axis=0)
    flat = np.empty(total[-1] - total[0], np.int32)
    begin = total - total[0]
    for t in range(len(texts)):
        p = begin[t]
        for o, w in zip(out, where, strict=True):
            q = o[w[t] : w[t + 1]]
            flat[p : p + len(q)] = q
            p += len(q)
    return flat, begin


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: bucket numbers, shares of the text's subwords, and where each text's begin."""
    flat, begin = subwords(texts)
    ids, share, off = [], [], [0]
    for t in range(len(texts)):
        u, n = np.unique(flat[begin[t] : begin[t + 1]], return_counts=True)
        ids.append(u)
        share.append((n / max(1, n.sum())).astype(np.float32))
        off.append(off[-1] + len(u))
    return np.concatenate(ids), np.concatenate(share), np.array(off)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class Model:
    """``table``: logits by bucket (BUCKETS x languages), ``bias``, ``temperature``, ``threshold``, ``langs``."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and how many subwords it has."""
        flat, begin = subwords(texts)
        n = np.diff(begin)
        x = np.zeros((len(texts), len(self.langs)), np.float64)
        some = np.flatnonzero(n)
        if len(some):
            for k in range(len(self.langs)):
                x[some, k] = np.add.reduceat(self.table[:, k][flat], begin[:-1][some]) / n[some]
        return x + self.bias, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated confidence and rejection of each text."""
        x, n = self.logits([t or "" for t in texts])
        p = _softmax(x / self.temperature)
        best = p.argmax(axis=1)
        none = n == 0
        score = np.where(none, 0.0, p[np.arange(len(p)), best]) if len(p) else np.zeros(0)
        return [UNKNOWN if z else self.langs[b] for b, z in zip(best, none, strict=True)], score, none | (score < self.threshold)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """Fit on three quarters of the texts, given by bucket numbers and shares; temperature and threshold come from the rest.

    One language or none is allowed.
    """
    langs = sorted(set(labels))
    if not langs:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    order = rng.permutation(len(y))
    fit, held = (order, order) if len(y) < 8 * len(langs) else (order[len(y) // 4 :], order[: len(y) // 4])
    weight = len(fit) / (len(langs) * np.maximum(1, np.bincount(y[fit], minlength=len(langs))))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            u, s = rows[i]
            if not len(u):
                continue
            h = s @ e[u]
            g = _softmax(h @ w + bias)
            g[y[i]] -= 1
            g *= min(4.0, weight[y[i]])
            back = w @ g
            w -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            e[u] -= rate * 10 * s[:, None] * back
    seen = np.zeros(BUCKETS, bool)
    for i in fit:
        seen[rows[i][0]] = True
    e[~seen] = 0  # subwords that training never met say nothing
    model = Model(langs, (e @ w).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    held = [i for i in held if len(rows[i][0])]
    if held:
        x, t = np.array([rows[i][1] @ model.table[rows[i][0]] for i in held], np.float64) + model.bias, y[held]
        loss = lambda q: -np.log(np.maximum(1e-12, _softmax(x / q)[np.arange(len(t)), t])).mean()
        grid = np.geomspace(0.5, 10, 61)  # languages that are told apart without fault would sharpen it without end
        model.temperature = float(grid[np.argmin([loss(q) for q in grid])])
        p = _softmax(x / model.temperature)
        sure = p.max(axis=1)[p.argmax(axis=1) == t]
        # No more than one in two hundred rightly recognised texts may be lost, and never one that is more likely right than wrong.
        model.threshold = float(min(0.5, np.quantile(sure, 0.005))) if len(sure) else 0.0
    return model


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(lang, doc_id, text) of at most ``per_lang`` labelled rows of each language, those with the least hashes of doc_id, then of text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text"))
    keyed = known.withColumn("at", F.struct(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.xxhash64("text").alias("t")))
    place = F.row_number().over(W.partitionBy("lang").orderBy("at"))
    # The last place of each language is found without the texts: each task keeps its own first ones only.
    last = keyed.select("lang", "at").withColumn("k", place).filter(F.col("k") <= per_lang).groupBy("lang").agg(F.max("at").alias("last"))
    # A row for each language, of which the model holds a column of BUCKETS numbers anyway.
    near = keyed.join(F.broadcast(last), "lang").filter(F.col("at") <= F.col("last"))
    return near.withColumn("k", place).filter(F.col("k") <= per_lang).select("lang", "doc_id", "text")


def fitted(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """The model of a bounded sample. What reaches the driver for a text is its buckets' shares, not the text: ``BUCKETS`` pairs at most."""
    C.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in C.slices(texts, 1 << 19):
                ids, share, off = _counts(texts[a:b])
                lists = [pa.ListArray.from_arrays(off.astype(np.int32), pa.array(x)) for x in (ids, share)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], ["lang", "ids", "share"])

    found = sample(docs, per_lang).select("lang", "text").mapInArrow(run, "lang string, ids array<int>, share array<float>").collect()
    rows = sorted((r["lang"], r["ids"], r["share"]) for r in found)
    return train([(np.array(i, np.int32), np.array(s, np.float32)) for _, i, s in rows], [lang for lang, _, _ in rows])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """lang_pred, score, rejected beside ``keys`` (all columns but text) of each row; only the text is looked at."""
    spark = docs.sparkSession
    C.small_batches(spark)
    sent = spark.sparkContext.broadcast((model.langs, model.table, model.bias, model.temperature, model.threshold))

    def run(batches):
        m = Model(*sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores, out = [], [], []
            for a, b in C.slices([t or "" for t in texts], 1 << 19):
                p, s, r = m.predict(texts[a:b])
                langs += p
                scores.append(s)
                out.append(r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(out) if out else [], pa.bool_())],
                ["key", "lang_pred", "score", "rejected"],
            )

    out = StructType([StructField("key", docs.schema["key"].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return docs.select("key", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every input row.

    The model learns from rows whose crc32(doc_id) mod 4 is not 2 and whose lang is known. ``und`` with score 0, rejected: a
    null text or one without letters. Rows that repeat are judged alike; a null doc_id is not held out and not learned
    from. Without any label everything is ``und``. Empty input gives no rows.
    """
    model = fitted(docs.filter(F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id"))), per_lang)
    found = predicted(docs.select(F.col("doc_id").alias("key"), "text"), model)
    return found.select(F.col("key").alias("doc_id"), _held_out(F.col("key")).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the language identifier rejects go; the others stay as they came.

    Null and empty texts and those without letters are rejected; texts of any length are read whole; rows that repeat, or tie, are
    judged alike; other columns may have any name. An empty table, or one without labels, teaches nothing: then only what has
    letters stays.
    """
    model = fitted(docs.filter(F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id"))))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("key"), "text")
    return predicted(whole, model).filter("not rejected").select("key.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.table(spark, sf_dir, "documents"))
