"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Words (runs of letters, of digits, or of other signs) fall into ``BUCKETS`` hash
buckets by word and shape. Each bucket has a fixed sparse random index vector; a
bucket's word vector is the sum of the index vectors of its neighbours within ``REACH``
words, over all documents. A document pools its words' vectors, frequent words
weighted down, and adds logarithms of its length and of its share of distinct
words, and the share of words that repeat the one before. A two-layer numpy network is fitted on a bounded, seeded sample of labelled
rows (``SAMPLE_ROWS``); a temperature fitted on a part of the sample that the
network hasn't seen calibrates its probabilities.

Edge cases: null and empty texts pool to zeros and get a score like any other; texts of
any length are read whole; rows without a label, or with a null one, are scored but
not learned from; with no labels, or one class only, the score is the share of
that class, 0.5 if there is none; repeated ids are rows of their own, and a label
given twice counts twice; an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from junctura.llm.batches import bounded

BUCKETS = 8192
DIMENSIONS = 48
REACH = 2
MORE = 3  # features besides the pooled vector
SAMPLE_ROWS = 12_000
HIDDEN = 24
TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_MEMO = 200_000

_draw = np.random.Generator(np.random.PCG64(77))
#: Two places and signs of each bucket's index vector.
PLACES = np.stack([_draw.integers(0, DIMENSIONS, BUCKETS), _draw.integers(0, DIMENSIONS, BUCKETS)], 1)
SIGNS = _draw.choice(np.array([-1.0, 1.0]), (BUCKETS, 2))


class _Buckets(dict):
    """Word to bucket, remembered for a bounded number of words. Words all in capitals are words of their own."""

    def __missing__(self, word: str) -> int:
        shape = "^" + word.lower() if len(word) > 1 and word.isupper() else word.lower()
        bucket = zlib.crc32(shape.encode()) * 2654435761 % 2**32 % BUCKETS
        if len(self) < _MEMO:
            self[word] = bucket
        return bucket


def buckets_of(text: str | None, memo: _Buckets) -> np.ndarray:
    words = TOKENS.findall(text or "")
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def _cooccur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums: for each bucket its count and the sums of its neighbours' index vectors."""
    memo, total, counts = _Buckets(), np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS)
    gap = np.full(REACH, -1)

    def flush(docs: list[np.ndarray]) -> None:
        nonlocal total, counts
        ids = np.concatenate([x for d in docs for x in (d, gap)])
        counts += np.bincount(ids[ids >= 0], minlength=BUCKETS)
        for step in range(1, REACH + 1):
            a, b = ids[:-step], ids[step:]
            both = (a >= 0) & (b >= 0)
            a, b = a[both], b[both]
            for one, other in ((a, b), (b, a)):
                for k in (0, 1):
                    total += np.bincount(one * DIMENSIONS + PLACES[other, k], SIGNS[other, k], minlength=BUCKETS * DIMENSIONS)

    docs, held = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            docs.append(buckets_of(text, memo))
            held += len(docs[-1])
            if held > 1_000_000:
                flush(docs)
                docs, held = [], 0
    if docs:
        flush(docs)
    used = np.flatnonzero(counts)
    sums = total.reshape(BUCKETS, DIMENSIONS)[used].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used].astype(np.int64)), *[pa.array(sums[:, i]) for i in range(DIMENSIONS)]], names=["bucket", "n", *[f"d{i}" for i in range(DIMENSIONS)]])


@dataclass
class WordVectors:
    vectors: np.ndarray  # unit vectors by bucket, scaled by the bucket's weight

    def pool(self, ids: np.ndarray) -> np.ndarray:
        """Features of a document of these buckets."""
        if not len(ids):
            return np.zeros(DIMENSIONS + MORE, np.float32)
        mean = self.vectors[ids].mean(axis=0)
        distinct = np.count_nonzero(np.bincount(ids, minlength=BUCKETS))
        return np.concatenate([mean, [np.log1p(len(ids)) / 10, np.log(distinct / len(ids)), np.mean(ids[1:] == ids[:-1]) if len(ids) > 1 else 0.0]]).astype(np.float32)


def word_vectors(df: DataFrame, text: str) -> WordVectors:
    """Random indexing over all texts. A row per bucket and task is shuffled; a table of fixed size reaches the driver."""
    columns = [f"d{i}" for i in range(DIMENSIONS)]
    schema = ", ".join(["bucket long", "n long", *[f"{c} long" for c in columns]])
    sums = bounded(df).select(text).mapInArrow(_cooccur, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", *columns]])
    table = sums.toPandas()
    ids, counts = table["bucket"].to_numpy(int), np.zeros(BUCKETS)
    counts[ids] = table["n"].to_numpy(float)
    raw = np.zeros((BUCKETS, DIMENSIONS))
    raw[ids] = table[columns].to_numpy(float)
    share = counts / max(1.0, counts.sum())
    vectors = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9) * (1e-3 / (1e-3 + share))[:, None]
    return WordVectors(vectors.astype(np.float32))


@dataclass
class Classifier:
    words: WordVectors
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        z = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -40, 40)))


def train(words: WordVectors, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3) -> Classifier:
    """Full passes of mini-batch Adam with weight decay; every fifth row is kept for the temperature."""
    draw = np.random.default_rng(seed)
    n = x.shape[1]
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        bias = float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -14, 14))
        return Classifier(words, np.zeros(n), np.ones(n), np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), bias, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    kept = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[kept])) < 2 or len(np.unique(y[~kept])) < 2:
        kept[:] = False
    z = (x - mean) / scale
    tx, ty = z[~kept], y[~kept].astype(float)
    p = [draw.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        order = draw.permutation(len(ty))
        for at in range(0, len(order), 128):
            i = order[at : at + 128]
            h = np.tanh(tx[i] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - ty[i]) / len(i)
            back = np.outer(g, p[2]) * (1 - h**2)
            grads = [tx[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], g.sum(keepdims=True)]
            step += 1
            for k, d in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                p[k] = p[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Classifier(words, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if kept.any():
        logit = np.tanh(z[kept] @ p[0] + p[1]) @ p[2] + p[3]
        losses = {t: np.logaddexp(0, np.where(y[kept] == 1, -logit, logit) / t).mean() for t in np.geomspace(0.25, 8, 61)}
        net.temperature = float(min(losses, key=losses.get))
    return net


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the key as text leaves no remainder by 5; null keys count as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str) -> Classifier:
    """Word vectors from all texts, the network from a sample of labelled rows that aren't held out.

    The sample is the ``SAMPLE_ROWS`` smallest by a hash of the key; their features are
    pooled on the executors, and only these reach the driver.
    """
    words = word_vectors(df, text)
    shared = df.sparkSession.sparkContext.broadcast(words)
    marks = labels.select(F.col(label_key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key")))
    marks = marks.orderBy(F.xxhash64(F.lit(9), "key"), "key", "label").limit(SAMPLE_ROWS)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(marks), "key").select("key", "text", "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets()
        for batch in batches:
            x = [shared.value.pool(buckets_of(t, memo)).astype(np.float64).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["key", "x", "label"])

    got = rows.mapInArrow(features, f"key {df.schema[key].dataType.simpleString()}, x array<double>, label int").orderBy(F.xxhash64(F.lit(9), "key"), "key", "label").limit(2 * SAMPLE_ROWS).toPandas()
    got = got.assign(order=[zlib.crc32(str(k).encode()) for k in got["key"]]).sort_values(["order", "key", "label"]) if len(got) else got
    x = np.array(got["x"].tolist(), float).reshape(len(got), DIMENSIONS + MORE)
    return train(words, x, got["label"].to_numpy(int))


def score_quality(df: DataFrame, key: str, text: str, net: Classifier, threshold: float = 0.3) -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo, model = _Buckets(), shared.value
        for texts in batches:
            x = np.array([model.words.pool(buckets_of(t, memo)) for t in texts], float).reshape(len(texts), DIMENSIONS + MORE)
            yield pd.Series(model.scores(x))

    rows = bounded(df).select(F.col(key), score(F.col(text)).alias("score"))
    return rows.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
