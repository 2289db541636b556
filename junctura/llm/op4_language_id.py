"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, all of them scored.
The network embeds bytes, applies filters of widths 2 and 4, takes the maximum of
each filter over a window, and a softmax over the languages. A text's log
probabilities are the means of its windows', weighted by their bytes. Training is
plain numpy (Adam) on windows of a bounded, seeded sample of labelled rows,
``SAMPLE_ROWS`` at most, drawn evenly over the languages; for scoring the filters
become tables over byte pairs, which give the same sums.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; very
long texts are scored whole, ``CHUNK`` windows at a time; a null language is never
learned; without any labelled row everything is ``und``; repeated rows and ids are
independent; an empty table gives no rows. ``predict_languages`` carries only the key;
``with_language`` keeps all columns and adds a struct under a name of the caller's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from junctura.llm.batches import bounded, forget, give_back

WINDOW = 256
WIDTH = 8  # of the byte embedding
FILTERS = 16  # of each width
SAMPLE_ROWS = 4000
#: Most languages that are learned; each has a row in the sample at least.
LANGUAGES = 4000
CHUNK = 64
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    short: np.ndarray
    long: np.ndarray
    short_bias: np.ndarray
    long_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def _im2col(x: np.ndarray, width: int) -> np.ndarray:
    n, length, e = x.shape
    return np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * e), x.strides)


def train(texts: list[str], languages: list[str], epochs: int = 6, seed: int = 11) -> Network:
    """Fits the network on windows of the given texts; half of them cut to a random shorter length."""
    draw = np.random.default_rng(seed)
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages])
    raw = np.zeros((len(texts), WINDOW), np.uint8)
    for row, text in zip(raw, texts):
        data = text.encode()[:WINDOW]
        row[: len(data)] = np.frombuffer(data, np.uint8)
    p = {
        "embed": draw.normal(0, 0.5, (256, WIDTH)),
        "short": draw.normal(0, 1 / np.sqrt(2 * WIDTH), (2 * WIDTH, FILTERS)),
        "long": draw.normal(0, 1 / np.sqrt(4 * WIDTH), (4 * WIDTH, FILTERS)),
        "short_bias": np.zeros(FILTERS),
        "long_bias": np.zeros(FILTERS),
        "dense": draw.normal(0, 0.2, (2 * FILTERS, len(names))),
        "dense_bias": np.zeros(len(names)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names)))).astype(np.float32)
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(order), CHUNK):
            pick = order[at : at + CHUNK]
            bytes_ = raw[pick].copy()
            cut = draw.integers(16, 2 * WINDOW, len(pick))
            bytes_[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            x = p["embed"][bytes_] * (bytes_ > 0)[..., None]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            pooled, places = [], []
            for name, width in (("short", 2), ("long", 4)):
                out = _im2col(x, width) @ p[name] + p[f"{name}_bias"]
                where = out.argmax(axis=1)
                places.append(where)
                pooled.append(np.take_along_axis(out, where[:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, axis=1)
            act = np.maximum(h, 0)
            z = act @ p["dense"] + p["dense_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(pick)), y[pick]] -= 1
            z *= weight[y[pick]][:, None] / len(pick)
            grads["dense"], grads["dense_bias"] = act.T @ z, z.sum(axis=0)
            back = (z @ p["dense"].T) * (h > 0)
            for i, (name, width) in enumerate((("short", 2), ("long", 4))):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                rows = np.arange(len(pick))[:, None, None]
                at_bytes = places[i][:, :, None] + np.arange(width)
                seen = x[rows, at_bytes].reshape(len(pick), FILTERS, -1)
                grads[name] = np.einsum("nfk,nf->kf", seen, g)
                grads[f"{name}_bias"] = g.sum(axis=0)
                spread = (g[:, :, None] * p[name].T[None]).reshape(len(pick), FILTERS, width, WIDTH)
                ids = bytes_[rows, at_bytes]
                np.add.at(grads["embed"], ids, spread * (ids > 0)[..., None])
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                p[k] -= 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return Network(names, **p)


class Scorer:
    """The network with its filters as tables over byte pairs."""

    def __init__(self, net: Network):
        embed = net.embed.copy()
        embed[0] = 0
        pairs = np.concatenate([np.repeat(embed, 256, axis=0), np.tile(embed, (256, 1))], axis=1)
        self.short = (pairs @ net.short + net.short_bias).astype(np.float32)
        self.ahead = (pairs @ net.long[: 2 * WIDTH] + net.long_bias).astype(np.float32)
        self.behind = (pairs @ net.long[2 * WIDTH :]).astype(np.float32)
        self.dense, self.dense_bias = net.dense, net.dense_bias

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Log probabilities of each row of ``WINDOW`` bytes."""
        out = np.empty((len(data), len(self.dense_bias)), np.float32)
        for i in range(0, len(data), CHUNK):
            b = data[i : i + CHUNK].astype(np.int32)
            pair = (b[:, :-1] << 8) | b[:, 1:]
            wide = self.ahead[pair[:, :-2]]
            wide += self.behind[pair[:, 2:]]
            h = np.concatenate([self.short[pair].max(axis=1), wide.max(axis=1)], axis=1)
            z = np.maximum(h, 0) @ self.dense + self.dense_bias
            z -= z.max(axis=1, keepdims=True)
            out[i : i + CHUNK] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        """Probabilities of each text."""
        encoded = [t.encode() for t in texts]
        counts = np.array([max(1, -(-len(e) // WINDOW)) for e in encoded], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        data = bytearray(int(starts[-1]) * WINDOW)
        for e, s in zip(encoded, starts):
            data[s * WINDOW : s * WINDOW + len(e)] = e
        logs = self.windows(np.frombuffer(data, np.uint8).reshape(-1, WINDOW)).astype(np.float64)
        sizes = np.full(int(starts[-1]), float(WINDOW))
        sizes[starts[1:] - 1] = [max(1, len(e) - (c - 1) * WINDOW) for e, c in zip(encoded, counts)]
        logs = np.add.reduceat(logs * sizes[:, None], starts[:-1], axis=0) / np.add.reduceat(sizes, starts[:-1])[:, None]
        out = np.exp(logs - logs.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the key as text leaves no remainder by 5; null keys count as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def quota_of(counts: list[int], rows: int) -> int:
    """The greatest number of rows of each language, 1 at least, with which all languages give ``rows`` at most."""
    left, level = rows, 1
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) > left:
            return max(level, left // (len(counts) - k))
        left, level = left - n, n
    return level


def sample(df: DataFrame, key: str, text: str, language: str, rows: int = SAMPLE_ROWS, salt: int = 5) -> list[tuple[float, str, str, str]]:
    """``luck, language, w1, w2`` of the rows to learn from: some of those that aren't held out and have a language and a text.

    Counts by language come first. Each language has a quota, as even as the counts allow, of ``rows`` in all and 1 at least; a language with no more rows
    than its quota is taken whole. Rows are drawn by a hash of the text at a rate a little above the quota, and of these the least hashes stay, each language by
    itself, so no language's rows are cut for another's, however the rows are partitioned. Of each drawn text two
    windows from anywhere in it reach the driver. Of more than ``LANGUAGES`` languages the most frequent are learned.
    """
    learn = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(language).alias("language")).filter(F.col("language").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("key")))
    counts = {r["language"]: r["count"] for r in learn.groupBy("language").count().orderBy(F.desc("count"), "language").limit(LANGUAGES).collect()}
    if not counts:
        return []
    quota = quota_of(list(counts.values()), rows)
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 1.0 if n <= quota else min(1.0, (quota + 6 * math.sqrt(quota) + 6) / n))])
    luck = (F.shiftrightunsigned(F.xxhash64(F.lit(salt), "text", F.col("key").cast("string")), 11) / float(1 << 53)).alias("luck")
    place = lambda salt: (1 + F.pmod(F.xxhash64(F.lit(salt), "text"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1)))).cast("int")
    windows = [F.substr("text", place(s), F.lit(WINDOW)).alias(f"w{s}") for s in (1, 2)]
    drawn = learn.withColumn("luck", luck).filter(F.col("luck") < F.try_element_at(rates, F.col("language"))).select("language", "luck", *windows)
    rank = F.row_number().over(W.partitionBy("language").orderBy("luck", "w1", "w2"))
    return sorted(tuple(r) for r in drawn.withColumn("rank", rank).filter(F.col("rank") <= quota).select("luck", "language", "w1", "w2").collect())


def fit(df: DataFrame, key: str, text: str, language: str) -> Network | None:
    """Trains on two windows of each row of the ``sample``; None if there is none."""
    rows = sample(df, key, text, language)
    if not rows:
        return None
    texts = [t for r in rows for t in r[2:]]
    return train(texts, [r[1] for r in rows for _ in (1, 2)])


def language_of(df: DataFrame, text: str, net: Network | None) -> Column:
    """A struct ``language, score`` for each text."""
    if net is None:
        return F.struct(F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("score"))
    shared = bounded(df, lean=True).sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("language string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        scorer = Scorer(shared.value)
        names = np.array(shared.value.languages, object)
        for texts in batches:
            found, scores = [], []
            for i in range(0, len(texts), 512):
                p = scorer.texts(texts.iloc[i : i + 512].fillna("").tolist())
                best = p.argmax(axis=1)
                found += names[best].tolist()
                scores += p[np.arange(len(p)), best].tolist()
            yield pd.DataFrame({"language": found, "score": scores})
        give_back()

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    said = predict(F.col(text))
    return F.struct(F.when(lettered, said["language"]).otherwise(UNKNOWN).alias("language"), F.when(lettered, said["score"]).otherwise(0.0).alias("score"))


def predict_languages(df: DataFrame, key: str, text: str, net: Network | None) -> DataFrame:
    """``key, held_out, lang_pred, score`` of every row."""
    rows = df.select(F.col(key), F.col(text).alias("text"))
    rows = rows.withColumn("said", language_of(rows, "text", net))
    return rows.select(key, held_out(F.col(key)).alias("held_out"), F.col("said.language").alias("lang_pred"), F.col("said.score").alias("score"))


def with_language(df: DataFrame, text: str, net: Network | None, name: str) -> DataFrame:
    """``df`` with the prediction as struct column ``name``."""
    return df.withColumn(name, language_of(df, text, net))
