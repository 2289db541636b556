"""Toxicity: maximum-scoring segments of token log-odds, aggregated by extreme-value calibration.

Tokens are runs of letters and digits. The numbers of toxic and clean labelled texts that hold them give each a log-odds
score under Dirichlet priors in a chain: a word's prior is its first ``STEMS[-1]`` characters' estimate, theirs is that of fewer characters, and the
first prior is that a token is as frequent in both classes. So a word that was never seen is scored
by its stem. A drift is taken off each token, so clean text has a falling sum; a linear-time scan then finds all maximal-scoring
segments of a document, and each is a passage whose significance follows from extreme-value theory: in clean
text of n tokens, E = K n exp(-lambda S) segments reach the score S by chance. ``lambda`` solves
the sum of p(s) exp(lambda s) = 1 over the clean tokens' scores, K is the likeliest value given the clean documents' best segments. A
document's evidence is the sum of -ln E over its passages with E below 1; a logistic curve of its logarithm gives the probability.

The model learns from ``CLASS_ROWS`` labelled rows of each class at most that aren't held out, those with the least hashes of their keys: the
curve from a tenth of them, the counts from the others. Counts are kept by hash in ``BUCKETS`` places, so the model has a fixed size whatever the vocabulary.

Edge cases: null and empty texts, and texts without letters or digits, have no passage and the curve's least probability; texts of any length are read whole; rows without
a label, or with a null one, are scored but not learned from; with one class only, or no labels, each score is the share of
that class, 0.5 if there is none; repeated ids are rows of their own, and a label given twice counts twice; an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from junctura.functions.checkpoints import shared_table
from junctura.llm.batches import bounded

WORDS = re.compile(r"[^\W_]+")
BUCKETS = 1 << 20
#: Lengths of the stems that a word's prior comes from.
STEMS = (4, 6)
STRENGTH = 4.0
DRIFT = 1.25
SIGNIFICANT = 0.05
CLASS_ROWS = 30_000
_MEMO = 300_000
#: Bins of the clean tokens' scores.
BIN, LEAST, BINS = 0.05, -16.0, 640


def places_of(word: str) -> list[int]:
    """Places of a word's counts: its stems', shortest first, then its own."""
    word = word.lower()
    parts = [f"{n}{word[:n]}" for n in STEMS] + [f"={word}"]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) * 2654435761 % 2**32 % BUCKETS for p in parts]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as ``(start, end, score)``, in order and in time linear in the length.

    Positive runs come one by one with the sums before and after them. A run is joined with the nearest segment that begins lower, if that one
    ends lower too; each segment remembers where its own search ended, so no segment is passed twice.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive, prepend=False, append=False)).reshape(-1, 2)
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    # start, end, sum before, sum after, nearest segment that begins lower (-1: none)
    held: list[tuple[int, int, float, float, int]] = []
    for start, end in edges.tolist():
        low, high = sums[start], sums[end]
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                break
            start, _, low, _, up = held[j]
            del held[j:]
            j = up
        held.append((start, end, low, high, j))
    return [(s, e, h - b) for s, e, b, h, _ in held]


class _Scores(dict):
    """Word to score, remembered for a bounded number of words."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray):
        self.toxic, self.clean = toxic, clean

    def __missing__(self, word: str) -> float:
        share = 0.5
        for at in places_of(word):
            toxic, clean = float(self.toxic[at]), float(self.clean[at])
            share = (toxic + STRENGTH * share) / (toxic + clean + STRENGTH)
        score = max(-12.0, min(12.0, math.log(share / (1 - share)))) - DRIFT
        if len(self) < _MEMO:
            self[word] = score
        return score


@dataclass
class Model:
    toxic: np.ndarray  # counts in toxic texts by place
    clean: np.ndarray  # counts in clean texts, scaled to as many tokens as the toxic texts have
    steepness: float = 1.0  # lambda
    log_k: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)  # level and slope

    def scorer(self) -> _Scores:
        return _Scores(self.toxic, self.clean)

    def log_e(self, tokens: int, found: list[tuple[int, int, float]]) -> list[float]:
        """ln E of each segment: how many as good are expected in clean text of so many tokens."""
        return [self.log_k + math.log(max(1, tokens)) - self.steepness * s for _, _, s in found]

    def evidence(self, tokens: int, found: list[tuple[int, int, float]]) -> float:
        return sum(max(0.0, -x) for x in self.log_e(tokens, found))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        level, slope = self.curve
        return 1 / (1 + np.exp(-np.clip(level + slope * np.log1p(evidence), -40, 40)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by place and class, of rows ``text, label``. A document counts once, so one that repeats its lines says no more."""
    known: dict[str, list[int]] = {}
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held: set[int] = set()
            for word in set(WORDS.findall(text or "")):
                places = known.get(word)
                if places is None:
                    places = places_of(word)
                    if len(known) < _MEMO:
                        known[word] = places
                held.update(places)
            counts[label, np.fromiter(held, np.int64, len(held))] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[1, used]), pa.array(counts[0, used])], names=["place", "toxic", "clean"])


def _constants(model: Model, bins: np.ndarray, clean: list[tuple[int, float]]) -> None:
    """Sets lambda and K from the histogram of clean tokens' scores and the clean documents' ``(tokens, best score)``."""
    share = bins / max(1, bins.sum())
    value = LEAST + (np.arange(BINS) + 0.5) * BIN
    total = lambda x: float((share * np.exp(np.clip(x * value, -700, 700))).sum())
    low, high = 0.0, 1.0
    if (share * value).sum() < 0 and share[value > 0].sum() > 0:
        while total(high) < 1 and high < 50:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if total(mid) < 1 else (low, mid)
    model.steepness = high
    # K n exp(-lambda M) of clean documents follows the exponential distribution of mean 1
    chance = sum(n * math.exp(-model.steepness * best) for n, best in clean if n)
    model.log_k = math.log(max(1, sum(1 for n, _ in clean if n)) / chance) if chance > 0 else 0.0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Level and slope (not below 0) of the likeliest logistic curve over weighted rows, held back by a little weight on small values."""
    toxic, clean = (weight * y).sum() + 0.5, (weight * (1 - y)).sum() + 0.5
    at = np.array([math.log(toxic / clean), 0.0])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -40, 40)))
        hold = np.array([1e-3, 1e-2])
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(hold), design.T @ (weight * (y - p)) - hold * at)
        at = at + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), max(0.0, float(at[1]))


def _constant(seen: dict[int, int]) -> Model:
    """A model that gives the share of the one class there is, 0.5 without labels."""
    share = seen.get(1, 0) / sum(seen.values()) if seen else 0.5
    bias = math.log((share + 1e-6) / (1 - share + 1e-6))
    return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), curve=(max(-14.0, min(14.0, bias)), 0.0))


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the key as text leaves no remainder by 5; null keys count as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str) -> Model:
    """The model from a sample of labelled rows that aren't held out.

    Keys and labels of the sample are broadcast (``2 * CLASS_ROWS`` rows at most), so texts stay where they are. Sums by
    place, a table of fixed size, and narrow rows of the curve's tenth reach the driver.
    """
    bounded(df, lean=True)
    marks = labels.select(F.col(label_key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key")))
    seen = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if len(seen) < 2:
        return _constant(seen)
    marks = marks.withColumn("luck", F.xxhash64(F.lit(21), "key"))
    least = [marks.filter(F.col("label") == k).orderBy("luck", "key").limit(CLASS_ROWS) for k in (0, 1)]
    sample = F.broadcast(least[0].unionByName(least[1]).withColumn("spared", F.pmod("luck", F.lit(10)) == 0).drop("luck"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sample, "key").select("label", "text", "spared")
    learn = rows.filter(~F.col("spared")).select("text", "label")
    sums = learn.mapInArrow(_count, "place long, toxic long, clean long").groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    table = sums.select(F.col("place").cast("int"), F.col("toxic").cast("int"), F.col("clean").cast("int")).toArrow()
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    place = table.column("place").to_numpy()
    toxic[place], clean[place] = table.column("toxic").to_numpy(), table.column("clean").to_numpy()
    if not toxic.sum() or not clean.sum():
        return _constant(seen)
    model = Model(toxic.astype(np.float32), (clean * (toxic.sum() / clean.sum())).astype(np.float32))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = shared.value.scorer()
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(1).to_pylist():
                words = WORDS.findall(text or "")
                scores = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
                bins = np.bincount(np.clip(((scores - LEAST) / BIN).astype(np.int64), 0, BINS - 1))
                out[0].append(len(words))
                out[1].append([s for _, _, s in segments(scores)])
                out[2].append([{"bin": int(b), "n": int(bins[b])} for b in np.flatnonzero(bins)])
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.struct([("bin", pa.int32()), ("n", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=["label", "tokens", "found", "bins"])

    measured = rows.filter("spared").select("label", "text").mapInArrow(measure, "label int, tokens long, found array<double>, bins array<struct<bin:int,n:bigint>>")
    measured = shared_table(measured)
    of_clean = measured.filter("label = 0").select(F.explode("bins").alias("b")).groupBy("b.bin").agg(F.sum("b.n").alias("n")).collect()
    bins = np.zeros(BINS)
    for r in of_clean:
        bins[r["bin"]] = r["n"]
    told = measured.select("label", "tokens", F.filter("found", lambda s: s > F.lit(0.5)).alias("found"), F.coalesce(F.array_max("found"), F.lit(0.0)).alias("best")).collect()
    _constants(model, bins, [(r["tokens"], r["best"]) for r in told if r["label"] == 0])
    x = np.array([math.log1p(model.evidence(r["tokens"], [(0, 0, s) for s in r["found"]])) for r in told])
    y = np.array([r["label"] for r in told], float)
    weight = np.array([seen[r["label"]] / min(seen[r["label"]], CLASS_ROWS) for r in told])
    model.curve = logistic(x, y, weight) if 0 < y.sum() < len(y) else (-1.5, 1.5)
    shared.unpersist()
    return model


def score_toxicity(df: DataFrame, key: str, text: str, model: Model, threshold: float = 0.5) -> DataFrame:
    """``key, held_out, score, predicted, n_passages`` of every row; the last counts the significant passages."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("evidence double, score double, n long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        memo = model.scorer()
        for texts in batches:
            evidence, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                words = WORDS.findall(text or "")
                found = segments(np.fromiter(map(memo.__getitem__, words), np.float64, len(words)))
                chances = model.log_e(len(words), found)
                evidence[i] = sum(max(0.0, -x) for x in chances)
                n[i] = sum(x <= math.log(SIGNIFICANT) for x in chances)
            yield pd.DataFrame({"evidence": evidence, "score": model.probability(evidence), "n": n})

    rows = bounded(df, lean=True).select(F.col(key), judge(F.col(text)).alias("judged"))
    score = F.col("judged.score")
    return rows.select(key, held_out(F.col(key)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), F.col("judged.n").alias("n_passages"))


def toxic_passages(df: DataFrame, text: str, model: Model, name: str = "passages", significant: float = SIGNIFICANT) -> DataFrame:
    """``df`` with each text's significant passages: ``start, end`` in code points (end exclusive), ``score`` and ``expected``, the number of such by chance."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,score:double,expected:double>>")
    def passages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        memo = model.scorer()
        for texts in batches:
            out = []
            for text in texts:
                words = list(WORDS.finditer(text or ""))
                found = segments(np.fromiter((memo[w[0]] for w in words), np.float64, len(words)))
                told = [(s, e, score, chance) for (s, e, score), chance in zip(found, model.log_e(len(words), found)) if chance <= math.log(significant)]
                out.append([{"start": words[s].start(), "end": words[e - 1].end(), "score": float(score), "expected": math.exp(chance)} for s, e, score, chance in told])
            yield pd.Series(out)

    return bounded(df, lean=True).withColumn(name, passages(F.col(text)))
