"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each phrase is the shortest run of
code points that is not in the dictionary yet. The set of phrases is hashed (a
polynomial over code points modulo 2^64, taken from prefix sums, then mixed), and
the fingerprint is the minimum of each of ``SIGNATURE`` permutations, in hex. The
share of equal places of two fingerprints estimates the Jaccard likeness of the
phrase sets, which is high for texts that compress each other well.

Edge cases: null and empty texts have no phrase and the fingerprint of the empty
set, alike only to itself; texts of any length are parsed whole; equal texts have
equal fingerprints by construction. In ``edit_likeness`` null ids come last, rows with equal
ids follow each other by their text's hash, a single row is its own successor,
and an empty table gives no rows. Extra columns are not carried.

The phrase that a text's end leaves unfinished is always one that the text has already, so it adds nothing to the set: ``a``
and ``aa`` have one fingerprint. Rows with one id, or without one, follow each other in one block, whatever their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from junctura.llm.batches import bounded

SIGNATURE = 64
EMPTY = np.full(SIGNATURE, 0xFFFFFFFF, np.uint64)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_DRAW = np.random.Generator(np.random.PCG64(20240601))
_TIMES = _DRAW.integers(0, 2**64, SIGNATURE, dtype=np.uint64) | np.uint64(1)
_PLUS = _DRAW.integers(0, 2**64, SIGNATURE, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2^64; grown by doubling."""
    held = _powers[which]
    if len(held) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _ODD if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        held = _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def parse(text: str, phrases: set[str], partial: str, cuts: list[int], base: int) -> str:
    """Continues a parse over ``text``; adds the phrases' ends to ``cuts``. Returns the unfinished phrase."""
    add, cut = phrases.add, cuts.append
    for i, c in enumerate(text, base + 1):
        partial += c
        if partial not in phrases:
            add(partial)
            cut(i)
            partial = ""
    return partial


def phrase_hashes(text: str, cuts: list[int], first: int) -> np.ndarray:
    """Hashes of the phrases that end at ``cuts[first:]``."""
    if first >= len(cuts):
        return np.empty(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power("up", len(codes)), out=sums[1:])
    ends = np.array(cuts[first:], np.int64)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = (cuts[first - 1] if first else 0), ends[:-1]
    h = (sums[ends] - sums[starts]) * _power("down", len(codes) + 1)[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the hashes, 32 bits each."""
    least = EMPTY
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[i : i + 1024, None] * _TIMES + _PLUS) >> np.uint64(32)).min(axis=0))
    return least


def signature(text: str | None) -> np.ndarray:
    if not text:
        return EMPTY
    cuts: list[int] = []
    parse(text, set(), "", cuts, 0)
    return minima(phrase_hashes(text, cuts, 0))


def as_hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SIGNATURE


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, fingerprint`` of every row."""

    @F.pandas_udf("string")
    def hexed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_hex(signature(t)))

    return bounded(df).select(F.col(key), hexed(F.col(text)).alias("fingerprint"))


def block_of(value: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not above ``value``, by binary search."""
    held = F.lit(bounds) if bounds else F.array().cast("array<bigint>")

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(held, mid) <= value
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve, lambda s: s["lo"])


class _Row:
    """A text with its signature, and the state of its parse where its second half begins."""

    def __init__(self, key, text: str | None):
        self.key, self.text = key, text or ""
        n = len(self.text)
        self.kept = n - n // 2
        self.cuts: list[int] = []
        self.phrases: set[str] = set()
        self.partial = parse(self.text[: self.kept], self.phrases, "", self.cuts, 0)
        self.shared = len(self.cuts)
        all_cuts = list(self.cuts)
        parse(self.text[self.kept :], set(self.phrases), self.partial, all_cuts, self.kept)
        hashes = phrase_hashes(self.text, all_cuts, 0)
        self.half = minima(hashes[: self.shared])
        self.signature = np.minimum(self.half, minima(hashes[self.shared :]))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The edited text and its signature; uses up the parse state."""
        tail = following[: len(self.text) // 2]
        text = self.text[: self.kept] + tail
        parse(tail, self.phrases, self.partial, self.cuts, self.kept)
        return text, np.minimum(self.half, minima(phrase_hashes(text, self.cuts, self.shared)))


def _told(row: _Row, following: _Row) -> tuple:
    text, sig = row.edited(following.text)
    return row.key, len(row.text), hashlib.sha256(text.encode()).hexdigest(), as_hex(row.signature), as_hex(sig), likeness(row.signature, sig), likeness(row.signature, following.signature)


def _walk(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows by block and key; each is told when its successor has come. Borrowed rows only end a block."""
    held, block = None, None
    for frame in frames:
        out = []
        for key, text, at, borrowed in zip(frame["key"].astype(object), frame["text"], frame["block"], frame["borrowed"]):
            if borrowed and (held is None or at != block):
                continue  # the block's last row has its successor
            row = _Row(None if pd.isna(key) else key, text)
            if held is not None and at == block:
                out.append(_told(held, row))
            held, block = (None if borrowed else row), at
        result = pd.DataFrame(out, columns=names)
        yield result.astype({names[0]: "Int64"})


def edit_likeness(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last half, rounded down, replaced by the first as many code
    points of the next text by ``key`` (a long); after the last comes the first. Returns
    ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.

    Keys are cut into as many blocks as there are shuffle partitions, at
    quantiles. The first row of each block is also sent to the block before, so
    texts move once and every row meets its successor while a task streams
    through sorted rows, holding two.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = 2**63 - 1
    rows = bounded(df).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(last)).alias("place"))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("place", shares, max(10_000, 100 * parts))).first()[0] or [])) if shares else []
    rows = rows.withColumn("block", block_of(F.col("place"), bounds))
    firsts = [r["place"] for r in rows.groupBy("block").agg(F.min("place").alias("place")).orderBy("block").collect()]
    # the block before that of each first row; the first of all follows the last
    ahead = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(firsts)], "place long, nth int")
    at = df.sparkSession.createDataFrame([((i + 1) % len(firsts), p) for i, p in enumerate(firsts)], "nth int, before long")
    lends = ahead.join(at, "nth").select("place", block_of(F.col("before"), bounds).alias("lent"))
    rows = rows.join(F.broadcast(lends), "place", "left")
    home = F.struct(F.col("block").alias("block"), F.lit(False).alias("borrowed"))
    away = F.struct(F.col("lent").alias("block"), F.lit(True).alias("borrowed"))
    rows = rows.select("key", "text", "place", F.explode(F.when(F.col("lent").isNull(), F.array(home)).otherwise(F.array(home, away))).alias("to")).select("key", "text", "place", "to.block", "to.borrowed")
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(parts, "block").sortWithinPartitions("block", "borrowed", "place", tie)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [T.LongType(), T.LongType(), *[T.StringType()] * 3, *[T.DoubleType()] * 2]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return rows.select("key", "text", "block", "borrowed").mapInPandas(lambda frames: _walk(frames, names), schema)
