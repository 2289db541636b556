"""Phrase collocations from an FM-index per shard over word ids.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. Each task cuts its
documents, by language, into shards of about ``SHARD_WORDS`` words and writes an index of each: the vocabulary, and the Burrows-Wheeler transforms of the word ids
and of their reverse, in the order of the next ``LONGEST - 1`` words. A pattern is an interval of either order; it is extended by
a word on its left through the one transform, and on its right through the other, with the word's rank as the new interval's place. Extension goes
level by level, both ways in turn, for all intervals of a shard at once, and gives each phrase's count in the shard; counts are summed across shards.

A phrase can't be frequent unless the shorter phrases in it are. So words and pairs, then phrases of three words, then of four, are counted over all shards by hash, and those that are
frequent set bits in a map of fixed size (``MAP_BITS``), which the next length's extensions are held against. Hashes and bits may let more phrases
through, never fewer; the last pass counts what is left by its words, so results are exact. Hashes go in sorted, packed runs of 4 bytes a phrase, and a task sums up
its shards before it sends them.

Edge cases: a null text is empty; a null language is ``und``; texts of any length are indexed whole, and a document is never cut, so a shard grows by a long
one; repeated rows count again; an empty table gives no rows. Ties in score go by count, then by the phrase's bytes. Extra columns are not carried.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from junctura.functions.checkpoints import shared_table
from junctura.llm.batches import bounded, lighter, small

LONGEST = 5
SHARD_WORDS = 1 << 19
MAP_BITS = 1 << 26
TOP = 2000
_UNUSED = 64 - (MAP_BITS.bit_length() - 1)
#: A bucket is a part of the map, 4096 bytes; within it phrases are told apart by 24 more bits of their hash.
_BUCKET_BITS, _KEY_BITS = 15, 24
_BUCKETS = MAP_BITS >> _BUCKET_BITS
_COUNT_BITS = 28
#: Phrases that a task holds before it sums them up.
HELD = 1 << 20
#: A row group of the index: a shard or two.
GROUP_BYTES = 4 << 20
_SALTS = 64

_BREAK = ord(".")
_SIGNS = bytes(_BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with ``b"."`` wherever a piece ends."""
    if not text:
        return []
    # no word holds a full stop, so it can stand for all breaks; of white space only spaces and tabs are left
    return text.encode("utf-8", "surrogatepass").lower().translate(_SIGNS).replace(b".", b" . ").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(language: str, words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word of a language."""
    halves = [np.fromiter((zlib.crc32(w, s) for w in words), np.uint64, len(words)) for s in (zlib.crc32(language.encode()), zlib.crc32(language.encode(), 77))]
    lengths = np.fromiter(map(len, words), np.uint64, len(words))
    return _mixed((halves[0] << np.uint64(32) | halves[1]) + lengths * _ODD)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def _order(ids: np.ndarray) -> np.ndarray:
    """Places sorted by the next ``LONGEST - 1`` ids, which go on with the first after the last; equal ones by place."""
    rank, span = ids.astype(np.int64), 1
    while span < LONGEST - 1:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -span)
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        span *= 2
    return order


def transform(ids: np.ndarray) -> np.ndarray:
    """The id before each place, in the order of the places."""
    return ids[_order(ids) - 1]


@dataclass
class Intervals:
    """Patterns of one length: where each one's interval begins in both orders, its size, hash and words."""

    left: np.ndarray  # in the order of what follows
    right: np.ndarray  # in the order of what comes before
    size: np.ndarray
    hash: np.ndarray
    words: np.ndarray  # a row of ids for each

    def kept(self, mask: np.ndarray) -> Intervals:
        return Intervals(self.left[mask], self.right[mask], self.size[mask], self.hash[mask], self.words[mask])


class Index:
    """A shard's index: ids below the vocabulary's size, 0 for breaks, and both transforms."""

    def __init__(self, hashes: np.ndarray, before: np.ndarray, after: np.ndarray):
        self.hashes, self.before, self.after = hashes, before, after
        self.counts = np.bincount(before, minlength=len(hashes))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self._moves: dict[bool, np.ndarray] = {}

    def moves(self, leftwards: bool) -> np.ndarray:
        """Where each place goes when it is extended: the start of its id and how many of the same id stand before it."""
        if leftwards not in self._moves:
            symbols = self.before if leftwards else self.after
            self._moves[leftwards] = np.empty(len(symbols), np.int64)
            self._moves[leftwards][np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
        return self._moves[leftwards]

    def words(self) -> Intervals:
        ids = np.flatnonzero(self.counts)
        ids = ids[ids > 0]
        return Intervals(self.starts[ids], self.starts[ids], self.counts[ids], self.hashes[ids], ids[:, None])

    def extended(self, held: Intervals, leftwards: bool) -> Intervals:
        """All patterns with one more word on the left, or on the right, of ``held``; none across a break."""
        symbols, moves = self.before if leftwards else self.after, self.moves(leftwards)
        near, far = (held.left, held.right) if leftwards else (held.right, held.left)
        total = int(held.size.sum())
        of = np.repeat(np.arange(len(near)), held.size)
        inside = np.arange(total) - np.repeat(np.cumsum(held.size) - held.size, held.size)
        place = near[of] + inside
        key = of * np.int64(len(self.hashes)) + symbols[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
        size = np.diff(np.append(first, total))
        of, word = of[order[first]], symbols[place[order[first]]].astype(np.int64)
        # in the other order the new pattern lies where the smaller ids' extensions end
        other = far[of] + (first - (np.cumsum(held.size) - held.size)[of])
        new = moves[place[order[first]]]
        hashed = self.hashes[word] * _power(held.words.shape[1]) + held.hash[of] if leftwards else held.hash[of] * _ODD + self.hashes[word]
        words = np.concatenate([word[:, None], held.words[of]] if leftwards else [held.words[of], word[:, None]], axis=1)
        out = Intervals(new if leftwards else other, other if leftwards else new, size, hashed, words)
        return out.kept(word > 0)


def slots(hashes: np.ndarray) -> np.ndarray:
    """A bit of the map for each pattern's hash: its highest bits."""
    return (hashes >> np.uint64(_UNUSED)).astype(np.int64)


def _frequent(held: Intervals, index: Index, maps: list[np.ndarray]) -> np.ndarray:
    """Which patterns may be frequent, by the map of their length. Patterns without a map yet: whether their parts at both ends may."""
    n = held.words.shape[1]

    def marked(hashes: np.ndarray, n: int) -> np.ndarray:
        at = slots(hashes)
        return (maps[n - 1][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    if n <= len(maps):
        return marked(held.hash, n)
    if n == 1 or n - 1 > len(maps):
        return np.ones(len(held.hash), bool)
    last = held.hash - index.hashes[held.words[:, 0]] * _power(n - 1)
    mask = marked(last, n - 1)
    # what is left without the last word: its hash from the words, as the sum can't be divided
    first = np.zeros(len(held.hash), np.uint64)
    for k in range(n - 1):
        first = first * _ODD + index.hashes[held.words[:, k]]
    return mask & marked(first, n - 1)


def enumerate_levels(index: Index, upto: int, maps: list[np.ndarray]) -> Iterator[Intervals]:
    """The shard's patterns of 1, 2, ... ``upto`` words whose parts may be frequent, extended on the left and on the right in turn."""
    held = index.words()
    for n in range(1, upto + 1):
        if n > 1:
            held = index.extended(held, leftwards=n % 2 == 0)
        held = held.kept(_frequent(held, index, maps))
        yield held


INDEX_SCHEMA = "language string, n_words long, vocabulary binary, before binary, after binary"


def _build(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    """Index rows of the shards of ``language, text`` rows. A task holds twice ``shard_words`` in shards of all languages; beyond, it writes the largest."""
    held: dict[str, tuple[list[np.ndarray], list[int], defaultdict]] = {}

    def fresh() -> tuple[list[np.ndarray], list[int], defaultdict]:
        ids: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        return [np.array([ids[b"."]], np.int32)], [0], ids

    def told(language: str) -> pa.RecordBatch:
        parts, size, ids = held.pop(language)
        text = np.concatenate(parts)
        del parts
        row = [language, size[0], b" ".join(ids), transform(text).tobytes(), transform(text[::-1]).tobytes()]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["language", "n_words", "vocabulary", "before", "after"])

    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if not words:
                continue
            if language not in held:
                held[language] = fresh()
            parts, size, ids = held[language]
            words.append(b".")
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            size[0] += int(np.count_nonzero(parts[-1]))
            if size[0] >= shard_words:
                yield told(language)
            elif sum(s[1][0] for s in held.values()) >= 2 * shard_words:
                yield told(max(held, key=lambda x: held[x][1][0]))
    for language in list(held):
        yield told(language)


def build_index(df: DataFrame, text: str, language: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """An index row for each shard, written in the shared folder. Nothing is shuffled."""
    rows = bounded(df, lean=True).select(F.coalesce(F.col(language).cast("string"), F.lit("und")).alias("language"), F.col(text).alias("text"))
    return shared_table(rows.mapInArrow(lighter(lambda b: _build(b, shard_words)), INDEX_SCHEMA), group_bytes=GROUP_BYTES, huge_rows=True)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], Index]]:
    for batch in batches:
        for i in range(batch.num_rows):
            language, vocabulary = batch.column(0)[i].as_py(), batch.column(2)[i].as_py().split(b" ")
            before, after = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int32) for k in (3, 4))
            yield language, vocabulary, Index(word_hashes(language, vocabulary), before, after)


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Coded counts, ``code << 28 | count``, as one for each code, in order. Sorted in place: only a few arrays of the parts' size are held."""
    coded = np.concatenate(parts)
    parts.clear()
    coded.sort()
    codes, counts = coded >> _COUNT_BITS, coded & ((1 << _COUNT_BITS) - 1)
    firsts = np.flatnonzero(np.diff(codes, prepend=-1))
    if not len(firsts):
        return coded
    return codes[firsts] << _COUNT_BITS | np.minimum(np.add.reduceat(counts, firsts), (1 << _COUNT_BITS) - 1)


def _packed(level: int, coded: np.ndarray) -> pa.RecordBatch:
    """Rows ``level, bucket, entries`` of summed codes: an entry is 24 bits of the code and 8 of the count; a larger count takes several."""
    codes, counts = coded >> _COUNT_BITS, coded & ((1 << _COUNT_BITS) - 1)
    times = -(-counts // 255)
    of = np.repeat(np.arange(len(codes)), times)
    count = np.full(len(of), 255)
    last = np.cumsum(times) - 1
    count[last] = counts - 255 * (times - 1)
    entries = ((codes[of] & ((1 << _KEY_BITS) - 1)) << 8 | count).astype(np.uint32)
    bucket = codes[of] >> _KEY_BITS
    firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
    offsets = pa.py_buffer((np.append(firsts, len(entries)) * 4).astype(np.int32).tobytes())
    blobs = pa.Array.from_buffers(pa.binary(), len(firsts), [None, offsets, pa.py_buffer(entries.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array([level] * len(firsts), pa.int32()), pa.array(bucket[firsts], pa.int32()), blobs], names=["level", "bucket", "entries"])


def _tally(batches: Iterator[pa.RecordBatch], levels: list[int], maps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's sums of the shards' phrases of some lengths, by hash."""
    held: dict[int, list[np.ndarray]] = {n: [] for n in levels}
    for _, _, shard in _opened(batches):
        for n, found in enumerate(enumerate_levels(shard, max(levels), maps), 1):
            if n in held and len(found.hash):
                codes = (found.hash >> np.uint64(_UNUSED + _BUCKET_BITS - _KEY_BITS)).astype(np.int64)
                held[n].append(codes << _COUNT_BITS | found.size)
                if sum(map(len, held[n])) > HELD:
                    held[n] = [_summed(held[n])]
                    if len(held[n][0]) > HELD // 2:
                        yield _packed(n, held[n].pop())
    for n in levels:
        if held[n]:
            yield _packed(n, _summed(held[n]))


def _marks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The map's parts, ``level, bucket, bits``, of sorted rows ``level, bucket, entries``: a bit for each code whose counts sum up to ``least``."""
    at: tuple[int, int] | None = None
    held: list[np.ndarray] = []

    def part() -> pa.RecordBatch:
        coded = _summed(held)
        codes, counts = coded >> _COUNT_BITS, coded & ((1 << _COUNT_BITS) - 1)
        bits = np.zeros(1 << _BUCKET_BITS, np.uint8)
        bits[codes[counts >= least] >> (_KEY_BITS - _BUCKET_BITS)] = 1
        values = [at[0], at[1], np.packbits(bits, bitorder="little").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.binary()))], names=["level", "bucket", "bits"])

    for batch in batches:
        for level, bucket, entries in zip(*batch.columns):
            if at is not None and at != (level.as_py(), bucket.as_py()):
                yield part()
            at = (level.as_py(), bucket.as_py())
            entries = np.frombuffer(entries.as_buffer(), np.uint32).astype(np.int64)
            held.append(entries >> 8 << _COUNT_BITS | entries & 255)
            if sum(map(len, held)) > HELD:  # at most as many as 24 bits can tell apart
                held = [_summed(held)]
    if held:
        yield part()


def _maps_of(index: DataFrame, levels: list[int], maps: list[np.ndarray], least: int) -> list[np.ndarray]:
    """The maps of some lengths: each has a fixed size and comes in parts that are made on the executors."""
    shared = index.sparkSession.sparkContext.broadcast(maps)
    entries = index.mapInArrow(lighter(lambda b: _tally(b, levels, shared.value)), "level int, bucket int, entries binary")
    sorted_ = entries.repartition("level", "bucket").sortWithinPartitions("level", "bucket")
    out = {n: np.zeros((_BUCKETS, 1 << (_BUCKET_BITS - 3)), np.uint8) for n in levels}
    for r in sorted_.mapInArrow(lighter(lambda b: _marks(b, least)), "level int, bucket int, bits binary").collect():
        out[r["level"]][r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return [out[n].ravel() for n in levels]


def _spelt(batches: Iterator[pa.RecordBatch], maps: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """A task's counts of the phrases that may be frequent, by their words: rows ``language, bucket, phrases, counts`` of many phrases each."""
    counts: defaultdict[tuple[str, bytes], int] = defaultdict(int)

    def told() -> pa.RecordBatch:
        groups: defaultdict[tuple[str, int], list[tuple[bytes, int]]] = defaultdict(list)
        for (language, phrase), n in counts.items():
            groups[language, zlib.crc32(phrase) % buckets].append((phrase, n))
        counts.clear()
        # no word holds a line feed
        columns = [[k[0] for k in groups], [k[1] for k in groups], [b"\n".join(p for p, _ in g) for g in groups.values()], [np.array([n for _, n in g], np.int64).tobytes() for g in groups.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["language", "bucket", "phrases", "counts"])

    for language, vocabulary, shard in _opened(batches):
        names = np.array(vocabulary, object)
        for held in enumerate_levels(shard, LONGEST, maps):
            # in a large table most phrases of a shard may be frequent: only some are spelt at a time
            for at in range(0, len(held.size), HELD // 16):
                words = held.words[at : at + HELD // 16]
                phrase = names[words[:, 0]]
                for k in range(1, words.shape[1]):
                    phrase = phrase + b" " + names[words[:, k]]
                for p, n in zip(phrase.tolist(), held.size[at : at + HELD // 16].tolist()):
                    counts[language, p] += n
                if len(counts) > HELD // 4:
                    yield told()
    if counts:
        yield told()


def _reached(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows ``language, phrase, a`` of the phrases whose counts sum up to ``least``, of sorted rows ``language, bucket, phrases, counts``."""
    at: tuple[str, int] | None = None
    sums: defaultdict[bytes, int] = defaultdict(int)

    def told() -> pa.RecordBatch:
        good = [(p, n) for p, n in sums.items() if n >= least]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(good), pa.string()), pa.array([p for p, _ in good], pa.binary()).cast(pa.string()), pa.array([n for _, n in good], pa.int64())], names=["language", "phrase", "a"])

    for batch in batches:
        for language, bucket, phrases, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if at is not None and at != (language, bucket):
                yield told()
            at = (language, bucket)
            for p, n in zip(phrases.split(b"\n"), np.frombuffer(counts, np.int64).tolist()):
                sums[p] += n
    if at is not None:
        yield told()


def phrase_counts(index: DataFrame, least: int) -> DataFrame:
    """``language, phrase, a``: words and phrases up to ``LONGEST`` words that occur ``least`` times or more, with their counts."""
    maps = _maps_of(index, [1, 2], [], least)
    for level in range(3, LONGEST):
        maps += _maps_of(index, [level], maps, least)
    shared = index.sparkSession.sparkContext.broadcast(maps)
    # a bucket of a language has no more phrases than a task holds easily, however many words there are
    words = index.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(64, words >> 18)
    spelt = index.mapInArrow(lighter(lambda b: _spelt(b, shared.value, buckets)), "language string, bucket long, phrases binary, counts binary")
    sorted_ = spelt.repartition("language", "bucket").sortWithinPartitions("language", "bucket")
    return shared_table(sorted_.mapInArrow(lighter(lambda b: _reached(b, least)), "language string, phrase string, a long"))


def _words(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def collocations(df: DataFrame, text: str, language: str, least: int = 100, closed_percent: int = 100, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by their lowest-scoring cut.

    A phrase is dropped if a longer candidate that holds it occurs ``closed_percent`` / 100 as often or more. It is enough to look at candidates one word
    longer: what lies between a phrase and a longer one occurs at least as often as that one.
    """
    index = build_index(df, text, language, shard_words)
    counts = phrase_counts(index, least)
    totals = index.groupBy("language").agg(F.sum("n_words").alias("n"))
    candidates = counts.filter(_words(F.col("phrase")) >= 2)
    parts = F.split("phrase", " ")
    cut = candidates.select("language", "phrase", "a", parts.alias("words")).select("language", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    joined = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    cut = cut.select("language", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cut = cut.join(counts.select("language", F.col("phrase").alias("first"), F.col("a").alias("l")), ["language", "first"])
    cut = cut.join(counts.select("language", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["language", "rest"])
    cut = cut.join(small(totals), "language")
    # products may pass 64 bits: 38 decimal digits hold them
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("up", (wide("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * wide("n")).withColumn("down", wide("l") * wide("r"))
    scored = cut.groupBy("language", "phrase").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "a", "l", "r", "n")).alias("s")).select("language", "phrase", "s.*")

    words = candidates.select("language", "a", parts.alias("words")).filter(F.size("words") > 2)
    shorter = F.array(joined(F.lit(1), F.size("words") - 1), joined(F.lit(2), F.size("words") - 1))
    holders = words.select("language", "a", F.explode(shorter).alias("phrase")).groupBy("language", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(holders, ["language", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < closed_percent * F.col("a")))
    ranked = [F.desc("score"), F.desc("a"), "phrase"]
    # a language may hold most phrases: first the best of parts of it
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    some = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("language", "salt").orderBy(*ranked))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(*ranked))).filter(F.col("rank") <= top)
    return best.select(F.col("language").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
