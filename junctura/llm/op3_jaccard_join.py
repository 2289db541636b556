"""N-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct five-word shingles. One
global order of all shingles is cut in two ways. Light shingles come first, by hash;
heavy ones (classes of hashes that ``HEAVY`` documents or more hold) come last, by
count. Two sets with a Jaccard likeness of 80 % or more share one of the first
n - ceil(0.8 n) + 1 shingles of each, so only these meet:

* fragments of the hash range count the classes, each fragment by itself; a filter of fixed size
  tells which shingles only one document holds, and these are never sent;
* each light shingle's documents are paired; a pair's partial overlap and its last
  shared places are summed over all shingles, and bound the difference of the sets
  from below, which drops most pairs that share a passage only;
* documents in the list of a heavy shingle have all their light ones among their first, so two of
  them that share none differ by all of these, which drops most pairs of loose copies;
* what is left is verified: sets are cut into ``FRAGMENTS`` hash ranges, overlaps are
  counted range by range and summed per pair.

Heavy shingles whose lists have the same least text mostly have the same texts. They make one group, in which each
text stands once, so what follows costs a row for each text and group, not for each shingle. No pair is made within a group:

* a text first meets the group's pivots of like size, drawn by hash, one at first and then ``PIVOTS`` where texts of
  different components are left;
* then each group that still holds several components is counted by block: what is outside its largest component is sent
  to blocks of its texts, and counted there against an inverted index of each fragment.

Pairs are verified once in ``EARLY`` of the ``FRAGMENTS``, and in the others only if the rest could still reach 80 %; overlaps are
summed per pair. Only pairs whose texts are in different components are verified after the first round, so copies by the
thousand aren't paired with each other, and no link between components is lost. Exact copies of a text are one node.

Sizes: the table of heavy classes holds ``HEAVY_TABLE`` of them (16 MB). A class that it has no room for stays light in the
order, and its lists of ``HEAVY`` texts or more are groups like those of heavy ones, without the bound by light shingles. The filter has a
bit for every 8 bytes of text, ``MOST_BITS`` (32 MB) at most; beyond 2 GB of text it fills up slowly, and at worst all first
shingles are sent, a fifth of all. Neither changes a result.

Edge cases: null and wordless texts have no shingles and are linked with nothing, not even with each other; fewer
than five words are one shingle; texts of any length are taken whole; rows with a
null id get their count and a null component, and don't link others; repeated ids are
kept as rows, and their texts link like any; an empty table gives no rows. Extra columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest

from junctura.functions.checkpoints import shared_table
from junctura.llm.batches import bounded, lighter, small
from junctura.operators.graph import connected_components

WORDS = 5
HEAVY = 16
#: Most classes that the table of heavy classes holds: 16 bytes each, 16 MB.
HEAVY_TABLE = 1 << 20
CLASS_BITS = 44
FRAGMENTS = 8
#: Bytes of a shingle in a segment.
WIDTH = 5
SEGMENTS = [f"s{f}" for f in range(FRAGMENTS)]
#: Bits of the filter over verified documents, and the most documents it serves; beyond, a join does.
FILTER_BITS = 1 << 24
FILTER_NODES = 1 << 21
#: Most bits (as a power of two) of the filter over shingle classes that two documents or more hold: 32 MB.
MOST_BITS = 28
#: Most fragments (as a power of two) in which classes are counted.
MOST_FRAGMENTS = 20
PIVOTS = 8
#: Fragments in which a pair is counted first.
EARLY = 2
BLOCK = 512
_TIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_EMPTY = np.empty(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text. Only A-Z are lower-cased, only ASCII white space separates."""
    words = text.encode().lower().split() if text else []
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64) if words else _EMPTY
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    s = h[:n] * _TIMES[0]
    for k in range(1, WORDS):
        s += h[k : n + k] * _TIMES[k]
    s ^= s >> np.uint64(29)
    s *= _TIMES[3]
    s ^= s >> np.uint64(32)
    return np.unique(s)


def prefix_length(n: int) -> int:
    """How many first shingles of n must hold one of any set that is 80 % alike."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _classes(values: np.ndarray) -> np.ndarray:
    return values >> np.uint64(64 - CLASS_BITS)


def class_table(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes held ``HEAVY`` times or more, and their counts; the ``HEAVY_TABLE`` largest, sorted by class.

    Third, a filter with the bit of each class that is held twice or more.

    Tasks send sorted classes as differences in byte planes, cut into fragments of the
    class range; each fragment is counted by itself. A class that the table has no
    room for counts as light: the order stays one order, and ``_lists`` deals with its long lists.
    """
    total = int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    filter_bits = min(MOST_BITS, max(16, (total >> 3).bit_length()))
    bits = min(MOST_FRAGMENTS, filter_bits - 3, max(8, (total >> 24).bit_length()))
    rest = CLASS_BITS - bits
    most = max(1_000_000, 4 << bits)

    def cut(held: list[np.ndarray]) -> pa.RecordBatch:
        classes = _classes(np.sort(np.concatenate(held)))
        edges = np.searchsorted(classes, np.arange(2**bits + 1, dtype=np.uint64) << np.uint64(rest))
        numbers, blobs = [], []
        for f in np.flatnonzero(np.diff(edges)):
            part = classes[edges[f] : edges[f + 1]]
            steps = np.diff(part, prepend=np.uint64(int(f) << rest))
            numbers.append(int(f))
            blobs.append(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["fragment", "steps"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for t in batch.column(0).slice(at, 512).to_pylist():
                    held.append(shingles(t))
                    size += len(held[-1])
                if size > most:
                    yield cut(held)
                    held, size = [], 0
        if size:
            yield cut(held)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        base = np.uint64(int(group["fragment"].iloc[0]) << rest)
        parts = []
        for blob in group["steps"]:
            planes = np.frombuffer(blob, np.uint8).reshape(5, -1)
            steps = np.zeros((planes.shape[1], 8), np.uint8)
            steps[:, :5] = planes.T
            parts.append(np.cumsum(steps.view(np.uint64)[:, 0], dtype=np.uint64) + base)
        values = np.sort(np.concatenate(parts))
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        counts = np.diff(np.append(starts, len(values)))
        many = counts >= HEAVY
        seen = np.zeros(1 << (filter_bits - bits), bool)
        seen[(values[starts[counts > 1]] - base) >> np.uint64(CLASS_BITS - filter_bits)] = True
        row = {"fragment": int(group["fragment"].iloc[0]), "class": values[starts[many]].astype(np.int64), "n": counts[many].astype(np.int64), "seen": np.packbits(seen, bitorder="little").tobytes()}
        return pd.DataFrame([row])

    blobs = df.select(text).mapInArrow(lighter(collect), "fragment int, steps binary")
    counts = shared_table(blobs.groupBy("fragment").applyInPandas(count, "fragment int, class array<bigint>, n array<bigint>, seen binary"), files=2)
    pairs = counts.select(F.explode(F.arrays_zip("class", "n")).alias("p")).select("p.class", "p.n")
    table = pairs.orderBy(F.desc("n"), "class").limit(HEAVY_TABLE).toPandas().sort_values("class")
    filter_ = np.zeros(1 << (filter_bits - 3), np.uint8)
    width = len(filter_) >> bits
    for row in counts.select("fragment", "seen").collect():
        filter_[row["fragment"] * width : (row["fragment"] + 1) * width] = np.frombuffer(bytes(row["seen"]), np.uint8)
    return table["class"].to_numpy(np.uint64), table["n"].to_numpy(np.int64), filter_


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _firsts(batches: Iterator[pa.RecordBatch], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, salt, node, n, place, light`` of those of each text's first shingles that another text may hold.

    Once per task and text. salt: 0 for light shingles, above it for heavy ones, -1 for a row that
    tells a text's count. light: how many of the text's first shingles are light.
    """
    classes, counts, seen = table
    filter_bits = len(seen).bit_length() + 2
    done: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets, nodes = [], []
            for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if node not in done:
                    done.add(node)
                    sets.append(shingles(text))
                    nodes.append(node)
            keys, salts, owners, places, sizes, lights = [], [], [], [], [], []
            for node, s in zip(nodes, sets):
                n, p = len(s), prefix_length(len(s))
                first, salt, place, most = s[:0], np.zeros(p, np.int32), np.arange(p, dtype=np.int32), 0
                if n:
                    mine = _classes(s)
                    where = np.searchsorted(classes, mine)
                    where[where == len(classes)] = 0
                    held = classes[where] == mine if len(classes) else np.zeros(n, bool)
                    light = s[~held]
                    first = light[:p]
                    most = len(first)
                    if most < p:
                        often = counts[where[held]]
                        order = np.lexsort((s[held], often))[: p - most]
                        salt[most:] = 1 + node % (1 + often[order] // 2000)
                        first = np.concatenate([first, s[held][order]])
                    slot = first >> np.uint64(64 - filter_bits)
                    sent = (seen[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    first, salt, place = first[sent], salt[sent], place[sent]
                keys += [first.view(np.int64), np.array([node], np.int64)]
                salts += [salt, np.array([-1], np.int32)]
                places += [place, np.zeros(1, np.int32)]
                owners.append(np.full(len(first) + 1, node, np.int64))
                sizes.append(np.full(len(first) + 1, n, np.int32))
                lights.append(np.full(len(first) + 1, most, np.int32))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, salts, owners, sizes, places, lights)], names=["key", "salt", "node", "n", "place", "light"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks rows sorted by key, salt and node. Emits ``kind, a, b, na, nb, pa, pb, la, lb``:

    kind 0: text a has na shingles; 1: a and b share a light shingle at places pa and pb, of la and lb light ones;
    2: the heavy shingle a is held by text b, of na shingles and la light ones; or a light shingle that ``HEAVY`` texts
    or more hold, and 0 for la, as these texts do share a light shingle.
    """
    names = ["key", "salt", "node", "n", "place", "light"]
    held = None

    def emit(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, salt, node, n, place, most = rows
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
        key, salt, node, n, place, most = (x[fresh] for x in (key, salt, node, n, place, most))
        out = []
        told = salt < 0
        zero = lambda k: np.zeros(k, np.int32)
        k = int(told.sum())
        out.append((zero(k), node[told], node[told], n[told], *[zero(k)] * 5))
        often = salt > 0
        k = int(often.sum())
        out.append((zero(k) + 2, key[often], node[often], n[often], zero(k), zero(k), zero(k), most[often], zero(k)))
        light = np.flatnonzero(salt == 0)
        if len(light):
            lk = key[light]
            starts = np.flatnonzero(np.concatenate([[True], lk[1:] != lk[:-1]]))
            sizes = np.diff(np.append(starts, len(lk)))
            long = np.repeat(sizes >= HEAVY, sizes)
            k = int(long.sum())
            out.append((zero(k) + 2, lk[long], node[light[long]], n[light[long]], *[zero(k)] * 5))
            for m in np.unique(sizes[(sizes > 1) & (sizes < HEAVY)]):
                one, two = np.triu_indices(m, 1)
                heads = starts[sizes == m]
                step = max(1, 300_000 // len(one))
                for at in range(0, len(heads), step):
                    i = light[(heads[at : at + step, None] + one).ravel()]
                    j = light[(heads[at : at + step, None] + two).ravel()]
                    near = 5 * np.minimum(n[i], n[j]).astype(np.int64) >= 4 * np.maximum(n[i], n[j]).astype(np.int64)
                    i, j = i[near], j[near]
                    out.append((zero(len(i)) + 1, node[i], node[j], n[i], n[j], place[i], place[j], most[i], most[j]))
        for part in out:
            if len(part[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["kind", "a", "b", "na", "nb", "pa", "pb", "la", "lb"])

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        # the last list goes on in the next batch; heavy rows need no company
        cut = int(np.argmax(last)) if len(last) and rows[1][-1] == 0 else len(last)
        held = [x[cut:] for x in rows]
        if cut:
            yield from emit([x[:cut] for x in rows])
    if held is not None and len(held[0]):
        yield from emit(held)


def _segments(batches: Iterator[pa.RecordBatch], mask: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """``node`` and a column for each fragment: sets cut by the hashes' first bits, five bytes a shingle, once per task and text."""
    done: set[int] = set()
    bits = FRAGMENTS.bit_length() - 1
    edges = (np.arange(1, FRAGMENTS, dtype=np.uint64)) << np.uint64(64 - bits)
    for batch in batches:
        ids = batch.column(0).to_numpy()
        wanted = np.ones(len(ids), bool)
        if mask is not None:
            bit = ids & (FILTER_BITS - 1)
            wanted = (mask[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        nodes, parts = [], []
        for k in np.flatnonzero(wanted):
            if ids[k] in done:
                continue
            done.add(ids[k])
            s = shingles(batch.column(1)[int(k)].as_py())
            packed = ((s << np.uint64(bits)) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :WIDTH]
            nodes.append(int(ids[k]))
            parts.append([p.tobytes() for p in np.split(packed, np.searchsorted(s, edges))])
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *[pa.array(x, pa.binary()) for x in zip(*parts)]], names=["node", *SEGMENTS])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each node of a partition."""
    done: set[int] = set()
    for batch in batches:
        fresh = [k for k, v in enumerate(batch.column(0).to_pylist()) if not (v in done or done.add(v))]
        yield batch.take(pa.array(fresh, pa.int64()))


def _unpacked(segment: bytes) -> np.ndarray:
    out = np.zeros((len(segment) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(segment, np.uint8).reshape(-1, WIDTH)
    return out.view(np.uint64)[:, 0]


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two segments."""
    return pd.Series([(len(x) + len(y)) // WIDTH - len(np.unique(np.concatenate([_unpacked(x), _unpacked(y)]))) for x, y in zip(a, b)], dtype="int64")


# a filter on what it gives would else be pushed below it, and all be counted twice, by two workers of each task
_overlap = F.pandas_udf(_shared, T.LongType()).asNondeterministic()


def segments_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments of the sets of ``nodes`` (column ``node``), from ``texts`` (``node, text``)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = nodes.count()
    mask = None
    if count <= FILTER_NODES:
        # a filter of fixed size lets few other texts through, which later joins ignore
        bit = F.col("node").bitwiseAND(FILTER_BITS - 1)
        rows = nodes.select(bit.alias("bit")).groupBy(F.call_function("bitmap_bucket_number", F.col("bit") + 1).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("bit") + 1)).alias("bits")).collect()
        mask = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in rows:
            at = (r["bucket"] - 1) * 4096
            mask[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    else:
        texts = texts.join(nodes, "node", "left_semi")
    shared = texts.sparkSession.sparkContext.broadcast(mask)
    kind = ", ".join(["node long", *[f"{x} binary" for x in SEGMENTS]])
    held = shared_table(texts.mapInArrow(lighter(lambda batches: _segments(batches, shared.value)), kind).repartition(-(-parts // 4), "node").mapInArrow(lighter(_once), kind))
    shared.destroy()
    return held


def _counted(pairs: DataFrame, segments: DataFrame, names: list[str]) -> DataFrame:
    """``pairs`` with the overlap ``o`` and the sizes ``ka, kb`` of both sets, summed over the fragments ``names``."""
    one = segments.select(F.col("node").alias("a"), *[F.col(x).alias(f"a_{x}") for x in names])
    two = segments.select(F.col("node").alias("b"), *[F.col(x).alias(f"b_{x}") for x in names])
    held = small(pairs)
    both = one.join(held, "a").join(two.join(small(pairs.select("b").distinct()), "b", "left_semi"), "b")
    of = lambda side: sum((F.octet_length(f"{side}_{x}") for x in names), F.lit(0)) / WIDTH
    overlaps = [_overlap(f"a_{x}", f"b_{x}") for x in names]
    return both.select(*pairs.columns, sum(overlaps, F.lit(0)).alias("o"), of("a").alias("ka"), of("b").alias("kb"))


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (``a, b, na, nb``) that reach 80 %: overlaps are counted by fragment and summed.

    Pairs that can't reach it after the first fragments don't meet in the others. 100 o >= 80 (na + nb - o) is 9 o >= 4 (na + nb).
    """
    pairs = shared_table(pairs.select("a", "b", "na", "nb"))
    early = _counted(pairs, segments, SEGMENTS[:EARLY])
    reach = F.col("o") + F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    left = shared_table(early.filter(9 * reach >= 4 * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb", F.col("o").alias("before")))
    late = _counted(left, segments, SEGMENTS[EARLY:])
    return late.filter(9 * (F.col("o") + F.col("before")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _groups(often: DataFrame) -> DataFrame:
    """``head, class, node, n, l`` from the texts of heavy shingles (``shingle, node, n, l``): shingles with one least text are a group."""
    heads = often.groupBy("shingle").agg(F.min("node").alias("head"))
    rows = often.join(heads, "shingle").groupBy("head", "node", "n").agg(F.min("l").alias("l"))
    return shared_table(rows.withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.25)))))


def _around(column: str = "class") -> Column:
    """A size class and its neighbours: sets that are 80 % alike are in one class or in adjacent ones."""
    return F.explode(F.array(F.col(column) - 1, F.col(column), F.col(column) + 1))


def _pivot_pairs(held: DataFrame, turn: int, pivots: int) -> DataFrame:
    """Pairs of each group's texts (``head, class, node, n, l, c``) with pivots of like size in other components ``c``.

    Pivots have the least hashes. They are found by partial aggregation; no list is gathered.
    """
    luck = lambda k: F.xxhash64(F.lit(1000 * turn + k), "node").alias("luck")
    drawn = held.groupBy("head", "class").agg(*[F.min(F.struct(luck(k), "node", "n", "l", "c")).alias(f"h{k}") for k in range(pivots)])
    drawn = drawn.select("head", "class", F.explode(F.array(*[f"h{k}" for k in range(pivots)])).alias("h"))
    drawn = drawn.select("head", _around().alias("class"), F.col("h.node").alias("a"), F.col("h.n").alias("na"), F.col("h.l").alias("la"), F.col("h.c").alias("ca")).distinct()
    rows = held.select("head", "class", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("l").alias("lb"), F.col("c").alias("cb"))
    return _ordered(rows.join(drawn, ["head", "class"]).filter((F.col("ca") != F.col("cb")) & _may_link()))


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")).distinct()


def _may_link() -> Column:
    """Sizes are alike, and the light shingles, of which none is shared, don't make too many differences.

    Pairs that share a light shingle are found by it.
    """
    return _like_size() & (9 * (F.col("la") + F.col("lb")) <= F.col("na") + F.col("nb"))


def _like_size() -> Column:
    return 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")


def _labelled(pairs: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Adds the component of ``node`` as ``name``: itself if it has none."""
    return pairs.join(labels.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _apart(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``groups`` with their component ``c``, where a text of like size and another component is left that they may link with."""
    rows = shared_table(_labelled(groups, labels, "node", "c"))
    spare = 9 * F.col("l") - F.col("n")
    near = rows.groupBy("head", "class").agg(F.min(spare).alias("least"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    near = near.select("head", _around().alias("class"), "least", "c0", "c1").groupBy("head", "class").agg(F.min("least").alias("least"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    near = near.filter("c0 != c1").select("head", "class", "least")
    return shared_table(rows.join(near, ["head", "class"]).filter(spare + F.col("least") <= 0).drop("least"))


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a block's texts (role 0) and those sent to it (role 1), one for each component that is met."""
    key, members, index, out = None, [], None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for group, block, role, node, n, c, *segments in zip(*columns):
            if (group, block) != key:
                key, members, index = (group, block), [], None
            if role == 0:
                members.append((node, n, c, segments))
                continue
            if not members:
                continue
            if index is None:
                index = []
                for f in range(FRAGMENTS):
                    parts = [_unpacked(m[3][f]) for m in members]
                    owners = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
                    values = np.concatenate(parts)
                    order = np.argsort(values, kind="stable")
                    index.append((values[order], owners[order]))
                nodes, sizes, comps = (np.array([m[i] for m in members]) for i in range(3))
            overlap = np.zeros(len(members), np.int64)
            for f, (values, owners) in enumerate(index):
                own = _unpacked(segments[f])
                lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                spans = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                overlap += np.bincount(owners[at], minlength=len(members))
            linked = np.flatnonzero((100 * overlap >= 80 * (sizes + n - overlap)) & (comps != c))
            for first in np.unique(comps[linked], return_index=True)[1]:
                out.append((node, int(nodes[linked[first]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out = []


def _counted_by_block(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Links across components within the groups of ``rows``.

    A group's texts are cut into blocks; those outside its largest
    component go to every block. A task holds one block and streams through what is sent to it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("head", "c").agg(F.count("*").alias("k")).groupBy("head").agg(F.sum("k").alias("k"), F.max(F.struct("k", "c"))["c"].alias("main"))
    texts = shared_table(rows.join(sizes, "head").select("head", "node", "n", "c", "main", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int")
    home = F.array(F.struct(own.alias("block"), F.lit(0).alias("role")))
    everywhere = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("role")))
    sent = segments.join(small(texts), "node").withColumn("to", F.explode(F.when(F.col("c") == F.col("main"), home).otherwise(F.concat(home, everywhere))))
    sent = sent.select("head", "to.block", "to.role", "node", "n", "c", *SEGMENTS)
    return sent.repartition(parts, "head", "block").sortWithinPartitions("head", "block", "role", "node").mapInArrow(lighter(_block_links), "a long, b long").distinct()


def _components(df: DataFrame, key: str, text: str) -> DataFrame:
    """``node, n, least, times, rows, component_id, first`` of each text.

    least: its least id, which ``times`` of its ``rows`` rows with an id have; first: the text of its component that has the least id.
    """
    spark = bounded(df).sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(_text_hash(text).alias("node"), F.col(text).alias("text"))
    classes = spark.sparkContext.broadcast(class_table(df.select(F.col(text).alias("text")), "text"))
    all_texts = df.select(_text_hash(text).alias("node"), F.col(text).alias("text"))
    firsts = all_texts.mapInArrow(lighter(lambda batches: _firsts(batches, classes.value)), "key long, salt int, node long, n int, place int, light int")
    firsts = firsts.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "node")
    lists = shared_table(firsts.mapInArrow(lighter(_lists), "kind int, a long, b long, na int, nb int, pa int, pb int, la int, lb int"), files=-(-parts // 8))
    classes.destroy()
    counts = lists.filter("kind = 0").select(F.col("a").alias("node"), F.col("na").alias("n")).distinct()

    # of the text whose light first shingles end earlier, all that aren't shared are missing in the other
    # one; of the other, those up to the last shared one
    light = lists.filter("kind = 1").groupBy("a", "b", "na", "nb", "la", "lb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    least = F.least(F.col("la") + F.col("pb"), F.col("lb") + F.col("pa")) + 1 - 2 * F.col("c")
    light = light.filter(9 * least <= F.col("na") + F.col("nb")).select("a", "b", "na", "nb")
    groups = _groups(lists.filter("kind = 2 AND na > 0").select(F.col("a").alias("shingle"), F.col("b").alias("node"), F.col("na").alias("n"), F.col("la").alias("l")))
    candidates = shared_table(light.unionByName(_pivot_pairs(groups.withColumn("c", F.col("node")), 0, 1)).distinct())

    nodes = candidates.select(F.col("a").alias("node")).union(candidates.select(F.col("b").alias("node"))).union(groups.select("node")).distinct()
    segments = segments_of(texts, nodes)
    # one partner for each text, then what is still apart
    tested = candidates.groupBy("b", "nb").agg(F.min(F.struct("a", "na")).alias("m")).select("m.a", "b", "m.na", "nb")
    links = shared_table(verified(tested, segments))
    labels = connected_components(links, "a", "b")
    still = _labelled(_labelled(candidates, labels, "a", "ca"), labels, "b", "cb").filter("ca != cb").select("a", "b", "na", "nb")
    more = still.unionByName(_pivot_pairs(_apart(groups, labels), 1, PIVOTS)).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    links = links.unionByName(shared_table(verified(more, segments)))
    left = _apart(groups, connected_components(links, "a", "b"))
    if not left.isEmpty():
        links = shared_table(links.unionByName(_counted_by_block(left, segments)))
    joined = connected_components(links, "a", "b")

    ids = df.select(F.col(key).alias("id"), _text_hash(text).alias("node"))
    known = ids.groupBy("node", "id").agg(F.count("*").alias("times")).filter("id IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "times")).alias("l"), F.sum("times").alias("rows"))
    known = ids.select("node").distinct().join(known, "node", "left").select("node", F.col("l.id").alias("least"), F.col("l.times").alias("times"), "rows").join(counts, "node", "left").join(joined, "node", "left")
    firsts = known.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("least", "node")).alias("of_component"))
    known = known.join(firsts, "component", "left")
    return known.select("node", "n", "least", "times", "rows", F.coalesce("of_component.least", "least").alias("component_id"), F.coalesce("of_component.node", "node").alias("first"))


def jaccard_components(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_shingles, component_id`` of every row; links are pairs with 100 * intersection >= 80 * union."""
    ids = df.select(F.col(key).alias("id"), _text_hash(text).alias("node"))
    out = ids.join(_components(df, key, text), "node", "left").withColumn("n_shingles", F.coalesce("n", F.lit(0)).cast("long"))
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))


def first_of_each(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the text with the least id stays, in one row.

    Rows without an id and texts without words stay, all of them; so do different texts that share an id and aren't linked. Of
    rows with one id and one text one stays. Texts aren't shuffled while the nodes of copies are ``batches.BROADCAST_ROWS`` at most; beyond that they are joined once.
    """
    known = _components(df, key, text).filter("n > 0 AND least IS NOT NULL AND (rows > 1 OR first != node)")
    mine = F.col("first") == F.col("node")
    copies = shared_table(known.select(F.col("node").alias("__node"), F.when(mine, F.col("least")).alias("__stays"), (mine & (F.col("times") > 1)).alias("__repeated")))
    rows = df.withColumn("__node", _text_hash(text)).join(small(copies), "__node", "left")
    rows = rows.filter(F.col("__repeated").isNull() | F.col(key).isNull() | (F.col(key) == F.col("__stays")))
    if copies.filter("__repeated").isEmpty():
        return rows.select(*df.columns)
    repeated = F.coalesce("__repeated", F.lit(False)) & F.col(key).isNotNull()
    return rows.filter(~repeated).unionByName(rows.filter(repeated).dropDuplicates(["__node"])).select(*df.columns)
