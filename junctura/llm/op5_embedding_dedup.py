"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets 64 bits, the signs of random projections, and the
vectors of a label are ordered by them, the first bit first. Each vector is compared
with the ``WINDOW`` before it, across the borders of ranges too: each range borrows the last rows before it; pairs of cosine ``THRESHOLD`` or more in double precision
are linked, and the links of all passes are united. A second look makes the
counts whole: within a united component every pair is compared, block against block,
so a vector's links to its component are counted exactly and no pair is ever emitted.
Exact copies of one label are one node with a multiplicity.

Windows are a feature of the method: a pair is found if any pass, or any chain of found
pairs, brings its vectors together. The number of passes is ``PASSES`` at least and grows with the largest label,
so that a pair just at the threshold is expected to be met with a chance of ``RECALL``, whatever the size.
Recall against brute force is measured in the tests.

Edge cases: a null label or vector, a zero vector, one with null or non-finite components
is linked with nothing and is its own component; any other length counts, down to the least number above 0; vectors of different lengths aren't compared; a
null id has a null component and isn't kept; repeated ids are rows of their own, and all rows
with the component's id are kept; an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from junctura.functions.checkpoints import shared_table
from junctura.operators.graph import connected_components

THRESHOLD = 0.93
PASSES = 12
RECALL = 0.99
WINDOW = 32
BLOCK = 1024


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can be linked at all."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & vector.isNotNull() & ~bad & some, F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Unit vectors, in double precision, of lists of one length. The greatest component is made 1 first, so no square leaves the range of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the rows of each vector length."""
    lengths = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, _matrix(batch.column(at).take(pa.array(rows)))


def passes_for(size: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, least: int = PASSES) -> int:
    """Passes after which a pair at the threshold was met with chance ``recall`` in a label of ``size`` vectors.

    One sign agrees with chance 1 - angle / pi, and a pass meets a pair if about log2(size / window) leading signs agree.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    met = agree ** max(0.0, math.log2(max(1, size) / window))
    return least if met >= 1 else max(least, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _keys(batches: Iterator[pa.RecordBatch], passes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Adds the key of each pass: 64 signs, as a long that sorts like the bits."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        keys = np.zeros((batch.num_rows, passes), np.int64)
        for rows, x in _by_length(batch, 2):
            n = x.shape[1]
            if n not in planes:
                planes[n] = np.random.default_rng((seed, n)).normal(size=(n, passes * 64))
            bits = np.packbits((x @ planes[n] > 0).reshape(len(rows), passes, 64), axis=2)
            keys[rows] = (bits.view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * passes), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "label", "vector", "keys"])


def _sorts_like(*columns: np.ndarray) -> np.ndarray:
    """Byte strings that sort like rows of longs."""
    words = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1)
    return np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * len(columns)}").ravel()


def _borders(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The first and the last ``window`` rows of a sorted range: ``pass, label, key, node, first``."""
    begin, held = None, None
    for batch in batches:
        if batch.num_rows:
            begin = batch.slice(0, 1) if begin is None else begin
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            held = whole.slice(max(0, whole.num_rows - window))
    for part, first in ((begin, True), (held, False)):
        if part is not None:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([first] * part.num_rows)], names=["pass", "label", "key", "node", "first"])


def _lent(borders: list[tuple[int, int, int, int, bool]], window: int) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
    """First rows of the ranges, and the (pass, range) that each node is lent to: the ``window`` rows of one pass and label before a range."""
    firsts = sorted(b[:4] for b in borders if b[4])
    ends = sorted(b[:4] for b in borders if not b[4])
    lent: dict[int, list[tuple[int, int]]] = {}
    for r, first in enumerate(firsts):
        at = bisect.bisect_left(ends, first)
        for k in range(max(0, at - window), at):
            if ends[k][:2] == first[:2]:
                lent.setdefault(ends[k][3], []).append((ends[k][0], r))
    starts = _sorts_like(*np.array(firsts, np.int64).reshape(-1, 4).T) if firsts else np.zeros(0, "S32")
    return starts, lent


def _dealt(batches: Iterator[pa.RecordBatch], starts: np.ndarray, lent: dict[int, list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Adds to keyed rows the places of each vector: its own range in each pass, and those it is lent to."""
    names = ["pass", "key", "range", "lent"]
    for batch in batches:
        nodes, labels = (batch.column(k).to_numpy() for k in (0, 1))
        n = batch.num_rows
        keys = batch.column(3).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0), np.int64)
        rows, passes = (x.ravel() for x in np.indices(keys.shape))
        own = np.searchsorted(starts, _sorts_like(passes, labels[rows], keys.ravel(), nodes[rows]), side="right") - 1 if n else rows
        own = np.maximum(own, 0)
        more = np.array([(i, p, r) for i, node in enumerate(nodes.tolist()) for p, r in lent.get(node, ())], np.int64).reshape(-1, 3)
        rows, passes = np.concatenate([rows, more[:, 0]]), np.concatenate([passes, more[:, 1]])
        ranges, borrowed = np.concatenate([own, more[:, 2]]), np.arange(len(rows)) >= len(own)
        order = np.argsort(rows, kind="stable")
        rows, passes = rows[order], passes[order]
        fields = [pa.array(passes.astype(np.int32)), pa.array(keys[rows, passes]), pa.array(ranges[order].astype(np.int32)), pa.array(borrowed[order])]
        spots = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, names=names))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], spots], names=["node", "label", "vector", "spots"])


def _windows(batches: Iterator[pa.RecordBatch], window: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between rows at most ``window`` apart in order, the later one not a borrowed one; of links that close a circle within a batch none is told."""
    held = None
    for batch in batches:
        batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None and held.num_rows else batch
        found_a, found_b = [], []
        group = [batch.column(i).to_numpy() for i in (0, 1, 4)]
        nodes, lent = batch.column(2).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
        fresh = 0 if held is None else held.num_rows
        for rows, x in _by_length(batch, 3):
            for gap in range(1, min(window, len(rows) - 1) + 1):
                a, b = rows[:-gap], rows[gap:]
                near = np.all([g[a] == g[b] for g in group], axis=0) & (b >= fresh) & ~lent[b]
                near[near] = np.einsum("ij,ij->i", x[:-gap][near], x[gap:][near]) >= threshold
                found_a.append(nodes[a[near]])
                found_b.append(nodes[b[near]])
        root: dict[int, int] = {}

        def top(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = up
            return v

        out = []
        for a, b in zip(np.concatenate(found_a).tolist() if found_a else [], np.concatenate(found_b).tolist() if found_b else []):
            ra, rb = top(a), top(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        held = batch.slice(max(0, batch.num_rows - window))


def _counts(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each node within the block pairs of its component. Rows come sorted by component and block pair."""
    held = None

    def count(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(part.column(6))
        nodes, size, own = part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(3).to_numpy()
        i, j = part.column(1)[0].as_py(), part.column(2)[0].as_py()
        if i == j:
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            return nodes, linked @ size
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        linked = x[a] @ x[b].T >= threshold
        return np.concatenate([nodes[a], nodes[b]]), np.concatenate([linked @ size[b], size[a] @ linked])

    def told(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in (0, 1)], names=["node", "links"])

    for batch in batches:
        batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None and held.num_rows else batch
        keys = [batch.column(i).to_numpy() for i in (0, 1, 2)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        edges = [0, *change.tolist()]
        parts = [count(batch.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:])]
        held = batch.slice(edges[-1])
        if parts:
            yield told(parts)
    if held is not None and held.num_rows:
        yield told([count(held)])


def near_duplicates(df: DataFrame, key: str, vector: str, label: str, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, seed: int = 17, recall: float = RECALL) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row. ``passes`` is the least number of passes."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    rows = rows.withColumn("node", F.when(usable(F.col("vector"), F.col("label")), F.xxhash64("label", F.size("vector"), "vector")))
    groups = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("size"))
    groups = shared_table(groups.withColumn("label", F.xxhash64("label", F.size("vector"))))
    largest = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(largest, threshold, window, recall, passes)
    keyed = groups.select("node", "label", "vector").mapInArrow(lambda b: _keys(b, passes, seed), f"node long, label long, {_field(groups, 'vector')}, keys array<bigint>")
    # ranges first, over rows without vectors: where they start and what they lend to the next ones
    order = ["pass", "label", "key", "node"]
    light = keyed.select("node", "label", F.posexplode("keys").alias("pass", "key")).select(*[F.col(c).cast("long").alias(c) for c in order])
    light = light.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    borders = light.mapInArrow(lambda b: _borders(b, window), "pass long, label long, key long, node long, first boolean").collect()
    starts, lent = _lent([tuple(r) for r in borders], window)
    spots = "spots array<struct<pass:int,key:bigint,range:int,lent:boolean>>"
    dealt = keyed.mapInArrow(lambda b: _dealt(b, starts, lent), f"node long, label long, {_field(groups, 'vector')}, {spots}")
    dealt = dealt.select("node", "label", "vector", F.explode("spots").alias("s")).select("node", "label", "vector", "s.*")
    walked = dealt.repartitionById(max(1, len(starts)), F.col("range")).sortWithinPartitions("range", *order).select("pass", "label", "node", "vector", "range", "lent")
    links = shared_table(walked.mapInArrow(lambda b: _windows(b, window, threshold), "a long, b long").distinct())
    labels = connected_components(links, "a", "b")

    members = groups.select("node", "least", "size", "vector").join(labels, "node")
    of_component = members.groupBy("component").agg(F.min("least").alias("component_id"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = members.join(of_component, "component").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int"))
    sent = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "vector")
    sent = sent.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "own", "node")
    counts = sent.mapInArrow(lambda b: _counts(b, threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    told = members.select("node", "component_id").join(counts, "node", "left")
    told = groups.select("node", "least", "size").join(told, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("id", "node").join(told, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _field(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"
