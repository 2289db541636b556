"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of letters and digits, ASCII or beyond (``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``), with A-Z lower-cased. With N documents that have a term, L terms
in all and n in a document, its normaliser is m = 10 + 90 n N div L; a term of weight w = floor(1000 ln((2 N + 2) / (2 df + 1)))
that it holds tf times adds w * ((10^9 tf) div (1000 tf + 8 m)).

The score of a term depends on a document by m and tf alone. So documents are grouped by m into strata, and a stratum's postings by term and then by tf: the impact is
computed once for each term and tf of a stratum, not for each document. A stratum is stored in blocks of ``POSTINGS`` postings at most (a block of one longer document
excepted), so a length that very many documents share is many rows. For each item, the highest tf of each term bounds what a block can give; blocks
are visited in the order of their bounds until the bound falls below the tenth best score so far. Nothing is left out by that: documents that could still enter are all visited.

Items come in blocks of ``ITEM_TERMS`` terms, which are broadcast; each block of items is held against the whole index. Each task gives its best of each item, and these
are ranked by salted parts first.

Edge cases: null texts, and texts without terms, have no terms: they count in no statistic, are in no stratum and are never found; items without terms have no rows;
a very long text is one block of its stratum; repeated ids are rows of their own; a null id is found like others, after all
others of equal score; an empty table gives no rows. Keys are whole numbers. Extra columns are not carried.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from junctura.functions.checkpoints import shared_table
from junctura.llm.batches import bounded, lighter

POSTINGS = 1 << 18
ITEM_TERMS = 100_000
TOP = 10
#: Row groups of written tables: an executor holds one for each task that writes or reads.
GROUP_BYTES = 8 << 20
_SALTS = 64
_LAST = (1 << 63) - 1  # stands for a null id

_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_SIGNS).split() if text else []


@dataclass
class Index:
    """``blocks`` has a row for each block. ``m`` is the stratum, ``docs`` the documents' keys, ``terms`` the block's terms, joined by spaces.

    ``groups`` is the number of different tf of each term; ``tfs``, ascending for each term, and ``sizes``, how many documents have that tf, are of
    each group; ``places`` of each posting in ``docs``. Numbers are packed: 8 bytes for keys, 2 for places, 4 for others.
    """

    blocks: DataFrame
    documents: int  # N
    terms: int  # L


_BLOCK = "m long, docs binary, terms string, groups binary, tfs binary, sizes binary, places binary"
#: Documents of a block, so that two bytes hold a place.
DOCUMENTS = 1 << 16


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms, joined by spaces, and their packed numbers of ``key, text`` rows that have terms."""
    for batch in batches:
        texts = batch.column(1)
        rows, sizes, terms, tfs = [], [], [], []
        for i in range(batch.num_rows):
            found = terms_of(texts[i].as_py())
            if found:
                counts = Counter(found)
                rows.append(i)
                sizes.append(len(found))
                terms.append(b" ".join(counts))
                tfs.append(np.fromiter(counts.values(), np.uint32, len(counts)).tobytes())
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "terms", "tfs"])


def _inverted(m: int, rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    """A block of documents ``key, terms, tfs`` of one stratum, their postings grouped by term and tf."""
    ids: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    found = [terms.split(" ") for _, terms, _ in rows]
    codes = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(found)), np.int64, sum(map(len, found)))
    tfs = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).astype(np.int64)
    key = codes * (int(tfs.max()) + 1) + tfs
    order = np.argsort(key, kind="stable")
    firsts = np.flatnonzero(np.diff(key[order], prepend=-1))
    places = np.repeat(np.arange(len(rows), dtype=np.uint16), list(map(len, found)))[order]
    groups = np.bincount(codes[order[firsts]], minlength=len(ids))
    packed = [groups.astype(np.uint32), tfs[order[firsts]].astype(np.uint32), np.diff(firsts, append=len(key)).astype(np.uint32), places]
    values = [m, np.array([r[0] for r in rows], np.int64).tobytes(), " ".join(ids), *[x.tobytes() for x in packed]]
    kinds = [pa.int64(), pa.binary(), pa.string(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["m", "docs", "terms", "groups", "tfs", "sizes", "places"])


def _blocks(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows ``m, doc, terms, tfs`` that come sorted by ``m``."""
    held: list[tuple[int, str, bytes]] = []
    size, at = 0, None
    for batch in batches:
        columns = [batch.column(k) for k in range(4)]
        for i in range(batch.num_rows):
            m, *row = (c[i].as_py() for c in columns)
            n = len(row[2]) // 4
            if held and (m != at or size + n > postings or len(held) == DOCUMENTS):
                yield _inverted(at, held)
                held, size = [], 0
            at, size = m, size + n
            held.append(tuple(row))
    if held:
        yield _inverted(at, held)


def build_index(df: DataFrame, key: str, text: str, postings: int = POSTINGS) -> Index:
    """The index of all rows, written in the shared folder."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bounded(df, lean=True).select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text).alias("text"))
    counted = shared_table(rows.mapInArrow(lighter(_counted), "doc long, n long, terms string, tfs binary"), group_bytes=GROUP_BYTES)
    told = counted.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not told["documents"]:
        return Index(counted.sparkSession.createDataFrame([], _BLOCK), 0, 0)
    wide = F.lit(90 * told["documents"]).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    shaped = counted.withColumn("up", wide).withColumn("m", 10 + F.expr(f"up div {told['terms']}"))
    # documents of one length can be a third of all: their rows are dealt by document too
    dealt = shaped.select("m", "doc", "terms", "tfs").repartitionByRange(parts, "m", F.xxhash64("doc")).sortWithinPartitions("m", "doc")
    blocks = dealt.mapInArrow(lighter(lambda b: _blocks(b, postings)), _BLOCK)
    return Index(shared_table(blocks, group_bytes=GROUP_BYTES), told["documents"], told["terms"])


@dataclass
class _Items:
    """A block of items: each pair of an item and one of its terms."""

    terms: list[str]
    item: np.ndarray  # of each pair, ascending
    term: np.ndarray
    size: int  # items

    @staticmethod
    def of(found: list[list[bytes]]) -> _Items:
        ids: dict[bytes, int] = {}
        pairs = [(k, ids.setdefault(t, len(ids))) for k, terms in enumerate(found) for t in dict.fromkeys(terms)]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return _Items([t.decode("utf-8", "surrogatepass") for t in ids], both[:, 0], both[:, 1], len(found))


class _Block:
    """A block with the postings of wanted terms found."""

    def __init__(self, row: dict, wanted: dict[str, int]):
        self.m = row["m"]
        ends = np.cumsum(np.frombuffer(row["groups"], np.uint32), dtype=np.int64)
        self.tfs = np.frombuffer(row["tfs"], np.uint32).astype(np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        # groups of each wanted term
        self.found = {wanted[t]: (int(ends[k - 1]) if k else 0, int(ends[k])) for k, t in enumerate(row["terms"].split(" ")) if t in wanted}
        self.row = row

    def frequency(self, low: int, high: int) -> int:
        """Documents in groups from ``low`` to ``high``."""
        return int(self.ends[high - 1] - (self.ends[low - 1] if low else 0))

    def impacts(self, weight: int, low: int, high: int) -> np.ndarray:
        """What a term of this weight adds, for each of its tf."""
        tf = self.tfs[low:high]
        return weight * ((10**9 * tf) // (1000 * tf + 8 * self.m))

    def scores(self, terms: list[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the block's documents for an item of these terms."""
        docs, places = np.frombuffer(self.row["docs"], np.int64), np.frombuffer(self.row["places"], np.uint16)
        spots, gains = [], []
        for t in terms:
            if t in self.found:
                low, high = self.found[t]
                spots.append(places[self.ends[low] - self.sizes[low] : self.ends[high - 1]])
                gains.append(np.repeat(self.impacts(int(weights[t]), low, high), self.sizes[low:high]))
        return docs, np.bincount(np.concatenate(spots), np.concatenate(gains), minlength=len(docs)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task's blocks hold each of the terms."""
    wanted, total = {t: k for k, t in enumerate(terms)}, np.zeros(len(terms), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            block = _Block(row, wanted)
            for t, (low, high) in block.found.items():
                total[t] += block.frequency(low, high)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "df"])


class _Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.docs: list[np.ndarray] = [np.zeros(0, np.int64)] * items
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * items
        self.least = np.ones(items, np.int64)  # a score must reach it: above 0, or the last of the best

    def add(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[item]
        docs, scores = np.concatenate([self.docs[item], docs[good]]), np.concatenate([self.scores[item], scores[good]])
        order = np.lexsort((docs, -scores))[: self.top]
        self.docs[item], self.scores[item] = docs[order], scores[order]
        if len(order) == self.top:
            self.least[item] = scores[order[-1]]


def _visit(blocks: list[_Block], items: _Items, weights: np.ndarray, best: _Best) -> None:
    """Holds all items against some blocks, those of the highest bound first."""
    bounds = np.zeros((items.size, len(blocks)), np.int64)
    for b, block in enumerate(blocks):
        most = np.zeros(len(weights), np.int64)
        for t, (_, high) in block.found.items():  # the last group has the highest tf
            most[t] = block.impacts(int(weights[t]), high - 1, high)[0]
        bounds[:, b] = np.bincount(items.item, most[items.term], minlength=items.size)
    starts = np.searchsorted(items.item, np.arange(items.size + 1))
    for item in range(items.size):
        terms = items.term[starts[item] : starts[item + 1]].tolist()
        for b in np.argsort(-bounds[item], kind="stable").tolist():
            if bounds[item, b] < best.least[item]:
                break
            best.add(item, *blocks[b].scores(terms, weights))


def _search_block(index: Index, items: _Items, top: int) -> DataFrame:
    """``item, doc, score``: the best documents of each item of a block."""
    spark = index.blocks.sparkSession
    shared = spark.sparkContext.broadcast(items)
    df_rows = index.blocks.select("m", "terms", "groups", "tfs", "sizes").mapInArrow(lighter(lambda b: _frequencies(b, shared.value.terms)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(len(items.terms), np.int64)
    for r in df_rows:
        weights[r["term"]] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r["df"] + 1)))
    told = spark.sparkContext.broadcast(weights)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        wanted, best = {t: k for k, t in enumerate(items.terms)}, _Best(items.size, top)
        for batch in batches:
            _visit([_Block(row, wanted) for row in batch.to_pylist()], items, told.value, best)
        item = np.repeat(np.arange(items.size), [len(d) for d in best.docs])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(best.docs)), pa.array(np.concatenate(best.scores))], names=["item", "doc", "score"])

    found = index.blocks.mapInArrow(lighter(search), "item long, doc long, score long")
    order = [F.desc("score"), "doc"]
    some = found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(_SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top).select("item", "doc", "score", "rank")


def search(index: Index, items: DataFrame, item_key: str, item_text: str, top: int = TOP) -> DataFrame:
    """``item_key, rank, doc_id, score``: each item's ``top`` highest-scoring documents."""
    spark = items.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    out: DataFrame | None = None

    def ranked(keys: list, found: list[list[bytes]]) -> DataFrame:
        names = spark.createDataFrame(list(enumerate(keys)), f"item long, key {kind}")
        hits = _search_block(index, _Items.of(found), top)
        doc = F.when(F.col("doc") != _LAST, F.col("doc"))
        return hits.join(F.broadcast(names), "item").select(F.col("key").alias(item_key), "rank", doc.alias("doc_id"), "score")

    keys, found, held = [], [], 0
    # items come to the driver one partition at a time, and leave it in blocks
    for row in items.select(F.col(item_key).alias("key"), F.col(item_text).alias("text")).toLocalIterator():
        terms = terms_of(row["text"])
        if not terms:
            continue
        keys.append(row["key"])
        found.append(terms)
        held += len(terms)
        if held >= ITEM_TERMS:
            part = ranked(keys, found)
            out, keys, found, held = part if out is None else out.unionByName(part), [], [], 0
    if keys or out is None:
        part = ranked(keys, found) if keys and index.documents else spark.createDataFrame([], f"{item_key} {kind}, rank int, doc_id long, score long")
        out = part if out is None else out.unionByName(part)
    return out
