"""Run index of CIGAR strings: where each run begins on the query and on the reference, looked up by binary search.

``functions.cigar`` says the same with built-in functions over arrays of operations; sums over all earlier elements of an
array are beyond them in linear time. Here a batch of strings is parsed at once and its runs lie in flat arrays with running sums, so a long
CIGAR costs no more a run than a short one. Null CIGARs give nulls, ``*`` has no runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_KNOWN = np.zeros(256, bool)
_KNOWN[list(b"MIDNSHPX")] = True
_M, _I, _D, _N, _S, _H = b"MIDNSH"


@dataclass
class Runs:
    """Runs of a batch, in order; those of row r are from ``starts[r]`` to ``starts[r + 1]``."""

    n: np.ndarray
    op: np.ndarray  # codes of the letters
    starts: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def kept(self, mask: np.ndarray) -> Runs:
        return Runs(self.n[mask], self.op[mask], np.concatenate([[0], np.cumsum(mask)])[self.starts])

    def before(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of a row's earlier runs."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[:-1] - np.repeat(sums[self.starts[:-1]], np.diff(self.starts))

    def inner(self) -> Runs:
        """Without one clip at each end."""
        clip, size = (self.op == _S) | (self.op == _H), np.diff(self.starts)
        place = np.arange(len(self.n)) - np.repeat(self.starts[:-1], size)
        ends = (place == 0) | (place == np.repeat(size, size) - 1)
        return self.kept(~(clip & ends))

    def turned(self, reverse: np.ndarray) -> Runs:
        """Rows of the reverse strand from their last run to their first."""
        row, at = self.row, np.arange(len(self.n))
        at = np.where(reverse[row], self.starts[row] + self.starts[row + 1] - 1 - at, at)
        return Runs(self.n[at], self.op[at], self.starts)


def runs_of(cigars: pa.Array) -> Runs:
    """The runs of a batch of CIGAR strings: numbers with a known letter after them."""
    texts = cigars.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    digit = (data >= 48) & (data <= 57)
    ends = np.flatnonzero(~digit)
    digits = np.flatnonzero(digit)
    of = np.searchsorted(ends, digits)
    of, digits = of[of < len(ends)], digits[of < len(ends)]
    # digits belong to the next letter of their own string
    row_of_end = np.searchsorted(offsets, ends, side="right") - 1
    own = np.searchsorted(offsets, digits, side="right") - 1 == row_of_end[of]
    of, digits = of[own], digits[own]
    values = np.bincount(of, (data[digits] - 48.0) * 10.0 ** (ends[of] - digits - 1), minlength=len(ends)).astype(np.int64)
    good = _KNOWN[data[ends]] & (np.bincount(of, minlength=len(ends)) > 0)
    counts = np.bincount(row_of_end[good], minlength=len(texts))
    return Runs(values[good], data[ends[good]], np.concatenate([[0], np.cumsum(counts)]))


def _lists(starts: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values, mask=like.is_null())


def letters(op: np.ndarray) -> pa.Array:
    """Codes as one-letter strings."""
    return pa.DictionaryArray.from_arrays(pa.array(op.astype(np.int16)), pa.array([chr(k) for k in range(128)])).cast(pa.string())


_INDEX = "array<struct<number:int,op:string,n:long,query:long,reference:long,deleted:long>>"


def run_index(cigar: Column) -> Column:
    """Matches and insertions as ``array<struct<number, op, n, query, reference, deleted>>``: the operation's number, its length, the query bases and the
    reference bases before it, and the bases deleted after its last base where a match or an insertion follows."""

    @F.arrow_udf(_INDEX)
    def index(cigars: pa.Array) -> pa.Array:
        runs = runs_of(cigars)
        number = np.arange(len(runs.n)) - np.repeat(runs.starts[:-1], np.diff(runs.starts))
        bases = (runs.op == _M) | (runs.op == _I)
        far = (runs.op == _M) | (runs.op == _D) | (runs.op == _N)
        query, reference = runs.before(runs.n * bases), runs.before(runs.n * far)
        row = runs.row
        deleted = np.zeros(len(runs.n), np.int64)
        follows = (runs.op[1:-1] == _D) & bases[2:] & (row[2:] == row[:-2])
        deleted[:-2][follows] = runs.n[1:-1][follows]
        starts = np.concatenate([[0], np.cumsum(bases)])[runs.starts]
        fields = [pa.array(number[bases], pa.int32()), letters(runs.op[bases]), *[pa.array(x[bases], pa.int64()) for x in (runs.n, query, reference, deleted)]]
        return _lists(starts, pa.StructArray.from_arrays(fields, names=["number", "op", "n", "query", "reference", "deleted"]), cigars)

    return index(cigar)


def reference_at(cigar: Column, offset: Column, start: Column, reverse: Column) -> Column:
    """Reference position that ``offset`` query bases lead to from ``start``: up, or down on the reverse strand, whose runs are turned round.

    Matches before the offset count, and deletions after a base before it. The runs that begin at or before the offset are found by binary search; of their sum is taken what the last match has beyond it.
    """

    @F.arrow_udf("long")
    def at(cigars: pa.Array, offsets: pa.Array, starts: pa.Array, reverses: pa.Array) -> pa.Array:
        back = reverses.fill_null(False).to_numpy(zero_copy_only=False)
        o, s = (x.fill_null(0).to_numpy().astype(np.int64) for x in (offsets, starts))
        runs = runs_of(cigars).inner().turned(back)
        base = np.isin(runs.op, [_M, _I])
        query = runs.before(runs.n * base)
        counts = (runs.op == _M) | ((runs.op == _D) & (query > 0))
        row = runs.row
        top = int(max(query.max(initial=0), o.max(initial=0))) + 1
        found = np.searchsorted(row * top + query, np.arange(len(o)) * top + np.maximum(o, 0), side="right")
        sums = np.concatenate([[0], np.cumsum(runs.n * counts)])
        far = sums[found] - sums[runs.starts[:-1]]
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(base, np.arange(len(runs.n)), -1))])[found]
        some = last >= runs.starts[:-1]
        last = np.where(some, last, 0)
        if len(runs.n):
            over = np.where(some & (runs.op[last] == _M), np.maximum(query[last] + runs.n[last] - np.maximum(o, 0), 0), 0)
            far = far - over
        return pa.array(np.where(back, s - far, s + far), pa.int64(), mask=np.logical_or.reduce([x.is_null().to_numpy(zero_copy_only=False) for x in (cigars, offsets, starts)]))

    return at(cigar, offset.cast("long"), start.cast("long"), reverse)


def sub_interval(cigar: Column, first: Column, last: Column, reverse: Column) -> tuple[Column, Column]:
    """Query offsets before the operations number ``first`` and ``last``, from the fragment's end on the reverse strand. Deletions take no bases."""

    @F.arrow_udf("first long, last long")
    def sides(cigars: pa.Array, a: pa.Array, b: pa.Array, reverses: pa.Array) -> pa.Array:
        runs = runs_of(cigars)
        sums = np.concatenate([[0], np.cumsum(runs.n * (runs.op != _D))])
        begin, end = runs.starts[:-1], runs.starts[1:]
        back = reverses.fill_null(False).to_numpy(zero_copy_only=False)
        gone = cigars.is_null().to_numpy(zero_copy_only=False)

        def side(k: pa.Array) -> pa.Array:
            at = sums[np.minimum(begin + k.fill_null(0).to_numpy().astype(np.int64), end)]
            return pa.array(np.where(back, sums[end] - at, at - sums[begin]), pa.int64(), mask=gone)

        return pa.StructArray.from_arrays([side(a), side(b)], names=["first", "last"])

    both = sides(cigar, first.cast("int"), last.cast("int"), reverse)
    return both["first"], both["last"]


def slice_by_query(cigar: Column, start: Column, end: Column) -> Column:
    """The CIGAR of the query bases ``[start, end)``, counted from 0 after clips are dropped; a deletion at ``end`` belongs to the base before it."""

    @F.arrow_udf("string")
    def cut(cigars: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        runs = runs_of(cigars)
        runs = runs.kept((runs.op != _S) & (runs.op != _H))
        uses, row = (runs.op != _D) & (runs.op != _N), runs.row
        at = runs.before(runs.n * uses)
        low, high = (x.fill_null(0).to_numpy().astype(np.int64)[row] for x in (starts, ends))
        inside = np.where((at > low) & (at <= high), runs.n, 0)
        n = np.where(uses, np.minimum(at + runs.n, high) - np.maximum(at, low), inside)
        runs = Runs(n, runs.op, runs.starts).kept(n > 0)
        told = [f"{k}{chr(c)}" for k, c in zip(runs.n.tolist(), runs.op.tolist())]
        edges = runs.starts.tolist()
        return pa.array(["".join(told[a:b]) or "*" for a, b in zip(edges[:-1], edges[1:])], pa.string(), mask=cigars.is_null().to_numpy(zero_copy_only=False))

    return cut(cigar, start.cast("long"), end.cast("long"))


def expanded_bases(df: DataFrame, cigar: str, *columns: str) -> DataFrame:
    """``columns`` with ``place, base, deleted, number`` for each query base: a row a base, made on demand from the run index.

    ``base`` is ``M``, or ``-`` for an insertion; ``deleted`` how many bases are deleted after it; ``number`` its operation's.
    """
    rows = df.select(*columns, F.explode(run_index(F.col(cigar))).alias("__run"))
    at = len(columns)

    def bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run = batch.column(at)
            number, op, n, query, deleted = (run.field(k) for k in (0, 1, 2, 3, 5))
            ends = np.cumsum(n.to_numpy())
            begin = 0
            while begin < len(ends):  # not many more bases than a million at once
                done = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, done + 1_000_000, side="right")))
                size = n.to_numpy()[begin:stop]
                of = np.repeat(np.arange(begin, stop), size)
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                last = place == np.repeat(size, size) - 1
                taken = [batch.column(k).take(pa.array(of)) for k in range(at)]
                sign = pa.array(np.where(op.to_numpy(zero_copy_only=False)[of] == "M", "M", "-"))
                yield pa.RecordBatch.from_arrays([*taken, pa.array(query.to_numpy()[of] + place), sign, pa.array(np.where(last, deleted.to_numpy()[of], 0)), pa.array(number.to_numpy()[of], pa.int32())], names=[*columns, "place", "base", "deleted", "number"])
                begin = stop

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(bases, f"{kinds}, place long, base string, deleted long, number int")
