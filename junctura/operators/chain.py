"""The best chain of segments of each fragment."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from junctura.functions.cigar import told
from junctura.functions.runs import Runs, letters, runs_of
from junctura.operators.intervals import drop_contained

JUMP = -50.0
OPERATIONS, KNOWN = re.compile(r"(\d+)(\D)"), re.compile(r"(\d+)([MIDNSHPX])")
#: Operations that many fragments can be told by at once: matches, insertions and deletions between clips, as they are written.
PLAIN = r"^((0|[1-9][0-9]{0,8})[HS])?((0|[1-9][0-9]{0,8})[MID])*((0|[1-9][0-9]{0,8})[HS])?$"
#: Rows that go through arrays at once, most segments of a fragment there, and the bound of its places.
ROWS, TOGETHER, FAR = 32_768, 32, 1 << 40
_M, _I, _D = b"MID"


def _slices(ops: list[tuple[int, str]], cuts: list[int]) -> list[float]:
    """Scores of the query bases between consecutive ``cuts``, counted from the segment's start, in one walk over the operations. Deletions belong to the base before."""
    out = [0.0] * (len(cuts) - 1)
    at, k = 0, 0
    for n, op in ops:
        if op == "D":
            # the slice that holds the base before: cuts[k] < at <= cuts[k + 1]
            i = k if at > cuts[k] else k - 1
            if 0 <= i < len(out) and cuts[i] < at <= cuts[i + 1]:
                out[i] += -1.0 - 0.2 * n
        elif op in "MI":
            low, end = at, at + n
            while k < len(out) and low < end:
                inside = min(end, cuts[k + 1]) - max(low, cuts[k])
                if inside > 0:
                    out[k] += 0.92 * inside if op == "M" else -1.0 - 0.2 * inside
                if cuts[k + 1] > end:
                    break
                low, k = cuts[k + 1], k + 1
            at = end
    return out


def best_chain(segments: list[tuple[int, int, list[tuple[int, str]]]]) -> tuple[int, list[tuple[int, int, int, float]]]:
    """Best chain of (first, last, operations) segments of which none lies in another, sorted by first.

    States are (place, segment) for every segment border within a segment. A segment goes on to the next
    border for its score there; where two overlap, the chain may leave the first at the second's
    start and enter the second at the first's end, for the mean of both scores just before that end and a
    penalty; and it may jump to a segment from the latest one that ends before it. Scores are cut to whole
    numbers at every state, toward zero. Of equal ones the later state wins.
    Returns the score and (segment, first, last, exact score) pieces; -1 for no segment.

    Both ends of such segments ascend, so those over a place are a range of them, at most one ends there, and the latest before a start is found by bisection. The
    time goes with the number of states.
    """
    if not segments:
        return -1, []
    places = sorted({p for a, b, _ in segments for p in (a, b + 1)})
    index = {p: k for k, p in enumerate(places)}
    lo = [index[a] for a, _, _ in segments]
    hi = [index[b + 1] for _, b, _ in segments]
    gains = [_slices(ops, [p - a for p in places[i : k + 1]]) for (a, _, ops), i, k in zip(segments, lo, hi)]
    ends = {k: o for o, k in enumerate(hi)}
    score: list[list[int]] = [[] for _ in segments]
    back: list[list[tuple[int, int] | None]] = [[] for _ in segments]
    begun = done = 0
    for k in range(len(places)):
        while begun < len(segments) and lo[begun] <= k:
            begun += 1
        while hi[done] < k:
            done += 1
        o = ends.get(k)
        for j in range(done, begun):
            came = []
            if k > lo[j]:
                came.append((score[j][-1] + gains[j][k - 1 - lo[j]], (k - 1, j)))
                if o is not None and o < j:
                    came.append((score[o][lo[j] - lo[o]] + JUMP + (gains[o][-1] + gains[j][k - 1 - lo[j]]) / 2, (lo[j], o)))
            else:
                before = bisect_right(hi, k, 0, j) - 1
                if before >= 0:
                    came.append((score[before][-1] + JUMP, (hi[before], before)))
            top = max(came, default=(0.0, None))
            score[j].append(int(top[0]))
            back[j].append(top[1])
    at = max((score[j][-1], (hi[j], j)) for j in range(len(segments)))[1]
    total, pieces, stop = score[at[1]][-1], [], at
    while True:
        previous = back[at[1]][at[0] - lo[at[1]]]
        if previous is None or previous[1] != at[1]:
            j, k0, k1 = at[1], at[0], stop[0]
            pieces.append((j, places[k0], places[k1] - 1, sum(gains[j][k0 - lo[j] : k1 - lo[j]])))
            stop = previous
        if previous is None:
            return total, pieces[::-1]
        at = previous


def _cut(ops: list[tuple[int, str]], lo: int, hi: int) -> list[tuple[int, str]]:
    """Operations of the query bases [lo, hi), with deletions after one of them."""
    at, out = 0, []
    for n, op in ops:
        if op == "D":
            if lo < at <= hi:
                out.append((n, op))
            continue
        inside = min(hi, at + n) - max(lo, at)
        if inside > 0:
            out.append((inside, op))
        at += n
    return out


def _walked(ops: list[tuple[int, str]], offset: int) -> int:
    """Reference bases of the first ``offset`` query bases."""
    return sum(n for n, op in _cut(ops, 0, offset) if op in "MD")


def _inner(ops: list[tuple[int, str]], reverse: bool) -> list[tuple[int, str]]:
    """Operations in the order of the fragment, without one clip at each end."""
    if ops and ops[0][1] in "HS":
        ops = ops[1:]
    if ops and ops[-1][1] in "HS":
        ops = ops[:-1]
    return ops[::-1] if reverse else ops


@dataclass
class _Pieces:
    """Pieces of chains: the segment of each, its first base, the base after it, its score and its chain's."""

    segment: np.ndarray
    first: np.ndarray
    end: np.ndarray
    score: list[float]
    total: np.ndarray


def _chains(first: np.ndarray, end: np.ndarray, starts: np.ndarray, runs: Runs) -> _Pieces:
    """``best_chain`` of many fragments at once, with the same numbers: the n-th states of all fragments are worked out together.

    Segments of a fragment follow each other from ``starts``; ``runs`` has matches, insertions and deletions in the order of the fragment. A step
    is a few operations on arrays, so a fragment of a few segments costs microseconds.
    """
    n = len(first)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    both, owner = np.concatenate([first, end]), np.concatenate([of, of])
    order = np.lexsort((both, owner))
    both, owner = both[order], owner[order]
    fresh = np.append(True, (both[1:] != both[:-1]) | (owner[1:] != owner[:-1]))
    number = np.empty(2 * n, np.int64)
    number[order] = np.cumsum(fresh) - 1
    lo, hi, places, owner = number[:n], number[n:], both[fresh], owner[fresh]
    # fragments side by side on one line, so one search finds places of all of them
    width = end[np.append(starts[1:], n) - 1] - first[starts] + 1
    shift = np.cumsum(width) - width - first[starts]
    line, left, right = places + shift[owner], first + shift[of], end + shift[of]

    slices = hi - lo
    gain_at, state_at = np.cumsum(slices) - slices, np.cumsum(slices + 1) - slices - 1
    row = runs.row
    base, gone = runs.op != _D, runs.op == _D
    offset = runs.before(runs.n * base)
    at = left[row] + offset
    low, high = np.minimum(at, right[row]), np.minimum(at + runs.n, right[row])
    begin = np.where(gone, np.searchsorted(line, at, "left"), np.searchsorted(line, low, "right")) - 1
    count = np.where(gone, (offset > 0) & (at <= right[row]), np.where(high > low, np.searchsorted(line, high, "left") - begin, 0))
    k = np.repeat(np.arange(len(row)), count)
    s = begin[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
    inside = np.where(gone[k], runs.n[k], np.minimum(high[k], line[np.minimum(s + 1, len(line) - 1)]) - np.maximum(low[k], line[s]))
    value = np.where(runs.op[k] == _M, 0.92 * inside, -1.0 - 0.2 * inside)
    gains = np.bincount(gain_at[row[k]] + s - lo[row[k]], value, minlength=slices.sum())

    segment = np.repeat(np.arange(n), slices + 1)
    states = len(segment)
    step = np.arange(states) - state_at[segment]
    place = lo[segment] + step
    own = gains[np.maximum(gain_at[segment] + step - 1, 0)]
    ending = np.full(len(places), -1)
    ending[hi] = np.arange(n)
    before = np.searchsorted(hi, lo, "right") - 1
    before = np.where(before >= starts[of], before, -1)[segment]
    # a state is reached along its segment or by a jump; the last number of ``score`` stands for none
    other = np.where(step > 0, np.where(ending[place] < segment, ending[place], -1), before)
    jumps = other >= 0
    o = np.maximum(other, 0)
    source = np.where(jumps, np.where(step > 0, state_at[o] + lo[segment] - lo[o], state_at[o] + slices[o]), states)
    added = np.where(jumps, np.where(step > 0, (gains[gain_at[o] + slices[o] - 1] + own) / 2, 0.0), -np.inf)
    along = np.where(step > 0, np.arange(states) - 1, states)
    own = np.where(step > 0, own, np.where(jumps, -np.inf, 0.0))
    turn = np.arange(states) - state_at[starts[of[segment]]]
    order = np.argsort(turn, kind="stable")
    ends = np.cumsum(np.bincount(turn))
    source_o, added_o, along_o, own_o = source[order], added[order], along[order], own[order]
    score, jumped = np.zeros(states + 1), np.zeros(states, bool)
    a = 0
    for b in ends.tolist():
        stay, jump = score[along_o[a:b]] + own_o[a:b], score[source_o[a:b]] + JUMP + added_o[a:b]
        better = jump > stay
        score[order[a:b]] = np.trunc(np.where(better, jump, stay))
        jumped[order[a:b]] = better
        a = b

    last = score[state_at + slices]
    total = np.maximum.reduceat(last, starts)
    chosen = np.maximum.reduceat(np.where(last == total[of], np.arange(n), -1), starts)
    entry = np.maximum.accumulate(np.where((step == 0) | jumped, np.arange(states), 0))
    came = np.where(jumped, source, -1)
    at, pieces = state_at[chosen] + slices[chosen], []
    while len(at):
        into = entry[at]
        pieces.append((segment[into], place[into], place[at]))
        at = came[into]
        at = at[at >= 0]
    j, k0, k1 = (np.concatenate(x) for x in zip(*pieces))
    order = np.argsort(j)
    j, k0, k1 = j[order], k0[order], k1[order]
    numbers, begin = gains.tolist(), gain_at[j] + k0 - lo[j]
    sums = [float(sum(numbers[a:b])) for a, b in zip(begin.tolist(), (begin + k1 - k0).tolist())]
    return _Pieces(j, places[k0], places[k1], sums, total[of[j]].astype(np.int64))


def _told_together(batch: pa.RecordBatch, starts: np.ndarray, span: bool) -> list[pa.Array]:
    """Columns of the result for fragments of few segments with plain operations."""
    first, end = batch.column(2).to_numpy(), batch.column(3).to_numpy() + 1
    low, high = batch.column(5).to_numpy(), batch.column(6).to_numpy()
    reverse = batch.column(7).fill_null(False).to_numpy(zero_copy_only=False)
    runs = runs_of(batch.column(4)).inner().turned(reverse)
    if span:
        sums = np.concatenate([[0], np.cumsum(runs.n * (runs.op != _I))])
        high = low + sums[runs.starts[1:]] - sums[runs.starts[:-1]]
    pieces = _chains(first, end, starts, runs)
    j = pieces.segment
    # each piece beside all operations of its segment
    size = np.diff(runs.starts)[j]
    of = np.repeat(np.arange(len(j)), size)
    k = runs.starts[j][of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    n, op, at = runs.n[k], runs.op[k], runs.before(runs.n * (runs.op != _D))[k]
    a, b = (pieces.first - first[j])[of], (pieces.end - first[j])[of]
    inside = np.where(op == _D, n, np.minimum(b, at + n) - np.maximum(a, at))
    kept = np.where(op == _D, (at > a) & (at <= b), inside > 0)

    def walked(stop: np.ndarray) -> np.ndarray:
        far = np.where(op == _M, np.maximum(np.minimum(stop, at + n) - at, 0), np.where((op == _D) & (at > 0) & (at <= stop), n, 0))
        sums = np.concatenate([[0], np.cumsum(far)])
        return sums[np.cumsum(size)] - sums[np.cumsum(size) - size]

    back, alone = reverse[j], np.diff(np.append(starts, len(first)))[np.searchsorted(starts, j, "right") - 1] == 1
    low, high = low[j], high[j]
    ends = [np.where(back, high - far, low + far) for far in (walked(a), walked(b))]
    whole = [np.where(back, high, low), np.where(back, low, high)]
    items = pc.binary_join_element_wise(pa.array(inside[kept]).cast(pa.string()), letters(op[kept]), "")
    sizes = np.bincount(of[kept], minlength=len(j))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items), "")
    own = batch.column(4).take(pa.array(j)).cast(pa.string())
    return [
        batch.column(0).take(pa.array(j)), batch.column(1).take(pa.array(j)), pa.array(pieces.first), pa.array(pieces.end - 1), pa.array(pieces.score, pa.float64()), pa.array(pieces.total),
        *[pa.array(np.where(alone, x, y)) for x, y in zip(whole, ends)], pc.if_else(pa.array(alone), own, texts),
    ]


def _told_alone(batch: pa.RecordBatch, starts: np.ndarray, span: bool, pattern: re.Pattern) -> list[pa.Array]:
    """The same for any fragment, one by one."""
    taken, out = [], []
    ends = np.append(starts[1:], batch.num_rows)
    rows = list(zip(*[batch.column(k).to_pylist() for k in range(2, 8)]))
    for a, b in zip(starts.tolist(), ends.tolist()):
        items = rows[a:b]
        raw = [[(int(n), op) for n, op in pattern.findall(x[2])] for x in items]
        inner = [_inner(ops, bool(x[5])) for ops, x in zip(raw, items)]
        total, pieces = best_chain([(x[0], x[1], ops) for x, ops in zip(items, inner)])
        for j, first, last, gain in pieces:
            x, ops = items[j], inner[j]
            low = x[3]
            high = low + sum(n for n, op in raw[j] if op not in "IHS") if span else x[4]
            lo, hi = first - x[0], last + 1 - x[0]
            if b - a == 1:
                at = (high, low) if x[5] else (low, high)
            else:
                at = (high - _walked(ops, lo), high - _walked(ops, hi)) if x[5] else (low + _walked(ops, lo), low + _walked(ops, hi))
            own = raw[j] if b - a == 1 else _cut(ops, lo, hi)
            taken.append(a + j)
            out.append((first, last, float(gain), total, *at, "".join(f"{n}{op}" for n, op in own)))
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return [batch.column(0).take(pa.array(taken, pa.int64())), batch.column(1).take(pa.array(taken, pa.int64())), *[pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]]


def _starts(names: pa.Array) -> np.ndarray:
    """Where each fragment begins among rows in its order."""
    code = names.dictionary_encode("encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """The fragments of ``batch`` that can be told together, and the others."""
    starts = _starts(batch.column(0))
    first, end = batch.column(2).to_numpy(), batch.column(3).to_numpy() + 1
    good = pc.match_substring_regex(batch.column(4), PLAIN).fill_null(False).to_numpy(zero_copy_only=False)
    good = np.logical_and.reduceat(good & (end > first) & (np.abs(first) < FAR) & (np.abs(end) < FAR), starts)
    size = np.diff(np.append(starts, batch.num_rows))
    good &= size <= TOGETHER
    for plain in (True, False):
        own = good == plain
        if own.all():
            yield batch, starts, plain
        elif own.any():
            yield batch.filter(pa.array(np.repeat(own, size))), np.cumsum(size[own]) - size[own], plain


def _whole_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some ``ROWS`` rows that end where a fragment ends; only a fragment with more makes a larger one."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS or held[0].column(0)[0].as_py() == batch.column(0)[-1].as_py():
            continue
        joined = pa.concat_batches(held)
        at = int(_starts(joined.column(0))[-1])
        yield joined.slice(0, at)
        held, rows = [joined.slice(at)], len(joined) - at
    if held:
        yield pa.concat_batches(held)


def chain_segments(df: DataFrame, fragment: str, row: str, first: str, last: str, cigar: str, ref_start: str | None = None, ref_end: str | None = None, reverse: str | None = None) -> DataFrame:
    """``fragment, row, first, last, score, chain_score, ref_start, ref_end, align_str`` of the segments of each fragment's best chain.

    ``cigar`` has each segment's operations as aligned, clips included: an array of struct<n, op>, or a CIGAR text, which saves parsing rows that
    don't stay. A piece is told in the context of the fragment: its operations in that order, and the reference ends from the first base of it to the last, so they fall on the
    reverse strand. Without ``ref_start`` and ``ref_end`` they count from 0; without ``ref_end`` alone a segment ends as far on as its operations reach.
    A fragment with one segment gives it whole, with its clips as aligned. Contained segments are dropped by
    window functions first; what is left goes to Python sorted, a fragment's rows in one task. Fragments of up to ``TOGETHER`` segments
    are chained together, as arrays of ``ROWS`` rows; longer ones, and those with other operations, one by one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [fragment, row, first, last, "score", "chain_score", "ref_start", "ref_end", "align_str"]
    text, span = kinds[cigar] == "string", ref_start is not None and ref_end is None
    pattern = KNOWN if text else OPERATIONS

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_fragments(batches):
            for part, starts, plain in _parts(batch):
                columns = _told_together(part, starts, span) if plain else _told_alone(part, starts, span, pattern)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    zero = F.lit(0).cast("long")
    rows = df.select(
        fragment, row, F.col(first).cast("long").alias(first), F.col(last).cast("long").alias(last), F.col(cigar).alias("__ops"),
        (F.col(ref_start).cast("long") if ref_start else zero).alias("__from"), (F.col(ref_end).cast("long") if ref_end else zero).alias("__to"), (F.col(reverse) if reverse else F.lit(False)).alias("__reverse"),
    )
    survivors = drop_contained(rows, fragment, first, last, together=True)
    survivors = survivors if text else survivors.withColumn("__ops", told(F.col("__ops")))
    inputs = survivors.select(fragment, row, first, last, "__ops", "__from", "__to", "__reverse")
    return inputs.mapInArrow(best, f"`{fragment}` {kinds[fragment]}, `{row}` {kinds[row]}, `{first}` long, `{last}` long, score double, chain_score long, ref_start long, ref_end long, align_str string")
