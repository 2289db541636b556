"""Operators on intervals: containment, overlap, coverage, nearest points, merging.

Every function takes DataFrames and column names and returns a DataFrame. Range joins
add bin columns and so become equi joins with a residual predicate: no cross join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


#: Most rows of a key that are sorted in one piece.
PIECE_ROWS = 2_000_000
BROADCAST_ROWS = 500_000


def _cut(rows: DataFrame, keys: list[str], at: str) -> tuple[DataFrame, int]:
    """Adds ``__piece``, the piece that a row's place ``at`` is in, and returns how many pieces there are.

    Rows are counted by key first. While no key has more than ``PIECE_ROWS`` there is one piece; otherwise pieces end at quantiles of the
    places of the keys that have more, as many as the largest needs. A key with a third of all rows so is as many tasks as it has parts of that size.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__rows"))
    most = counts.agg(F.max("__rows")).first()[0] or 0
    if most <= PIECE_ROWS:
        return rows.withColumn("__piece", F.lit(0)), 1
    pieces = -(-most // PIECE_ROWS)
    large = counts.filter(F.col("__rows") > PIECE_ROWS).select(*[F.col(k).alias(f"__of_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    # a large key has more than PIECE_ROWS rows, so there are few
    places = rows.join(F.broadcast(large), same, "left_semi")
    bounds = sorted(set(places.approxQuantile(at, [k / pieces for k in range(1, pieces)], min(0.02, 0.25 / pieces))))
    inside = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    piece = F.coalesce(F.size(F.filter(inside, lambda b: F.col(at) >= b)), F.lit(0))
    return rows.withColumn("__piece", F.when(F.col(at).isNull(), 0).otherwise(piece)), len(bounds) + 1


def _carried(rows: DataFrame, keys: list[str], at: str, value: Column) -> DataFrame:
    """Adds ``__piece`` (see ``_cut``), ``__before``, the greatest ``value`` of a row's key in earlier pieces, and ``__after``, the least in later ones.

    What is carried between pieces is a row for each key and piece; it is broadcast
    if it is ``BROADCAST_ROWS`` rows at most by a count. With one piece nothing is carried.
    """
    return _between(*_cut(rows, keys, at), keys, value)


def _between(rows: DataFrame, pieces: int, keys: list[str], value: Column) -> DataFrame:
    """Rows that are cut, with what is carried."""
    if pieces == 1:
        kind = rows.select(value.alias("v")).schema["v"].dataType
        return rows.withColumns({"__before": F.lit(None).cast(kind), "__after": F.lit(None).cast(kind)})
    totals = rows.groupBy(*keys, "__piece").agg(F.max(value).alias("__m"), F.min(value).alias("__n"))
    w = W.partitionBy(*keys).orderBy("__piece")
    carry = totals.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__piece").alias("__at_piece"), F.max("__m").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("__before"), F.min("__n").over(w.rowsBetween(1, W.unboundedFollowing)).alias("__after"))
    return _joined(rows, carry, keys)


def _joined(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is carried to their key and piece."""
    if carry.count() <= BROADCAST_ROWS:
        carry = F.broadcast(carry)
    same = F.col("__piece") == F.col("__at_piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(carry, same).drop("__at_piece", *[f"__of_{k}" for k in keys])


def islands(df: DataFrame, key: str, lo: str, hi: str, out: str) -> DataFrame:
    """``df`` with the start of each interval's island: an island begins where no earlier interval of the key reaches. Intervals without a place have none."""
    reach = F.greatest("__before", F.max(hi).over(W.partitionBy(key, "__piece").orderBy(lo, hi).rowsBetween(W.unboundedPreceding, -1)))
    rows = _carried(df, [key], lo, F.col(hi)).withColumn("__reach", reach)
    fresh = F.when(F.col(lo).isNotNull() & (F.col("__reach").isNull() | (F.col(lo) >= F.col("__reach"))), F.col(lo))
    rows = rows.withColumn("__fresh", fresh).drop("__before", "__after")
    totals = rows.groupBy(key, "__piece").agg(F.max("__fresh").alias("__m"))
    w = W.partitionBy(key).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(F.col(key).alias(f"__of_{key}"), F.col("__piece").alias("__at_piece"), F.max("__m").over(w).alias("__since"))
    inside = F.max("__fresh").over(W.partitionBy(key, "__piece").orderBy(lo, hi).rowsBetween(W.unboundedPreceding, 0))
    # the last island that began within the piece, or else in a piece before
    placed = _joined(rows, carry, [key]).withColumn(out, F.when(F.col(lo).isNotNull(), F.coalesce(inside, F.col("__since"))))
    return placed.select(*df.columns, out)


def drop_contained(df: DataFrame, key: str, lo: str, hi: str, together: bool = False) -> DataFrame:
    """Keeps intervals that lie in no other interval of their key (closed comparison, no tie-break).

    Of identical intervals none stays. One sort by key, piece and start replaces the self join: an
    interval lies in another if its neighbour in the sort is the same, or if an earlier one reaches as far. A key is
    cut into pieces by start, and the farthest reach of earlier pieces is carried on, so no task sorts a whole key. With
    ``together``, what stays of a key is in one task, in order; it is only sent again if keys were cut, as a window has a whole key otherwise.
    """
    w = W.partitionBy(key, "__piece").orderBy(F.col(lo).asc(), F.col(hi).desc())
    same = lambda move: F.coalesce((move(lo).over(w) == F.col(lo)) & (move(hi).over(w) == F.col(hi)), F.lit(False))
    reach = F.greatest("__before", F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1)))
    rows, pieces = _cut(df, [key], lo)
    ranked = _between(rows, pieces, [key], F.col(hi)).withColumn("__reach", reach).withColumn("__same", same(F.lag) | same(F.lead))
    stay = ranked.filter(~F.col("__same") & (F.col("__reach").isNull() | (F.col("__reach") < F.col(hi)))).select(*df.columns)
    if not together:
        return stay
    return (stay if pieces == 1 else stay.repartition(F.col(key))).sortWithinPartitions(F.col(key).asc(), F.col(lo).asc(), F.col(hi).desc())


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_lo: str, left_hi: str, right_lo: str, right_hi: str, width: int, condition: Column | None = None) -> DataFrame:
    """Inner join of half-open intervals ``[lo, hi)`` that overlap within equal ``keys``.

    Both sides are spread over bins of ``width``; a pair is kept in the bin of its
    later start only, so no pair comes twice and no distinct is needed. Column names of the two sides must
    differ except for the keys.
    """
    a = left.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(left_lo) / width), F.floor((F.greatest(F.col(left_hi), F.col(left_lo) + 1) - 1) / width))))
    b = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(right_lo) / width), F.floor((F.greatest(F.col(right_hi), F.col(right_lo) + 1) - 1) / width))))
    joined = a.join(b, [*keys, "__bin"])
    meets = (F.col(left_lo) < F.col(right_hi)) & (F.col(right_lo) < F.col(left_hi)) & (F.floor(F.greatest(left_lo, right_lo) / width) == F.col("__bin"))
    return joined.filter(meets if condition is None else meets & condition).drop("__bin")


def overlap_pairs(df: DataFrame, key: str, lo: str, hi: str, row: str, width: int) -> DataFrame:
    """Pairs of intervals ``[lo, hi)`` of one key with an overlap of positive length: ``key, row_a, row_b, overlap``, row_a < row_b."""
    side = lambda s: df.select(F.col(key), F.col(row).alias(f"row_{s}"), F.col(lo).alias(f"lo_{s}"), F.col(hi).alias(f"hi_{s}"))
    pairs = range_join(side("a"), side("b"), [key], "lo_a", "hi_a", "lo_b", "hi_b", width, F.col("row_a") < F.col("row_b"))
    return pairs.select(key, "row_a", "row_b", (F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b")).alias("overlap"))


def previous_before(df: DataFrame, key: str, lo: str, hi: str, out: str) -> DataFrame:
    """As-of predecessor: the greatest end of the key's intervals that end at or before each start; null if none.

    Ends and starts are sorted together once, in pieces; the last end seen is the answer.
    """
    starts = df.select(F.col(key), F.col(lo).alias("__at"), F.lit(1).alias("__kind"), F.struct("*").alias("__row"))
    ends = df.select(F.col(key), F.col(hi).alias("__at"), F.lit(0).alias("__kind")).withColumn("__row", F.lit(None).cast(starts.schema["__row"].dataType))
    own = F.when(F.col("__kind") == 0, F.col("__at"))
    order = W.partitionBy(key, "__piece").orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    both = _carried(ends.unionByName(starts), [key], "__at", own).withColumn("__last", F.greatest("__before", F.max(own).over(order)))
    return both.filter("__kind = 1").select("__row.*", F.col("__last").alias(out))


def union_coverage(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """``key, covered, islands``: length of the union of half-open intervals, and the number of its pieces. Gaps and islands, no per-base rows."""
    before = W.partitionBy(key, "__piece").orderBy(lo, hi).rowsBetween(W.unboundedPreceding, -1)
    steps = _carried(df.select(key, lo, hi), [key], lo, F.col(hi)).withColumn("__reach", F.greatest("__before", F.max(hi).over(before)))
    fresh = F.when(F.col("__reach").isNull() | (F.col(lo) > F.col("__reach")), 1).otherwise(0)
    gain = F.greatest(F.lit(0), F.col(hi) - F.greatest(F.col(lo), F.coalesce("__reach", lo)))
    return steps.groupBy(key).agg(F.sum(gain).cast("long").alias("covered"), F.sum(fresh).cast("long").alias("islands"))


def nearest_point(targets: DataFrame, points: DataFrame, keys: list[str], target: str, point: str, out: str) -> DataFrame:
    """The point nearest to each target within the keys; a tie takes the right one; null if the key has no point.

    Targets and points are sorted together, in pieces: the last point at or before and the first point at or after are the only candidates.
    """
    a = targets.select(*keys, F.col(target).alias("__at"), F.lit(1).alias("__kind"), F.struct(*[F.col(f"`{c}`") for c in targets.columns]).alias("__row"))
    b = points.select(*keys, F.col(point).alias("__at"), F.lit(0).alias("__kind")).withColumn("__row", F.lit(None).cast(a.schema["__row"].dataType))
    own = F.when(F.col("__kind") == 0, F.col("__at"))
    w = W.partitionBy(*keys, "__piece")
    left = F.greatest("__before", F.max(own).over(w.orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)))
    right = F.least("__after", F.min(own).over(w.orderBy(F.col("__at").desc(), "__kind").rowsBetween(W.unboundedPreceding, 0)))
    near = _carried(a.unionByName(b), keys, "__at", own).withColumn("__left", left).withColumn("__right", right).filter("__kind = 1")
    pick = F.when(F.col("__left").isNull(), F.col("__right")).when(F.col("__right").isNull(), F.col("__left"))
    pick = pick.when(F.col("__at") - F.col("__left") < F.col("__right") - F.col("__at"), F.col("__left")).otherwise(F.col("__right"))
    return near.select("__row.*", pick.alias(out))


def nearest_exon(df: DataFrame, position: str, starts: str, ends: str) -> DataFrame:
    """Index of the exon whose start, and whose end, is nearest to ``position`` (first of ties): ``start_exon, end_exon``."""
    def first(values: str) -> Column:
        near = F.transform(values, lambda v, i: F.struct(F.abs(v - F.col(position)).alias("far"), i.alias("i")))
        return F.array_min(near)["i"]

    return df.withColumn("start_exon", first(starts)).withColumn("end_exon", first(ends))


def merge_similar(df: DataFrame, key: str, lo: str, hi: str, ratio: float = 0.8, samples: str | None = None) -> DataFrame:
    """Ordered merging: sorted by (lo, hi), an interval joins the one before if (its end - lo) / (the longer length) exceeds ``ratio``.

    The end before isn't cut at the new one, so an interval nested in the one before is measured by what is left of that one. The merged
    end feeds the next test, so a key is one fold in order: ``key, lo, hi, members``, and with ``samples``, a column of arrays of strings,
    their union over the members, sorted. No interval joins one that begins where nothing before it reaches, so a key is cut into ``islands``, which are folded apart; rows
    of an island stream sorted through one task, and only the last interval is held.
    """
    if ratio < 0:
        raise ValueError("a ratio below 0 would merge over gaps")
    rows = df.select(F.col(key), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"), (F.col(samples) if samples else F.lit(None)).cast("array<string>").alias("samples"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kind = None, None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for k, x, y, names in zip(*[c.to_pylist() for c in batch.columns]):
                if last is not None and k == last[0] and None not in (x, y, last[1], last[2]):
                    longer = max(last[2] - last[1], y - x)
                    if longer > 0 and (last[2] - x) / longer > ratio:
                        last = (k, last[1], max(last[2], y), last[3] + 1, last[4] | set(names or ()))
                        continue
                if last is not None:
                    out.append(last)
                last = (k, x, y, 1, set(names or ()))
            if out:
                yield _pieces(out, kind, key)
        if last is not None:
            yield _pieces([last], kind, key)

    def fold_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = a = b = n = kind = None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for k, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                if n is not None and k == at and x is not None and y is not None and a is not None and b is not None:
                    longer = max(b - a, y - x)
                    if longer > 0 and (b - x) / longer > ratio:
                        b, n = max(b, y), n + 1
                        continue
                if n is not None:
                    out.append((at, a, b, n))
                at, a, b, n = k, x, y, 1
            if out:
                yield _plain(out, kind, key)
        if n is not None:
            yield _plain([(at, a, b, n)], kind, key)

    if samples is None:
        # without sets to unite, three numbers a row are all that goes to Python and comes back
        apart = islands(rows.drop("samples"), key, "lo", "hi", "__island").repartition(F.col(key), F.col("__island")).sortWithinPartitions(key, "__island", "lo", "hi").drop("__island")
        return apart.mapInArrow(fold_plain, f"`{key}` {rows.schema[key].dataType.simpleString()}, lo long, hi long, members long")
    apart = islands(rows, key, "lo", "hi", "__island").repartition(F.col(key), F.col("__island")).sortWithinPartitions(key, "__island", "lo", "hi").drop("__island")
    return apart.mapInArrow(fold, f"`{key}` {rows.schema[key].dataType.simpleString()}, lo long, hi long, members long, samples array<string>")


def _plain(rows: list[tuple], kind: pa.DataType, key: str) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[key, "lo", "hi", "members"])


def _pieces(rows: list[tuple], kind: pa.DataType, key: str) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    rows = [(*r[:4], sorted(r[4])) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[key, "lo", "hi", "members", "samples"])


def overlap_counts(df: DataFrame, key: str, row: str, lo: str, hi: str, width: int) -> DataFrame:
    """Diagnostics of a key's closed intervals: ``key, n, overlaps, containments, contained``.

    overlaps counts ordered pairs of different rows that share a point, containments those of which the first
    lies in the second, contained the rows that lie in any other. Ends are compared as they are: of two equal intervals each lies in the other.
    """
    side = lambda s: df.select(F.col(key), F.col(row).alias(f"row_{s}"), F.col(lo).alias(f"lo_{s}"), F.col(hi).alias(f"hi_{s}"), (F.col(hi) + 1).alias(f"end_{s}"))
    pairs = range_join(side("a"), side("b"), [key], "lo_a", "end_a", "lo_b", "end_b", width, F.col("row_a") != F.col("row_b"))
    inside = (F.col("lo_b") <= F.col("lo_a")) & (F.col("hi_a") <= F.col("hi_b"))
    per_row = pairs.groupBy(key, "row_a").agg(F.count("*").alias("o"), F.count_if(inside).alias("c"))
    counts = per_row.groupBy(key).agg(F.sum("o").alias("overlaps"), F.sum("c").alias("containments"), F.count_if(F.col("c") > 0).alias("contained"))
    zero = F.lit(0).cast("long")
    return df.groupBy(key).agg(F.count("*").alias("n")).join(counts, key, "left").select(key, "n", *[F.coalesce(c, zero).alias(c) for c in ("overlaps", "containments", "contained")])


def rounded_out(lo: Column, hi: Column, step: int = 10_000) -> tuple[Column, Column]:
    """An interval widened by ``step`` at both ends and rounded out to whole steps."""
    return (F.floor((lo - step) / step) * step).cast("long"), (F.ceil((hi + step) / step) * step).cast("long")


def longest_run(text: Column, stop: str) -> tuple[Column, Column, Column]:
    """Length, 1-based start and end of the longest run without the character ``stop``; the first of equal runs."""
    runs = F.split(text, f"[{stop}]", -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("best"), F.lit(0).alias("start"))

    def step(acc: Column, run: Column) -> Column:
        n = F.length(run)
        better = n > acc["best"]
        return F.struct((acc["at"] + n + 1).alias("at"), F.when(better, n).otherwise(acc["best"]).alias("best"), F.when(better, acc["at"] + 1).otherwise(acc["start"]).alias("start"))

    found = F.aggregate(runs, zero, step)
    return found["best"], found["start"], F.when(found["best"] > 0, found["start"] + found["best"] - 1).otherwise(F.lit(0))


def bin_counts(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Two-dimensional histogram from the least coordinates in bins of ``width``: ``bin_x, bin_y, n``."""
    least = df.agg(F.min(x).alias("__x"), F.min(y).alias("__y"))
    cell = lambda c, m: F.floor((F.col(c) - F.col(m)) / width).cast("long")
    return df.join(F.broadcast(least)).groupBy(cell(x, "__x").alias("bin_x"), cell(y, "__y").alias("bin_y")).agg(F.count("*").alias("n"))
