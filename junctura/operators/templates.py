"""From clusters to template sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from junctura.functions.sequence import reverse_complement, wrapped
from junctura.sources import sequences


def noise_filter(a: Column, b: Column, d: Column, max_d: int = 100, min_distance: int = 10) -> Column:
    """Whether a junction is kept: d is at most ``max_d`` and the flanks are ``min_distance`` apart or more."""
    return (d <= max_d) & (F.abs(F.abs(a) - F.abs(b)) >= min_distance)


def reciprocal_merge(df: DataFrame, order: str, a: str, b: str, d: str) -> DataFrame:
    """Merges (a, b) with (b, a): the smaller |.| first, the least d, the later cluster's order.

    The same junction again takes the later d. Equal to folding the clusters in order whenever
    each orientation occurs once; where one occurs more often, its last row speaks for it.
    """
    last = df.groupBy(a, b).agg(F.max(F.struct(F.col(order), F.col(d))).alias("m")).select(a, b, F.col(f"m.{order}").alias(order), F.col(f"m.{d}").alias(d))
    swap = F.abs(a) > F.abs(b)
    tie = F.abs(F.col(a)) == F.abs(F.col(b))
    lo = F.when(swap, F.col(b)).when(tie, F.least(a, b)).otherwise(F.col(a))
    hi = F.when(swap, F.col(a)).when(tie, F.greatest(a, b)).otherwise(F.col(b))
    merged = last.withColumn("__lo", lo).withColumn("__hi", hi).groupBy("__lo", "__hi").agg(
        F.max(order).alias(order), F.min(d).alias(d), F.count("*").alias("merged"), F.max(F.struct(F.col(order), F.col(a).alias("a"), F.col(b).alias("b"))).alias("__own")
    )
    both = F.col("merged") > 1
    return merged.select(order, F.when(both, F.col("__lo")).otherwise(F.col("__own.a")).alias(a), F.when(both, F.col("__hi")).otherwise(F.col("__own.b")).alias(b), d, "merged")


def reciprocal_fold(df: DataFrame, order: str, a: str, b: str, d: str, max_d: int = 100, min_distance: int = 10) -> DataFrame:
    """``order, a, b, d, merged``: the junctions that are left after all were taken in ``order``, with the noise filter inside.

    A junction whose reverse is held takes the reverse's d if that is less, is told with the smaller |.| first (a tie as it stands), and takes the reverse's place. One that the
    noise filter refuses isn't held, and its reverse is gone all the same. The same junction again replaces the one held. Only junctions of one unordered pair bear on each other, and one of them is held at a
    time: each pair is a machine of one state, through which its rows stream in order; ``merged`` counts the junctions that the state stands for.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (order, a, b, d)}
    names = [order, a, b, d, "merged"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, state, schema, out = None, None, None, []
        for batch in batches:
            schema = schema or batch.schema
            for o, x, y, far, *own in zip(*(c.to_pylist() for c in batch.columns)):
                if own != pair:
                    if state is not None:
                        out.append(state)
                    pair, state = own, None
                count = 1
                back = state is not None and (state[1], state[2]) == (y, x)
                if back:
                    count, far = state[4] + 1, min(far, state[3])
                    x, y = (y, x) if abs(y) < abs(x) else (x, y)
                    state = None
                if far <= max_d and abs(abs(x) - abs(y)) >= min_distance:
                    state = (o, x, y, far, count)
            if out:
                yield told(out, schema)
                out = []
        if state is not None:
            yield told([state], schema)

    def told(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        types = [*[schema.field(k).type for k in range(4)], pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows = df.select(order, a, b, d, F.least(a, b).alias("__lo"), F.greatest(a, b).alias("__hi")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(d).isNotNull())
    sorted_ = rows.repartition("__lo", "__hi").sortWithinPartitions("__lo", "__hi", order, a, b, d)
    return sorted_.mapInArrow(fold, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", merged long")


def flank(sequence: Column, position: Column, k: int, left: bool) -> Column:
    """k + 1 bases that end (left) or start (right) at a signed position.

    A position that runs forward on its side is read as it stands, the other strand as reverse
    complement. A slice that would begin before the sequence is empty.
    """
    at = F.abs(position)
    ending = F.when(at - k >= 1, F.substr(sequence, (at - k).cast("int"), F.lit(k + 1))).otherwise("")
    starting = F.when(at >= 1, F.substr(sequence, at.cast("int"), F.lit(k + 1))).otherwise("")
    if left:
        return F.when(position < 0, ending).otherwise(reverse_complement(starting))
    return F.when(position > 0, starting).otherwise(reverse_complement(ending))


def flank_range(position: Column, k: int, left: bool) -> tuple[Column, Column, Column]:
    """Where ``flank`` reads: start and end from 0, end exclusive, and whether the other strand is meant."""
    at = F.abs(position).cast("long")
    forward = position < 0 if left else position > 0
    ends = forward if left else ~forward
    nothing = F.when(ends, at - k < 1).otherwise(at < 1)
    zero = F.lit(0).cast("long")
    return F.when(nothing, zero).when(ends, at - k - 1).otherwise(at - 1), F.when(nothing, zero).when(ends, at).otherwise(at + k), ~forward


def spacer(d: Column, offset: int | None) -> Column:
    """Ns between the flanks: d + offset of them, none without an offset."""
    return F.lit("") if offset is None else F.repeat(F.lit("N"), F.greatest(d + offset, F.lit(0)).cast("int"))


def templates(df: DataFrame, name: str, a: str, b: str, d: str, sequence: str, k: int = 6500, offset: int | None = None) -> DataFrame:
    """``header, template``: left flank, spacer, right flank, in FASTA form of 80 columns."""
    bases = F.concat(flank(F.col(sequence), F.col(a), k, True), spacer(F.col(d), offset), flank(F.col(sequence), F.col(b), k, False))
    header = F.concat_ws(",", F.concat(F.lit(">"), F.col(name).cast("string")), F.col(a).cast("string"), F.col(b).cast("string"), F.col(d).cast("string"))
    return df.select(header.alias("header"), wrapped(bases).alias("template"))


def templates_of_chunks(df: DataFrame, key: str, name: str, a: str, b: str, d: str, contig: str, chunks: DataFrame, k: int = 6500, offset: int | None = None, size: int = sequences.CHUNK) -> DataFrame:
    """``key, header, template`` as ``templates`` makes them, from contigs in chunks (see ``sequences.fasta_chunks``): each flank fetches the chunks it touches. ``key`` tells rows apart."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), *[c.alias(n) for c, n in zip(flank_range(F.col(p), k, i == 0), ("start", "end", "turned"))]) for i, p in enumerate((a, b))])
    ranges = df.select(F.col(key).alias("__key"), F.col(contig).alias("__contig"), F.explode(sides).alias("s")).select("__key", "__contig", "s.*").withColumn("__side", F.struct("__key", "side"))
    got = sequences.fetch(ranges, chunks, "__side", "__contig", "start", "end", "bases", size)
    got = got.withColumn("bases", F.when(F.col("turned"), reverse_complement(F.col("bases"))).otherwise(F.col("bases")))
    both = got.groupBy("__key").agg(*[F.max(F.when(F.col("side") == i, F.col("bases"))).alias(f"__flank_{i}") for i in (0, 1)])
    rows = df.join(both, F.col(key) == F.col("__key"))
    header = F.concat_ws(",", F.concat(F.lit(">"), F.col(name).cast("string")), F.col(a).cast("string"), F.col(b).cast("string"), F.col(d).cast("string"))
    return rows.select(key, header.alias("header"), wrapped(F.concat("__flank_0", spacer(F.col(d), offset), "__flank_1")).alias("template"))


def chained_templates(df: DataFrame, name: str, a: str, b: str, d: str, sequence: str, k: int = 6500, offset: int | None = None) -> DataFrame:
    """Templates over several breaks: rows whose names share the part before ``_`` follow each other by name.

    Between two breaks stands the segment from the end of one to the start of the next, forward
    if the end is greater; the first and last break have a flank of k bases outside. The start of a segment and its end must have opposite signs, otherwise the strands contradict each other and the query fails.
    """
    rows = df.withColumn("__group", F.split(F.col(name), "_")[0])
    w = W.partitionBy("__group").orderBy(name)
    lead = F.lead(a).over(w)
    segment_end, segment_start = F.abs(lead), F.abs(F.col(b))
    forward = segment_end > segment_start
    plain = F.substr(F.col(sequence), F.least(segment_start, segment_end).cast("int"), (F.abs(segment_end - segment_start) + 1).cast("int"))
    middle = F.when(lead.isNull(), flank(F.col(sequence), F.col(b), k, False)).otherwise(F.when(forward, plain).otherwise(reverse_complement(plain)))
    first = F.when(F.row_number().over(w) == 1, flank(F.col(sequence), F.col(a), k, True)).otherwise("")
    bad = F.lit("strands of consecutive breaks contradict each other")
    middle = F.when(F.signum(lead) == F.signum(F.col(b)), F.raise_error(bad).cast("string")).otherwise(middle)
    parts = rows.select("__group", name, F.concat(first, spacer(F.col(d), offset), middle).alias("__part"))
    joined = parts.groupBy("__group").agg(F.array_sort(F.collect_list(F.struct(name, "__part"))).alias("p"))
    return joined.select(F.col("__group").alias("name"), F.array_join(F.transform("p", lambda x: x["__part"]), "").alias("template"))


def named_noise_filter(name: Column, a: Column, b: Column, d: Column, max_d: int = 100, min_distance: int = 10) -> Column:
    """The noise filter of templates over several breaks: a junction without a name isn't kept either."""
    return noise_filter(a, b, d, max_d, min_distance) & (F.coalesce(name, F.lit("")) != "")
