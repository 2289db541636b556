"""Reports on deletions: which breakpoints primers reach, amplicon sizes, coverage and carriers by population."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from junctura.operators.intervals import merge_similar, range_join, union_coverage


def primer_distances(points: DataFrame, primers: DataFrame, keys: list[str], breakpoint: str, position: str, forward: str, d: int = 6500) -> DataFrame:
    """Adds ``distance`` and ``covered`` to each breakpoint: to the nearest primer of its strand on the outer side.

    A forward breakpoint has its primers before it, a reverse one behind. The distance is above 0 and below 2 d, and 2 d where there is no
    such primer; a breakpoint is covered if it is below d. Both strands are one range join, as reverse coordinates are mirrored.
    """
    sign = F.when(F.col(forward), 1).otherwise(-1).cast("long")
    at = points.select(*keys, forward, breakpoint).distinct().withColumn("__x", F.col(breakpoint) * sign).withColumn("__from", F.col("__x") - 2 * d + 1).withColumn("__to", F.col("__x"))
    p = primers.select(*keys, forward, (F.col(position) * sign).alias("__at")).distinct().withColumn("__next", F.col("__at") + 1)
    near = range_join(at, p, [*keys, forward], "__from", "__to", "__at", "__next", 2 * d).groupBy(*keys, forward, breakpoint).agg(F.min(F.col("__x") - F.col("__at")).alias("distance"))
    told = points.join(near, [*keys, forward, breakpoint], "left").withColumn("distance", F.coalesce("distance", F.lit(2 * d).cast("long")))
    return told.select(*points.columns, "distance", (F.col("distance") < d).alias("covered"))


def sample_report(distances: DataFrame, sample: str, forward: str) -> DataFrame:
    """``sample, covered, total, least, greatest``: breakpoints that a primer reaches, and the least and the greatest amplicon.

    An amplicon runs from a forward to a reverse primer over the joined breakpoints: the nearest of both sides added, and the farthest. Both are 0 for a
    sample without breakpoints of one strand.
    """
    of = lambda side: F.when(side, F.col("distance"))
    ahead, back = of(F.col(forward)), of(~F.col(forward))
    zero = F.lit(0).cast("long")
    return distances.groupBy(sample).agg(
        F.count_if("covered").alias("covered"), F.count("*").alias("total"), F.coalesce(F.min(ahead) + F.min(back), zero).alias("least"), F.coalesce(F.max(ahead) + F.max(back), zero).alias("greatest")
    )


def strand_coverage(primers: DataFrame, keys: list[str], position: str, forward: str, d: int = 6500) -> DataFrame:
    """``keys, forward, covered, total, share, uncovered`` of the windows of ``d`` bases inside of each primer.

    The total runs from the first primer to d + 1 bases beyond the last one. The union of the windows is a walk over their sorted starts.
    """
    group = [*keys, forward]
    windows = primers.select(F.struct(*group).alias("__of"), F.when(F.col(forward), F.col(position)).otherwise(F.col(position) - d).alias("__lo")).withColumn("__hi", F.col("__lo") + d)
    covered = union_coverage(windows, "__of", "__lo", "__hi").select("__of", "covered")
    total = windows.groupBy("__of").agg((F.max("__lo") - F.min("__lo") + d + 1).alias("total"))
    told = covered.join(total, "__of")
    return told.select("__of.*", "covered", "total", (F.col("covered") / F.col("total")).alias("share"), (F.col("total") - F.col("covered")).alias("uncovered"))


def merged_deletions(carriers: DataFrame, contig: str, pos: str, length: str, sample: str, least: int = 500, ratio: float = 0.8, passes: int = 2) -> DataFrame:
    """``contig, lo, hi, samples``: deletions of ``least`` bases or more, similar ones merged with the union of their samples, ``passes`` times over."""
    rows = carriers.filter(F.col(length) >= least).groupBy(contig, F.col(pos).cast("long").alias("lo"), (F.col(pos) + F.col(length)).cast("long").alias("hi")).agg(F.collect_set(sample).alias("samples"))
    for _ in range(passes):
        rows = merge_similar(rows, contig, "lo", "hi", ratio, "samples").select(contig, "lo", "hi", "samples")
    return rows


def sample_names(left: DataFrame, right: DataFrame, sample: str) -> DataFrame:
    """Samples of either table, each once."""
    return left.select(sample).union(right.select(sample)).distinct()
