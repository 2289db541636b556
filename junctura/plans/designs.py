"""From regions and the outputs of the primer designer, the aligner and the pair scorer to primer sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from junctura.functions.checkpoints import shared_table
from junctura.operators import anneal, links, primers
from junctura.sources import design


def usable_candidates(candidates: DataFrame, psl: DataFrame, max_penalty: float = 1.2, max_hits: int = 10, min_length: int = 15) -> DataFrame:
    """Candidates (``pos, sequence, penalty``) with a low penalty and few places where they can prime; those without any place are out, too."""
    few = primers.at_most(primers.off_target_hits(psl, min_length), "primer", max_hits).select(F.col("primer").alias("pos"))
    return design.within_penalty(candidates, max_penalty).join(few, "pos", "left_semi")


def incompatible_pairs(scores: DataFrame, hits: DataFrame, max_distance: int = 20_000, rule=primers.incompatible, compat: bool = False) -> DataFrame:
    """``p, q`` of pairs that score badly or amplify across. A cross-amplifying pair overrides its score."""
    crossing = primers.cross_amplification(hits, "contig", "pos", "forward", "primer", max_distance, compat)
    bad = [F.lit(-100.0).alias(c) for c in ("s1", "s2", "s3")]
    own = scores.select("p1", "p2", "s1", "s2", "s3", F.lit(0).alias("seq"))
    return primers.edges_from_scores(own.unionByName(crossing.select(F.col("p").alias("p1"), F.col("q").alias("p2"), *bad, F.lit(1).alias("seq"))), rule)


def designed_sets(candidates: DataFrame, regions: DataFrame, edges: DataFrame, d: float, rho: float, grid: list[tuple[float, float, int]], **limits: int) -> DataFrame:
    """``params, cost, seconds, primers`` of an annealing run for each schedule and seed of ``grid``: an array of positions for each region in order.

    ``regions`` has ``region, start, length, forward`` on the joined sequence. Candidates outside of every region are discarded; a
    region without any is an error. Runs aren't timed here, so the seconds are 0. ``limits`` are those of ``anneal_graphs``.
    """
    placed = primers.in_region(candidates.select("pos"), regions.select("region", "start", "length"), [], "pos", "start", "length", 1 << 16).select("pos", "region").distinct()
    counts = primers.require_primers(primers.primers_per_region(placed, regions, "region"), "region").filter("n > 0").select("region")
    one = lambda df: df.withColumn("design", F.lit(0))
    ends = regions.join(counts, "region").select("region", F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"), "forward")
    runs = anneal.anneal_graphs(one(placed).withColumn("x", F.col("pos")), one(ends), edges, "design", "pos", "region", "x", "a", "b", "forward", "p", "q", d, rho, grid, **limits)
    chosen = runs.select(F.format_string("%s,%s,%s", F.col("slope").cast("string"), F.col("intercept").cast("string"), F.col("seed").cast("string")).alias("params"), "cost", F.explode_outer("chosen").alias("pos"))
    rows = chosen.join(placed, "pos", "left").groupBy("params", "cost", "region").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    sets = rows.groupBy("params", "cost").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("region", "p")), lambda x: x["region"].isNotNull())).alias("m"))
    order = regions.agg(F.array_sort(F.collect_set("region")).alias("order"))
    none = F.array().cast("array<bigint>")
    held = F.transform("order", lambda r: F.coalesce(F.col("m")[r].cast("array<bigint>"), none))
    return sets.join(F.broadcast(order)).select("params", "cost", F.lit(0.0).alias("seconds"), held.alias("primers"))


def best_sets(solutions: DataFrame, candidates: DataFrame, regions: DataFrame, top: int = 5) -> DataFrame:
    """The rows of the best solutions with the place and sequence of each primer; see ``links.solution_primers``."""
    return links.solution_primers(shared_table(design.solution_rows(solutions, top)), candidates, regions)
