"""Operators of primer design: off-target filters, incompatible pairs, tilings, links and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from junctura.operators.intervals import range_join
from junctura.operators.junctions import running_sum

#: Fixed limits of the three pair scores below which two primers are incompatible.
PAIR_SCORE_LIMITS = (-3.2, -8.0, -8.0)


def off_target_hits(psl: DataFrame, min_length: int = 15) -> DataFrame:
    """Alignment rows that can prime: long enough, and anchored at the 3' end on the strand of their side.

    Names are ``LEFT:pos`` and ``RIGHT:pos``. Returns ``primer, contig, pos, forward``.
    """
    side = F.split("qseqid", ":")
    left = (F.get(side, F.lit(0)) == "LEFT") & (F.col("strand") == "+") & (F.col("qlen") - F.col("qend") <= 1)
    right = (F.get(side, F.lit(0)) == "RIGHT") & (F.col("strand") == "-") & (F.col("qstart") <= 1)
    rows = psl.filter((F.col("send") - F.col("sstart") >= min_length) & (left | right))
    return rows.select(F.get(side, F.lit(1)).try_cast("long").alias("primer"), F.col("sseqid").alias("contig"), F.col("sstart").alias("pos"), (F.col("strand") == "+").alias("forward"))


def at_most(df: DataFrame, key: str, most: int) -> DataFrame:
    """``key, n`` of keys with ``most`` rows or fewer."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") <= most)


def cross_amplification(df: DataFrame, contig: str, pos: str, forward: str, primer: str, max_distance: int = 20_000, compat: bool = False) -> DataFrame:
    """Unordered primer pairs with a forward hit before a reverse hit, 0 < distance <= ``max_distance``: ``p, q``, p <= q, distinct.

    ``compat`` searches only forward hits beyond which any hit of any contig lies farther than ``max_distance``.
    """
    f = df.filter(F.col(forward)).select(F.col(contig), F.col(primer).alias("__p"), (F.col(pos) + 1).alias("__from"), (F.col(pos) + max_distance + 1).alias("__to")).distinct()
    r = df.filter(~F.col(forward)).select(F.col(contig), F.col(primer).alias("__q"), F.col(pos).alias("__at"), (F.col(pos) + 1).alias("__next")).distinct()
    if compat:
        last = df.agg(F.max(pos).alias("__last"))
        f = f.join(F.broadcast(last)).filter(F.col("__last") >= F.col("__to")).drop("__last")
    pairs = range_join(f, r, [contig], "__from", "__to", "__at", "__next", max_distance)
    return pairs.select(F.least("__p", "__q").alias("p"), F.greatest("__p", "__q").alias("q")).distinct()


def pair_products(df: DataFrame, contig: str, pos: str, forward: str, primer: str, max_distance: int) -> DataFrame:
    """Number of products of each primer pair: ``p, q, n``. Pairs with more than one are to be dropped."""
    f = df.filter(F.col(forward)).select(F.col(contig), F.col(primer).alias("__p"), (F.col(pos) + 1).alias("__from"), (F.col(pos) + max_distance).alias("__to"))
    r = df.filter(~F.col(forward)).select(F.col(contig), F.col(primer).alias("__q"), F.col(pos).alias("__at"), (F.col(pos) + 1).alias("__next"))
    pairs = range_join(f, r, [contig], "__from", "__to", "__at", "__next", max_distance)
    return pairs.groupBy(F.least("__p", "__q").alias("p"), F.greatest("__p", "__q").alias("q")).agg(F.count("*").alias("n"))


def incompatible(s1: Column, s2: Column, s3: Column) -> Column:
    """Whether any pair score is below its limit."""
    a, b, c = PAIR_SCORE_LIMITS
    return (s1 < a) | (s2 < b) | (s3 < c)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in df.columns if c not in (*keys, order)])).alias("m"))
    return best.select(*keys, "m.*")


def incompatibility_density(nodes: DataFrame, node: str, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """One row ``nodes, edges, density, free``: share of incompatible cells of the upper triangle with diagonal, and nodes without an edge."""
    ends = edges.select(F.col(src).alias(node)).union(edges.select(F.col(dst).alias(node))).distinct()
    counted = nodes.select(node).distinct().join(ends.withColumn("__bound", F.lit(1)), node, "left").agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("__bound").isNull(), 1).otherwise(0)).alias("free"))
    links = edges.select(F.least(src, dst).alias("s"), F.greatest(src, dst).alias("t")).distinct().agg(F.count("*").alias("edges"))
    density = F.col("edges") / (F.col("nodes") * (F.col("nodes") + 1) * 0.5)
    return counted.join(F.broadcast(links)).select("nodes", "edges", density.alias("density"), "free")


def is_independent(chosen: DataFrame, node: str, edges: DataFrame, src: str, dst: str) -> bool:
    """Whether no incompatibility, self-edges included, lies within the chosen nodes."""
    own = chosen.select(node).distinct()
    return edges.join(own.withColumnRenamed(node, src), src, "left_semi").join(own.withColumnRenamed(node, dst), dst, "left_semi").isEmpty()


def region_offsets(df: DataFrame, order: str, length: str, out: str) -> DataFrame:
    """Start of each region on the concatenation of all: the running sum of the lengths before it. A row per region; ``order`` tells them apart."""
    return running_sum(df, [order], F.col(length), out).withColumn(out, F.col(out).cast("long"))


def in_region(points: DataFrame, regions: DataFrame, keys: list[str], position: str, start: str, length: str, width: int) -> DataFrame:
    """Points with the region that holds them: start <= position < start + length. The columns of both sides."""
    p = points.withColumn("__from", F.col(position)).withColumn("__to", F.col(position) + 1)
    r = regions.withColumn("__at", F.col(start)).withColumn("__next", F.col(start) + F.col(length)).filter(F.col(length) > 0)
    return range_join(p, r, keys, "__from", "__to", "__at", "__next", width).drop("__from", "__to", "__at", "__next")


def tiling_cost(primers: DataFrame, regions: DataFrame, region: str, position: str, start: str, end: str, forward: str, d: float, rho: float) -> DataFrame:
    """``region, cost``: what its primers leave uncovered, plus what they crowd.

    Gaps run from the region's start over its primers to its end, each less d; the outer gap (the first
    of a forward region, the last of a reverse one) gets d back. Positive gaps count in full, others by
    how far they exceed rho * d.
    """
    points = primers.select(region, F.col(position).cast("double").alias("__x"), F.lit(1).alias("__kind"))
    ends = regions.select(region, F.col(start).cast("double").alias("__x"), F.lit(0).alias("__kind")).unionByName(regions.select(region, F.col(end).cast("double").alias("__x"), F.lit(2).alias("__kind")))
    w = W.partitionBy(region).orderBy("__kind", "__x")
    gaps = points.join(regions.select(region), region, "left_semi").unionByName(ends).select(region, "__kind", (F.col("__x") - F.lag("__x").over(w)).alias("__gap"), F.lag("__kind").over(w).alias("__before"))
    gaps = gaps.filter(F.col("__gap").isNotNull()).join(regions.select(region, F.col(forward).alias("__forward")), region)
    outer = F.when(F.col("__forward"), F.col("__before") == 0).otherwise(F.col("__kind") == 2)
    g = F.col("__gap") - d + F.when(outer, F.lit(float(d))).otherwise(0.0)
    return gaps.groupBy(region).agg(F.sum(F.when(g > 0, g).otherwise(F.greatest(F.lit(0.0), -g - d * rho))).alias("cost"))


def complement_pairs(nodes: DataFrame, node: str, position: str, forward: str, edges: DataFrame, src: str, dst: str, group: list[str]) -> DataFrame:
    """Compatible pairs of opposite orientation within a group, with their distance: ``group, a, b, distance``."""
    side = lambda s, keep: nodes.filter(keep).select(*group, F.col(node).alias(f"n_{s}"), F.col(position).alias(f"x_{s}"))
    pairs = side("f", F.col(forward)).join(side("r", ~F.col(forward)), group)
    pairs = pairs.select(*group, F.least("n_f", "n_r").alias("a"), F.greatest("n_f", "n_r").alias("b"), F.abs(F.col("x_f") - F.col("x_r")).alias("distance")).filter("a < b")
    bad = edges.select(*group, F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()
    return pairs.join(bad, [*group, "a", "b"], "left_anti")


def innermost(df: DataFrame, region: str, position: str, forward: str, tie: str) -> DataFrame:
    """The primer nearest the inner end of each region: the last of a forward one, the first of a reverse one; of equals the later by ``tie``."""
    toward = F.when(F.col(forward), F.col(position)).otherwise(-F.col(position))
    best = df.groupBy(region).agg(F.max(F.struct(toward.alias("__toward"), F.col(tie), F.struct("*").alias("__row"))).alias("m"))
    return best.select("m.__row.*")


def synthesis_length(position: Column, start: Column, end: Column, forward: Column, extension: Column | int = 0) -> Column:
    """Bases from a primer to the region's inner end: end - p forward, p - start + extension reverse."""
    return F.when(forward, end - position).otherwise(position - start + extension)


def ends_apart(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Least distance between the end points of two regions."""
    return F.least(F.abs(start_a - start_b), F.abs(start_a - end_b), F.abs(end_a - start_b), F.abs(end_a - end_b))


def product_lengths(links: DataFrame, chosen: DataFrame, region: str, length: str) -> DataFrame:
    """``region_i, region_j, product``: synthesis lengths of both regions of a link added."""
    a = chosen.select(F.col(region).alias("region_i"), F.col(length).alias("__i"))
    b = chosen.select(F.col(region).alias("region_j"), F.col(length).alias("__j"))
    return links.join(a, "region_i").join(b, "region_j").select("region_i", "region_j", (F.col("__i") + F.col("__j")).alias("product"))


def nearest_primer(samples: DataFrame, primers: DataFrame, key: str, breakpoint: str, position: str, d: int) -> DataFrame:
    """Distance from each breakpoint to the nearest primer before it, within 2 d; 2 d if there is none: adds ``distance`` and ``covered`` (below d)."""
    s = samples.withColumn("__from", F.col(breakpoint) - 2 * d + 1).withColumn("__to", F.col(breakpoint))
    p = primers.select(F.col(key), F.col(position).alias("__at"), (F.col(position) + 1).alias("__next"))
    near = range_join(s, p, [key], "__from", "__to", "__at", "__next", 2 * d).groupBy(*samples.columns).agg(F.min(F.col(breakpoint) - F.col("__at")).alias("distance"))
    joined = samples.join(near, samples.columns, "left")
    distance = F.coalesce("distance", F.lit(2 * d))
    return joined.withColumn("distance", distance).withColumn("covered", distance < d)


def length_histogram(fs: DataFrame, f: str, rs: DataFrame, r: str, keys: list[str]) -> DataFrame:
    """Histogram of amplicon lengths x + y over the grids of spacings, with its running share: ``keys, length, n, share``.

    Equal spacings are counted first, so the product is over distinct values. For spacings f and r the
    counts of lengths 1 to f + r - 1 form a trapezoid of height min(f, r).
    """
    a = fs.groupBy(*keys, F.col(f).alias("f")).agg(F.count("*").alias("nf"))
    b = rs.groupBy(*keys, F.col(r).alias("r")).agg(F.count("*").alias("nr"))
    grid = a.join(b, keys).filter((F.col("f") > 0) & (F.col("r") > 0)).withColumn("length", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("f") + F.col("r") - 1).cast("long"))))
    height = F.least("f", "r", F.col("length"), F.col("f") + F.col("r") - F.col("length"))
    counts = grid.groupBy(*keys, "length").agg(F.sum(height * F.col("nf") * F.col("nr")).cast("long").alias("n"))
    w = W.partitionBy(*keys).orderBy("length")
    return counts.withColumn("share", F.sum("n").over(w) / F.sum("n").over(W.partitionBy(*keys)))


def complete_groups(df: DataFrame, group: str, region: str, regions: DataFrame) -> DataFrame:
    """Groups that have every region, with the number of regions: ``group, n``."""
    total = regions.agg(F.count_distinct(region).alias("__all"))
    return df.groupBy(group).agg(F.count_distinct(region).alias("n")).join(F.broadcast(total)).filter(F.col("n") == F.col("__all")).drop("__all")


def region_shares(df: DataFrame, group: str, region: str) -> DataFrame:
    """Share of all groups that have each region: ``region, share``."""
    total = df.agg(F.count_distinct(group).alias("__all"))
    return df.groupBy(region).agg(F.count_distinct(group).alias("n")).join(F.broadcast(total)).select(region, (F.col("n") / F.col("__all")).alias("share"))


def first_matches(df: DataFrame, keys: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key that is listed in ``keys``."""
    listed = df.join(keys.select(key).distinct(), key, "left_semi")
    best = listed.groupBy(key).agg(F.min(F.struct(*order, F.struct("*").alias("__row"))).alias("m"))
    return best.select("m.__row.*")


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def even_spaced(pairs: DataFrame, keys: list[str], midpoint: str, length: Column, n: int) -> DataFrame:
    """For each of n evenly spaced targets the nearest midpoint, or null where a sequence end is nearer: ``keys, target, midpoint``.

    Ends at 0 and ``length`` compete as candidates of their own; a tie takes the right one.
    """
    from junctura.operators.intervals import nearest_point

    whole = pairs.groupBy(*keys).agg(F.max(length).cast("long").alias("__length"))
    spacing = F.call_function("div", F.col("__length"), F.lit(n + 1).cast("long"))
    targets = whole.select(*keys, "__length", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i * spacing)).alias("target"))
    ends = whole.select(*keys, F.explode(F.array(F.lit(0).cast("long"), F.col("__length"))).alias("__x"))
    points = pairs.select(*keys, F.col(midpoint).cast("long").alias("__x")).unionByName(ends)
    found = nearest_point(targets, points, keys, "target", "__x", "midpoint")
    inner = (F.col("midpoint") > 0) & (F.col("midpoint") < F.col("__length"))
    return found.select(*keys, "target", F.when(inner, F.col("midpoint")).alias("midpoint"))


def search_labels(index: Column, depth: int) -> tuple[Column, Column]:
    """Depth (from 1) and path of left and right turns of the in-order ``index`` (from 1) in a full binary tree of ``depth`` levels."""
    zeros = F.length(F.bin(index)) - F.length(F.regexp_replace(F.bin(index), "0+$", ""))
    level = F.lit(depth) - zeros
    turns = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda k: F.when(k >= level, "").when(F.getbit(index, F.lit(depth) - k) == 1, "R").otherwise("L"))
    return level.cast("long"), F.array_join(turns, "")


def primers_per_region(primers: DataFrame, regions: DataFrame, region: str) -> DataFrame:
    """``region, n`` of every region, those without a primer with 0."""
    counts = primers.groupBy(region).agg(F.count("*").alias("n"))
    return regions.select(region).distinct().join(counts, region, "left").select(region, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def require_primers(counts: DataFrame, region: str) -> DataFrame:
    """The same rows; an error for a region that has none to choose from."""
    return counts.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("no primers to choose from in region "), F.col(region).cast("string"))).cast("long")))


def spacings(primers: DataFrame, bounds: DataFrame, keys: list[str], position: str, bound: str) -> DataFrame:
    """``keys, at, spacing``: gaps between neighbouring primers and the inner boundary of their region, sorted together."""
    points = primers.select(*keys, F.col(position).cast("long").alias("at")).unionByName(bounds.select(*keys, F.col(bound).cast("long").alias("at")))
    return points.withColumn("spacing", F.lead("at").over(W.partitionBy(*keys).orderBy("at")) - F.col("at")).filter("spacing is not null")


def target_cost(primers: DataFrame, regions: DataFrame, region: str, position: str, start: str, end: str, forward: str) -> DataFrame:
    """Multi-target cost ``region, cost``: the distances of all its primers to a region's inner end, or its length if it has none."""
    r = regions.select(region, F.col(start).alias("__a"), F.col(end).alias("__b"), F.col(forward).alias("__f"))
    far = F.when(F.col("__f"), F.col("__b") - F.col("__x")).otherwise(F.col("__x") - F.col("__a"))
    joined = r.join(primers.select(region, F.col(position).alias("__x")), region, "left")
    return joined.groupBy(region).agg(F.sum(F.when(F.col("__x").isNull(), F.col("__b") - F.col("__a")).otherwise(far)).cast("double").alias("cost"))


def gap_cost(primers: DataFrame, regions: DataFrame, region: str, position: str, start: str, end: str, forward: str, d: float) -> DataFrame:
    """Cost ``region, cost`` of what primers leave uncovered alone: the tiling cost without that of crowding."""
    return tiling_cost(primers, regions, region, position, start, end, forward, d, float("inf"))


def linked_amplicons(primers: DataFrame, regions: DataFrame, links: DataFrame, region: str, position: str, start: str, end: str, forward: str) -> DataFrame:
    """``region_i, region_j, product``: least amplicon of linked regions, of the innermost primers, or the whole length of a region without one."""
    inner = primers.groupBy(region).agg(F.max(position).alias("__last"), F.min(position).alias("__first"))
    own = F.when(F.col("__last").isNull(), F.col(end) - F.col(start)).when(F.col(forward), F.col(end) - F.col("__last")).otherwise(F.col("__first") - F.col(start))
    return product_lengths(links, regions.join(inner, region, "left").select(region, own.cast("long").alias("__own")), region, "__own")


#: Costs of a set of primers by name: each takes primers, regions and the names of their columns, and gives ``region, cost``.
COSTS = {"tiling": tiling_cost, "targets": target_cost, "gaps": gap_cost}


def edges_from_scores(scores: DataFrame, rule=incompatible) -> DataFrame:
    """``p, q`` (p <= q) of the pairs whose last score row ``rule``, a function of the three scores, finds incompatible.

    Score rows come in the order of ``seq``; the last one of a pair, in either direction, decides.
    """
    pairs = scores.select(F.least("p1", "p2").alias("p"), F.greatest("p1", "p2").alias("q"), "seq", "s1", "s2", "s3")
    return last_wins(pairs, ["p", "q"], "seq").filter(rule(F.col("s1"), F.col("s2"), F.col("s3"))).select("p", "q")


def surviving_pairs(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Pair numbers whose left and right primers both survive."""
    return left.select(index).distinct().join(right.select(index).distinct(), index)


def read_pairs(df: DataFrame, order: str, position: str, reverse: str) -> DataFrame:
    """``pair, x, y, x_reverse, y_reverse`` of reads that follow each other two by two in the order ``order`` (0, 1, ...), the lower position first; an odd last one is left out."""
    rows = df.select(F.call_function("div", F.col(order).cast("long"), F.lit(2).cast("long")).alias("pair"), F.struct(F.col(position).alias("at"), (F.col(order) % 2).alias("k"), F.col(reverse).alias("r")).alias("m"))
    both = rows.groupBy("pair").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.count("*").alias("__n")).filter("__n = 2")
    return both.select("pair", F.col("a.at").alias("x"), F.col("b.at").alias("y"), F.col("a.r").alias("x_reverse"), F.col("b.r").alias("y_reverse"))


def length_mismatches(transcripts: DataFrame, contigs: DataFrame, name: str, length: str) -> DataFrame:
    """Transcripts whose contig is missing or has another length: ``name, length, found``."""
    return transcripts.select(name, length).distinct().join(contigs.select(F.col("name").alias(name), F.col("length").alias("found")), name, "left").filter(~F.col(length).eqNullSafe(F.col("found")))


def labelled_targets(pairs: DataFrame, keys: list[str], midpoint: str, length: Column, depth: int) -> DataFrame:
    """``even_spaced`` for the 2^depth - 1 targets of a binary search over the sequence, with ``depth`` and ``path`` of each."""
    n = 2**depth - 1
    found = even_spaced(pairs, keys, midpoint, length, n)
    number = F.dense_rank().over(W.partitionBy(*keys).orderBy("target")).cast("long")
    level, path = search_labels(F.col("__number"), depth)
    return found.withColumn("__number", number).withColumns({"depth": level, "path": path}).drop("__number")
