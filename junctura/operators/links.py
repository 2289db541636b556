"""Chosen primer sets: complete solutions, products of linked regions, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from junctura.functions.sequence import reverse_complement
from junctura.operators.primers import ends_apart, innermost, product_lengths, synthesis_length


def verified_solutions(primers: DataFrame, regions: DataFrame, solution: str, order: str) -> DataFrame:
    """The innermost primer of each region of each solution, with ``valid`` and ``complete``.

    ``primers`` has ``solution, region, contig, position, forward`` and a column ``order`` that decides ties (the later one wins);
    ``regions`` has ``region, contig, start, length, forward``. A primer is valid on its region's contig and strand within start <= position < start + length. A
    solution is complete if every region has a primer and all of these are valid.
    """
    best = innermost(primers.withColumn("__in", F.struct(solution, "region")), "__in", "position", "forward", order).drop("__in")
    r = regions.select("region", F.col("contig").alias("__contig"), F.col("start").alias("__start"), F.col("length").alias("__length"), F.col("forward").alias("__forward"))
    inside = (F.col("contig") == F.col("__contig")) & (F.col("forward") == F.col("__forward")) & (F.col("position") >= F.col("__start")) & (F.col("position") < F.col("__start") + F.col("__length"))
    checked = best.join(r, "region", "left").withColumn("valid", F.coalesce(inside, F.lit(False))).drop("__contig", "__start", "__length", "__forward")
    total = regions.agg(F.count_distinct("region").alias("__all"))
    whole = checked.groupBy(solution).agg(F.count("*").alias("__n"), F.every("valid").alias("__valid")).join(F.broadcast(total)).select(solution, ((F.col("__n") == F.col("__all")) & F.col("__valid")).alias("complete"))
    return checked.join(whole, solution)


def first_complete(verified: DataFrame, solution: str) -> DataFrame:
    """The rows of the first complete solution in order; none if there is none."""
    first = verified.filter("complete").agg(F.min(solution).alias(solution))
    return verified.join(F.broadcast(first), solution)


def link_products(chosen: DataFrame, regions: DataFrame, links: DataFrame, extension: int = 0) -> DataFrame:
    """``region_i, region_j, name, product``: synthesis lengths of the chosen primers of both regions of each link added."""
    r = regions.select("region", "start", (F.col("start") + F.col("length")).alias("end"))
    lengths = chosen.join(r, "region").select("region", synthesis_length(F.col("position"), F.col("start"), F.col("end"), F.col("forward"), extension).alias("__own"))
    return links.join(product_lengths(links, lengths, "region", "__own"), ["region_i", "region_j"])


def phased_products(products: DataFrame, regions: DataFrame) -> DataFrame:
    """Products with the distance to the variant added to those of links whose name has ``snp``; adds ``snp_distance``.

    The region that two of these links share is the variant's; the link that also has ``inner`` in its name tells the inner region. The
    distance is the least between the ends of both. No such links, or none or several shared regions, leave a null distance and the products as they are.
    """
    snp = products.filter(F.col("name").contains("snp"))
    ends = snp.select("region_i", "region_j").distinct().select(F.explode(F.array_distinct(F.array("region_i", "region_j"))).alias("region"))
    shared = ends.groupBy("region").count().filter("count > 1").agg(F.min("region").alias("s"), F.count("*").alias("n")).filter("n = 1").select("s")
    inner = snp.filter(F.col("name").contains("inner")).join(F.broadcast(shared), (F.col("region_i") == F.col("s")) | (F.col("region_j") == F.col("s")))
    inner = inner.agg(F.max("s").alias("s"), F.max(F.when(F.col("region_i") == F.col("s"), F.col("region_j")).otherwise(F.col("region_i"))).alias("i"))
    side = lambda c: regions.select(F.col("region").alias(c), F.col("start").alias(f"a_{c}"), (F.col("start") + F.col("length")).alias(f"b_{c}"))
    distance = inner.join(side("s"), "s").join(side("i"), "i").select(ends_apart(F.col("a_s"), F.col("b_s"), F.col("a_i"), F.col("b_i")).alias("snp_distance"))
    told = products.join(F.broadcast(distance), F.lit(True), "left")
    return told.withColumn("product", F.col("product") + F.when(F.col("name").contains("snp"), F.coalesce("snp_distance", F.lit(0))).otherwise(0))


def solution_primers(rows: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Solution rows (``rank, cost, region, position``, positions on the joined regions) with their candidate and its place on the contig.

    ``candidates`` has ``pos, sequence, penalty``, ``regions`` ``region, contig, start, length, forward, offset``, the offset being
    the region's place among the joined ones. Adds ``contig, at, forward, sequence, penalty``.
    """
    c = candidates.select(F.col("pos").alias("position"), "sequence", "penalty")
    r = regions.select("region", "contig", "start", "offset", "forward")
    return rows.join(c, "position").join(r, "region").withColumn("at", F.col("start") + F.col("position") - F.col("offset")).drop("start", "offset")


def solution_text(primers: DataFrame, solutions: DataFrame) -> DataFrame:
    """``rank, value``: the text block of each solution: cost, seconds and parameters, a line for each primer, and ``=``.

    ``solutions`` has ``rank, cost, seconds, params``.
    """
    line = F.concat_ws("\t", "contig", F.col("at").cast("string"), F.initcap(F.col("forward").cast("string")), "sequence", F.format_string("%.4f", "penalty"))
    body = primers.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("region", "position", line.alias("line")))).alias("lines"))
    head = F.concat_ws("\t", F.col("cost").cast("string"), F.col("seconds").cast("string"), "params")
    return solutions.join(body, "rank").select("rank", F.concat(head, F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n=")).alias("value"))


def solution_fasta(primers: DataFrame) -> DataFrame:
    """``rank, value``: a FASTA entry for each primer of each solution; ranks and regions count from 0."""
    name = F.format_string(">sln-%02d-%02d_%s_%d_%s\t%.4f\n%s", "rank", "region", "contig", "at", F.initcap(F.col("forward").cast("string")), "penalty", "sequence")
    return primers.select("rank", name.alias("value"))


def penalty_sums(primers: DataFrame, solution: str, penalty: str) -> DataFrame:
    """``solution, primers, penalty``: the number of a solution's primers and the sum of their penalties."""
    return primers.groupBy(solution).agg(F.count("*").alias("primers"), F.sum(penalty).alias("penalty"))


def printed_designs(designs: DataFrame, left: DataFrame, right: DataFrame, solution: str, right_offset: int = 104_000) -> DataFrame:
    """Candidates of printed designs (``solution, left, right``: arrays of positions): ``solution, side, pos, sequence, penalty``.

    Right positions are printed with an offset. A position without a candidate is left out.
    """
    pick = lambda side, at: designs.select(solution, F.lit(side).alias("side"), F.explode(at).alias("pos"))
    lefts = pick("LEFT", F.col("left")).join(left.select("pos", "sequence", "penalty"), "pos")
    rights = pick("RIGHT", F.transform("right", lambda p: p - right_offset)).join(right.select("pos", "sequence", "penalty"), "pos")
    return lefts.unionByName(rights).select(solution, "side", "pos", "sequence", "penalty")


def designer_check_lines(primers: DataFrame) -> DataFrame:
    """``value``: primers as input lines of the designer, the right ones as those of the other strand."""
    return primers.select(F.concat(F.when(F.col("side") == "LEFT", "SEQUENCE_PRIMER=").otherwise("SEQUENCE_PRIMER_REVCOMP="), "sequence").alias("value"))


def primer_validity(position: Column, length: Column, start: Column, end: Column, forward: Column) -> tuple[Column, Column, Column]:
    """Verdict on a primer in its exon, and bases from its first and its last end to the exon's inner end (null if invalid)."""
    verdict = F.when((position < start) & (position > end), "outside exon").when(forward & (position > end), "forward past exon").when(~forward & (position < start), "reverse before exon").otherwise("valid")
    first = F.when(verdict == "valid", F.when(forward, end - position).otherwise(position - start))
    last = F.when(verdict == "valid", F.when(forward, end - (position + length)).otherwise(position + length - start))
    return verdict, first, last


def marked_product(sequence: Column, primer: Column, position: Column, start: Column, end: Column, forward: Column, extend: int = 0) -> Column:
    """The region's product from the primer to the inner end, ``extend`` bases added outside, with the primer between two marks: ``>`` forward, ``<`` reverse.

    Positions count from 0. The first occurrence of the primer (or its reverse complement) in the product is marked; null if there is none.
    """
    own = F.when(forward, primer).otherwise(reverse_complement(primer))
    lo = F.when(forward, F.greatest(position - extend, F.lit(0))).otherwise(start)
    hi = F.when(forward, end).otherwise(position + F.length(primer) + extend)
    product = F.substr(sequence, (lo + 1).cast("int"), (hi - lo).cast("int"))
    at, mark = F.instr(product, own), F.when(forward, ">").otherwise("<")
    return F.when(at > 0, F.concat(F.substr(product, F.lit(1), at - 1), mark, own, mark, F.substr(product, (at + F.length(own)).cast("int"))))


def well_lines(chosen: DataFrame, labels: list[str], row: str, note: str) -> DataFrame:
    """``value``: plate lines ``well, name, sequence, note`` of the chosen primers (``label, name, sequence``), a well for each of ``labels`` in order."""
    well = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    return chosen.filter(well > 0).select(F.concat_ws("\t", F.concat(F.lit(row), well.cast("string")), F.substr("name", F.lit(6), F.length("name") - 7), "sequence", F.lit(note)).alias("value"))
