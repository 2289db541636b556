"""From alignments of long reads to breakpoint templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from junctura.functions import cigar
from junctura.functions.checkpoints import shared_table
from junctura.functions.stages import Stages
from junctura.operators import chain, clusters, junctions, templates
from junctura.sources import alignments, sequences


def chained_alignments(sam: DataFrame) -> DataFrame:
    """Segment rows (see ``alignments.SEGMENTS``) of the best chain of every read, told in the context of the read.

    Segments are sorted by their place on the read. Pieces of one base, which come from trivial overlaps, are left out.
    """
    rows = alignments.alignments(sam)
    chained = chain.chain_segments(rows, "qname", "rname", "frag_start", "frag_end", "ops", "ref_start", "ref_end", "reverse")
    lengths = rows.groupBy("qname").agg(F.max("frag_len").cast("long").alias("frag_len"))
    kept = chained.filter("frag_start <> frag_end").join(lengths, "qname")
    return kept.select("qname", "rname", "ref_start", "ref_end", "frag_start", "frag_end", "frag_len", "align_str", F.col("score").alias("ascore"))


def clustered_junctions(segments: DataFrame, mode: str = "exact", max_distance: int | None = None, keep_isolated: bool = False) -> DataFrame:
    """``cluster, frag_idx, bp_idx, left, right, d``: the junctions of each cluster of triangles that meet. Contigs don't count.

    Equal triangles are linked once and get their rows back after. Fragments are numbered over all of them, those with one segment too.
    """
    found = shared_table(junctions.junctions(segments, "qname", ["frag_start"], "ref_start", "ref_end", "frag_start", "frag_end", max_distance))
    points = shared_table(clusters.unique_points(found, "a", "b", "d").withColumn("node", F.struct("a", "b", "d")))
    labels = clusters.triangle_clusters(points, "node", "a", "b", "d", mode, keep_isolated)
    labels = labels.select("node.*", F.col("component").alias("cluster"))
    numbered = junctions.dense_ids(segments.select("qname").distinct(), "qname", "frag_idx")
    return found.join(labels, ["a", "b", "d"]).join(numbered, "qname").select("cluster", "frag_idx", F.col("ordinal").alias("bp_idx"), F.col("a").alias("left"), F.col("b").alias("right"), "d")


def cluster_modes(supports: DataFrame, min_size: int = 25) -> DataFrame:
    """``rank, cluster, n, left, right, d`` of clusters of ``min_size`` or more, the largest first: the most frequent pair and the mode of d."""
    ranked = clusters.largest_first(supports, "cluster").filter(F.col("n") >= min_size)
    pairs = clusters.pair_mode(supports, "cluster", "left", "right", ["frag_idx", "bp_idx"]).select("cluster", "left", "right")
    return ranked.join(pairs, "cluster").join(clusters.mode_tie_average(supports, "cluster", "d", "d"), "cluster").select("rank", "cluster", "n", "left", "right", "d")


def junction_templates(modes: DataFrame, contigs: DataFrame, contig: str, k: int = 6500, offset: int | None = None, max_d: int = 100, min_distance: int = 10) -> DataFrame:
    """``rank, header, template`` of the junctions that stay after reciprocal ones are merged and noise is dropped.

    ``contigs`` has ``name, seq``, or ``name, chunk, bases`` (see ``sequences.fasta_chunks``); flanks fetch the chunks they touch of the one named ``contig``, and it is an error if there is none.
    """
    chunks = contigs if "chunk" in contigs.columns else sequences.chunked(contigs.filter(F.col("name") == contig))
    chunks = chunks.filter(F.col("name") == contig)
    if chunks.isEmpty():
        raise ValueError(f"no contig is named {contig}")
    merged = templates.reciprocal_fold(modes.select("rank", F.col("left").alias("a"), F.col("right").alias("b"), F.col("d").cast("long").alias("d")), "rank", "a", "b", "d", max_d, min_distance)
    kept = merged.withColumns({"name": F.lit("name"), "contig": F.lit(contig)})
    return templates.templates_of_chunks(kept, "rank", "name", "a", "b", "d", "contig", chunks, k, offset)


def analyze(sam: DataFrame, contigs: DataFrame, contig: str, min_size: int = 25, mode: str = "exact", k: int = 6500, offset: int | None = None, max_distance: int | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, clusters' modes, and templates of an alignment table; each stage is written in the shared folder before the next.

    With ``folder``, stages are kept there, and those whose inputs and parameters haven't changed are read again (see ``functions.stages``).
    """
    if folder is None:
        segments = shared_table(chained_alignments(sam))
        modes = shared_table(cluster_modes(shared_table(clustered_junctions(segments, mode, max_distance)), min_size))
        return segments, modes, junction_templates(modes, contigs, contig, k, offset)
    kept = Stages(sam.sparkSession, folder)
    segments = kept.stage("segments", lambda: chained_alignments(sam), [sam])
    found = kept.stage("junctions", lambda: clustered_junctions(segments, mode, max_distance), [segments], mode=mode, max_distance=max_distance)
    modes = kept.stage("modes", lambda: cluster_modes(found, min_size), [found], min_size=min_size)
    made = kept.stage("templates", lambda: junction_templates(modes, contigs, contig, k, offset), [modes, contigs], contig=contig, k=k, offset=offset)
    return segments, modes, made


def score_of(segments: DataFrame) -> DataFrame:
    """Segment rows with the score that their own operations give, ``again``, to hold against ``ascore``."""
    return segments.withColumn("again", cigar.score(cigar.parse(F.col("align_str"))))
