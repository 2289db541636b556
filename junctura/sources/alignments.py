"""Alignment files: SAM, segment tables and PSL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from junctura.functions import cigar

SAM_COLUMNS = ("qname", "flags", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
#: Fixed bit of each flag name.
SAM_FLAGS = {
    "multiple_fragments": 0,
    "properly_aligned": 1,
    "unmapped": 2,
    "next_unmapped": 3,
    "rev_strand_of_query": 4,
    "rev_strand_of_next": 5,
    "first_fragment": 6,
    "last_fragment": 7,
    "secondary": 8,
    "failed_quality": 9,
    "duplicate": 10,
}
SEGMENTS = "qname string, rname string, ref_start long, ref_end long, frag_start long, frag_end long, frag_len long, align_str string, ascore double"
PSL = (
    "match int, mismatch int, repmatch int, n_s int, qgap int, qgap_bases int, sgap int, tgap_bases int, strand string, qseqid string, qlen long, "
    "qstart long, qend long, sseqid string, slen long, sstart long, send long, block_count int, block_sizes string, q_starts string, t_starts string"
)


def sam_rows(lines: DataFrame) -> DataFrame:
    """The first eleven columns of alignment rows out of text lines (``value``); header rows and empty lines are skipped."""
    part = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    typed = {"flags": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    return rows.select(*[F.get(part, F.lit(i)).try_cast(typed.get(c, "string")).alias(c) for i, c in enumerate(SAM_COLUMNS)])


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return sam_rows(spark.read.text(path))


def sam_of_text(texts: DataFrame, column: str) -> DataFrame:
    """Alignment rows of whole SAM texts, one in each row; what follows a text's last line feed is dropped."""
    return sam_rows(texts.select(F.explode(F.split(F.regexp_replace(F.col(column), r"[^\n]*\z", ""), "\n")).alias("value")))


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(1 << SAM_FLAGS[name]) != 0


def alignments(sam: DataFrame) -> DataFrame:
    """Mapped alignments with their operations, interval on the fragment and strand: the fields of a segment."""
    rows = cigar.with_ops(sam.filter(~has_flag(F.col("flags"), "unmapped")), F.col("cigar"), "ops").withColumn("reverse", has_flag(F.col("flags"), "rev_strand_of_query"))
    start, end = cigar.fragment_interval(F.col("ops"), F.col("reverse"))
    rows = rows.select("qname", "rname", F.col("pos").alias("ref_start"), (F.col("pos") + F.col("tlen")).alias("ref_end"), F.least(start, end).alias("frag_start"), F.greatest(start, end).alias("frag_end"), cigar.fragment_length(F.col("ops")).alias("frag_len"), "ops", "reverse")
    return rows.filter("frag_start <> frag_end")


def oriented(rows: DataFrame) -> DataFrame:
    """Segments with the strand told by the order of the reference ends: start above end if reverse."""
    swap = F.col("reverse")
    return rows.withColumns({"ref_start": F.when(swap, F.col("ref_end")).otherwise(F.col("ref_start")), "ref_end": F.when(swap, F.col("ref_start")).otherwise(F.col("ref_end"))})


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SEGMENTS, comment="#")


def write_segments(df: DataFrame, path: str) -> None:
    """Segment rows, tab separated, scores with two digits."""
    columns = [c.split()[0] for c in SEGMENTS.split(", ")]
    df.select(*columns[:-1], F.format_string("%.2f", "ascore").alias("ascore")).write.csv(path, sep="\t")


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """PSL rows of 21 columns; rows with another number of columns or a number that doesn't parse are dropped.

    Rows are checked here, as the CSV reader's own check only sees the columns that a query asks for.
    """
    part = F.split("value", "\t", -1)
    fields = [c.split() for c in PSL.split(", ")]
    typed = spark.read.text(path).filter(F.size(part) == len(fields)).select(*[F.get(part, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])
    return typed.dropna(subset=[name for name, kind in fields if kind != "string"])


#: Readers of an aligner's output by the end of its program's name.
READERS = {"blat": read_psl}


def read_hits(spark: SparkSession, path: str, program: str) -> DataFrame:
    """The output of an aligner, told by its program's name; another one is an error."""
    for name, reader in READERS.items():
        if program.endswith(name):
            return reader(spark, path)
    raise ValueError(f"no reader for the output of {program}")
