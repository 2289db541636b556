"""Sequence files: FASTA with its index, FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from junctura.functions.sequence import reverse_complement, wrapped

INDEX = "name string, length long, offset long, line_bases int, line_width int"


#: Bases of a chunk.
CHUNK = 1 << 16


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of FASTA files: ``__file, __at`` (offset in bytes), ``__bytes, value, __contig`` (how many headers there were so far), ``__base`` (place of its first base in the contig).

    Files are split anywhere. Lines are numbered within the block that they begin in, by sums over it; what comes before a block is a row for each block. So
    a contig of any length is read by as many tasks as its file has blocks. A header is a line that begins with ``>``; one elsewhere is part of a name.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    head = F.col("value").startswith(">")
    bases = F.when(~head, F.regexp_replace("value", r"\s", "")).otherwise("")
    lines = raw.withColumns({"__bytes": (F.octet_length("value") + 1).cast("long"), "__head": head.cast("long"), "__seq": bases}).withColumn("__n", F.length("__seq").cast("long"))
    sums = {"__bytes": "__at", "__head": "__heads", "__n": "__sum"}
    blocks = lines.groupBy("__file", "__block").agg(*[F.sum(c).alias(c) for c in sums])
    before = W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("__file", "__block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    inside = W.partitionBy("__file", "__block").orderBy("__id").rowsBetween(W.unboundedPreceding, -1)
    for c, name in sums.items():
        lines = lines.withColumn(name, F.coalesce(F.sum(c).over(inside), F.lit(0)))
    placed = lines.join(F.broadcast(blocks), ["__file", "__block"])
    for c, name in sums.items():
        placed = placed.withColumn(name, F.col(name) + F.col(f"{c}_before"))
    placed = placed.withColumn("__contig", F.col("__heads") + F.col("__head"))
    return placed.select("__file", "__at", "__bytes", "__head", "__contig", "__sum", "value", "__seq", "__n").filter("__contig > 0")


def _contigs(lines: DataFrame) -> DataFrame:
    """``__file, __contig, name, __start``: a row for each header, with the bases of its file before it."""
    return lines.filter("__head = 1").select("__file", "__contig", F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("name"), F.col("__sum").alias("__start"))


def fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """``name, chunk, bases``: the contigs of FASTA files in chunks of ``size`` bases, numbered from 0. No row holds more; a contig without bases has no row."""
    lines = _lines(spark, path)
    rows = lines.filter("__n > 0").join(_contigs(lines), ["__file", "__contig"]).withColumn("__base", F.col("__sum") - F.col("__start"))
    return _cut(rows, ["__file", "__contig", "name"], "__base", "__seq", size).select("name", "chunk", "bases")


def _cut(rows: DataFrame, contig: list[str], at: str, seq: str, size: int) -> DataFrame:
    """Chunks from pieces that begin at ``at``: each piece is cut at the chunks' borders, and a chunk's parts are put together in order."""
    first, last = F.floor(F.col(at) / size), F.floor((F.col(at) + F.length(seq) - 1) / size)
    parts = rows.filter(F.length(seq) > 0).select(*contig, at, seq, F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest(F.col("chunk") * size - F.col(at), F.lit(0))
    part = F.substr(seq, (low + 1).cast("int"), (F.least((F.col("chunk") + 1) * size - F.col(at), F.length(seq)) - low).cast("int"))
    parts = parts.select(*contig, "chunk", F.struct(F.col(at).alias("at"), part.alias("part")).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
    return parts.groupBy(*contig, "chunk").agg(whole.alias("bases"))


def chunked(contigs: DataFrame, size: int = CHUNK) -> DataFrame:
    """``name, chunk, bases`` of contigs that are whole rows ``name, seq``."""
    return _cut(contigs.select("name", F.lit(0).cast("long").alias("__base"), "seq"), ["name"], "__base", "seq", size)


def fetch(ranges: DataFrame, chunks: DataFrame, key: str, contig: str, start: str, end: str, out: str, size: int = CHUNK) -> DataFrame:
    """``ranges`` with the bases ``[start, end)`` from 0 of each one's contig as ``out``; what lies beyond a contig isn't there. ``key`` tells ranges apart.

    A range is joined with the chunks that it touches and with no others, and only its part of each is carried on.
    """
    size_ = F.lit(size)
    wanted = ranges.filter(F.col(end) > F.greatest(F.col(start), F.lit(0))).select(F.col(key).alias("__of"), F.col(contig).alias("name"), F.greatest(F.col(start), F.lit(0)).alias("__low"), F.col(end).alias("__high"))
    wanted = wanted.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__low") / size_), F.floor((F.col("__high") - 1) / size_))))
    low, high = F.greatest(F.col("__low") - F.col("chunk") * size_, F.lit(0)), F.least(F.col("__high") - F.col("chunk") * size_, size_)
    parts = wanted.join(chunks, ["name", "chunk"]).select("__of", F.struct("chunk", F.substr("bases", (low + 1).cast("int"), (high - low).cast("int")).alias("part")).alias("p"))
    whole = parts.groupBy("__of").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("__fetched"))
    return ranges.join(whole, F.col(key) == F.col("__of"), "left").withColumn(out, F.coalesce("__fetched", F.lit(""))).drop("__of", "__fetched")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq``: a row per contig; the name ends at the first white space. For contigs that are too long for a row, see ``fasta_chunks``."""
    lines = _lines(spark, path)
    parts = lines.filter("__n > 0").groupBy("__file", "__contig").agg(F.array_sort(F.collect_list(F.struct("__at", "__seq"))).alias("p"))
    whole = F.coalesce(F.array_join(F.transform("p", lambda p: p["__seq"]), ""), F.lit(""))
    return _contigs(lines).join(parts, ["__file", "__contig"], "left").select("name", whole.alias("seq"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=INDEX)


def index_of(contigs: DataFrame) -> DataFrame:
    """``name, length`` from the sequences themselves."""
    return contigs.select("name", F.length("seq").cast("long").alias("length"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """``name, length, offset, line_bases, line_width`` of the contigs of FASTA files, offsets in bytes of each file.

    Lengths count bases, so a blank line at the end doesn't add to them; the width is that of the contig's first line with its ending, be it one byte or two.
    """
    lines = _lines(spark, path)
    first = F.min_by(F.struct("__n", "__bytes"), "__at")
    rows = lines.filter("__head = 0").groupBy("__file", "__contig").agg(F.sum("__n").alias("length"), first.alias("f"))
    heads = _contigs(lines).join(lines.filter("__head = 1").select("__file", "__contig", (F.col("__at") + F.col("__bytes")).alias("offset")), ["__file", "__contig"])
    zero = F.lit(0)
    return heads.join(rows, ["__file", "__contig"], "left").select(
        "name", F.coalesce("length", zero).cast("long").alias("length"), "offset", F.coalesce("f.__n", zero).cast("int").alias("line_bases"), F.coalesce("f.__bytes", F.lit(1)).cast("int").alias("line_width")
    )


def write_index(index: DataFrame, path: str) -> None:
    index.select(*[c.split()[0] for c in INDEX.split(", ")]).write.csv(path, sep="\t")


def subsequence(seq: Column, start: Column, end: Column, reverse: Column) -> Column:
    """Bases [start, end) from 0, reverse-complemented where asked; an end beyond the contig is an error."""
    inside = F.when(end <= F.length(seq), F.substr(seq, (start + 1).cast("int"), (end - start).cast("int"))).otherwise(F.raise_error(F.lit("range beyond the contig")).cast("string"))
    return F.when(reverse, reverse_complement(inside)).otherwise(inside)


def select_contigs(contigs: DataFrame, names: DataFrame) -> DataFrame:
    """Asked-for contigs with ``missing`` true and no sequence where there is none."""
    return names.select("name").distinct().join(contigs, "name", "left").withColumn("missing", F.col("seq").isNull())


def write_fasta(df: DataFrame, name: str, seq: str, path: str, width: int = 80) -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped(F.col(seq), width)).alias("value")).write.text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq, qual`` of records of four lines. Files are split: lines are numbered by the sizes of the blocks before their own."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    blocks = lines.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("__file", "__block", (before - F.col("__first")).alias("__start"))
    numbered = lines.join(F.broadcast(starts), ["__file", "__block"]).withColumn("__at", F.col("__id") + F.col("__start"))
    of = lambda k: F.max(F.when(F.col("__at") % 4 == k, F.col("value")))
    records = numbered.groupBy("__file", F.call_function("div", F.col("__at"), F.lit(4).cast("long")).alias("__record")).agg(of(0).alias("h"), of(1).alias("seq"), of(3).alias("qual"), F.count("*").alias("__n"))
    return records.filter("__n = 4").select(F.regexp_replace("h", "^@", "").alias("name"), "seq", "qual")
