"""Files of primer design: regions, candidates, scores, solutions, traces, links, deletions, variants, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``contig, start, length, forward``; any orientation but ``forward`` is reverse."""
    rows = spark.read.csv(path, sep="\t", schema="contig string, start long, length long, orientation string", comment="#")
    return rows.select("contig", "start", "length", (F.col("orientation") == "forward").alias("forward"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of key=value lines; lines without exactly one ``=`` are skipped."""
    part = F.split("value", "=", -1)
    return spark.read.text(path).filter(F.size(part) == 2).select(F.trim(F.get(part, F.lit(0))).alias("key"), F.trim(F.get(part, F.lit(1))).alias("value"))


def settings(rows: list[tuple[str, str]]) -> dict[str, dict[str, str]]:
    """Settings by kind: the suffixes ``_bin``, ``_p`` and ``_dir`` of a key tell programs, parameters and folders."""
    kinds = {"_bin": "programs", "_p": "parameters", "_dir": "folders"}
    out: dict[str, dict[str, str]] = {k: {} for k in kinds.values()}
    for key, value in rows:
        for suffix, kind in kinds.items():
            if key.endswith(suffix):
                out[kind][key[: -len(suffix)]] = value
    return out


def candidate_records(lines: DataFrame) -> DataFrame:
    """``side, idx, key, value`` of output lines ``PRIMER_LEFT_0_KEY=value``, after the other columns; the bare key is named POSITION."""
    pattern = r"^PRIMER_(LEFT|RIGHT)_(\d+)(?:_([^=]+))?=(.*)$"
    rows = lines.filter(F.col("value").rlike(pattern) & ~F.col("value").contains("RETURNED"))
    key = F.regexp_extract("value", pattern, 3)
    others = [c for c in lines.columns if c != "value"]
    return rows.select(*others, F.regexp_extract("value", pattern, 1).alias("side"), F.regexp_extract("value", pattern, 2).try_cast("int").alias("idx"), F.when(key == "", "POSITION").otherwise(key).alias("key"), F.regexp_extract("value", pattern, 4).alias("value"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per candidate: ``region, side, idx, pos, len, penalty, sequence`` and all values as a map.

    Files count their candidates each from 0, so rows are kept apart by file. ``region`` is the number in names like ``tag.0001.primer3.out``, null in others.
    """
    records = candidate_records(spark.read.text(path).withColumn("file", F.input_file_name()))
    wide = records.groupBy("file", "side", "idx").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    get = lambda k: F.col("m")[k]
    at = F.split(get("POSITION"), ",")
    region = F.regexp_extract("file", r"\.(\d+)\.primer3\.out$", 1).try_cast("int")
    return wide.select(region.alias("region"), "side", "idx", F.get(at, F.lit(0)).try_cast("long").alias("pos"), F.get(at, F.lit(1)).try_cast("int").alias("len"), get("PENALTY").try_cast("double").alias("penalty"), get("SEQUENCE").alias("sequence"), F.col("m").alias("values"))


def pivot_records(records: DataFrame, by: list[str], key: str, value: str, keys: list[str]) -> DataFrame:
    """Key-value rows as a column for each of the given keys."""
    return records.groupBy(*by).pivot(key, keys).agg(F.first(value))


def within_penalty(candidates: DataFrame, most: float = 1.2) -> DataFrame:
    return candidates.filter(F.col("penalty") <= most)


def longest_by_sequence(candidates: DataFrame, sequence: str, position: str) -> DataFrame:
    """One row per sequence, the one with the last position."""
    return candidates.groupBy(sequence).agg(F.max(F.struct(position, F.struct("*").alias("__row"))).alias("m")).select("m.__row.*")


def designer_input(regions: DataFrame, seq: str, start: str, length: str, forward: str, per_kbp: int = 50) -> DataFrame:
    """``value``: the designer's input text of each region of the whole sequence ``seq``.

    The pair must have its right primer in the last five bases of a forward region, its left one in the first five of a reverse one.
    """
    bases = F.substr(F.col(seq), (F.col(start) + 1).cast("int"), F.col(length).cast("int"))
    n = F.call_function("div", F.length(bases) * F.lit(per_kbp), F.lit(1000))
    ok = F.when(F.col(forward), F.concat(F.lit(",,"), (F.length(bases) - 5).cast("string"), F.lit(",5"))).otherwise("0,5,,")
    text = F.concat(F.lit("PRIMER_NUM_RETURN="), n.cast("string"), F.lit("\nSEQUENCE_ID=pamp_workflow\nSEQUENCE_TEMPLATE="), bases, F.lit("\nSEQUENCE_PRIMER_PAIR_OK_REGION_LIST="), ok, F.lit("\n="))
    return regions.select(text.alias("value"))


def candidate_fasta(candidates: DataFrame) -> DataFrame:
    """``value``: FASTA lines ``>SIDE:pos`` and the sequence."""
    return candidates.select(F.concat(F.lit(">"), "side", F.lit(":"), F.col("pos").cast("string"), F.lit("\n"), "sequence").alias("value"))


def pair_score_input(candidates: DataFrame) -> DataFrame:
    """``value``: position, sequence and N, tab separated."""
    return candidates.select(F.concat_ws("\t", F.col("pos").cast("string"), "sequence", F.lit("N")).alias("value"))


def read_pair_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="p1 long, p2 long, s1 double, s2 double, s3 double", header=True)


def with_cross_amplification(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores with a row of -100 for each cross-amplifying pair."""
    bad = F.lit(-100.0)
    return scores.unionByName(pairs.select(F.col("p").alias("p1"), F.col("q").alias("p2"), bad.alias("s1"), bad.alias("s2"), bad.alias("s3")))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="region_i int, region_j int, name string", mode="PERMISSIVE")


def read_solutions(spark: SparkSession, path: str) -> DataFrame:
    """``params, cost, seconds, primers``: an array of positions per region."""
    rows = spark.read.csv(path, sep="\t", schema="params string, cost long, seconds double, chosen string")
    per_region = F.transform(F.split("chosen", ":"), lambda r: F.transform(F.filter(F.split(r, ","), lambda x: x != ""), lambda x: x.try_cast("long")))
    return rows.select("params", "cost", "seconds", per_region.alias("primers"))


def solution_rows(solutions: DataFrame, top: int = 5) -> DataFrame:
    """``rank, cost, region, position`` of the best solutions: ties by parameters."""
    best = solutions.orderBy("cost", "params").limit(top)
    ranked = best.groupBy().agg(F.array_sort(F.collect_list(F.struct("cost", "params", "primers"))).alias("s")).select(F.posexplode("s").alias("rank", "s"))
    return ranked.select("rank", "s.cost", F.posexplode("s.primers").alias("region", "p")).select("rank", "cost", "region", F.explode("p").alias("position"))


def write_solutions(solutions: DataFrame, path: str) -> None:
    chosen = F.array_join(F.transform("primers", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), ":")
    solutions.select("params", "cost", "seconds", chosen.alias("chosen")).write.csv(path, sep="\t")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """``m, b, run, iteration, seconds, min_cost, curr_cost``; schedule and run come from the file name ``*.m.b.run``, or from the folder that ``write_trace`` gives a run."""
    part = F.split("value", "\t")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/run=([^/]+)/[^/]+$", 1)
    name = F.when(folder != "", F.split(folder, "_")).otherwise(F.split(F.col("_metadata.file_path"), r"\."))
    rows = spark.read.option("recursiveFileLookup", "true").text(path).filter(F.col("value").startswith("Iterations"))
    return rows.select(
        F.element_at(name, -3).alias("m"), F.element_at(name, -2).alias("b"), F.element_at(name, -1).alias("run"), F.get(part, F.lit(1)).try_cast("long").alias("iteration"), F.get(part, F.lit(2)).try_cast("double").alias("seconds"), F.get(part, F.lit(3)).try_cast("double").alias("min_cost"), F.get(part, F.lit(4)).try_cast("double").alias("curr_cost")
    )


def write_trace(traces: DataFrame, path: str) -> None:
    """Lines of ``m, b, run, iteration, seconds, min_cost, curr_cost`` in order, a folder for each run, and last the time that it took."""
    named = traces.withColumn("run", F.concat_ws("_", "m", "b", "run"))
    lines = named.select("run", "iteration", F.concat_ws("\t", F.lit("Iterations"), "iteration", "seconds", "min_cost", "curr_cost").alias("value"))
    ends = named.groupBy("run").agg(F.concat(F.lit("TerminationClock:"), F.max("seconds").cast("string")).alias("value")).select("run", F.lit(2**62).alias("iteration"), "value")
    lines.unionByName(ends).repartition("run").sortWithinPartitions("run", "iteration").select("run", "value").write.partitionBy("run").text(path)


def solution_names(df: DataFrame, name: str) -> DataFrame:
    """Adds ``solution, row, contig, position, forward`` from names like ``sln-01-02_contig_pos_True``."""
    pattern = r"^>?sln-(\d+)-(\d+)_(.+)_(\d+)_(True|False)$"
    part = lambda i: F.regexp_extract(F.col(name), pattern, i)
    return df.withColumns({"solution": part(1).try_cast("int"), "row": part(2).try_cast("int"), "contig": part(3), "position": part(4).try_cast("long"), "forward": part(5) == "True"})


def deletion_breakpoints(df: DataFrame) -> DataFrame:
    """``sample, seqid, side, breakpoint``: the exact breakpoint where known (above 0), otherwise both ends of its range."""
    points = lambda bp, lo, hi: F.when(F.col(bp) > 0, F.array(bp)).otherwise(F.array(lo, hi))
    sides = F.array(F.struct(F.lit("left").alias("side"), points("l_bp", "l_lo", "l_hi").alias("at")), F.struct(F.lit("right").alias("side"), points("r_bp", "r_lo", "r_hi").alias("at")))
    return df.select("sample", "seqid", F.explode(sides).alias("s")).select("sample", "seqid", "s.side", F.explode("s.at").alias("breakpoint"))


def variant_samples(lines: DataFrame) -> DataFrame:
    """``pos, length, sample`` of VCF lines: samples are listed in the INFO column as SAMPLES=a,b."""
    part = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#"))
    return rows.select(F.get(part, F.lit(1)).try_cast("long").alias("pos"), F.length(F.get(part, F.lit(3))).cast("long").alias("length"), F.explode(F.split(F.regexp_extract(F.get(part, F.lit(7)), "SAMPLES=([^;]*)", 1), ",")).alias("sample"))


def population_ratios(deletions: DataFrame, panel: DataFrame, lo: str = "lo", hi: str = "hi", samples: str = "samples") -> DataFrame:
    """``lo, hi, population, n, ratio``: carriers of each (merged) deletion by population, against its size; samples that aren't in the panel fall under null.

    ``deletions`` holds an array of samples for each deletion; ``panel`` has ``sample, population``.
    """
    sizes = panel.groupBy("population").agg(F.count_distinct("sample").alias("size"))
    carriers = deletions.select(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.explode(F.array_distinct(samples)).alias("sample"))
    counts = carriers.join(panel, "sample", "left").groupBy("lo", "hi", "population").agg(F.count("*").alias("n"))
    return counts.join(sizes, "population", "left").select("lo", "hi", "population", "n", (F.col("n") / F.col("size")).alias("ratio"))


def block_values(text: Column) -> Column:
    """Numbers of a comma-separated list with a trailing comma."""
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.try_cast("long"))


def exon_regions(df: DataFrame, starts: str, sizes: str, forward: str, width: int) -> DataFrame:
    """Exons ``exon, start, end`` from block lists, in reading order, no wider than ``width`` at the outer side."""
    blocks = F.arrays_zip(block_values(F.col(starts)).alias("s"), block_values(F.col(sizes)).alias("n"))
    ordered = F.when(F.col(forward), blocks).otherwise(F.reverse(blocks))
    rows = df.select("*", F.posexplode(ordered).alias("exon", "x"))
    end = F.col("x.s") + F.col("x.n")
    return rows.withColumns({"start": F.greatest(F.col("x.s"), end - width), "end": end}).drop("x")


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    """``contig, pos, forward, sequence, penalty`` of a table of primers whose first line is a heading."""
    rows = spark.read.csv(path, sep="\t", schema="contig string, pos long, orient string, sequence string, penalty double", header=True, enforceSchema=True)
    return rows.select("contig", "pos", (F.col("orient") == "True").alias("forward"), "sequence", "penalty")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a tab-separated transcript alignment table with a heading, as strings."""
    return spark.read.csv(path, sep="\t", header=True)


def overlaid(*layers: dict[str, dict[str, str]]) -> dict[str, dict[str, str]]:
    """Settings of several files by kind, later ones over earlier ones."""
    out: dict[str, dict[str, str]] = {}
    for layer in layers:
        for kind, values in layer.items():
            out.setdefault(kind, {}).update(values)
    return out


def subset_by_window(candidates: DataFrame, position: str, first: int, last: int) -> DataFrame:
    """Candidates within a window of positions, both ends included."""
    return candidates.filter(F.col(position).between(first, last))


def subset_by_sequence(candidates: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose ``keys``, such as side and sequence, are among the chosen ones."""
    return candidates.join(chosen.select(*keys).distinct(), keys, "left_semi")


def alignments_as_regions(psl: DataFrame, contigs: list[str], max_gap: int = 2) -> DataFrame:
    """``contig, first, last, primer`` of alignments to some contigs whose gaps in the target have fewer than ``max_gap`` bases; starts count from 1.

    One row a primer: that with the most matches, then the first by contig and place.
    """
    rows = psl.filter((F.col("tgap_bases") < max_gap) & F.col("sseqid").isin(*contigs))
    best = rows.groupBy("qseqid").agg(F.min(F.struct((-F.col("match")).alias("m"), "sseqid", "sstart", "send")).alias("b"))
    return best.select(F.col("b.sseqid").alias("contig"), (F.col("b.sstart") + 1).alias("first"), (F.col("b.send") + 1).alias("last"), F.col("qseqid").alias("primer"))


def penalty_layers(candidates: DataFrame, keys: list[str], position: str, penalty: str, thresholds: list[float], width: int = 2000) -> DataFrame:
    """Histogram of positions in bins of ``width``, in layers: ``keys, threshold, bin, n, added``; n has the penalty below the threshold, ``added`` only what the threshold before hasn't."""
    at = (F.floor(F.col(position) / width) * width).cast("long")
    counts = candidates.groupBy(*keys, at.alias("bin")).agg(*[F.count_if(F.col(penalty) < t).alias(f"__{i}") for i, t in enumerate(thresholds)])
    layers = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"__{i}").alias("n"), (F.col(f"__{i}") - (F.col(f"__{i - 1}") if i else F.lit(0))).alias("added")) for i, t in enumerate(thresholds)]
    return counts.select(*keys, "bin", F.explode(F.array(*layers)).alias("l")).select(*keys, "l.threshold", "bin", "l.n", "l.added").filter("n > 0")


def longest_per_position(candidates: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Candidates that no longer one shares a position (``keys``) with; equally long ones all stay."""
    longest = candidates.groupBy(*keys).agg(F.max(length).alias("__longest"))
    return candidates.join(longest, keys).filter(F.col(length) == F.col("__longest")).drop("__longest")


def scored_positions(candidates: DataFrame, scores: DataFrame, position: str) -> DataFrame:
    """Candidates whose position occurs on either side of a score row ``p1, p2``."""
    both = scores.select(F.col("p1").alias(position)).union(scores.select(F.col("p2").alias(position))).distinct()
    return candidates.join(both, position, "left_semi")


def thousands(number: Column) -> Column:
    """A whole number with a comma between thousands."""
    return F.format_number(number, 0)


def round_nicely(number: Column) -> Column:
    """To whole thousands above a thousand, otherwise to whole hundreds; halves go away from zero."""
    return F.when(number > 1000, F.round(number, -3)).otherwise(F.round(number, -2))
