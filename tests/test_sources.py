"""Readers and writers on small files made here."""

import random

import pytest
from pyspark.sql import functions as F

from junctura.operators import anneal, deletions
from junctura.sources import alignments, clusters, design, sequences


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_sam(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@HD\tVN:1\nr1\t16\tc\t10\t60\t5H10M3H\t*\t0\t10\tACGTACGTAC\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    got = alignments.alignments(alignments.read_sam(spark, path)).collect()
    assert len(got) == 1 and (got[0].frag_start, got[0].frag_end, got[0].frag_len, got[0].ref_end, got[0].reverse) == (4, 13, 18, 20, True)
    turned = alignments.oriented(spark.createDataFrame([(1, 5, True)], "ref_start int, ref_end int, reverse boolean")).first()
    assert (turned.ref_start, turned.ref_end) == (5, 1)


def test_fasta_and_fastq(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">c1 note\nACGT\nAC\n>c2\nGGG\n")
    contigs = sequences.read_fasta(spark, path)
    assert dict(map(tuple, contigs.collect())) == {"c1": "ACGTAC", "c2": "GGG"}
    cut = contigs.filter("name = 'c1'").select(sequences.subsequence(F.col("seq"), F.lit(1), F.lit(4), F.lit(True))).first()[0]
    assert cut == "ACG"
    asked = spark.createDataFrame([("c2",), ("c9",)], "name string")
    assert {r.name: r.missing for r in sequences.select_contigs(contigs, asked).collect()} == {"c2": False, "c9": True}
    sequences.write_fasta(contigs, "name", "seq", str(tmp_path / "out"), 4)
    assert dict(map(tuple, sequences.read_fasta(spark, str(tmp_path / "out")).collect())) == {"c1": "ACGTAC", "c2": "GGG"}
    q = put(tmp_path, "a.fq", "@r1\nACGT\n+\nII!I\n@r2\nA\n+\n!\n")
    assert [tuple(r) for r in sequences.read_fastq(spark, q).collect()] == [("r1", "ACGT", "II!I"), ("r2", "A", "!")]


def test_cluster_blocks(spark, tmp_path):
    text = "#\t\t\t1.0\t2.0\t25.5\n3\t0\t1\t2\t14\n1\t0\t1\t2\t37\n=\n#\t\t\t5.0\t6.0\t7.0\n2\t1\t5\t6\t7\n=\n"
    got = clusters.read_clusters(spark, put(tmp_path, "a.bp", text))
    assert got.count() == 3 and got.select("cluster").distinct().count() == 2
    assert got.filter("mode_d = 25.5").select(F.sum("d")).first()[0] == 51
    modes = got.select("cluster", "name", "mode_left", "mode_right", "mode_d").distinct()
    clusters.write_clusters(got, modes, "cluster", str(tmp_path / "out"))
    assert clusters.read_clusters(spark, str(tmp_path / "out")).count() == 3


def test_candidates(spark, tmp_path):
    text = "PRIMER_LEFT_NUM_RETURNED=1\nPRIMER_LEFT_0_PENALTY=0.5\nPRIMER_LEFT_0_SEQUENCE=ACGT\nPRIMER_LEFT_0=12,4\nPRIMER_RIGHT_0_PENALTY=1.4\nPRIMER_RIGHT_0=30,5\n=\n"
    got = design.read_candidates(spark, put(tmp_path, "p.out", text))
    rows = {r.side: (r.pos, r.len, r.penalty) for r in got.collect()}
    assert rows == {"LEFT": (12, 4, 0.5), "RIGHT": (30, 5, 1.4)}
    assert [r.side for r in design.within_penalty(got).collect()] == ["LEFT"]
    for region, at in ((0, 5), (1, 9)):
        put(tmp_path, f"tag.000{region}.primer3.out", f"PRIMER_LEFT_0={at},4\nPRIMER_LEFT_0_PENALTY=1\n=\n")
    both = design.read_candidates(spark, str(tmp_path / "tag.*.primer3.out"))
    assert sorted((r.region, r.side, r.idx, r.pos) for r in both.collect()) == [(0, "LEFT", 0, 5), (1, "LEFT", 0, 9)]


def test_psl_filter(spark):
    from junctura.operators import primers

    columns = [c.split() for c in alignments.PSL.split(", ")]
    base = dict.fromkeys([c for c, _ in columns], 0) | {"qlen": 20, "qstart": 0, "qend": 20, "sstart": 100, "send": 120, "sseqid": "c", "block_sizes": "", "q_starts": "", "t_starts": ""}
    rows = [base | {"qseqid": "LEFT:5", "strand": "+"}, base | {"qseqid": "RIGHT:9", "strand": "-"}, base | {"qseqid": "LEFT:7", "strand": "-"}, base | {"qseqid": "LEFT:8", "strand": "+", "send": 105}]
    psl = spark.createDataFrame([tuple(r[c] for c, _ in columns) for r in rows], alignments.PSL)
    assert sorted(r.primer for r in primers.off_target_hits(psl).collect()) == [5, 9]


def test_solutions_and_settings(spark, tmp_path):
    s = design.read_solutions(spark, put(tmp_path, "s.sa", "m,b,0\t20\t1.5\t3,1:7\nm,b,1\t10\t1.0\t4:\n"))
    assert [tuple(r) for r in design.solution_rows(s, 1).collect()] == [(0, 10, 0, 4)]
    got = design.settings([tuple(r) for r in design.read_settings(spark, put(tmp_path, "c.conf", "blat_bin=/x\nd_p=5\nbad=1=2\n")).collect()])
    assert got["programs"] == {"blat": "/x"} and got["parameters"] == {"d": "5"}


def test_deletions_and_variants(spark):
    df = spark.createDataFrame([("s", "c", 1, 5, 9, 12, 0, 10)], "sample string, seqid string, l_lo int, l_hi int, r_lo int, r_hi int, l_bp int, r_bp int")
    assert sorted((r.side, r.breakpoint) for r in design.deletion_breakpoints(df).collect()) == [("left", 1), ("left", 5), ("right", 10)]
    lines = spark.createDataFrame([("#h",), ("1\t77\t.\t" + "A" * 600 + "\tA\t.\t.\tX=1;SAMPLES=a,b",)], "value string")
    carriers = design.variant_samples(lines)
    assert [tuple(r) for r in carriers.orderBy("sample").collect()] == [(77, 600, "a"), (77, 600, "b")]
    panel = spark.createDataFrame([("a", "P"), ("c", "P")], "sample string, population string")
    merged = deletions.merged_deletions(carriers.withColumn("contig", F.lit("1")), "contig", "pos", "length", "sample")
    assert {(r.lo, r.hi, r.population, r.n, r.ratio) for r in design.population_ratios(merged, panel).collect()} == {(77, 677, "P", 1, 0.5), (77, 677, None, 1, None)}


def test_sam_of_text(spark):
    line = "r{}\t0\tc\t10\t60\t4M\t*\t0\t4\tACGT\t*"
    df = spark.createDataFrame([("@HD\n" + line.format(1) + "\n" + line.format(2),), ("",)], "text string")
    assert [r.qname for r in alignments.sam_of_text(df, "text").collect()] == ["r1"]


def test_fasta_index(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">c1 note\nACGT\nAC\n>c2\nGGGGG\nGG\n\n")
    got = sorted(map(tuple, sequences.fasta_index(spark, path).collect()))
    assert got == [("c1", 6, 9, 4, 5), ("c2", 7, 21, 5, 6)]
    assert open(path).read()[21:26] == "GGGGG"
    sequences.write_index(sequences.fasta_index(spark, path), str(tmp_path / "fai"))
    assert sorted(map(tuple, sequences.read_index(spark, str(tmp_path / "fai")).collect())) == got
    assert sorted(map(tuple, sequences.index_of(sequences.read_fasta(spark, path)).collect())) == [("c1", 6), ("c2", 7)]


def test_fastq_of_many_blocks(spark, tmp_path):
    """Records are found in every block of a split file; quality lines that look like names are no names."""
    path = put(tmp_path, "a.fq", "".join(f"@r{i}\nACGT{'A' * (i % 7)}\n+\n@r{i}x{'!' * (i % 7)}\n" for i in range(500)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = {r.name: (r.seq, r.qual) for r in sequences.read_fastq(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"r{i}": ("ACGT" + "A" * (i % 7), f"@r{i}x" + "!" * (i % 7)) for i in range(500)}


def test_segments_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r", "c", 5, 9, 1, 5, 30, "5M", 4.6)], alignments.SEGMENTS)
    alignments.write_segments(rows, str(tmp_path / "t"))
    assert [tuple(r) for r in alignments.read_segments(spark, str(tmp_path / "t")).collect()] == [("r", "c", 5, 9, 1, 5, 30, "5M", 4.6)]


def test_psl_file(spark, tmp_path):
    line = "20\t0\t0\t0\t0\t0\t0\t{gap}\t+\tLEFT:5\t20\t0\t20\tchr4\t900\t{at}\t{to}\t1\t20,\t0,\t100,"
    path = put(tmp_path, "a.psl", "\n".join([line.format(gap=0, at=100, to=120), line.format(gap=3, at=10, to=30), "a bad line"]) + "\n")
    psl = alignments.read_psl(spark, path)
    assert psl.count() == 2 and alignments.read_hits(spark, path, "/bin/blat").count() == 2
    with pytest.raises(ValueError, match="no reader"):
        alignments.read_hits(spark, path, "other")
    assert [tuple(r) for r in design.alignments_as_regions(psl, ["chr4", "chr7"]).collect()] == [("chr4", 101, 121, "LEFT:5")]


def test_design_files(spark, tmp_path):
    regions = design.read_regions(spark, put(tmp_path, "r.tsv", "#contig\nc\t10\t200\tforward\nc\t400\t100\tbackward\n"))
    assert [tuple(r) for r in regions.orderBy("start").collect()] == [("c", 10, 200, True), ("c", 400, 100, False)]
    seq = "ACGTACGTAC" * 60
    text = [r.value for r in design.designer_input(regions.withColumn("seq", F.lit(seq)).orderBy("start"), "seq", "start", "length", "forward", 50).collect()]
    assert text[0] == f"PRIMER_NUM_RETURN=10\nSEQUENCE_ID=pamp_workflow\nSEQUENCE_TEMPLATE={seq[10:210]}\nSEQUENCE_PRIMER_PAIR_OK_REGION_LIST=,,195,5\n="
    assert text[1].endswith("\nSEQUENCE_PRIMER_PAIR_OK_REGION_LIST=0,5,,\n=") and text[1].startswith("PRIMER_NUM_RETURN=5\n")
    c = spark.createDataFrame([("LEFT", 12, "ACGT")], "side string, pos long, sequence string")
    assert design.candidate_fasta(c).first().value == ">LEFT:12\nACGT" and design.pair_score_input(c).first().value == "12\tACGT\tN"
    scores = design.read_pair_scores(spark, put(tmp_path, "s.txt", "Name1\tName2\ta\tb\tc\n1\t2\t-4\t0\t0\n3\t4\t0\t0\t-7.5\n"))
    bad = spark.createDataFrame([(3, 4)], "p long, q long")
    both = design.with_cross_amplification(scores, bad)
    assert sorted(map(tuple, both.collect())) == [(1, 2, -4.0, 0.0, 0.0), (3, 4, -100.0, -100.0, -100.0), (3, 4, 0.0, 0.0, -7.5)]
    assert [tuple(r) for r in design.read_links(spark, put(tmp_path, "l.tsv", "0\t1\tinner\n")).collect()] == [(0, 1, "inner")]
    found = design.read_primers(spark, put(tmp_path, "p.tsv", "contig\tpos\torient\tseq\tpenalty\nc\t7\tTrue\tACGT\t0.5\nc\t9\tFalse\tGG\t1\n"))
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [("c", 7, True, "ACGT", 0.5), ("c", 9, False, "GG", 1.0)]
    assert [r.qName for r in design.read_transcripts(spark, put(tmp_path, "t.tsv", "qName\ttStart\nm1\t5\n")).collect()] == ["m1"]
    assert design.overlaid({"parameters": {"d": "1", "e": "2"}}, {"parameters": {"d": "3"}}) == {"parameters": {"d": "3", "e": "2"}}


def test_solution_files(spark, tmp_path):
    s = spark.createDataFrame([("m,b,0", 20, 1.5, [[1, 3], []]), ("m,b,1", 10, 1.0, [[4], [8]])], "params string, cost long, seconds double, primers array<array<long>>")
    design.write_solutions(s, str(tmp_path / "s"))
    assert sorted(map(str, design.read_solutions(spark, str(tmp_path / "s")).collect())) == sorted(map(str, s.collect()))
    for run in (0, 1):
        put(tmp_path, f"x.m1.b4.{run}", f"Iterations\t5000\t1.0\t{90 + run}\t95\nIterations\t10000\t1.0\t80\t85\nTerminationClock:2.00\n")
    trace = design.read_trace(spark, str(tmp_path / "x.*"))
    assert {(r.m, r.b, r.run, r.iteration, r.min_cost) for r in trace.collect()} == {("m1", "b4", str(k), i, c) for k in (0, 1) for i, c in ((5000, 90.0 + k), (10000, 80.0))}
    assert {(r.iteration, r.min_cost) for r in anneal.average_traces(trace).collect()} == {(5000, 90.5), (10000, 80.0)}
    names = spark.createDataFrame([("sln-01-02_chr_9_77_True",)], "name string")
    assert tuple(design.solution_names(names, "name").first())[1:] == (1, 2, "chr_9", 77, True)


def test_exons(spark):
    df = spark.createDataFrame([("10,50,", "5,20,", True), ("10,50,", "5,20,", False)], "s string, n string, f boolean")
    got = sorted((r.f, r.exon, r.start, r.end) for r in design.exon_regions(df, "s", "n", "f", 8).collect())
    assert got == [(False, 0, 62, 70), (False, 1, 10, 15), (True, 0, 10, 15), (True, 1, 62, 70)]


def test_shared_tables(spark):
    from junctura.functions import checkpoints

    held = checkpoints.shared_table(spark.range(5))
    assert held.count() == 5
    path = checkpoints._WRITTEN[-1]
    checkpoints.remove_tables(spark)
    assert not checkpoints._WRITTEN and not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def plain_fasta(data):
    """Contigs and index entries of a file, line by line."""
    out, at = [], 0
    for line in data.split("\n"):
        if line.startswith(">"):
            out.append([line[1:].split()[0] if line[1:].split() else "", "", at + len(line) + 1, None])
        elif out and (line or at < len(data)):
            out[-1][3] = out[-1][3] or (len("".join(line.split())), len(line) + 1)
            out[-1][1] += "".join(line.split())
        at += len(line) + 1
    return [(n, s, o, *(f or (0, 1))) for n, s, o, f in out]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_fasta_by_record(spark, tmp_path, ending):
    """Signs inside headers, blank lines, lines before the first header, empty contigs; the same at any split of the file."""
    draw = random.Random(5)
    lines = ["ACGT", ">chr1 change A>G here", "ACGTA", "CC>GT", "", "T", ">empty", "> spaced name", "acgtn"]
    for k in range(40):
        lines += [f">c{k} x>y"] + ["".join(draw.choice("ACGTN") for _ in range(60)) for _ in range(draw.randrange(0, 30))] + ["AC"]
    data = ending.join(lines) + ending
    want = plain_fasta(data)
    path = put(tmp_path, "x.fa", data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("100m", "5000", "700", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert sorted(map(tuple, sequences.read_fasta(spark, path).collect())) == sorted(w[:2] for w in want)
        assert sorted(map(tuple, sequences.fasta_index(spark, path).collect())) == sorted((w[0], len(w[1]), *w[2:]) for w in want)
        chunks = sequences.fasta_chunks(spark, path, 100)
        assert sorted((r.name, r.chunk, r.bases) for r in chunks.collect()) == sorted((n, i // 100, s[i : i + 100]) for n, s, *_ in want for i in range(0, len(s), 100))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    seqs = {n: s for n, s, *_ in want}
    ranges = [(k, name, a, a + n) for k, (name, a, n) in enumerate((draw.choice(list(seqs)), draw.randrange(-20, 1900), draw.choice([0, 1, 99, 100, 350])) for _ in range(200))] + [(999, "missing", 0, 10)]
    got = sequences.fetch(spark.createDataFrame(ranges, "k int, of string, a long, b long"), chunks, "k", "of", "a", "b", "bases", 100)
    assert {r.k: r.bases for r in got.collect()} == {k: seqs.get(n, "")[max(a, 0) : max(b, 0)] for k, n, a, b in ranges}


def test_one_contig_in_several_tasks(spark, tmp_path):
    bases = "ACGTTGCA" * 40_000
    path = put(tmp_path, "long.fa", ">long\n" + "\n".join(bases[i : i + 80] for i in range(0, len(bases), 80)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    chunks = sequences.fasta_chunks(spark, path, 1 << 12)
    assert spark.read.text(path).rdd.getNumPartitions() > 4
    rows = sorted(map(tuple, chunks.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "".join(r[2] for r in rows) == bases and max(len(r[2]) for r in rows) == 1 << 12


def test_one_primer_of_each_sequence(spark):
    """Of equal sequences the last position stays; null sequences are one of their own."""
    df = spark.createDataFrame([("ACGT", 5, "a"), ("ACGT", 9, "b"), ("GG", 1, "c"), ("ACGT", 7, "d"), (None, 3, "e")], "seq string, pos long, name string")
    got = sorted((str(r.seq), r.pos) for r in design.longest_by_sequence(df, "seq", "pos").select("seq", "pos").collect())
    assert got == [("ACGT", 9), ("GG", 1), ("None", 3)]
