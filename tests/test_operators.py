"""Operators against brute force and hand-made traps."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.functions import cigar, runs, sequence, thermo
from junctura.operators import anneal, chain, clusters, deletions, graph, intervals, junctions, links, primers, templates
from junctura.functions.stages import Stages
from junctura.operators.graph import connected_components
from junctura.sources import design


def test_identical_intervals_both_go(spark):
    df = spark.createDataFrame([(1, 1, 9), (1, 1, 9), (2, 1, 9), (2, 3, 5), (3, 1, 5), (3, 6, 9)], "k int, lo int, hi int")
    assert sorted(map(tuple, intervals.drop_contained(df, "k", "lo", "hi").collect())) == [(2, 1, 9), (3, 1, 5), (3, 6, 9)]


def test_a_key_is_sorted_in_pieces(spark):
    """One key with all rows, a null key and null places: containment, predecessors, coverage and nearest points against plain loops."""
    draw = random.Random(41)
    rows = [(1 if i % 10 else None, a, a + draw.randrange(1, 60), i) for i, a in ((i, draw.randrange(3000)) for i in range(400))] + [(1, 5, 9, 900), (1, 5, 9, 901)]
    df = spark.createDataFrame(rows, "k int, lo int, hi int, row int")
    inside = lambda s, o: s[0] == o[0] and s[3] != o[3] and o[1] <= s[1] and s[2] <= o[2]
    assert sorted(r.row for r in intervals.drop_contained(df, "k", "lo", "hi").collect()) == sorted(s[3] for s in rows if not any(inside(s, o) for o in rows))
    before = {r.row: r.b for r in intervals.previous_before(df, "k", "lo", "hi", "b").collect()}
    assert before == {s[3]: max((o[2] for o in rows if o[0] == s[0] and o[2] <= s[1]), default=None) for s in rows}
    covered = {r.k: r.covered for r in intervals.union_coverage(df, "k", "lo", "hi").collect()}
    assert covered == {k: len({y for s in rows if s[0] == k for y in range(s[1], s[2])}) for k in (1, None)}
    targets = spark.createDataFrame([(1, x) for x in range(0, 3100, 7)], "k int, x int")
    got = {r.x: r.near for r in intervals.nearest_point(targets, df.filter("k = 1"), ["k"], "x", "lo", "near").collect()}
    assert got == {x: min((s[1] for s in rows if s[0] == 1), key=lambda y: (abs(y - x), -y)) for x in range(0, 3100, 7)}
    assert intervals.drop_contained(df.limit(0), "k", "lo", "hi").count() == 0
    assert intervals.union_coverage(spark.createDataFrame([(1, None, None), (1, 2, 4)], "k int, lo int, hi int"), "k", "lo", "hi").first().covered == 2


def test_range_join_finds_each_pair_once(spark):
    draw = random.Random(3)
    rows = [(i, i % 3, a, a + draw.randrange(1, 90)) for i, a in ((i, draw.randrange(500)) for i in range(120))]
    df = spark.createDataFrame(rows, "row int, k int, lo int, hi int")
    got = sorted((r.row_a, r.row_b, r.overlap) for r in intervals.overlap_pairs(df, "k", "lo", "hi", "row", 32).collect())
    want = sorted((a[0], b[0], min(a[3], b[3]) - max(a[2], b[2])) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    assert got == want


def test_merge_similar_is_a_fold(spark):
    draw = random.Random(5)
    rows = [(k, a, a + draw.randrange(1, 60)) for k in range(4) for a in (draw.randrange(100) for _ in range(30))] + [(9, 0, 100), (9, 5, 20), (10, 0, 10), (10, 3, 13)]
    got = sorted(map(tuple, intervals.merge_similar(spark.createDataFrame(rows, "k int, lo int, hi int"), "k", "lo", "hi").collect()))
    want = []
    for k in (0, 1, 2, 3, 9, 10):
        out = []
        for lo, hi in sorted((a, b) for q, a, b in rows if q == k):
            if out and (out[-1][1] - lo) / max(out[-1][1] - out[-1][0], hi - lo) > 0.8:
                out[-1] = (out[-1][0], max(out[-1][1], hi), out[-1][2] + 1)
            else:
                out.append((lo, hi, 1))
        want += [(k, *x) for x in out]
    assert got == sorted(want) and (9, 0, 100, 2) in got and (10, 0, 10, 1) in got
    named = spark.createDataFrame([(1, 0, 100, ["b", "a"]), (1, 5, 20, ["a", "c"]), (1, 90, 200, None)], "k int, lo int, hi int, s array<string>")
    assert [tuple(r) for r in intervals.merge_similar(named, "k", "lo", "hi", samples="s").orderBy("lo").collect()] == [(1, 0, 100, 2, ["a", "b", "c"]), (1, 90, 200, 1, [])]


def test_longest_run(spark):
    n, first, last = intervals.longest_run(F.col("q"), "!")
    got = [tuple(r) for r in spark.createDataFrame([("ab!cde!fgh",), ("!!",), ("abc",), ("",)], "q string").select(n, first, last).collect()]
    assert got == [(3, 4, 6), (0, 0, 0), (3, 1, 3), (0, 0, 0)]


@pytest.mark.parametrize("mode", ["exact", "compat"])
def test_triangle_edges(spark, mode):
    draw = random.Random(9)
    rows = [(i, draw.randrange(-60, 60), draw.randrange(-60, 60), draw.choice([0, 1, 3, 8, 40])) for i in range(150)]
    got = sorted(map(tuple, clusters.triangle_edges(spark.createDataFrame(rows, "node int, a int, b int, d int"), "node", "a", "b", "d", mode).collect()))

    def meets(p, q):
        (a1, b1, d1), (a2, b2, d2) = p[1:], q[1:]
        c1, c2 = a1 + b1 - d1, a2 + b2 - d2
        if mode == "exact":
            return min(a1, a2) + min(b1, b2) >= max(c1, c2)
        rule = lambda b1, d1, c1, b2, d2, c2: c1 < c2 and c2 - c1 <= d1 and b2 - d2 <= b1 <= b2
        return rule(b1, d1, c1, b2, d2, c2) or rule(b2, d2, c2, b1, d1, c1)

    assert got == sorted((p[0], q[0]) for p, q in itertools.combinations(rows, 2) if meets(p, q))


def test_traps_of_linking(spark):
    df = spark.createDataFrame([(1, 10, 10, 5), (2, 11, 11, 7), (3, 500, 500, 3)], "node int, a int, b int, d int")
    assert clusters.triangle_edges(df, "node", "a", "b", "d").count() == 1
    assert clusters.triangle_edges(df, "node", "a", "b", "d", "compat").count() == 0
    assert clusters.triangle_clusters(df, "node", "a", "b", "d").count() == 2
    assert clusters.triangle_clusters(df, "node", "a", "b", "d", keep_isolated=True).count() == 3


def test_components_of_paths(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    edges = [(a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if i % 100 != 99] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    assert got.count() == 300 and got.select("component").distinct().count() == 3


def test_mode_tie_average(spark):
    df = spark.createDataFrame([(1, v) for v in (14, 14, 14, 37, 37, 37, 28)] + [(2, 5)], "c int, v int")
    assert dict(map(tuple, clusters.mode_tie_average(df, "c", "v", "m").collect())) == {1: 25.5, 2: 5.0}


def test_reciprocal_merge(spark):
    df = spark.createDataFrame([(1, 5000, -90, 7), (2, -90, 5000, 3), (3, 40, 70, 1)], "o int, a int, b int, d int")
    got = sorted((r.o, r.a, r.b, r.d) for r in templates.reciprocal_merge(df, "o", "a", "b", "d").collect())
    assert got == [(2, -90, 5000, 3), (3, 40, 70, 1)]


def test_flanks(spark):
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(300))
    df = spark.createDataFrame([(seq,)], "s string")
    short = df.select(templates.flank(F.col("s"), F.lit(-40), 65, True)).first()[0]
    plain = df.select(templates.flank(F.col("s"), F.lit(-100), 65, True)).first()[0]
    assert short == "" and plain == seq[34:100]
    other = df.select(templates.flank(F.col("s"), F.lit(100), 65, True)).first()[0]
    assert other == seq[99:165][::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def test_junction_signs(spark):
    df = spark.createDataFrame([("f", 1, 50, 100, 1, 50), ("f", 2, 200, 150, 60, 90)], "q string, o int, l int, r int, s int, e int")
    assert tuple(junctions.junctions(df, "q", ["o"], "l", "r", "s", "e").first()) == ("f", 0, -100, -200, 9)
    assert junctions.junctions(df, "q", ["o"], "l", "r", "s", "e", max_distance=9).count() == 0


def test_cross_amplification_tail(spark):
    df = spark.createDataFrame([("c", 100, True, 1), ("c", 150, False, 2), ("c", 100, False, 3)], "c string, x int, f boolean, p int")
    assert [tuple(r) for r in primers.cross_amplification(df, "c", "x", "f", "p").collect()] == [(1, 2)]
    assert primers.cross_amplification(df, "c", "x", "f", "p", compat=True).count() == 0


def test_tiling_cost_matches_annealer(spark):
    regions = spark.createDataFrame([(1, 0, 1000, True), (2, 0, 1000, False)], "k int, a int, b int, f boolean")
    points = [(1, 90), (1, 400), (1, 410), (2, 700)]
    got = {r.k: r.cost for r in primers.tiling_cost(spark.createDataFrame(points, "k int, x int"), regions, "k", "x", "a", "b", "f", 100.0, 0.1).collect()}
    import numpy as np

    assert got == {k: anneal.Tiling(100.0, 0.1).of(sorted(x for q, x in points if q == k), (0, 1000, k == 1)) for k in (1, 2)}


def test_cigar(spark):
    df = spark.createDataFrame([("5H10M3H", True), ("10M2I3D", False), ("*", False)], "c string, r boolean").withColumn("o", cigar.parse(F.col("c")))
    first, last = cigar.fragment_interval(F.col("o"), F.col("r"))
    got = [tuple(r) for r in df.select(cigar.fragment_length(F.col("o")), first, last, F.round(cigar.score(F.col("o")), 6)).collect()]
    assert got[0][:3] == (18, 13, 4) and got[1][3] == 6.2 and got[2][0] == 0
    merged = df.select(cigar.told(cigar.concatenated(F.col("o"), cigar.parse(F.lit("2D4M"))))).collect()
    assert [r[0] for r in merged] == ["5H10M3H2D4M", "10M2I5D4M", "2D4M"]


def test_reverse_complement_keeps_lower_case(spark):
    assert spark.range(1).select(sequence.reverse_complement(F.lit("ACgt"))).first()[0] == "tgGT"


def brute_chain(segments):
    """Best score of plain chains without overlap, for segments that don't overlap."""
    best = [0] * len(segments)
    for i, (a, b, ops) in enumerate(segments):
        own = 0
        if i:
            own = int(best[i - 1] + chain.JUMP)
        best[i] = int(own + 0.92 * (b - a + 1))
    return max(best)


def test_chain_without_overlap():
    segments = [(1, 100, [(100, "M")]), (101, 300, [(200, "M")]), (310, 330, [(21, "M")])]
    total, pieces = chain.best_chain(segments)
    assert total == brute_chain(segments)
    assert [p[:3] for p in pieces] == [(0, 1, 100), (1, 101, 300)]


def test_chain_trims_overlap_from_both():
    total, pieces = chain.best_chain([(1, 150, [(150, "M")]), (141, 400, [(260, "M")])])
    assert [p[:3] for p in pieces] == [(0, 1, 140), (1, 151, 400)]
    assert chain.best_chain([]) == (-1, [])


def every_chain(segments):
    """Best score over all paths through the states, by plain search from the start."""
    places = sorted({p for a, b, _ in segments for p in (a, b + 1)})
    gain = lambda j, p, q: sum({"M": 0.92, "I": -0.2}[op] for op in bases(j)[p - segments[j][0] : q - segments[j][0]]) + sum(extra(j, p, q))

    def bases(j):
        return [op for n, op in segments[j][2] if op in "MI" for _ in range(n)]

    def extra(j, p, q):
        at = segments[j][0]
        for n, op in segments[j][2]:
            if op == "I" and min(q, at + n) > max(p, at):
                yield -1.0
            if op == "D" and p < at <= q:
                yield -1.0 - 0.2 * n
            at += n if op in "MI" else 0

    states = {(p, j) for j, (a, b, _) in enumerate(segments) for p in places if a <= p <= b + 1}
    into = {s: [] for s in states}
    for p, j in states:
        if p > segments[j][0]:
            before = places[places.index(p) - 1]
            into[p, j].append(((before, j), gain(j, before, p)))
    for j, (a, b, _) in enumerate(segments):
        ended = [o for o in range(j) if segments[o][1] + 1 <= a]
        if ended:
            into[a, j].append(((segments[ended[-1]][1] + 1, ended[-1]), chain.JUMP))
        for o in range(j):
            end = segments[o][1] + 1
            if end > a:
                last = places[places.index(end) - 1]
                into[end, j].append(((a, o), chain.JUMP + (gain(o, last, end) + gain(j, last, end)) / 2))
    memo = {}

    def best(s):
        if s not in memo:
            memo[s] = int(max([best(t) + w for t, w in into[s]], default=0.0))
        return memo[s]

    return max(best((b + 1, j)) for j, (_, b, _) in enumerate(segments))


def test_chain_against_every_path():
    """Mixed operations, overlaps and gaps: the score is that of the best path."""
    draw = random.Random(21)
    for _ in range(60):
        segments, at = [], 1
        for _ in range(draw.randrange(2, 6)):
            ops = [(draw.randrange(5, 90), "M"), (draw.randrange(1, 6), draw.choice("ID")), (draw.randrange(5, 90), "M")]
            n = sum(k for k, op in ops if op != "D")
            if not segments or (at > segments[-1][0] and at + n - 1 > segments[-1][1]):
                segments.append((at, at + n - 1, ops))
            at = max(segments[-1][0] + 1, segments[-1][1] + draw.randrange(-40, 30))
        total, pieces = chain.best_chain(segments)
        assert total == every_chain(segments)
        assert all(a <= b for _, a, b, _ in pieces) and all(p[2] < q[1] for p, q in zip(pieces, pieces[1:]))


def test_chain_tells_segments_of_both_strands(spark):
    """Reference ends and operations of trimmed pieces, against a walk base by base."""
    draw = random.Random(22)
    rows, want = [], {}
    for k in range(30):
        at = 0
        for j in range(3):
            ops = [(draw.randrange(60, 200), "M"), (draw.randrange(1, 5), draw.choice("ID")), (draw.randrange(60, 200), "M")]
            n, reverse, start = sum(m for m, op in ops if op != "D"), draw.random() < 0.5, draw.randrange(1000, 9000)
            first = max(1, at + draw.randrange(-20, 20))
            raw = [(first - 1 + 3, "H"), *(ops[::-1] if reverse else ops), (7, "S")]
            end = start + sum(m for m, op in ops if op in "MD")
            rows.append((k, 10 * k + j, first, first + n - 1, raw, start, end, reverse))
            at = first + n - 1
    df = spark.createDataFrame(rows, "q int, row int, a int, b int, ops array<struct<n:int,op:string>>, f int, t int, r boolean")
    got = chain.chain_segments(df, "q", "row", "a", "b", "ops", "f", "t", "r").collect()
    by_row = {r[1]: r for r in rows}
    alone = {k for k in {r.q for r in got} if sum(x.q == k for x in got) == 1}
    assert got and len({r.q for r in got}) == 30
    for r in got:
        _, _, first, last, raw, start, end, reverse = by_row[r.row]
        inner = raw[1:-1][::-1] if reverse else raw[1:-1]
        at, place, walked = first, end if reverse else start, []
        for n, op in inner:
            for _ in range(n):
                walked.append((at, op, place))
                place += (-1 if reverse else 1) * (op in "MD")
                at += op in "MI"
        own = [w for w in walked if (r.a <= w[0] <= r.b if w[1] != "D" else r.a < w[0] <= r.b + 1)]
        if r.q in alone and (r.a, r.b) == (first, last):
            continue
        assert r.ref_start == own[0][2] and r.ref_end == own[-1][2] + (-1 if reverse else 1) * (own[-1][1] in "MD")
        told = "".join(f"{len(list(g))}{op}" for op, g in itertools.groupby(w[1] for w in own))
        assert r.align_str == told
        assert abs(sum(0.92 * n if op == "M" else -1 - 0.2 * n for op, n in ((op, len(list(g))) for op, g in itertools.groupby(w[1] for w in own))) - r.score) < 1e-6 or "I" in told


def test_anneal_is_seeded_and_compatible(spark):
    draw = random.Random(8)
    df = spark.createDataFrame([(k, draw.randrange(2000)) for k in range(3) for _ in range(40)], "k int, x int")
    run = lambda: sorted(map(tuple, anneal.anneal_designs(df, "k", "x", 0.0, 2000.0, True, 200.0, 0.1, 20.0, [(-0.5, 50.0, 4)], 300).collect()))
    one = run()
    assert one == run()
    for row in one:
        assert row[5] <= row[4]
        assert all(abs(a - b) >= 20 for a, b in itertools.combinations(row[6], 2))


def test_anneal_runs_the_whole_schedule_over_graph_and_regions(spark):
    import numpy as np

    draw = random.Random(9)
    rows = [(k, 100 * k + i, i % 2 == 0, draw.randrange(2000)) for k in range(2) for i in range(40)]
    bad = [(100 * k + a, 100 * k + b) for k in range(2) for a in range(40) for b in range(a, 40) if draw.random() < 0.1]
    regions = spark.createDataFrame([(k, f, 0, 2000, f) for k in range(2) for f in (True, False)], "k int, r boolean, a int, b int, f boolean")
    primers_, edges = spark.createDataFrame(rows, "k int, p int, r boolean, x int"), spark.createDataFrame(bad, "s int, t int")
    run = lambda **more: anneal.anneal_graphs(primers_, regions, edges, "k", "p", "r", "x", "a", "b", "f", "s", "t", 200.0, 0.1, [(-0.5, 100.0, 1), (-2.0, 400.0, 2)], **more).collect()
    assert sorted((r.k, r.slope, r.steps) for r in run(floor=1)) == [(0, -2.0, 1000), (0, -0.5, 400), (1, -2.0, 1000), (1, -0.5, 400)]
    found, again = run(floor=100_000, patience=2000), run(floor=100_000, patience=2000)
    assert sorted(map(str, found)) == sorted(map(str, again)) and {r.steps for r in found} == {100_000}
    at, forbidden = {p: (r, x) for _, p, r, x in rows}, set(bad)
    for r in found:
        assert not [(a, b) for a in r.chosen for b in r.chosen if (a, b) in forbidden]
        cost = sum(anneal.Tiling(200.0, 0.1).of(sorted(at[p][1] for p in r.chosen if at[p][0] == f), (0, 2000, f)) for f in (True, False))
        assert r.cost == cost <= r.first_cost


def test_anneal_query_has_the_reference_budget(spark, monkeypatch):
    from junctura.plans import queries

    asked = []
    monkeypatch.setattr(anneal, "anneal_graphs", lambda *a, **k: asked.append((a, k)) or spark.range(1).withColumnRenamed("id", "chosen"))
    queries.q36(spark, "/root/testdata/sf0.001")
    assert asked and not {"cap", "floor", "patience"} & set(asked[0][1])  # no floor, cap or patience below the reference's
    assert (anneal.FLOOR, anneal.CAP) == (1_000_000, 100_000_000) and anneal.iterations(anneal.CAP, -0.5, 100.0) == 1_000_000


def test_designs_that_stay_where_they_are(spark):
    """Many designs: an edge goes once, whatever designs its ends are in, and a design once, whatever the grid has; the same runs."""
    draw = random.Random(4)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = sorted({(k, p) for k in range(12) for p in draw.sample(range(40), 25)})
    primers_ = spark.createDataFrame([(k, p, (k + p) % 2 == 0, draw.randrange(2000)) for k, p in held], "k int, p int, r boolean, x int")
    regions = spark.createDataFrame([(k, f, 0.0, 2000.0, f) for k in range(12) for f in (True, False)], "k int, r boolean, a double, b double, f boolean")
    bad = [(draw.randrange(45), draw.randrange(45)) for _ in range(60)] + [(3, 3), (7, 9), (9, 7)]
    edges = spark.createDataFrame([*bad, (None, 5), (6, None), (None, None)], "s int, t int")
    of = lambda p, r, **more: anneal.anneal_graphs(p, r, edges, "k", "p", "r", "x", "a", "b", "f", "s", "t", 200.0, 0.1, [(-0.5, 100.0, 1), (-2.0, 400.0, 2)], cap=2000, floor=2000, **more)
    dealt = of(primers_.repartition(n, "k"), regions.repartition(n, "k"), dealt=True, members=primers_.select("k", "p").union(primers_.select("k", "p")))
    spread = of(primers_, regions)
    told = sorted(map(tuple, dealt.collect()))
    assert told == sorted(map(tuple, spread.collect())) and len(told) == 24
    assert not [1 for r in told for a, b in bad if {a, b} <= set(r[-1])]
    assert {5, 6} & {p for r in told for p in r[-1]}  # an edge without an end binds nobody
    ends = [sorted(map(tuple, of(p, r, cost=anneal.MultiTarget(), **more).collect())) for p, r, more in ((primers_, regions, {}), (primers_.repartition(n, "k"), regions.repartition(n, "k"), {"dealt": True}))]
    assert ends[0] == ends[1] and len(ends[0]) == 24 and ends[0] != told
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "MapInPandas" in plan
    # the same pairs by a join over designs; a pair too many has its second end in the design
    links = {(min(e), max(e)) for e in bad}
    for whole, marks in ((1000, 1 << 16), (0, 1 << 16), (1000, 8)):
        before = anneal._SENT_WHOLE, anneal._MARKS
        anneal._SENT_WHOLE, anneal._MARKS = whole, marks
        got = [tuple(r) for r in anneal._pairs_within(primers_.select("k", F.col("p").alias("__p")), "k", edges, "s", "t").collect()]
        anneal._SENT_WHOLE, anneal._MARKS = before
        want = {(k, p, q) for k in range(12) for p, q in links if {(k, p), (k, q)} <= set(held)}
        assert len(got) == len(set(got)) and want <= set(got) and all((k, q) in held and (p, q) in links for k, p, q in set(got) - want)
        assert marks == 8 or set(got) == want


def test_components_over_all_links(spark, tmp_path):
    from junctura.plans import queries

    lines = [(1, 7, 1.0, 0.0), (1, 8, 50.0, 0.1), (2, 8, 3.0, 0.02), (3, 9, 4.0, 0.1), (4, 10, 50.0, 0.1), (5, 10, 2.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.node: r.component for r in queries.q44_all(spark, str(tmp_path)).collect()}
    far = 1_000_000_000
    assert got == {1: 1, 2: 1, far + 7: 1, far + 8: 1, 3: 3, far + 9: 3, 4: 4, 5: 4, far + 10: 4}


def test_merge_similar_holds_no_array_of_a_key(spark):
    df = spark.range(60_000).selectExpr("1 as k", "20 * (id div 2) + id % 2 as lo", "20 * (id div 2) + 15 as hi")
    merged = intervals.merge_similar(df, "k", "lo", "hi")
    assert "collect_list" not in merged._jdf.queryExecution().toString()
    assert merged.filter("members = 2 and hi - lo = 15").count() == 30_000


def test_search_labels(spark):
    def walk(n, depth=1, path=""):
        if n == 1:
            return [(depth, path)]
        m = (n - 1) // 2
        return walk(m, depth + 1, path + "L") + [(depth, path)] + walk(m, depth + 1, path + "R")

    depth, path = primers.search_labels(F.col("id"), 4)
    assert [tuple(r) for r in spark.range(1, 16).select(depth, path).orderBy("id").collect()] == walk(15)


def test_links_and_products(spark):
    regions = spark.createDataFrame([(0, "c", 100, 50, True), (1, "c", 200, 60, False), (2, "c", 400, 70, True)], "region int, contig string, start long, length long, forward boolean")
    rows = [(1, 0, "c", 110, True, 1, "a"), (1, 0, "c", 120, True, 2, "b"), (1, 1, "c", 230, False, 3, "c"), (2, 0, "c", 130, True, 1, "d"), (2, 1, "c", 240, False, 2, "e"), (2, 1, "c", 210, False, 3, "f"), (2, 2, "c", 405, True, 4, "g"), (3, 0, "x", 130, True, 1, "h"), (3, 1, "c", 210, False, 2, "i"), (3, 2, "c", 405, True, 3, "j")]
    primers_ = spark.createDataFrame(rows, "sln int, region int, contig string, position long, forward boolean, seq int, name string")
    checked = links.verified_solutions(primers_, regions, "sln", "seq")
    assert {(r.sln, r.region): (r.position, r.valid, r.complete) for r in checked.collect()} == {
        (1, 0): (120, True, False), (1, 1): (230, True, False), (2, 0): (130, True, True), (2, 1): (210, True, True), (2, 2): (405, True, True), (3, 0): (130, False, False), (3, 1): (210, True, False), (3, 2): (405, True, False)
    }
    first = links.first_complete(checked, "sln")
    assert {r.sln for r in first.collect()} == {2}
    pairs = spark.createDataFrame([(0, 1, "snp_inner"), (0, 2, "snp_outer"), (1, 2, "del")], "region_i int, region_j int, name string")
    products = links.link_products(first, regions, pairs, 5)
    assert {r.name: r["product"] for r in products.collect()} == {"snp_inner": 20 + 15, "snp_outer": 20 + 65, "del": 15 + 65}
    phased = links.phased_products(products, regions)
    assert {r.name: (r["product"], r.snp_distance) for r in phased.collect()} == {"snp_inner": (85, 50), "snp_outer": (135, 50), "del": (80, 50)}
    none = links.phased_products(products.filter("name = 'del'"), regions)
    assert [(r["product"], r.snp_distance) for r in none.collect()] == [(80, None)]


def test_solution_reports(spark):
    regions = spark.createDataFrame([(0, "c", 1000, 50, True, 0), (1, "c", 3000, 60, False, 50)], "region int, contig string, start long, length long, forward boolean, offset long")
    candidates = spark.createDataFrame([(7, "AC", 0.25), (70, "GT", 1.0)], "pos long, sequence string, penalty double")
    rows = spark.createDataFrame([(0, 12, 0, 7), (0, 12, 1, 70)], "rank int, cost long, region int, position long")
    chosen = links.solution_primers(rows, candidates, regions)
    assert sorted((r.region, r["at"], r.sequence) for r in chosen.collect()) == [(0, 1007, "AC"), (1, 3020, "GT")]
    solutions = spark.createDataFrame([(0, 12, 1.5, "m,b,0")], "rank int, cost long, seconds double, params string")
    assert links.solution_text(chosen, solutions).first().value == "12\t1.5\tm,b,0\nc\t1007\tTrue\tAC\t0.2500\nc\t3020\tFalse\tGT\t1.0000\n="
    assert sorted(r.value for r in links.solution_fasta(chosen).collect()) == [">sln-00-00_c_1007_True\t0.2500\nAC", ">sln-00-01_c_3020_False\t1.0000\nGT"]
    designs = spark.createDataFrame([(3, [7], [104070, 1])], "sln int, left array<long>, right array<long>")
    got = links.printed_designs(designs, candidates, candidates, "sln")
    assert sorted((r.side, r.pos) for r in got.collect()) == [("LEFT", 7), ("RIGHT", 70)]
    assert sorted(r.value for r in links.designer_check_lines(got).collect()) == ["SEQUENCE_PRIMER=AC", "SEQUENCE_PRIMER_REVCOMP=GT"]
    assert [tuple(r) for r in links.penalty_sums(got, "sln", "penalty").collect()] == [(3, 2, 1.25)]
    lines = links.well_lines(spark.createDataFrame([("inner", ">sln-00-01_c_7_True", "AC"), ("no", "x", "y")], "label string, name string, sequence string"), ["outer", "inner"], "A", "set")
    assert [r.value for r in lines.collect()] == ["A2\t00-01_c_7_Tr\tAC\tset"]


def test_marked_products(spark):
    seq = "TTACGGTTTTGCATTT"
    rows = [("ACG", 2, 0, 10, True), ("TGC", 10, 4, 16, False), ("CCC", 2, 0, 10, True)]
    df = spark.createDataFrame(rows, "p string, x int, a int, b int, f boolean").withColumn("s", F.lit(seq))
    got = [r[0] for r in df.select(links.marked_product(*[F.col(c) for c in "spxabf"])).collect()]
    assert got == [">ACG>GTTTT", "GGTTTT<GCA<", None]
    verdict = links.primer_validity(F.col("x"), F.length("p"), F.col("a"), F.col("b"), F.col("f"))
    assert [tuple(r) for r in df.select(*verdict).collect()] == [("valid", 8, 5), ("valid", 6, 9), ("valid", 8, 5)]
    late = spark.createDataFrame([("ACG", 20, 0, 10, True), ("ACG", 2, 5, 10, False)], "p string, x int, a int, b int, f boolean")
    assert [r[0] for r in late.select(*verdict).collect()] == ["forward past exon", "reverse before exon"]


def test_deletion_report(spark):
    draw = random.Random(31)
    points = [(s, draw.randrange(900), draw.random() < 0.5) for s in "abcd" for _ in range(6)] + [("e", 5, True)]
    found = [(draw.randrange(900), draw.random() < 0.5) for _ in range(25)]
    got = deletions.primer_distances(spark.createDataFrame(points, "s string, x int, f boolean"), spark.createDataFrame(found, "p int, f boolean"), [], "x", "p", "f", 40)
    rows = got.collect()
    near = lambda x, f: min([y for y in ((x - p if f else p - x) for p, g in found if g == f) if 0 < y < 80], default=80)
    assert sorted(map(tuple, rows)) == sorted((s, x, f, near(x, f), near(x, f) < 40) for s, x, f in points)
    for r in deletions.sample_report(got, "s", "f").collect():
        own = [(f, near(x, f)) for s, x, f in points if s == r.s]
        sides = [[v for f, v in own if f == side] for side in (True, False)]
        assert (r.covered, r.total) == (sum(v < 40 for _, v in own), len(own))
        assert (r.least, r.greatest) == ((min(sides[0]) + min(sides[1]), max(sides[0]) + max(sides[1])) if all(sides) else (0, 0))
    for r in deletions.strand_coverage(spark.createDataFrame(found, "p int, f boolean"), [], "p", "f", 40).collect():
        own = [p if r.f else p - 40 for p, f in found if f == r.f]
        assert r.covered == len({y for p in own for y in range(p, p + 40)}) and r.total == max(own) - min(own) + 41 and r.uncovered == r.total - r.covered


def test_costs_and_edges(spark):
    scores = spark.createDataFrame([(1, 2, 0, -4.0, 0.0, 0.0), (2, 1, 1, 0.0, 0.0, 0.0), (3, 4, 0, 0.0, 0.0, -8.5), (5, 5, 0, 0.0, -9.0, 0.0)], "p1 int, p2 int, seq int, s1 double, s2 double, s3 double")
    assert sorted(map(tuple, primers.edges_from_scores(scores).collect())) == [(3, 4), (5, 5)]
    counts = primers.primers_per_region(spark.createDataFrame([(1,), (1,)], "r int"), spark.createDataFrame([(1,), (2,)], "r int"), "r")
    assert sorted(map(tuple, counts.collect())) == [(1, 2), (2, 0)]
    with pytest.raises(Exception, match="no primers to choose from in region 2"):
        primers.require_primers(counts, "r").collect()
    nodes, edges = spark.createDataFrame([(1,), (2,)], "p int"), spark.createDataFrame([(1, 3), (2, 2)], "a int, b int")
    assert not primers.is_independent(nodes, "p", edges, "a", "b") and primers.is_independent(nodes.filter("p = 1"), "p", edges, "a", "b")
    assert [r[0] for r in spark.range(3).select(anneal.temperature(F.col("id"), -2.0, 4.0)).collect()] == [4.0, 2.0, 1.0]
    assert anneal.iterations(anneal.CAP, -0.001, 10**6) == anneal.CAP and anneal.iterations(anneal.CAP, -1.0, 10**6) == 3 * 10**6


def test_cigar_details(spark):
    df = cigar.with_ops(spark.createDataFrame([("2H3M2I2M4D1M3S", 100, False), ("2H3M2I2M4D1M3S", 100, True), ("*", 1, False), ("2M3D", 5, False)], "c string, at long, r boolean"), F.col("c"), "o")
    assert [len(r.e) for r in df.select(cigar.expanded(F.col("o")).alias("e")).collect()] == [8, 8, 0, 2]
    e = df.select(cigar.expanded(F.col("o")).alias("e")).collect()
    assert "".join(x.base for x in e[0].e) == "MMM--MMM" and [x.deleted for x in e[0].e] == [0, 0, 0, 0, 0, 0, 4, 0] and [x["op"] for x in e[0].e] == [1, 1, 1, 2, 2, 3, 3, 5]
    assert [x.deleted for x in e[3].e] == [0, 0]
    ops = cigar.in_fragment_order(F.col("o"), F.col("r"))
    at = [r[0] for r in df.select(cigar.reference_at(ops, F.lit(7).cast("long"), F.col("at"), F.col("r"))).collect()]
    assert at[:2] == [100 + 5 + 4, 100 - (1 + 4 + 2 + 2)]
    assert [r[0] for r in df.limit(1).select(F.round(cigar.score_with(F.col("o")) - cigar.score(F.col("o")), 9)).collect()] == [0.0]
    assert df.limit(1).select(cigar.score_with(F.col("o"), cigar.SCORES | {"M": lambda n: n * 0.0})).first()[0] == -1.4 - 1.8


def test_region_and_name_functions(spark):
    row = spark.range(1).select(*sequence.parse_region(F.lit("chr9:218-221")), sequence.segment(F.lit("ACGTT"), F.lit(2), F.lit(4)), sequence.fusion(F.lit("ACGTTGCA"), F.lit(1), F.lit(2), F.lit(6), F.lit(8))).first()
    assert tuple(row) == ("chr9", 218, 221, "CGT", "ACGCA")
    corner = spark.range(1).select(clusters.vertices(F.lit(10), F.lit(20), F.lit(3)).alias("v"), clusters.intersection(*[F.lit(x) for x in (10, 20, 6, 8, 19, 5)]).alias("i"), clusters.intersection(*[F.lit(x) for x in (10, 20, 1, 80, 19, 1)]).alias("n")).first()
    assert [tuple(v) for v in corner.v] == [(10, 20), (7, 20), (10, 17)] and tuple(corner.i) == (8, 19, 3) and corner.n is None
    exons = spark.createDataFrame([(52, [10, 50, 90], [20, 55, 99])], "x int, s array<int>, e array<int>")
    assert tuple(intervals.nearest_exon(exons, "x", "s", "e").first())[3:] == (1, 1)
    assert tuple(spark.range(1).select(primers.ends_apart(*[F.lit(v) for v in (0, 10, 25, 40)])).first()) == (15,)
    assert [r[0] for r in spark.range(1).select(primers.incompatible(F.lit(-3.3), F.lit(0.0), F.lit(0.0)))
            .union(spark.range(1).select(primers.incompatible(F.lit(-3.2), F.lit(-8.0), F.lit(-8.0)))).collect()] == [True, False]
    both = clusters.members(spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "a int, row int"), "a", row="row")
    assert sorted((r.a, r.n, r.members) for r in both.collect()) == [(1, 2, [3, 5]), (2, 1, [4])]
    bound = spark.range(1).select(thermo.report(F.lit("ACGT"), F.lit(1e-6)).alias("r")).first().r
    assert abs(bound.gibbs - (1.96 - 1.44 - 2.17 - 1.44 + 2 * 0.05)) < 1e-9 and abs(bound.bound - 1e-6 / (1e-6 + bound.dissociation)) < 1e-12


def test_chained_templates(spark):
    seq = "".join(random.Random(5).choice("ACGT") for _ in range(400))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    df = spark.createDataFrame([("x_1", -100, 200, 0), ("x_2", -260, -300, 1)], "name string, a int, b int, d int").withColumn("s", F.lit(seq))
    got = templates.chained_templates(df, "name", "a", "b", "d", "s", 30, 2).collect()
    wrong = df.withColumn("a", F.abs("a"))
    with pytest.raises(Exception, match="contradict"):
        templates.chained_templates(wrong, "name", "a", "b", "d", "s", 30, 2).collect()
    assert [(r.name, r.template) for r in got] == [("x", seq[69:100] + "NN" + seq[199:260] + "NNN" + turn(seq[269:300]))]


def test_analyze_end_to_end(spark):
    """Reads over three breakpoints, some with bases that both sides align: clusters, modes and templates come out."""
    from junctura.plans import analyze

    draw = random.Random(17)
    seq = "".join(draw.choice("ACGT") for _ in range(60_000))
    rows = []
    breaks = {"p": (10_000, 30_000), "q": (45_000, 20_000), "r": (5_000, 55_000)}
    for name, (left, right) in breaks.items():
        for k in range(40):
            n, m, both = draw.randrange(800, 1500), draw.randrange(800, 1500), draw.choice([0, 0, 0, 3, 5])
            rows.append((f"{name}{k}", 0, "c", left - n, 60, f"{n}M{m - both}H", "*", 0, n, "*", "*"))
            rows.append((f"{name}{k}", 0, "c", right - both, 60, f"{n - both}H{m}M", "*", 0, m, "*", "*"))
    rows.append(("alone", 0, "c", 1, 60, "500M", "*", 0, 500, "*", "*"))
    sam = spark.createDataFrame(rows, "qname string, flags int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string")
    contigs = spark.createDataFrame([("c", seq), ("d", "ACGT")], "name string, seq string")
    segments, modes, made = analyze.analyze(sam, contigs, "c", k=1000, offset=0)
    assert segments.count() == 241 and analyze.score_of(segments.filter("qname <> 'alone'")).filter("abs(again - ascore) > 1e-6").count() == 0
    assert sorted((r.left, r.right, r.d) for r in modes.collect()) == sorted((-a, b, 0.0) for a, b in breaks.values())
    got = {r.header: r.template.replace("\n", "") for r in made.collect()}
    assert set(got) == {f">name,{-a},{b},0" for a, b in breaks.values()}
    assert got[">name,-10000,30000,0"] == seq[8999:10_000] + seq[29_999:31_000]


def test_design_end_to_end(spark):
    from junctura.plans import designs

    draw = random.Random(18)
    at = sorted(draw.sample(range(4000), 60))
    candidates = spark.createDataFrame([(x, "ACGT", round(draw.random() * 1.3, 3)) for x in at] + [(9000, "A", 0.1)], "pos long, sequence string, penalty double")
    regions = spark.createDataFrame([(0, "c", 5000, 2000, True, 0), (1, "c", 9000, 2000, False, 2000)], "region int, contig string, start long, length long, forward boolean, offset long")
    joined = regions.select("region", F.col("offset").alias("start"), "length", "forward")
    scores = spark.createDataFrame([(a, b, -4.0, 0.0, 0.0) for a, b in zip(at, at[1:])], "p1 long, p2 long, s1 double, s2 double, s3 double")
    hits = spark.createDataFrame([("x", 50, True, at[0]), ("x", 90, False, at[5])], "contig string, pos long, forward boolean, primer long")
    edges = designs.incompatible_pairs(scores, hits)
    assert {tuple(r) for r in edges.collect()} == {*zip(at, at[1:]), (at[0], at[5])}
    psl = spark.createDataFrame([(f"{'LEFT' if x < 2000 else 'RIGHT'}:{x}", "c", x, x + 20, "+" if x < 2000 else "-", 20, 0, 20) for x in at], "qseqid string, sseqid string, sstart long, send long, strand string, qlen long, qstart long, qend long")
    able = designs.usable_candidates(candidates, psl)
    assert {r.pos for r in able.collect()} == {r.pos for r in candidates.collect() if r.penalty <= 1.2 and r.pos < 4000}
    sets = designs.designed_sets(able, joined, edges, 300.0, 0.1, [(-1.0, 100.0, 1), (-1.0, 100.0, 2)], floor=5000)
    best = designs.best_sets(sets, able, regions, 1).collect()
    rows = sets.collect()
    assert len(rows) == 2 and all(len(r.primers) == 2 for r in rows)
    assert {r.position for r in best} == {p for q in min(rows, key=lambda r: (r.cost, r.params)).primers for p in q}
    assert all(r["at"] == r.position + (5000 if r.region == 0 else 7000) for r in best)
    bad = {*zip(at, at[1:]), (at[0], at[5])}
    assert not [1 for r in rows for p in sum(r.primers, []) for q in sum(r.primers, []) if (p, q) in bad]


@pytest.mark.parametrize("roomy", [0, 16, 10**9])
@pytest.mark.parametrize("mode", ["exact", "compat"])
def test_links_in_large_cells(spark, monkeypatch, roomy, mode):
    """Links by cells of the triangles' size, by large ones and by both are those of all pairs, each once; a triangle of its own size is sent to few large cells."""
    monkeypatch.setattr(clusters, "ROOMY", roomy)
    draw = random.Random(8)
    rows = {(draw.randrange(-300, 300), draw.randrange(-300, 300), draw.choice([0, 1, 2, 3, 7, 8, 40, 120])) for _ in range(500)}
    rows |= {(0, 0, 1), (0, 0, 2), (-64, 64, 8), (-64, 56, 8), (-56, 64, 8)}
    df = spark.createDataFrame(sorted(rows), "a long, b long, d long")

    def one_way(p, q):
        c, e = p[0] + p[1] - p[2], q[0] + q[1] - q[2]
        return c < e and e - c <= p[2] and q[1] - q[2] <= p[1] <= q[1]

    def meets(p, q):
        return one_way(p, q) or one_way(q, p) if mode == "compat" else min(p[0], q[0]) + min(p[1], q[1]) >= max(p[0] + p[1] - p[2], q[0] + q[1] - q[2])

    got = sorted((tuple(r.src), tuple(r.dst)) for r in clusters.triangle_edges(df, None, "a", "b", "d", mode).collect())
    assert got == [(p, q) for p, q in itertools.combinations(sorted(rows), 2) if meets(p, q)]
    t = df.withColumn("tier", clusters._steps("d"))
    picked = clusters._roomy_tier(t, [0, 1, 2, 3, 6, 7])
    assert picked == {0: None, 10**9: 7}.get(roomy, picked)
    sparse = spark.range(2000).select((F.col("id") * 37).alias("a"), (F.col("id") * 11 % 2500).alias("b"), (F.col("id") % 7 + 1).alias("d"))
    monkeypatch.setattr(clusters, "ROOMY", 16)
    sent = []
    monkeypatch.setattr(clusters, "_roomy_edges", lambda t, k, meets: sent.append(k) or t)
    clusters.triangle_edges(sparse, None, "a", "b", "d", mode)
    assert sent == [3]


@pytest.mark.parametrize("sparse", [64, 0, 10**9])
def test_clusters_without_all_links(spark, monkeypatch, sparse):
    """Both ways, as counted and each by itself: stars and contested cells give the components of all links, over sides of all sizes; links stay in proportion to the triangles."""
    monkeypatch.setattr(clusters, "SPARSE", sparse)
    draw = random.Random(6)
    rows = {}
    for k in range(900):
        d = draw.choice([0, 1, 2, 5, 8, 9, 16, 17, 40, 100, 300])
        rows[k] = (draw.randrange(-400, 3000), draw.randrange(-400, 3000), d)
    rows |= {900 + k: (5000 + k // 4, 5000, 30) for k in range(300)}
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "k long, a long, b long, d long")
    parent = {k: k for k in rows}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    linked = set()
    for p, q in itertools.combinations(rows, 2):
        (a1, b1, d1), (a2, b2, d2) = rows[p], rows[q]
        if min(a1, a2) + min(b1, b2) >= max(a1 + b1 - d1, a2 + b2 - d2):
            parent[max(top(p), top(q))] = min(top(p), top(q))
            linked |= {p, q}
    want = {k: top(k) for k in linked}
    assert 1 < len(set(want.values())) < len(want) < len(rows)
    got = {r.node: r.component for r in clusters.triangle_clusters(df, "k", "a", "b", "d").collect()}
    assert got == want
    named = df.withColumn("k", F.struct((-F.col("k")).alias("v")))
    for r in clusters.triangle_clusters(named, "k", "a", "b", "d").collect():
        assert want[-r.node.v] == want[-r.component.v]
    assert clusters.triangle_clusters(df, "k", "a", "b", "d", keep_isolated=True).count() == len(rows)
    if sparse > 64:
        return
    dense = spark.range(100_000).select(F.col("id").alias("node"), F.col("id").alias("a"), F.lit(7).cast("long").alias("b"), F.lit(1000).cast("long").alias("d"), F.lit(10).alias("tier"))
    assert clusters.triangle_stars(dense, [10]).count() < 20 * 100_000
    assert clusters.triangle_clusters(dense, "node", "a", "b", "d").agg(F.countDistinct("component").alias("c"), F.count("*").alias("n")).first() == (1, 100_000)


def full_tiling(points, region, d, rho):
    """The cost of a region by its definition."""
    gaps = np.diff(np.array([region[0], *sorted(points), region[1]], float)) - d
    gaps[0 if region[2] else -1] += d
    return float(gaps[gaps > 0].sum() + np.maximum(0, -gaps[gaps <= 0] - d * rho).sum())


def test_costs_change_where_a_move_touches():
    """Every move's change, of both costs, is that of full costs; and whole runs are those of a cost without shortcuts."""
    draw = random.Random(14)
    regions = [(0.0, 1000.0, True), (500.0, 2500.0, False), (0.0, 300.0, True)]
    spots = sorted((draw.randrange(3), float(draw.randrange(0, 300))) for _ in range(60))
    near = {}
    for _ in range(80):
        u, v = draw.sample(range(60), 2)
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)

    class Plain(anneal.Cost):
        def of(self, points, region):
            return full_tiling(points, region, 70.0, 0.1)

    for cost in (anneal.Tiling(70.0, 0.1), anneal.MultiTarget(), Plain()):
        held = anneal._Set(spots, regions, near, 9.0, cost)
        held.become(())
        for _ in range(1500):
            u = draw.randrange(60)
            told = held.gain(u)
            before = held.whole()
            gone = held.driven_out(u)
            held.move(u)
            assert held.cost == pytest.approx(held.whole()) and told == pytest.approx(held.whole() - before)
            chosen = held.chosen()
            assert list(chosen) == sorted(chosen) and not set(gone) & set(chosen)
            assert not any(v in near.get(w, ()) or spots[w][0] == spots[v][0] and 0 < abs(spots[w][1] - spots[v][1]) < 9 for w in chosen for v in chosen)
        if not isinstance(cost, anneal.MultiTarget):
            assert held.whole() == pytest.approx(sum(full_tiling(p, r, 70.0, 0.1) for p, r in zip(held.points, regions)))
    for settled in (64, 10**9):
        anneal.SETTLED, before = settled, anneal.SETTLED
        runs = [anneal.anneal(spots, regions, near, 9.0, c, -0.5, 200.0, 20_000, 5, patience=3000) for c in (anneal.Tiling(70.0, 0.1), Plain())]
        anneal.SETTLED = before
        assert runs[0] == runs[1] and runs[0][1] < runs[0][0]
        same = runs[0] if settled == 64 else same
        assert same == runs[0]


def test_cold_runs_are_those_of_single_moves(monkeypatch):
    """Whole runs are those of a loop over single moves; runs of one seed share draws, and a set that no move can leave draws no more."""
    made = np.random.default_rng
    asked = []

    class Counted:
        def __init__(self, seed):
            self._of = made(seed)

        def integers(self, *a, **k):
            asked.append(k.get("size"))
            return self._of.integers(*a, **k)

        def __getattr__(self, name):
            return getattr(self._of, name)

    draw = random.Random(5)
    spots = sorted((draw.randrange(2), float(draw.randrange(2000))) for _ in range(200))
    regions = [(0.0, 2001.0, False), (0.0, 2001.0, True)]
    near = {1: {150}, 150: {1}}
    steps = 3 * (1 << 16) + 100
    for cost in (anneal.MultiTarget(), anneal.Tiling(300.0, 0.1)):
        told = anneal.anneal(spots, regions, near, 0.0, cost, -2.0, 400.0, steps, 3, patience=5000)
        one = made(3)
        within = [[u for u in range(200) if spots[u][0] == r] for r in (0, 1)]
        while True:
            first = [w[int(one.integers(len(w)))] for w in within]
            if first[1] not in near.get(first[0], ()):
                break
        held = anneal._Set(spots, regions, near, 0.0, cost)
        held.become(tuple(first))
        best, age = (held.cost, held.chosen()), 0
        for begin in range(0, steps, 1 << 16):
            n = min(1 << 16, steps - begin)
            for i, u, chance in zip(range(begin, begin + n), one.integers(200, size=n).tolist(), one.random(n).tolist()):
                worse, age = held.gain(u), age + 1
                if worse <= 0 or chance < math.exp(-worse / max(-2.0 * i + 400.0, 1.0)):
                    held.move(u)
                    if held.cost < best[0]:
                        best, age = (held.cost, held.chosen()), 0
                if age > 5000:
                    held.become(best[1])
                    age = 0
        assert told[1:] == (best[0], list(best[1]))
    monkeypatch.setattr(np.random, "default_rng", Counted)
    far = [(0, float(x)) for x in range(0, 2000, 400)]
    for k in (1, 2):
        asked.clear()
        anneal.anneal(far, [(0.0, 2000.0, True)], {}, 0.0, anneal.Tiling(100.0, 0.1), -2.0, 400.0, 10 * (1 << 16), 4)
        assert len([n for n in asked if n]) == 2 - k


def test_traces_of_runs(spark, tmp_path):
    """Results and traces in one stream; what is written is read again."""
    draw = random.Random(3)
    rows = [(k, p, p % 2 == 0, draw.randrange(2000)) for k in (1, 2) for p in range(40)]
    primers_ = spark.createDataFrame(rows, "k int, p int, r boolean, x int")
    regions = spark.createDataFrame([(k, f, 0.0, 2000.0, f) for k in (1, 2) for f in (True, False)], "k int, r boolean, a double, b double, f boolean")
    edges = spark.createDataFrame([(1, 3), (2, 7)], "s int, t int")
    of = lambda **more: anneal.anneal_graphs(primers_, regions, edges, "k", "p", "r", "x", "a", "b", "f", "s", "t", 200.0, 0.1, [(-0.5, 100.0, 1)], cap=3000, floor=3000, **more)
    both = of(every=500).cache()
    results, traces = anneal.results_of(both), anneal.traces_of(both, "k")
    assert sorted(map(tuple, results.collect())) == sorted(map(tuple, of().collect()))
    told = sorted(map(tuple, traces.select("k", "iteration").collect()))
    assert told == [(k, i) for k in (1, 2) for i in range(500, 3001, 500)]
    least = {r.k: r.cost for r in results.collect()}
    assert {r.k: r.min_cost for r in traces.filter("iteration = 3000").collect()} == least
    assert traces.filter("curr_cost < min_cost").count() == 0
    design.write_trace(traces.filter("k = 1"), str(tmp_path / "trace"))
    back = design.read_trace(spark, str(tmp_path / "trace"))
    want = traces.filter("k = 1").select("iteration", "seconds", "min_cost", "curr_cost")
    assert sorted(map(tuple, back.select("iteration", "seconds", "min_cost", "curr_cost").collect())) == sorted(map(tuple, want.collect()))
    assert {(r.m, r.b, r.run) for r in back.collect()} == {("-0.5", "100.0", "1")}
    targets = of(cost=anneal.MultiTarget()).collect()
    assert all(0 <= r.cost <= r.first_cost for r in targets)


def test_run_index_against_operations(spark):
    """Lookups in the run index are what the functions over arrays of operations say, for odd CIGARs and both strands."""
    draw = random.Random(9)
    made = ["".join(f"{draw.randrange(1, 12)}{draw.choice('MMMIDDN' if 0 < k < m - 1 else 'SHM')}" for k in range(m)) for m in (draw.randrange(1, 9) for _ in range(300))]
    texts = [None, "*", "", "5M", "3H4M2S", "3=4M", "MM3I", "12", "1M" * 3000, *made]
    rows = [(i, t, draw.randrange(0, 30), draw.randrange(0, 30), draw.random() < 0.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, c string, o long, p long, r boolean").repartition(3).withColumns({"a": F.least("o", "p"), "b": F.greatest("o", "p")})
    ops = cigar.parse(F.col("c"))
    plain = {
        "at": cigar.reference_at(cigar.in_fragment_order(ops, F.col("r")), F.col("o"), F.lit(100), F.col("r")),
        "cut": cigar.told(cigar.slice_by_query(ops, F.col("a"), F.col("b"))),
        "sides": F.struct(*[c.cast("long").alias(n) for n, c in zip(("first", "last"), cigar.sub_interval(ops, F.lit(1), F.lit(3), F.col("r")))]),
        "bases": F.transform(cigar.expanded(ops), lambda x, i: F.struct(i.cast("long").alias("place"), x["base"].alias("base"), x["deleted"].cast("long").alias("deleted"), x["op"].alias("number"))),
    }
    index = {
        "at": runs.reference_at(F.col("c"), F.col("o"), F.lit(100), F.col("r")),
        "cut": runs.slice_by_query(F.col("c"), F.col("a"), F.col("b")),
        "sides": F.struct(*[c.alias(n) for n, c in zip(("first", "last"), runs.sub_interval(F.col("c"), F.lit(1), F.lit(3), F.col("r")))]),
    }
    for name, column in index.items():
        both = df.filter("c IS NOT NULL").select("k", "c", column.alias("got"), plain[name].alias("want")).collect()
        assert [(r.k, r.c[:60]) for r in both if r.got != r.want] == []
    got = {}
    for r in runs.expanded_bases(df, "c", "k").collect():
        got.setdefault(r.k, []).append((r.place, r.base, r.deleted, r.number))
    want = {r.k: [tuple(x) for x in r.b] for r in df.filter("c IS NOT NULL").select("k", plain["bases"].alias("b")).collect() if r.b}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert df.filter("c IS NULL").select(runs.run_index(F.col("c")).alias("x"), index["at"].alias("y"), index["cut"].alias("z")).first() == (None, None, None)


def fold_of(rows, max_d, min_distance):
    """Junctions ``(order, a, b, d)`` taken one by one into a dictionary."""
    held = {}
    for o, a, b, d in sorted(rows):
        n = 1
        if (b, a) in held:
            _, far, m = held.pop((b, a))
            d, n = min(d, far), m + 1
            if abs(b) < abs(a):
                a, b = b, a
        if d <= max_d and abs(abs(a) - abs(b)) >= min_distance:
            held[a, b] = (o, d, n)
    return sorted((o, a, b, d, n) for (a, b), (o, d, n) in held.items())


def test_reciprocal_fold_of_repeats(spark):
    draw = random.Random(21)
    rows = [(o, draw.choice([-9, -4, 3, 4, 9]), draw.choice([-9, -4, 3, 4, 9]), draw.randrange(120)) for o in range(400)]
    df = spark.createDataFrame(rows, "o long, a long, b long, d long")
    for max_d, min_distance in ((100, 0), (60, 2), (10**6, 0)):
        got = sorted(map(tuple, templates.reciprocal_fold(df, "o", "a", "b", "d", max_d, min_distance).collect()))
        assert got == fold_of(rows, max_d, min_distance) and got
    assert templates.reciprocal_fold(df.limit(0), "o", "a", "b", "d").count() == 0


def merged_plainly(rows, ratio):
    out = []
    for k, lo, hi, names in sorted(rows, key=lambda r: r[:3]):
        if out and out[-1][0] == k:
            longer = max(out[-1][2] - out[-1][1], hi - lo)
            if longer > 0 and (out[-1][2] - lo) / longer > ratio:
                out[-1] = (k, out[-1][1], max(out[-1][2], hi), out[-1][3] + 1, out[-1][4] | set(names))
                continue
        out.append((k, lo, hi, 1, set(names)))
    return sorted((k, lo, hi, n, sorted(s)) for k, lo, hi, n, s in out)


@pytest.mark.parametrize("rows_of_a_piece", [2_000_000, 25])
def test_large_keys_in_pieces_and_islands(spark, monkeypatch, rows_of_a_piece):
    """Keys above the limit are cut into as many pieces as they need; islands are folded apart; small tables give the same."""
    monkeypatch.setattr(intervals, "PIECE_ROWS", rows_of_a_piece)
    draw = random.Random(33)
    rows = [(1 if i % 8 else 2, a, a + draw.randrange(0, 12), [f"s{i % 5}"]) for i, a in ((i, draw.randrange(4000)) for i in range(700))]
    df = spark.createDataFrame(rows, "k int, lo long, hi long, names array<string>")
    got = intervals.merge_similar(df, "k", "lo", "hi", 0.5, "names")
    assert sorted((r.k, r.lo, r.hi, r.members, r.samples) for r in got.collect()) == merged_plainly(rows, 0.5)
    starts = {}
    for k in (1, 2):
        reach = since = None
        for lo, hi in sorted((r[1], r[2]) for r in rows if r[0] == k):
            since = lo if reach is None or lo >= reach else since
            reach = hi if reach is None else max(reach, hi)
            starts.setdefault((k, lo, hi), since)
    placed = intervals.islands(df, "k", "lo", "hi", "start").collect()
    assert len(placed) == len(rows) and all(r.start == starts[r.k, r.lo, r.hi] for r in placed)
    assert len(set(starts.values())) > 50
    pieces = intervals._cut(df, ["k"], "lo")[1]
    assert pieces == 1 if rows_of_a_piece > 700 else pieces > 16
    before = {(r.k, r.lo, r.hi): r.b for r in intervals.previous_before(df.drop("names"), "k", "lo", "hi", "b").collect()}
    assert before == {s[:3]: max((o[2] for o in rows if o[0] == s[0] and o[2] <= s[1]), default=None) for s in rows}
    covered = {r.k: r.covered for r in intervals.union_coverage(df, "k", "lo", "hi").collect()}
    assert covered == {k: len({y for s in rows if s[0] == k for y in range(s[1], s[2])}) for k in (1, 2)}
    odd = spark.createDataFrame([(None, 1, 5), (None, 2, 6), (3, None, 4), (3, 1, None)], "k int, lo long, hi long")
    assert sum(r.members for r in intervals.merge_similar(odd, "k", "lo", "hi").collect()) == 4


def test_running_sums_over_ranges(spark):
    draw = random.Random(2)
    rows = [(i, draw.randrange(-5, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(7)
    got = {r.i: r.s for r in junctions.running_sum(df, [F.desc("v"), "i"], F.col("v"), "s").collect()}
    total, want = 0, {}
    for i, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[i], total = total, total + v
    assert got == want
    assert junctions.running_sum(df.limit(0), ["i"], F.lit(1), "s").count() == 0
    ranked = sorted((r.rank, r.n, r.v) for r in clusters.largest_first(df, "v").collect())
    counts = sorted(((-sum(x[1] == v for x in rows), v) for v in {x[1] for x in rows}))
    assert ranked == [(k, -n, v) for k, (n, v) in enumerate(counts)]
    offsets = {r.i: r.start for r in primers.region_offsets(df, "i", "v", "start").collect()}
    assert offsets == {i: sum(v for j, v in rows if j < i) for i, _ in rows}


def test_chain_of_many_segments():
    """Ten thousand overlapping segments take seconds; scores are those of the pieces."""
    segments = [(i * 10, i * 10 + 120, [(60, "M"), (2, "D"), (61, "M")]) for i in range(10_000)]
    began = time.perf_counter()
    total, pieces = chain.best_chain(segments)
    assert time.perf_counter() - began < 20 and len(pieces) > 1 and total > 0
    assert all(a[2] < b[1] and a[0] < b[0] for a, b in zip(pieces, pieces[1:]))


def test_stages_are_kept(spark, tmp_path):
    """A second run reads what didn't change without a job; changes of files or parameters, and half-written results, are made again."""
    data, folder = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(100).withColumn("v", F.col("id") % 7).write.parquet(data)

    def run(limit):
        kept = Stages(spark, folder)
        rows = spark.read.schema("id long, v long").parquet(data)
        first = kept.stage("filtered", lambda: rows.filter(F.col("v") < limit), [rows], limit=limit)
        second = kept.stage("counted", lambda: first.groupBy("v").count(), [first])
        return kept.made, second

    made, out = run(3)
    assert made == ["filtered", "counted"] and {r.v: r["count"] for r in out.collect()} == {0: 15, 1: 15, 2: 14}
    context = spark.sparkContext
    context.setJobGroup("again", "a second run")
    made, out = run(3)
    assert made == [] and not context.statusTracker().getJobIdsForGroup("again")
    context.setJobGroup("rest", "other runs")
    assert out.count() == 3 and run(4)[0] == ["filtered", "counted"] and run(3)[0] == []
    (half,) = [p for p in (tmp_path / "kept" / "counted").iterdir() if spark.read.parquet(str(p)).count() == 3]
    (half / "_stage.json").unlink()
    assert run(3)[0] == ["counted"]
    spark.range(50).withColumn("v", F.col("id") % 7).write.mode("append").parquet(data)
    made, out = run(3)
    assert made == ["filtered", "counted"] and out.agg(F.sum("count")).first()[0] == 44 + 22
    with pytest.raises(ValueError):
        Stages(spark, folder).stage("x", lambda: None, [spark.range(3)])


def test_merging_without_samples_sends_numbers_only(spark):
    """No array of samples goes to Python where none is asked for; the pieces are those of a merge with samples."""
    draw = random.Random(21)
    rows = [(k % 3, lo, lo + draw.randrange(0, 60)) for k in range(400) for lo in [draw.randrange(2000)]] + [(1, None, 5), (2, 7, None), (None, 3, 9), (None, 3, 9)]
    df = spark.createDataFrame(rows, "k int, lo long, hi long").withColumn("s", F.array(F.lit("x")))
    plain = intervals.merge_similar(df.drop("s"), "k", "lo", "hi")
    assert "array<string>" not in plain._jdf.queryExecution().optimizedPlan().toString() and plain.columns == ["k", "lo", "hi", "members"]
    assert "samples" not in plain._jdf.queryExecution().optimizedPlan().toString()
    sampled = intervals.merge_similar(df, "k", "lo", "hi", samples="s").drop("samples")
    assert sorted(map(str, plain.collect())) == sorted(map(str, sampled.collect()))


def odd_fragments(draw, fragments):
    """Rows ``q, row, a, b, cigar, f, r`` of segments of which none lies in another, a few with clips inside, other operations or none, as texts of many kinds."""
    rows = []
    for k in range(fragments):
        at, before = draw.randrange(-50, 200), None
        for _ in range(draw.choice([1, 1, 2, 3, 5, 9, 40])):
            ops = [(draw.randrange(0, 90), draw.choice("MMMID")) for _ in range(draw.randrange(1, 6))]
            n = max(1, sum(m for m, op in ops if op != "D") + draw.choice([0, 0, 0, -3, 4]))
            if before and (at <= before[0] or at + n - 1 <= before[1]):
                n, at = max(n, before[1] - before[0] + 1), before[0] + 1
            text = "".join(f"{m}{op}" for m, op in ops)
            text = draw.choice(["", "3H", "4S"] * 20 + ["2H5S"]) + text + draw.choice(["", "3H", "4S"] * 20 + ["6N2S"])
            rows.append((None if k == 3 else k, len(rows), at, at + n - 1, draw.choice([text] * 200 + ["*"]), draw.randrange(10_000), draw.choice([True, False, None])))
            before = (at, at + n - 1)
            at = before[1] + draw.choice([1, 2, draw.randrange(-60, 30)])
    return rows


def test_chains_of_many_fragments_at_once(spark, monkeypatch):
    """Fragments that are chained together give to the last bit what they give one by one, in batches of any size, and with keys that are cut."""
    rows = odd_fragments(random.Random(35), 300)
    df = spark.createDataFrame(rows, "q int, row int, a int, b int, cigar string, f int, r boolean").repartition(3)
    told = lambda: sorted(map(str, chain.chain_segments(df, "q", "row", "a", "b", "cigar", "f", reverse="r").collect()))
    got = told()
    want = []
    for name in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == name]
        raw = [[(int(n), op) for n, op in chain.KNOWN.findall(r[4])] for r in own]
        inner = [chain._inner(ops, bool(r[6])) for ops, r in zip(raw, own)]
        total, pieces = chain.best_chain([(r[2], r[3], ops) for r, ops in zip(own, inner)])
        want += [(name, own[j][1], a, b, gain, total) for j, a, b, gain in pieces]
    assert sorted(x.split(", ref_start")[0] for x in got) == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(["q", "row", "a", "b", "score", "chain_score"], (*w[:4], float(w[4]), w[5]))) for w in want)
    monkeypatch.setattr(intervals, "PIECE_ROWS", 20)
    assert told() == got
    monkeypatch.undo()
    parsed = df.withColumn("cigar", cigar.parse(F.col("cigar"))).withColumn("t", F.col("f") + cigar.reference_span(F.col("cigar")))
    assert sorted(map(str, chain.chain_segments(parsed, "q", "row", "a", "b", "cigar", "f", "t", "r").collect())) == got
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert told() == got
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    names = ["q", "row", "a", "b", "cigar", "f", "t", "r"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*r[:6], 0, r[6]) for r in rows])], names=names)
    parts = list(chain._parts(batch))
    assert [plain for _, _, plain in parts] == [True, False] and parts[0][0].num_rows > 500
    for span in (True, False):
        together, alone = chain._told_together(*parts[0][:2], span), chain._told_alone(*parts[0][:2], span, chain.KNOWN)
        assert [c.to_pylist() for c in together] == [c.to_pylist() for c in alone]


def test_whole_fragments_across_batches(monkeypatch):
    monkeypatch.setattr(chain, "ROWS", 10)
    names = [None] * 3 + [1] * 25 + [2, 3, 3] + [4] * 12 + [5]
    table = pa.RecordBatch.from_arrays([pa.array(names), pa.array(range(len(names)))], names=["q", "i"])
    out = list(chain._whole_fragments(iter([table.slice(k, 4) for k in range(0, len(names), 4)] + [table.slice(0, 0)])))
    assert [x for b in out for x in b.column(1).to_pylist()] == list(range(len(names))) and len(out) > 2
    assert all(a.column(0)[-1].as_py() != b.column(0)[0].as_py() for a, b in zip(out, out[1:]))


def test_chains_of_lines_parse_no_cigar(spark):
    """Lines go as text, and only those that stay; a hundred thousand fragments through arrays take seconds."""
    from junctura.plans import queries

    plan = queries.QUERIES["q35_chain_dp"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "collect_list" not in plan and "Generate" not in plan
    n = 100_000
    first = [x for k in range(n) for x in (k % 50, k % 50 + 70, k % 50 + 100)]
    columns = [pa.array([k for k in range(n) for _ in range(3)]), pa.array(range(3 * n)), pa.array(first), pa.array([x + 90 for x in first]), pa.array(["2H40M3I48M2D3S"] * (3 * n)), pa.array([0] * (3 * n)), pa.array([0] * (3 * n)), pa.array([False] * (3 * n))]
    began = time.perf_counter()
    out = chain._told_together(pa.RecordBatch.from_arrays(columns, names=list("abcdefgh")), np.arange(n) * 3, True)
    assert time.perf_counter() - began < 15 and len(out[0]) >= n


@pytest.mark.parametrize("most, told", [(1_000_000, 1_000_000), (100, 0), (100, 40)])
def test_components_hold_no_more_in_a_task_as_edges_grow(spark, monkeypatch, most, told):
    """Paths, a star, repeats and loops: edges go to as many tasks as they fill, and labels of many nodes or many labels are looked up by each way."""
    draw = random.Random(44)
    ids = list(range(1200))
    draw.shuffle(ids)
    edges = [(a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if i % 40 != 39]
    edges += [(9000 + draw.randrange(2), k) for k in range(9002, 9900)] + [(20_000 + k % 900, 21_000 + k % 900) for k in range(1800)] + [(7, 7), (None, 3), (30_000, 30_000)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    files, write = [], graph.shared_table
    monkeypatch.setattr(graph, "MOST_ROWS", most)
    monkeypatch.setattr(graph, "ROWS_PER_TASK", min(most, 100_000))
    monkeypatch.setattr(graph, "BROADCAST_ROWS", told)
    monkeypatch.setattr(graph, "shared_table", lambda *a, **k: (lambda df: files.append(len(df.inputFiles())) or df)(write(*a, **k)))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    # of the distinct pairs
    assert files[1] > 25 if most == 100 else files[1] <= 4
    assert graph.tasks_of(spark, 0) == 1


def test_lines_join_orders_in_tasks_by_their_number(spark, monkeypatch):
    from junctura.plans import queries

    plans = []
    monkeypatch.setattr(graph, "MOST_ROWS", 500)
    monkeypatch.setattr(graph, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(queries, "connected_components", lambda edges, *ends: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()))
    queries.q44_all(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert plans[0].count("RepartitionByExpression [l_orderkey") == plans[0].count(f", {-(-lines // 500)}") == 2
