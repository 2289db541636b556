"""Every operator applied to the given tables, whole, with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from junctura.functions import cigar, runs, sequence, thermo
from junctura.operators import anneal, chain, clusters, deletions, intervals, junctions, links, primers, templates
from junctura.operators.graph import connected_components, tasks_of
from junctura.sources import design, sequences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"
ODAY = "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"
IV = f"iv AS (SELECT *, {DAY} AS lo, {DAY} + CAST(l_quantity AS BIGINT) AS hi, row_number() OVER () AS rid FROM lineitem)"
OD = f"od AS (SELECT o_custkey, o_orderkey, {ODAY} AS day FROM orders)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL if there is one."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1995-01-01").cast("date")).cast("long")


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as intervals: ``lo`` the ship day, ``hi`` as many days on as the quantity."""
    return table(spark, sf_dir, "lineitem").withColumn("lo", _day("l_shipdate")).withColumn("hi", F.col("lo") + F.col("l_quantity").cast("long"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", _day("o_orderdate").alias("day"))


@query("q01_containment_filter", f"""WITH {IV} SELECT l_suppkey, lo, hi FROM iv s WHERE NOT EXISTS
  (SELECT 1 FROM iv o WHERE o.l_suppkey = s.l_suppkey AND o.rid <> s.rid AND o.lo <= s.lo AND o.hi >= s.hi)""")
def q01(spark, d):
    return intervals.drop_contained(shipped(spark, d).select("l_suppkey", "lo", "hi"), "l_suppkey", "lo", "hi")


STRAND = "event_type IN ('view', 'click', 'purchase')"


@query("q02_junctions", f"""WITH e AS (SELECT user_id, ts, event_id, event_id * 10 AS l, event_id * 10 + CASE WHEN {STRAND} THEN 5 ELSE -5 END AS r,
    event_id * 1000 AS s, event_id * 1000 + CAST(floor(value) AS BIGINT) AS t FROM events),
  n AS (SELECT *, lead(l) OVER w AS nl, lead(r) OVER w AS nr, lead(s) OVER w AS ns, row_number() OVER w - 1 AS ordinal FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, ordinal, CASE WHEN l <= r THEN -r ELSE r END AS a, CASE WHEN nl <= nr THEN nl ELSE -nl END AS b, ns - t - 1 AS d FROM n WHERE nl IS NOT NULL""")
def q02(spark, d):
    e = table(spark, d, "events").withColumn("l", F.col("event_id") * 10).withColumn("r", F.col("l") + F.when(F.expr(STRAND), 5).otherwise(-5))
    e = e.withColumn("s", F.col("event_id") * 1000).withColumn("t", F.col("s") + F.floor("value"))
    return junctions.junctions(e, "user_id", ["ts", "event_id"], "l", "r", "s", "t")


@query("q03_interval_overlap_pairs", f"""WITH {IV} SELECT a.l_orderkey, count(*) AS pairs, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS overlap
  FROM iv a JOIN iv b ON a.l_orderkey = b.l_orderkey AND a.rid < b.rid AND a.lo < b.hi AND b.lo < a.hi GROUP BY 1""")
def q03(spark, d):
    rows = shipped(spark, d).withColumn("row", F.xxhash64("*"))
    return intervals.overlap_pairs(rows, "l_orderkey", "lo", "hi", "row", 64).groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.sum("overlap").alias("overlap"))


@query("q04_previous_nonoverlap", f"""WITH {IV} SELECT s.l_suppkey, s.lo, s.hi, coalesce(max(o.hi), -1) AS before FROM iv s LEFT JOIN iv o ON o.l_suppkey = s.l_suppkey AND o.hi <= s.lo GROUP BY s.l_suppkey, s.lo, s.hi, s.rid""")
def q04(spark, d):
    return intervals.previous_before(shipped(spark, d).select("l_suppkey", "lo", "hi"), "l_suppkey", "lo", "hi", "before").withColumn("before", F.coalesce("before", F.lit(-1).cast("long")))


POINTS = f"pts AS (SELECT l_orderkey AS a, {DAY} AS b, CAST(l_linenumber AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"
#: Sides are at most 15, so partners lie in the next cell of 16 orders at most.
EDGES = """cells AS (SELECT *, unnest([-1, 0, 1]) + a // 16 AS cell FROM pts),
  e AS (SELECT p.a AS a1, p.b AS b1, p.d AS d1, q.a AS a2, q.b AS b2, q.d AS d2 FROM pts p JOIN cells q ON p.a // 16 = q.cell
    WHERE (p.a, p.b, p.d) < (q.a, q.b, q.d) AND {rule})"""
EXACT = "least(p.a, q.a) + least(p.b, q.b) >= greatest(p.a + p.b - p.d, q.a + q.b - q.d)"
ONE_WAY = "({p}.a + {p}.b - {p}.d < {q}.a + {q}.b - {q}.d AND ({q}.a + {q}.b - {q}.d) - ({p}.a + {p}.b - {p}.d) <= {p}.d AND {q}.b - {q}.d <= {p}.b AND {p}.b <= {q}.b)"
COMPAT = "(" + ONE_WAY.format(p="p", q="q") + " OR " + ONE_WAY.format(p="q", q="p") + ")"


def points(spark, d):
    rows = shipped(spark, d).select(F.col("l_orderkey").alias("a"), F.col("lo").alias("b"), F.col("l_linenumber").cast("long").alias("d"))
    return clusters.unique_points(rows, "a", "b", "d").withColumn("node", F.struct("a", "b", "d"))


def _flat(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "src"), (2, "dst")) for c in "abd"])


@query("q05_unique_multiplicity", f"WITH {POINTS} SELECT * FROM pts")
def q05(spark, d):
    return points(spark, d).drop("node")


@query("q06_triangle_edges", f"WITH {POINTS}, {EDGES.format(rule=EXACT)} SELECT * FROM e")
def q06(spark, d):
    return _flat(clusters.triangle_edges(points(spark, d), None, "a", "b", "d"))


@query("q06_triangle_edges_compat", f"WITH {POINTS}, {EDGES.format(rule=COMPAT)} SELECT * FROM e")
def q06_compat(spark, d):
    return _flat(clusters.triangle_edges(points(spark, d), None, "a", "b", "d", "compat"))


@query("q07_components", f"""WITH RECURSIVE {POINTS}, {EDGES.format(rule=EXACT)},
  both_ways AS (SELECT * FROM e UNION ALL SELECT a2, b2, d2, a1, b1, d1 FROM e),
  r AS (SELECT a1 AS a, b1 AS b, d1 AS d, {{'a': a1, 'b': b1, 'd': d1}} AS c FROM both_ways
    UNION SELECT w.a2, w.b2, w.d2, r.c FROM r JOIN both_ways w ON w.a1 = r.a AND w.b1 = r.b AND w.d1 = r.d)
  SELECT a, b, d, min(c).a AS ca, min(c).b AS cb, min(c).d AS cd FROM r GROUP BY a, b, d""")
def q07(spark, d):
    found = clusters.triangle_clusters(points(spark, d), "node", "a", "b", "d")
    return found.select("node.a", "node.b", "node.d", *[F.col(f"component.{c}").alias(f"c{c}") for c in "abd"])


@query("q08_cluster_pair_mode", """WITH c AS (SELECT l_returnflag, l_linenumber, l_quantity, count(*) AS n, min({'o': l_orderkey, 'p': l_partkey}) AS f FROM lineitem GROUP BY 1, 2, 3)
  SELECT l_returnflag, l_linenumber, l_quantity, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, f, l_linenumber, l_quantity) AS k FROM c) WHERE k = 1""")
def q08(spark, d):
    return clusters.pair_mode(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity", ["l_orderkey", "l_partkey"])


@query("q09_mode_tie_average", """WITH c AS (SELECT l_suppkey, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, v DESC) AS k FROM c)
  SELECT p.l_suppkey, CASE WHEN p.n = q.n THEN (p.v + q.v) * 0.5 ELSE p.v END AS mode FROM k p LEFT JOIN k q ON q.l_suppkey = p.l_suppkey AND q.k = 2 WHERE p.k = 1""")
def q09(spark, d):
    return clusters.mode_tie_average(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "mode")


@query("q10_cluster_stats_filter", """WITH e AS (SELECT user_id, CAST(floor(value * 100) AS BIGINT) AS v FROM events)
  SELECT user_id, count(*) AS n, min(v) AS min_v, avg(v) AS avg_v FROM e GROUP BY 1 HAVING count(*) >= 25""")
def q10(spark, d):
    return clusters.cluster_stats(table(spark, d, "events").select("user_id", F.floor(F.col("value") * 100).alias("v")), "user_id", ["v"])


NATIONS = """t AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) % 97 AS d, s_nationkey * 100 + c_nationkey AS ord FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def nation_pairs(spark, d):
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    joined = joined.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = joined.groupBy(F.col("s_nationkey").cast("long").alias("a"), F.col("c_nationkey").cast("long").alias("b")).agg((F.count("*") % 97).alias("d"))
    return rows.withColumn("ord", F.col("a") * 100 + F.col("b"))


@query("q11_reciprocal_merge", f"""WITH {NATIONS}, g AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, max(ord) AS ord, min(d) AS d, count(*) AS merged, max({{'o': ord, 'a': a, 'b': b}}) AS own FROM t GROUP BY 1, 2)
  SELECT CAST(ord AS BIGINT) AS ord, CAST(CASE WHEN merged > 1 THEN lo ELSE own.a END AS BIGINT) AS a, CAST(CASE WHEN merged > 1 THEN hi ELSE own.b END AS BIGINT) AS b, d, merged FROM g""")
def q11(spark, d):
    return templates.reciprocal_merge(nation_pairs(spark, d), "ord", "a", "b", "d")


YEARS = """t AS (SELECT CAST(s_nationkey AS BIGINT) AS a, CAST(c_nationkey AS BIGINT) AS b, count(*) % 97 AS d, year(CAST(l_shipdate AS DATE)) * 10000 + s_nationkey * 100 + c_nationkey AS ord FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, ord)"""


@query("q11_reciprocal_fold", f"""WITH RECURSIVE {YEARS}, s AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY ord) AS k FROM t),
  f AS (SELECT DISTINCT lo, hi, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS sa, CAST(NULL AS BIGINT) AS sb, CAST(NULL AS BIGINT) AS sd, CAST(NULL AS BIGINT) AS so, CAST(NULL AS BIGINT) AS sm FROM s
    UNION ALL SELECT lo, hi, k, CASE WHEN noisy THEN CASE WHEN NOT back THEN sa END ELSE na END, CASE WHEN noisy THEN CASE WHEN NOT back THEN sb END ELSE nb END, CASE WHEN noisy THEN CASE WHEN NOT back THEN sd END ELSE nd END,
      CASE WHEN noisy THEN CASE WHEN NOT back THEN so END ELSE ord END, CASE WHEN noisy THEN CASE WHEN NOT back THEN sm END WHEN back THEN sm + 1 ELSE 1 END
    FROM (SELECT *, nd > 80 OR abs(abs(na) - abs(nb)) < 2 AS noisy FROM (SELECT *, CASE WHEN back THEN least(d, sd) ELSE d END AS nd, CASE WHEN back AND abs(b) < abs(a) THEN b ELSE a END AS na, CASE WHEN back AND abs(b) < abs(a) THEN a ELSE b END AS nb
      FROM (SELECT s.*, f.sa, f.sb, f.sd, f.so, f.sm, coalesce(f.sa = s.b AND f.sb = s.a, false) AS back FROM f JOIN s ON s.lo = f.lo AND s.hi = f.hi AND s.k = f.k + 1))))
  SELECT CAST(so AS BIGINT) AS ord, sa AS a, sb AS b, sd AS d, sm AS merged FROM f WHERE sa IS NOT NULL AND k = (SELECT max(s.k) FROM s WHERE s.lo = f.lo AND s.hi = f.hi)""")
def q11_fold(spark, d):
    """Pairs of nations by year: both orientations repeat."""
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.year(F.col("l_shipdate").cast("date")).alias("y")).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    joined = joined.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = joined.groupBy(F.col("s_nationkey").cast("long").alias("a"), F.col("c_nationkey").cast("long").alias("b"), "y").agg((F.count("*") % 97).alias("d"))
    rows = rows.select((F.col("y") * 10000 + F.col("a") * 100 + F.col("b")).cast("long").alias("ord"), "a", "b", "d")
    return templates.reciprocal_fold(rows, "ord", "a", "b", "d", 80, 2)


@query("q12_noise_filter", f"""SELECT l_orderkey AS a, {DAY} AS b, CAST(l_quantity AS BIGINT) AS d FROM lineitem WHERE l_quantity <= 30 AND abs(abs(l_orderkey) - abs({DAY})) >= 10""")
def q12(spark, d):
    rows = shipped(spark, d).select(F.col("l_orderkey").alias("a"), F.col("lo").alias("b"), F.col("l_quantity").cast("long").alias("d"))
    return rows.filter(templates.noise_filter(F.col("a"), F.col("b"), F.col("d"), 30))


HITS = f"h AS (SELECT DISTINCT l_suppkey, {DAY} AS pos, l_returnflag = 'R' AS f, l_partkey FROM lineitem)"


def hits(spark, d):
    return shipped(spark, d).select("l_suppkey", F.col("lo").alias("pos"), (F.col("l_returnflag") == "R").alias("f"), "l_partkey")


@query("q13_cross_amp", f"""WITH {HITS} SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS p, greatest(a.l_partkey, b.l_partkey) AS q FROM h a JOIN h b ON a.l_suppkey = b.l_suppkey AND a.f AND NOT b.f AND b.pos - a.pos > 0 AND b.pos - a.pos <= 5""")
def q13(spark, d):
    return primers.cross_amplification(hits(spark, d), "l_suppkey", "pos", "f", "l_partkey", 5)


@query("q14_cross_amp_tail_compat", f"""WITH {HITS} SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS p, greatest(a.l_partkey, b.l_partkey) AS q FROM h a JOIN h b ON a.l_suppkey = b.l_suppkey AND a.f AND NOT b.f AND b.pos - a.pos > 0 AND b.pos - a.pos <= 9
  WHERE a.pos + 9 < (SELECT max(pos) FROM h)""")
def q14(spark, d):
    return primers.cross_amplification(hits(spark, d), "l_suppkey", "pos", "f", "l_partkey", 9, compat=True)


@query("q15_max_alignments", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <= 30")
def q15(spark, d):
    return primers.at_most(table(spark, d, "lineitem"), "l_partkey", 30)


@query("q16_point_in_region", """WITH s AS (SELECT c_nationkey, count(*) AS len FROM customer GROUP BY 1), r AS (SELECT *, coalesce(sum(len) OVER (ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
  SELECT c_custkey, r.c_nationkey AS region FROM customer c JOIN r ON r.start <= c_custkey AND c_custkey < r.start + r.len""")
def q16(spark, d):
    customers = table(spark, d, "customer")
    regions = primers.region_offsets(customers.groupBy("c_nationkey").agg(F.count("*").alias("len")), "c_nationkey", "len", "start").withColumnRenamed("c_nationkey", "region")
    return primers.in_region(customers.select("c_custkey"), regions, [], "c_custkey", "start", "len", 1024).select("c_custkey", "region")


@query("q17_tiling_cost", f"""WITH {OD}, r AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS f FROM customer),
  p AS (SELECT k, 0 AS kind, 0.0 AS x FROM r UNION ALL SELECT k, 2, 2500.0 FROM r UNION ALL SELECT o_custkey, 1, CAST(day AS DOUBLE) FROM od JOIN r ON k = o_custkey),
  g AS (SELECT k, kind, x - lag(x) OVER w AS gap, lag(kind) OVER w AS before FROM p WINDOW w AS (PARTITION BY k ORDER BY kind, x)),
  c AS (SELECT k, gap - 300 + CASE WHEN (f AND before = 0) OR (NOT f AND kind = 2) THEN 300 ELSE 0 END AS g FROM g JOIN r USING (k) WHERE gap IS NOT NULL)
  SELECT k AS c_custkey, CAST(sum(CASE WHEN g > 0 THEN g ELSE greatest(0, -g - 30) END) AS DOUBLE) AS cost FROM c GROUP BY 1""")
def q17(spark, d):
    regions = table(spark, d, "customer").select("c_custkey", F.lit(0).alias("start"), F.lit(2500).alias("end"), (F.col("c_custkey") % 2 == 0).alias("forward"))
    found = ordered(spark, d).select(F.col("o_custkey").alias("c_custkey"), "day")
    return primers.tiling_cost(found, regions, "c_custkey", "day", "start", "end", "forward", 300.0, 0.1)


@query("q18_incompat_density", f"""WITH {HITS}, e AS (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS p, greatest(a.l_partkey, b.l_partkey) AS q FROM h a JOIN h b ON a.l_suppkey = b.l_suppkey AND a.f AND NOT b.f AND b.pos - a.pos > 0 AND b.pos - a.pos <= 5),
  k AS (SELECT p AS k FROM e UNION SELECT q FROM e)
  SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e) / ((SELECT count(*) FROM part) * ((SELECT count(*) FROM part) + 1) * 0.5) AS density, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT k FROM k)) AS free""")
def q18(spark, d):
    return primers.incompatibility_density(table(spark, d, "part").select("p_partkey"), "p_partkey", q13(spark, d), "p", "q")


@query("q19_complement_pairs", f"""WITH n AS (SELECT DISTINCT l_orderkey, l_partkey, {DAY} AS x, l_returnflag = 'R' AS f FROM lineitem),
  e AS (SELECT DISTINCT a.l_orderkey, least(a.l_partkey, b.l_partkey) AS p, greatest(a.l_partkey, b.l_partkey) AS q FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.f AND NOT b.f AND b.x - a.x > 0 AND b.x - a.x <= 30)
  SELECT a.l_orderkey, least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b, abs(a.x - b.x) AS distance FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.f AND NOT b.f AND a.l_partkey <> b.l_partkey
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.l_orderkey = a.l_orderkey AND e.p = least(a.l_partkey, b.l_partkey) AND e.q = greatest(a.l_partkey, b.l_partkey))""")
def q19(spark, d):
    nodes = shipped(spark, d).select("l_orderkey", "l_partkey", F.col("lo").alias("x"), (F.col("l_returnflag") == "R").alias("f")).distinct()
    f = nodes.filter("f").select("l_orderkey", F.col("l_partkey").alias("__p"), (F.col("x") + 1).alias("lo"), (F.col("x") + 31).alias("hi"))
    r = nodes.filter("not f").select("l_orderkey", F.col("l_partkey").alias("__q"), F.col("x").alias("at"), (F.col("x") + 1).alias("next"))
    edges = intervals.range_join(f, r, ["l_orderkey"], "lo", "hi", "at", "next", 64).select("l_orderkey", F.least("__p", "__q").alias("p"), F.greatest("__p", "__q").alias("q"))
    return primers.complement_pairs(nodes, "l_partkey", "x", "f", edges, "p", "q", ["l_orderkey"])


@query("q20_semi_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def q20(spark, d):
    keys = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return primers.first_matches(table(spark, d, "orders").select("o_custkey", "o_orderkey"), keys, "o_custkey", ["o_orderkey"])


@query("q20_anti_keys", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q20_anti(spark, d):
    keys = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return primers.without_keys(table(spark, d, "orders").select("o_custkey", "o_orderkey"), keys, "o_custkey")


CIGAR = "concat(l_linenumber, 'H', CAST(l_quantity AS BIGINT), 'M', l_partkey % 5 + 1, 'I', CAST(l_quantity AS BIGINT) + 3, 'M', l_suppkey % 7 + 1, 'D', 4, 'M', l_linenumber % 3 + 1, 'S')"


def cigars(spark, d):
    rows = table(spark, d, "lineitem")
    text = F.expr(CIGAR.replace("BIGINT", "LONG"))
    return rows.select("l_orderkey", text.alias("cigar"), (F.col("l_returnflag") == "R").alias("reverse"))


@query("q21_cigar_parse_score", f"""WITH c AS (SELECT l_orderkey, {CIGAR} AS cigar, l_returnflag = 'R' AS reverse FROM lineitem),
  o AS (SELECT *, regexp_extract_all(cigar, '(\\d+)([MIDNSHPX])', 1) AS n, regexp_extract_all(cigar, '(\\d+)([MIDNSHPX])', 2) AS op FROM c),
  z AS (SELECT *, list_transform(n, lambda x: CAST(x AS BIGINT)) AS k FROM o),
  t AS (SELECT l_orderkey, cigar, reverse, k[1] + k[2] + k[3] + k[4] + k[6] + k[7] AS length, k[2] + k[4] + k[5] + k[6] AS span, k[1] AS lead, k[7] AS tail, (k[2] + k[4] + k[6]) AS m, k[3] AS i, k[5] AS d FROM z)
  SELECT l_orderkey, cigar, length, span, CASE WHEN reverse THEN length - lead ELSE 1 + lead END AS first, CASE WHEN reverse THEN 1 + tail ELSE length - tail END AS last, CAST(92 * m - 200 - 20 * i - 20 * d AS BIGINT) AS score_100 FROM t""")
def q21(spark, d):
    rows = cigar.with_ops(cigars(spark, d), F.col("cigar"), "ops")
    first, last = cigar.fragment_interval(F.col("ops"), F.col("reverse"))
    return rows.select("l_orderkey", "cigar", cigar.fragment_length(F.col("ops")).alias("length"), cigar.reference_span(F.col("ops")).alias("span"), first.alias("first"), last.alias("last"), F.round(cigar.score(F.col("ops")) * 100).cast("long").alias("score_100"))


@query("q21_cigar_slice", f"""WITH c AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS a, l_partkey % 5 + 1 AS i, l_suppkey % 7 + 1 AS dl FROM lineitem)
  SELECT l_orderkey, concat(least(a, 10), 'M', CASE WHEN a < 10 THEN concat(least(i, 10 - a), 'I') ELSE '' END, CASE WHEN a + i < 10 THEN concat(least(10 - a - i, a + 3), 'M') ELSE '' END,
    CASE WHEN 2 * a + i + 3 <= 10 THEN concat(dl, 'D') ELSE '' END, CASE WHEN 2 * a + i + 3 < 10 THEN concat(least(4, 10 - 2 * a - i - 3), 'M') ELSE '' END) AS head FROM c""")
def q21_slice(spark, d):
    return cigars(spark, d).select("l_orderkey", runs.slice_by_query(F.col("cigar"), F.lit(0), F.lit(10)).alias("head"))


@query("q22_reverse_complement", "SELECT doc_id, md5(reverse(translate(text, 'ACGTN', 'TGCAN'))) AS digest, length(text) AS length FROM documents")
def q22(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(sequence.reverse_complement(F.col("text")).cast("binary")).alias("digest"), F.length("text").cast("long").alias("length"))


BASES = "translate(regexp_replace(lower({0}), '[^a-z]', ''{1}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_SQL_PAIRS = ", ".join(f"('{k}', {h}, {s}, {g})" for k, (h, s, g) in sorted(thermo.closed_pairs().items()))


@query("q23_nn_thermo", f"""WITH s AS (SELECT p_partkey, {BASES.format('p_name', ", 'g'")} AS q FROM part), v(pair, h, e, g) AS (VALUES {_SQL_PAIRS}),
  p AS (SELECT p_partkey, substr(q, i, 2) AS pair FROM (SELECT p_partkey, q, unnest(range(1, length(q))) AS i FROM s)),
  t AS (SELECT p_partkey, sum(h) AS h, sum(e) AS e, sum(g) AS g FROM p JOIN v USING (pair) GROUP BY 1),
  a AS (SELECT p_partkey, CAST(left(q, 1) IN ('A', 'T') AS INT) + CAST(right(q, 1) IN ('A', 'T') AS INT) AS ends FROM s)
  SELECT p_partkey, CAST(round(1000 * (0.2 + t.h + 2.2 * ends)) AS BIGINT) AS enthalpy, CAST(round(1000 * (-5.7 + t.e + 6.9 * ends)) AS BIGINT) AS entropy, CAST(round(1000 * (1.96 + t.g + 0.05 * ends)) AS BIGINT) AS gibbs FROM t JOIN a USING (p_partkey)""")
def q23(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr(BASES.format("p_name", "")).alias("q"))
    milli = lambda c: F.round(c * 1000).cast("long")
    return rows.select("p_partkey", milli(thermo.enthalpy(F.col("q"))).alias("enthalpy"), milli(thermo.entropy(F.col("q"))).alias("entropy"), milli(thermo.gibbs(F.col("q"))).alias("gibbs"))


Q24 = f"""WITH s AS (SELECT doc_id, {BASES.format('text', ", 'g'")} AS q FROM documents), p AS (SELECT *, length(q) AS n, length(q) // 2 AS x, length(q) // 3 AS y, doc_id % 5 AS d FROM s),
  t AS (SELECT *, CASE WHEN x - 50 >= 1 THEN substr(q, x - 50, 51) ELSE '' END || repeat('N', d + 2) || CASE WHEN y >= 1 THEN substr(q, y, 51) ELSE '' END AS t FROM p)
  SELECT concat('>', doc_id, ',', -x, ',', y, ',', d) AS header, regexp_replace(t, '(.{{80}})', '\\1' || chr(10), 'g') AS template FROM t"""


@query("q24_flank_template", Q24)
def q24(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(BASES.format("text", "")).alias("q")).withColumn("n", F.length("q"))
    half = lambda k: F.floor(F.col("n") / k)
    return templates.templates(rows.withColumns({"a": -half(2), "b": half(3), "d": F.col("doc_id") % 5}), "doc_id", "a", "b", "d", "q", 50, 2)


@query("q24_chunked_template", Q24)
def q24_chunked(spark, d):
    """The same templates from documents in chunks of 1024 bases."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(BASES.format("text", "")).alias("q")).withColumn("n", F.length("q"))
    chunks = sequences.chunked(rows.select(F.col("doc_id").alias("name"), F.col("q").alias("seq")), 1024)
    half = lambda k: F.floor(F.col("n") / k)
    breaks = rows.select("doc_id", (-half(2)).alias("a"), half(3).alias("b"), (F.col("doc_id") % 5).alias("d"), F.col("doc_id").alias("contig"))
    return templates.templates_of_chunks(breaks, "doc_id", "doc_id", "a", "b", "d", "contig", chunks, 50, 2, 1024).drop("doc_id")


@query("q25_nearest_even_spaced", f"""WITH {OD}, p AS (SELECT DISTINCT o_custkey, day FROM od), k AS (SELECT DISTINCT o_custkey FROM od),
  c AS (SELECT o_custkey, day FROM p UNION SELECT o_custkey, 0 FROM k UNION SELECT o_custkey, 2500 FROM k),
  t AS (SELECT o_custkey, unnest(range(1, 8)) * (2500 // 8) AS target FROM k)
  SELECT t.o_custkey, t.target, CASE WHEN m > 0 AND m < 2500 THEN m ELSE -1 END AS midpoint FROM (SELECT t.o_custkey, t.target, arg_min(c.day, {{'far': abs(c.day - t.target), 'side': -c.day}}) AS m FROM t JOIN c USING (o_custkey) GROUP BY 1, 2) t""")
def q25(spark, d):
    return primers.even_spaced(ordered(spark, d).select("o_custkey", "day"), ["o_custkey"], "day", F.lit(2500), 7).withColumn("midpoint", F.coalesce("midpoint", F.lit(-1).cast("long")))


@query("q26_primer_cover", f"""WITH {OD}, m AS (SELECT s.o_custkey, s.o_orderkey, s.day, min(s.day - p.day) AS m FROM od s JOIN od p ON p.o_custkey = s.o_custkey AND p.day < s.day AND s.day - p.day < 120 GROUP BY 1, 2, 3)
  SELECT o_custkey, o_orderkey, day, coalesce(m, 120) AS distance, coalesce(m, 120) < 60 AS covered FROM od LEFT JOIN m USING (o_custkey, o_orderkey, day)""")
def q26(spark, d):
    orders = ordered(spark, d)
    return primers.nearest_primer(orders, orders.select("o_custkey", F.col("day").alias("at")), "o_custkey", "day", "at", 60)


@query("q27_union_coverage", f"""WITH {IV}, s AS (SELECT l_suppkey, lo, hi, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM s),
  i AS (SELECT l_suppkey, island, max(hi) - min(lo) AS len FROM g GROUP BY 1, 2)
  SELECT l_suppkey, CAST(sum(len) AS BIGINT) AS covered, count(*) AS islands FROM i GROUP BY 1""")
def q27(spark, d):
    return intervals.union_coverage(shipped(spark, d).select("l_suppkey", "lo", "hi"), "l_suppkey", "lo", "hi")


@query("q28_length_histogram", """WITH f AS (SELECT l_suppkey, l_linenumber AS f, count(*) AS nf FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), r AS (SELECT l_suppkey, l_linenumber AS r, count(*) AS nr FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
  g AS (SELECT l_suppkey, unnest(range(1, f + 1)) AS x, r, nf * nr AS w FROM f JOIN r USING (l_suppkey)), h AS (SELECT l_suppkey, x + unnest(range(0, r)) AS length, w FROM g),
  c AS (SELECT l_suppkey, length, CAST(sum(w) AS BIGINT) AS n FROM h GROUP BY 1, 2)
  SELECT l_suppkey, length, n, CAST(sum(n) OVER (PARTITION BY l_suppkey ORDER BY length) AS DOUBLE) / sum(n) OVER (PARTITION BY l_suppkey) AS share FROM c""")
def q28(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    f = lines.filter("l_returnflag = 'A'").select("l_suppkey", F.col("l_linenumber").alias("x"))
    r = lines.filter("l_returnflag = 'N'").select("l_suppkey", F.col("l_linenumber").alias("y"))
    return primers.length_histogram(f, "x", r, "y", ["l_suppkey"])


@query("q29_bin2d", """WITH m AS (SELECT min(l_extendedprice) AS x, min(l_discount) AS y FROM lineitem) SELECT CAST(floor((l_extendedprice - m.x) / 500.0) AS BIGINT) AS bin_x, CAST(floor((l_discount - m.y) / 500.0) AS BIGINT) AS bin_y, count(*) AS n FROM lineitem, m GROUP BY 1, 2""")
def q29(spark, d):
    return intervals.bin_counts(table(spark, d, "lineitem"), "l_extendedprice", "l_discount", 500.0)


@query("q30_longest_run", """WITH p AS (SELECT doc_id, string_split(text, 'e') AS r FROM documents), u AS (SELECT doc_id, unnest(r) AS s, generate_subscripts(r, 1) AS i FROM p),
  o AS (SELECT doc_id, i, length(s) AS n, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM u),
  b AS (SELECT doc_id, arg_min({'n': n, 'place': place}, {'a': -n, 'b': i}) AS m FROM o GROUP BY 1)
  SELECT doc_id, m.n AS length, CAST(CASE WHEN m.n > 0 THEN m.place + 1 ELSE 0 END AS BIGINT) AS first, CAST(CASE WHEN m.n > 0 THEN m.place + m.n ELSE 0 END AS BIGINT) AS last FROM b""")
def q30(spark, d):
    n, first, last = intervals.longest_run(F.col("text"), "e")
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("length"), first.cast("long").alias("first"), last.cast("long").alias("last"))


@query("q31_innermost_per_group", f"""SELECT l_orderkey, arg_max({DAY}, {{'t': CASE WHEN l_orderkey % 2 = 0 THEN {DAY} ELSE -{DAY} END, 'p': l_partkey}}) AS day, arg_max(l_partkey, {{'t': CASE WHEN l_orderkey % 2 = 0 THEN {DAY} ELSE -{DAY} END, 'p': l_partkey}}) AS l_partkey FROM lineitem GROUP BY 1""")
def q31(spark, d):
    rows = shipped(spark, d).select("l_orderkey", F.col("lo").alias("day"), "l_partkey", (F.col("l_orderkey") % 2 == 0).alias("forward"))
    return primers.innermost(rows, "l_orderkey", "day", "forward", "l_partkey").drop("forward")


@query("q32_topk_solutions", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30")
def q32(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(30)


@query("q33_complete_groups", """SELECT l_suppkey, count(DISTINCT n_regionkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(DISTINCT n_regionkey) = (SELECT count(DISTINCT r_regionkey) FROM region)""")
def q33(spark, d):
    return primers.complete_groups(supplier_regions(spark, d), "l_suppkey", "n_regionkey", table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"))


def supplier_regions(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = rows.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return rows.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey").select("l_suppkey", "n_regionkey")


@query("q33_region_shares", """WITH s AS (SELECT DISTINCT l_suppkey, n_regionkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
  SELECT n_regionkey, count(*) / (SELECT count(DISTINCT l_suppkey) FROM s) AS share FROM s GROUP BY 1""")
def q33_shares(spark, d):
    return primers.region_shares(supplier_regions(spark, d), "l_suppkey", "n_regionkey")


@query("q34_merge_80pct", f"""WITH RECURSIVE {IV}, s AS (SELECT l_suppkey, lo, hi, row_number() OVER (PARTITION BY l_suppkey ORDER BY lo, hi) AS k FROM iv),
  f AS (SELECT l_suppkey, k, 1 AS piece, lo, hi, 1 AS members FROM s WHERE k = 1
    UNION ALL SELECT l_suppkey, k, piece + CAST(NOT m AS INT), CASE WHEN m THEN lo0 ELSE lo END, CASE WHEN m THEN greatest(hi0, hi) ELSE hi END, CASE WHEN m THEN members + 1 ELSE 1 END
      FROM (SELECT s.l_suppkey, s.k, f.piece, f.members, f.lo AS lo0, f.hi AS hi0, s.lo, s.hi, CAST(f.hi - s.lo AS DOUBLE) / greatest(f.hi - f.lo, s.hi - s.lo) > CAST(0.8 AS DOUBLE) AS m FROM f JOIN s ON s.l_suppkey = f.l_suppkey AND s.k = f.k + 1))
  SELECT l_suppkey, max(lo) AS lo, max(hi) AS hi, CAST(max(members) AS BIGINT) AS members FROM f GROUP BY l_suppkey, piece""")
def q34(spark, d):
    return intervals.merge_similar(shipped(spark, d).select("l_suppkey", "lo", "hi"), "l_suppkey", "lo", "hi")


@query("q35_chain_dp")
def q35(spark, d):
    """Lines are segments of their order with clips, an insertion and a deletion, on both strands."""
    rows = shipped(spark, d).withColumn("row", F.xxhash64("*")).withColumn("hi", F.col("lo") + 2 * F.col("l_quantity").cast("long") + F.col("l_partkey") % 5 + 8).withColumn("last", F.col("hi") - 1)
    rows = rows.withColumn("cigar", F.expr(CIGAR.replace("BIGINT", "LONG"))).withColumn("from", F.col("l_partkey") * 100).withColumn("reverse", F.col("l_returnflag") == "R")
    return chain.chain_segments(rows, "l_orderkey", "row", "lo", "last", "cigar", "from", reverse="reverse")


def annealed(spark, d, cost=None):
    """Runs over designs: suppliers are designs, their parts primers at their first hit, each strand a region over all of the supplier's days; q13 has the incompatible parts."""
    found = members = hits(spark, d)
    dealt = anneal.many(spark, found.agg(F.approx_count_distinct("l_suppkey")).first()[0])
    if dealt:
        found = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_suppkey")
    parts = found.groupBy("l_suppkey", "l_partkey").agg(F.min(F.struct("pos", "f")).alias("m"), F.max("pos").alias("last"))
    regions = parts.groupBy("l_suppkey").agg(F.min("m.pos").alias("a"), (F.max("last") + 1).alias("b")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("f")).withColumn("forward", F.col("f"))
    parts = parts.select("l_suppkey", "l_partkey", "m.pos", "m.f")
    runs = anneal.anneal_graphs(parts, regions, q13(spark, d), "l_suppkey", "l_partkey", "f", "pos", "a", "b", "forward", "p", "q", 300.0, 0.1, [(-0.5, 100.0, 1), (-2.0, 400.0, 2)], cost=cost, dealt=dealt, members=members)
    return runs.drop("chosen")


@query("q36_anneal")
def q36(spark, d):
    return annealed(spark, d)


@query("q36_anneal_targets")
def q36_targets(spark, d):
    """The same designs by the distances from the regions' inner ends."""
    return annealed(spark, d, anneal.MultiTarget())


@query("q37_last_wins_edges", """WITH u AS (SELECT l_partkey AS p, l_suppkey AS q, 2 * l_orderkey AS seq, l_quantity AS v FROM lineitem UNION ALL SELECT l_partkey, l_suppkey, 2 * l_orderkey + 1, -100.0 FROM lineitem WHERE l_returnflag = 'R')
  SELECT p, q, max({'s': seq, 'v': v}).s AS seq, max({'s': seq, 'v': v}).v AS v FROM u GROUP BY 1, 2""")
def q37(spark, d):
    lines = table(spark, d, "lineitem")
    edges = lines.select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q"), (F.col("l_orderkey") * 2).alias("seq"), F.col("l_quantity").alias("v"))
    bad = lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q"), (F.col("l_orderkey") * 2 + 1).alias("seq"), F.lit(-100.0).alias("v"))
    return primers.last_wins(edges.unionByName(bad), ["p", "q"], "seq")


@query("q38_pivot_records", """SELECT user_id, max(CASE WHEN event_type = 'view' THEN v END) AS "view", max(CASE WHEN event_type = 'click' THEN v END) AS click, max(CASE WHEN event_type = 'purchase' THEN v END) AS purchase, max(CASE WHEN event_type = 'signup' THEN v END) AS signup, max(CASE WHEN event_type = 'error' THEN v END) AS error
  FROM (SELECT user_id, event_type, max(regexp_extract(props, '"k": (\\d+)', 1)) AS v FROM events GROUP BY 1, 2) GROUP BY 1""")
def q38(spark, d):
    records = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.regexp_extract("props", r'"k": (\d+)', 1)).alias("v"))
    return design.pivot_records(records, ["user_id"], "event_type", "v", ["view", "click", "purchase", "signup", "error"])


@query("q39_product_length", """WITH o AS (SELECT l_partkey AS i, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS j FROM lineitem), k AS (SELECT DISTINCT i, j FROM o WHERE j IS NOT NULL),
  p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 100 - p_size ELSE p_size + 5 END AS n FROM part)
  SELECT i AS region_i, j AS region_j, CAST(a.n + b.n AS BIGINT) AS product FROM k JOIN p a ON a.p_partkey = i JOIN p b ON b.p_partkey = j""")
def q39(spark, d):
    ahead = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_partkey"))
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("region_i"), ahead.alias("region_j")).filter("region_j is not null").distinct()
    length = primers.synthesis_length(F.col("p_size"), F.lit(0), F.lit(100), F.col("p_partkey") % 2 == 0, 5)
    return primers.product_lengths(links, table(spark, d, "part").select("p_partkey", length.cast("long").alias("n")), "p_partkey", "n")


@query("q40_binary_labels", """WITH i AS (SELECT c_custkey + 1 AS k FROM customer), z AS (SELECT k, unnest(range(0, 24)) AS b FROM i), t AS (SELECT k, min(CASE WHEN (k >> b) & 1 = 1 THEN b END) AS zeros FROM z GROUP BY 1)
  SELECT k, 24 - zeros AS depth, coalesce((SELECT string_agg(CASE WHEN (k >> (24 - s)) & 1 = 1 THEN 'R' ELSE 'L' END, '' ORDER BY s) FROM unnest(range(1, 24 - zeros)) AS u(s)), '') AS path FROM t""")
def q40(spark, d):
    index = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("k"))
    depth, path = primers.search_labels(F.col("k"), 24)
    return index.select("k", depth.alias("depth"), path.alias("path"))


@query("q41_pair_products", f"""WITH h AS (SELECT l_suppkey, {DAY} AS pos, l_returnflag = 'R' AS f, l_partkey FROM lineitem)
  SELECT least(a.l_partkey, b.l_partkey) AS p, greatest(a.l_partkey, b.l_partkey) AS q, count(*) AS n FROM h a JOIN h b ON a.l_suppkey = b.l_suppkey AND a.f AND NOT b.f AND b.pos - a.pos > 0 AND b.pos - a.pos < 7 GROUP BY 1, 2""")
def q41(spark, d):
    return primers.pair_products(hits(spark, d), "l_suppkey", "pos", "f", "l_partkey", 7)


@query("q42_dense_ids", "SELECT DISTINCT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS frag FROM orders")
def q42(spark, d):
    return junctions.dense_ids(table(spark, d, "orders").select("o_custkey").distinct(), "o_custkey", "frag")


@query("q43_n_rich", "SELECT doc_id, length(text) - length(replace(replace(text, 'n', 'N'), 'N', '')) > length(text) * CAST(0.08 AS DOUBLE) AS rich FROM documents")
def q43(spark, d):
    return table(spark, d, "documents").select("doc_id", sequence.n_rich(F.translate("text", "n", "N"), 0.08).alias("rich"))


COMPONENTS = """WITH RECURSIVE o AS (SELECT DISTINCT {links}), both_ways AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
  r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ways
    UNION SELECT w.b, min(r.component) FROM r JOIN both_ways w ON w.a = r.node JOIN recurring.r AS held ON held.node = w.b WHERE r.component < held.component GROUP BY w.b)
  SELECT node, component FROM r"""


@query("q44_independent_components", COMPONENTS.format(links="o_custkey AS a, 1000000000 + o_orderkey // 7 AS b FROM orders"))
def q44(spark, d):
    """Customers and runs of seven order numbers."""
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.floor(F.col("o_orderkey") / 7) + 1_000_000_000).alias("b"))
    return connected_components(edges, "a", "b")


@query("q44_all_components", COMPONENTS.format(links="o_custkey AS a, 1000000000 + l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey"))
def q44_all(spark, d):
    """Customers and suppliers over the links of all lines, which are counted so that a task joins no more of them in larger tables."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") + 1_000_000_000).alias("b"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("a"))
    tasks = tasks_of(spark, lines.count())
    edges = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "l_orderkey"), "l_orderkey")
    return connected_components(edges, "a", "b")


@query("q32_solution_rows", """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS cost, o_custkey, row_number() OVER (ORDER BY floor(o_totalprice), CAST(o_orderkey AS VARCHAR)) - 1 AS rank FROM orders)
  SELECT CAST(rank AS INT) AS rank, cost, 0 AS region, o_custkey AS position FROM s WHERE rank < 30 UNION ALL SELECT CAST(rank AS INT), cost, 1, o_orderkey FROM s WHERE rank < 30""")
def q32_rows(spark, d):
    orders = table(spark, d, "orders")
    solutions = orders.select(F.col("o_orderkey").cast("string").alias("params"), F.floor("o_totalprice").alias("cost"), F.array(F.array("o_custkey"), F.array("o_orderkey")).alias("primers"))
    return design.solution_rows(solutions, 30)


@query("q45_primers_per_region", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q45(spark, d):
    return primers.primers_per_region(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer"), "c_custkey")


@query("q46_sample_report", f"""WITH {IV}, p AS (SELECT DISTINCT l_suppkey, hi AS at, l_returnflag = 'A' AS f FROM iv),
  n AS (SELECT s.rid, min(abs(s.lo - p.at)) AS m FROM iv s JOIN p ON p.l_suppkey = s.l_suppkey AND p.f = (s.l_linestatus = 'O') AND CASE WHEN p.f THEN s.lo - p.at ELSE p.at - s.lo END BETWEEN 1 AND 19 GROUP BY 1),
  t AS (SELECT l_suppkey, l_linestatus = 'O' AS f, coalesce(m, 20) AS m FROM iv LEFT JOIN n USING (rid))
  SELECT l_suppkey, count(*) FILTER (m < 10) AS covered, count(*) AS total, CAST(coalesce(min(m) FILTER (f) + min(m) FILTER (NOT f), 0) AS BIGINT) AS least, CAST(coalesce(max(m) FILTER (f) + max(m) FILTER (NOT f), 0) AS BIGINT) AS greatest FROM t GROUP BY 1""")
def q46(spark, d):
    lines = shipped(spark, d)
    points = lines.select("l_suppkey", F.col("lo").alias("breakpoint"), (F.col("l_linestatus") == "O").alias("forward"))
    found = lines.select("l_suppkey", F.col("hi").alias("position"), (F.col("l_returnflag") == "A").alias("forward"))
    return deletions.sample_report(deletions.primer_distances(points, found, ["l_suppkey"], "breakpoint", "position", "forward", 10), "l_suppkey", "forward")


@query("q47_strand_coverage", f"""WITH {IV}, w AS (SELECT l_suppkey, l_returnflag = 'A' AS forward, lo - CASE WHEN l_returnflag = 'A' THEN 0 ELSE 5 END AS a FROM iv),
  g AS (SELECT *, max(a + 5) OVER (PARTITION BY l_suppkey, forward ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
  c AS (SELECT l_suppkey, forward, CAST(sum(greatest(0, a + 5 - greatest(a, coalesce(reach, a)))) AS BIGINT) AS covered, max(a) - min(a) + 6 AS total FROM g GROUP BY 1, 2)
  SELECT *, covered / total AS share, total - covered AS uncovered FROM c""")
def q47(spark, d):
    rows = shipped(spark, d).select("l_suppkey", "lo", (F.col("l_returnflag") == "A").alias("forward"))
    return deletions.strand_coverage(rows, ["l_suppkey"], "lo", "forward", 5)


@query("q48_penalty_layers", """WITH b AS (SELECT l_suppkey, l_orderkey // 2000 * 2000 AS bin, l_discount AS p FROM lineitem), t(threshold, before) AS (VALUES (CAST(0.02 AS DOUBLE), CAST(-1 AS DOUBLE)), (0.05, 0.02), (0.08, 0.05))
  SELECT l_suppkey, threshold, bin, count(*) FILTER (p < threshold) AS n, count(*) FILTER (p < threshold) - count(*) FILTER (p < before) AS added FROM b, t GROUP BY 1, 2, 3 HAVING count(*) FILTER (p < threshold) > 0""")
def q48(spark, d):
    return design.penalty_layers(table(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey", "l_discount", [0.02, 0.05, 0.08])


@query("q49_longest_per_position", "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY l_quantity = max(l_quantity) OVER (PARTITION BY l_partkey)")
def q49(spark, d):
    return design.longest_per_position(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey"], "l_quantity")


@query("q50_penalty_sums", "SELECT o_custkey, count(*) AS primers, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS penalty FROM orders GROUP BY 1")
def q50(spark, d):
    return links.penalty_sums(table(spark, d, "orders").select("o_custkey", F.floor("o_totalprice").alias("p")), "o_custkey", "p")


@query("q51_spacings", f"""WITH {OD}, p AS (SELECT o_custkey, day AS x FROM od UNION ALL SELECT c_custkey, 2500 FROM customer), s AS (SELECT o_custkey, x AS "at", lead(x) OVER (PARTITION BY o_custkey ORDER BY x) - x AS spacing FROM p) SELECT * FROM s WHERE spacing IS NOT NULL""")
def q51(spark, d):
    bounds = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(2500).alias("end"))
    return primers.spacings(ordered(spark, d), bounds, ["o_custkey"], "day", "end")


@query("q52_surviving_pairs", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0")
def q52(spark, d):
    return primers.surviving_pairs(table(spark, d, "customer").filter("c_acctbal > 0"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("q53_overlap_counts", f"""WITH {IV}, p AS (SELECT a.l_orderkey, a.rid, count(*) AS o, count(*) FILTER (b.lo <= a.lo AND a.hi <= b.hi) AS c FROM iv a JOIN iv b ON a.l_orderkey = b.l_orderkey AND a.rid <> b.rid AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1, 2),
  t AS (SELECT l_orderkey, sum(o) AS o, sum(c) AS c, count(*) FILTER (c > 0) AS k FROM p GROUP BY 1)
  SELECT iv.l_orderkey, count(*) AS n, CAST(coalesce(any_value(o), 0) AS BIGINT) AS overlaps, CAST(coalesce(any_value(c), 0) AS BIGINT) AS containments, coalesce(any_value(k), 0) AS contained FROM iv LEFT JOIN t ON t.l_orderkey = iv.l_orderkey GROUP BY 1""")
def q53(spark, d):
    return intervals.overlap_counts(shipped(spark, d).withColumn("row", F.xxhash64("*")), "l_orderkey", "row", "lo", "hi", 64)


@query("q54_target_cost", f"""WITH {OD} SELECT c_custkey, CAST(sum(CASE WHEN day IS NULL THEN 2500 WHEN c_custkey % 2 = 0 THEN 2500 - day ELSE day END) AS DOUBLE) AS cost FROM customer LEFT JOIN od ON o_custkey = c_custkey GROUP BY 1""")
def q54(spark, d):
    return primers.COSTS["targets"](_days(spark, d), _regions(spark, d), "c_custkey", "day", "start", "end", "forward")


def _regions(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("start"), F.lit(2500).cast("long").alias("end"), (F.col("c_custkey") % 2 == 0).alias("forward"))


def _days(spark, d):
    return ordered(spark, d).select(F.col("o_custkey").alias("c_custkey"), "day")


@query("q55_gap_cost", f"""WITH {OD}, p AS (SELECT c_custkey AS k, 0 AS kind, 0 AS x FROM customer UNION ALL SELECT c_custkey, 2, 2500 FROM customer UNION ALL SELECT o_custkey, 1, day FROM od JOIN customer ON c_custkey = o_custkey),
  g AS (SELECT k, kind, x - lag(x) OVER w AS gap, lag(kind) OVER w AS before FROM p WINDOW w AS (PARTITION BY k ORDER BY kind, x))
  SELECT k AS c_custkey, CAST(sum(greatest(0, gap - CASE WHEN (k % 2 = 0 AND before = 0) OR (k % 2 <> 0 AND kind = 2) THEN 0 ELSE 300 END)) AS DOUBLE) AS cost FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def q55(spark, d):
    return primers.COSTS["gaps"](_days(spark, d), _regions(spark, d), "c_custkey", "day", "start", "end", "forward", 300.0)


@query("q56_linked_amplicons", f"""WITH {OD}, r AS (SELECT c_custkey AS k, CASE WHEN min(day) IS NULL THEN 2500 WHEN c_custkey % 2 = 0 THEN 2500 - max(day) ELSE min(day) END AS n FROM customer LEFT JOIN od ON o_custkey = c_custkey GROUP BY 1)
  SELECT a.k AS region_i, b.k AS region_j, CAST(a.n + b.n AS BIGINT) AS product FROM r a JOIN r b ON b.k = a.k + 1""")
def q56(spark, d):
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("region_i"), (F.col("c_custkey") + 1).alias("region_j"))
    return primers.linked_amplicons(_days(spark, d), _regions(spark, d), pairs, "c_custkey", "day", "start", "end", "forward")


SOLUTIONS = f"""p AS (SELECT l_suppkey AS solution, n_regionkey AS region, CASE WHEN c_custkey % 50 = 0 THEN 'x' ELSE 'c' END AS contig, {DAY} AS position, n_regionkey % 2 = 0 AS forward, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
  i AS (SELECT solution, region, forward, arg_max({{'contig': contig, 'position': position, 'seq': seq}}, {{'t': CASE WHEN forward THEN position ELSE -position END, 'seq': seq}}) AS m FROM p GROUP BY 1, 2, 3),
  v AS (SELECT solution, region, forward, m.contig AS contig, m.position AS position, m.seq AS seq, m.contig = 'c' AND m.position >= 2 * region AND m.position < 2 * region + 2490 AS valid FROM i),
  w AS (SELECT *, count(*) OVER (PARTITION BY solution) = (SELECT count(*) FROM region) AND bool_and(valid) OVER (PARTITION BY solution) AS complete FROM v)"""


def solutions(spark, d):
    rows = shipped(spark, d).select("l_orderkey", "l_suppkey", "lo", "l_linenumber").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    rows = rows.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    found = rows.select(
        F.col("l_suppkey").alias("solution"), F.col("n_regionkey").alias("region"), F.when(F.col("c_custkey") % 50 == 0, "x").otherwise("c").alias("contig"), F.col("lo").alias("position"), (F.col("n_regionkey") % 2 == 0).alias("forward"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.lit("c").alias("contig"), (F.col("r_regionkey") * 2).cast("long").alias("start"), F.lit(2490).cast("long").alias("length"), (F.col("r_regionkey") % 2 == 0).alias("forward"))
    return links.verified_solutions(found, regions, "solution", "seq"), regions


@query("q57_verified_solutions", f"WITH {SOLUTIONS} SELECT * FROM w")
def q57(spark, d):
    return solutions(spark, d)[0]


@query("q58_first_complete", f"WITH {SOLUTIONS} SELECT * FROM w WHERE solution = (SELECT min(solution) FROM w WHERE complete)")
def q58(spark, d):
    return links.first_complete(solutions(spark, d)[0], "solution")


@query("q59_read_pairs", f"""WITH {OD}, r AS (SELECT o_orderkey // 2 AS pair, {{'at': day, 'k': o_orderkey % 2, 'r': o_orderstatus = 'F'}} AS m FROM od JOIN orders USING (o_custkey, o_orderkey))
  SELECT pair, min(m).at AS x, max(m).at AS y, min(m).r AS x_reverse, max(m).r AS y_reverse FROM r GROUP BY 1 HAVING count(*) = 2""")
def q59(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", _day("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("reverse"))
    return primers.read_pairs(rows, "o_orderkey", "day", "reverse")


@query("q60_cigar_expansion", """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, l_partkey % 5 + 1 AS i, l_suppkey % 7 + 1 AS dl FROM lineitem)
  SELECT l_orderkey, l_linenumber, CAST(2 * a + 7 + i AS BIGINT) AS bases, CAST(i AS BIGINT) AS inserted, CAST(dl AS BIGINT) AS deleted, CAST(a + 2 * i + 3 * (a + 3) + 5 * 4 AS BIGINT) AS numbers FROM c""")
def q60(spark, d):
    """Sums over all bases, from the runs that they lie in."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", runs.run_index(F.expr(CIGAR.replace("BIGINT", "LONG"))).alias("e"))
    add = lambda f: F.aggregate("e", F.lit(0).cast("long"), lambda n, x: n + f(x))
    return rows.select("l_orderkey", "l_linenumber", add(lambda x: x["n"]).alias("bases"), add(lambda x: F.when(x["op"] == "I", x["n"]).otherwise(0)).alias("inserted"), add(lambda x: x["deleted"]).alias("deleted"), add(lambda x: x["n"] * x["number"]).alias("numbers"))


@query("q61_reference_positions", """WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS reverse, CAST(l_quantity AS BIGINT) AS a, l_partkey % 5 + 1 AS i, l_suppkey % 7 + 1 AS dl, CAST(least(10 + l_linenumber, 2 * l_quantity + 7) AS BIGINT) AS o FROM lineitem),
  f AS (SELECT *, CASE WHEN reverse THEN least(4, o) + CASE WHEN o >= 4 THEN dl ELSE 0 END + greatest(0, least(a + 3, o - 4)) + greatest(0, least(a, o - 7 - a - i))
    ELSE least(a, o) + greatest(0, least(a + 3, o - a - i)) + CASE WHEN o >= 2 * a + i + 3 THEN dl ELSE 0 END + greatest(0, least(4, o - 2 * a - i - 3)) END AS far FROM c)
  SELECT l_orderkey, l_linenumber, CAST(CASE WHEN reverse THEN l_orderkey - far ELSE l_orderkey + far END AS BIGINT) AS at FROM f""")
def q61(spark, d):
    offset = F.least(F.lit(10) + F.col("l_linenumber"), 2 * F.col("l_quantity").cast("long") + 7).cast("long")
    at = runs.reference_at(F.expr(CIGAR.replace("BIGINT", "LONG")), offset, F.col("l_orderkey"), F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", at.alias("at"))


@query("q62_sub_interval", """WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS reverse, CAST(l_quantity AS BIGINT) AS a, l_partkey % 5 + 1 AS i, l_linenumber AS h, l_linenumber % 3 + 1 AS s FROM lineitem),
  n AS (SELECT *, h + 2 * a + 7 + i + s AS n FROM c)
  SELECT l_orderkey, l_linenumber, CAST(CASE WHEN reverse THEN n - h ELSE h END AS BIGINT) AS first, CAST(CASE WHEN reverse THEN n - h - a - i ELSE h + a + i END AS BIGINT) AS last FROM n""")
def q62(spark, d):
    first, last = runs.sub_interval(F.expr(CIGAR.replace("BIGINT", "LONG")), F.lit(1), F.lit(3), F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", first.alias("first"), last.alias("last"))


@query("q63_population_ratios", f"""WITH {IV}, dl AS (SELECT l_orderkey AS k, min(lo) AS lo, max(hi) AS hi FROM iv GROUP BY 1), c AS (SELECT DISTINCT dl.k, dl.lo, dl.hi, CAST(l_partkey % 50 AS VARCHAR) AS sample FROM iv JOIN dl ON dl.k = iv.l_orderkey),
  p AS (SELECT CAST(p_partkey % 50 AS VARCHAR) AS sample, any_value(p_partkey % 50 % 4) AS population FROM part WHERE p_partkey % 50 < 45 GROUP BY 1), z AS (SELECT population, count(*) AS size FROM p GROUP BY 1),
  n AS (SELECT lo, hi, population, count(*) AS n FROM c LEFT JOIN p USING (sample) GROUP BY 1, 2, 3)
  SELECT lo, hi, population, n, n / size AS ratio FROM n LEFT JOIN z USING (population)""")
def q63(spark, d):
    found = shipped(spark, d).groupBy("l_orderkey").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set((F.col("l_partkey") % 50).cast("string")).alias("samples"))
    number = (F.col("p_partkey") % 50).alias("k")
    panel = table(spark, d, "part").select(number).distinct().filter("k < 45").select(F.col("k").cast("string").alias("sample"), (F.col("k") % 4).alias("population"))
    return design.population_ratios(found, panel)


@query("q64_alignment_regions", f"""WITH r AS (SELECT l_partkey, CAST(l_quantity AS INT) AS m, l_returnflag AS contig, {DAY} AS a, {DAY} + 20 AS b FROM lineitem WHERE l_linenumber - 1 < 2 AND l_returnflag IN ('A', 'R'))
  SELECT min({{'m': -m, 'c': contig, 'a': a, 'b': b}}).c AS contig, min({{'m': -m, 'c': contig, 'a': a, 'b': b}}).a + 1 AS first, min({{'m': -m, 'c': contig, 'a': a, 'b': b}}).b + 1 AS last, CAST(l_partkey AS VARCHAR) AS primer FROM r GROUP BY l_partkey""")
def q64(spark, d):
    psl = shipped(spark, d).select(F.col("l_quantity").cast("int").alias("match"), (F.col("l_linenumber") - 1).alias("tgap_bases"), F.col("l_returnflag").alias("sseqid"), F.col("l_partkey").cast("string").alias("qseqid"), F.col("lo").alias("sstart"), (F.col("lo") + 20).alias("send"))
    return design.alignments_as_regions(psl, ["A", "R"])


@query("q65_scored_positions", "SELECT p_partkey, p_size FROM part WHERE p_partkey IN (SELECT l_suppkey FROM lineitem UNION SELECT l_orderkey FROM lineitem)")
def q65(spark, d):
    scores = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("p1"), F.col("l_orderkey").alias("p2"))
    return design.scored_positions(table(spark, d, "part").select("p_partkey", "p_size"), scores, "p_partkey")


@query("q66_candidate_subsets", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND (p_brand, p_type) IN (SELECT p_brand, p_type FROM part WHERE p_size > 40)")
def q66(spark, d):
    parts = table(spark, d, "part")
    return design.subset_by_sequence(design.subset_by_window(parts, "p_size", 10, 30), parts.filter("p_size > 40"), ["p_brand", "p_type"]).select("p_partkey")


@query("q67_lowest_scores", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) <= 3")
def q67(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return clusters.lowest_scores(rows, "l_suppkey", "l_extendedprice", ["l_orderkey", "l_linenumber"], 3)


@query("q68_largest_clusters", "SELECT l_partkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey) - 1 AS rank FROM lineitem GROUP BY 1")
def q68(spark, d):
    return clusters.largest_first(table(spark, d, "lineitem"), "l_partkey")


@query("q69_thermo_report", f"""WITH s AS (SELECT p_partkey, {BASES.format('p_name', ", 'g'")} AS q FROM part), v(pair, h, e, g) AS (VALUES {_SQL_PAIRS}),
  p AS (SELECT p_partkey, substr(q, i, 2) AS pair FROM (SELECT p_partkey, q, unnest(range(1, length(q))) AS i FROM s)),
  t AS (SELECT p_partkey, sum(h) AS h, sum(e) AS e FROM p JOIN v USING (pair) GROUP BY 1), a AS (SELECT p_partkey, CAST(left(q, 1) IN ('A', 'T') AS INT) + CAST(right(q, 1) IN ('A', 'T') AS INT) AS ends FROM s),
  x AS (SELECT p_partkey, 0.2 + t.h + 2.2 * ends AS h, -5.7 + t.e + 6.9 * ends AS e FROM t JOIN a USING (p_partkey)), y AS (SELECT *, CAST(h AS DOUBLE) - 323.15 * e / 1000 AS g FROM x)
  SELECT p_partkey, CAST(round(1000 * g) AS BIGINT) AS gibbs, CAST(round(1000 * (-1000 * g / (323.15 * 1.9872041))) AS BIGINT) AS dissociation FROM y""")
def q69(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr(BASES.format("p_name", "")).alias("q")).withColumn("r", thermo.report(F.col("q"), F.lit(1e-6), 50.0))
    return rows.select("p_partkey", F.round(F.col("r.gibbs") * 1000).cast("long").alias("gibbs"), F.round(F.log("r.dissociation") * 1000).cast("long").alias("dissociation"))


@query("q70_rounding", """SELECT c_custkey, c_custkey * 777 // 10000 * 10000 - 10000 AS first, CAST(ceil((c_custkey * 999 + 10000) / 10000.0) AS BIGINT) * 10000 AS last, format('{:,}', c_custkey * 777) AS told,
  CAST(CASE WHEN c_custkey * 7 > 1000 THEN (c_custkey * 7 + 500) // 1000 * 1000 ELSE (c_custkey * 7 + 50) // 100 * 100 END AS BIGINT) AS nice FROM customer""")
def q70(spark, d):
    k = F.col("c_custkey")
    first, last = intervals.rounded_out(k * 777, k * 999)
    return table(spark, d, "customer").select("c_custkey", first.alias("first"), last.alias("last"), design.thousands(k * 777).alias("told"), design.round_nicely(k * 7).cast("long").alias("nice"))


@query("q71_edges_from_scores", """WITH s AS (SELECT least(l_partkey, l_suppkey) AS p, greatest(l_partkey, l_suppkey) AS q, arg_max({'a': -100 * l_tax, 'b': -100 * l_discount, 'c': -l_quantity / 10}, {'s': l_orderkey * 10 + l_linenumber, 'a': -100 * l_tax, 'b': -100 * l_discount, 'c': -l_quantity / 10}) AS m FROM lineitem GROUP BY 1, 2)
  SELECT p, q FROM s WHERE m.a < -7.5 OR m.b < -9.5 OR m.c < -4.5""")
def q71(spark, d):
    scores = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p1"), F.col("l_suppkey").alias("p2"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (-100 * F.col("l_tax")).alias("s1"), (-100 * F.col("l_discount")).alias("s2"), (-F.col("l_quantity") / 10).alias("s3"))
    return primers.edges_from_scores(scores, lambda a, b, c: (a < -7.5) | (b < -9.5) | (c < -4.5))


@query("q72_sample_names", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def q72(spark, d):
    return deletions.sample_names(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("q73_named_noise", f"""SELECT l_orderkey AS a, {DAY} AS b, CAST(l_quantity AS BIGINT) AS d, nullif(l_linestatus, 'F') AS name FROM lineitem WHERE l_quantity <= 30 AND abs(abs(l_orderkey) - abs({DAY})) >= 10 AND l_linestatus <> 'F'""")
def q73(spark, d):
    rows = shipped(spark, d).select(F.col("l_orderkey").alias("a"), F.col("lo").alias("b"), F.col("l_quantity").cast("long").alias("d"), F.expr("nullif(l_linestatus, 'F')").alias("name"))
    return rows.filter(templates.named_noise_filter(F.col("name"), F.col("a"), F.col("b"), F.col("d"), 30))


@query("q74_length_mismatches", "SELECT o_custkey AS name, length, c_nationkey AS found FROM (SELECT DISTINCT o_custkey, o_custkey % 25 AS length FROM orders) LEFT JOIN customer ON c_custkey = o_custkey WHERE length IS DISTINCT FROM c_nationkey")
def q74(spark, d):
    contigs = table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").cast("long").alias("length"))
    return primers.length_mismatches(table(spark, d, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_custkey") % 25).alias("length")), contigs, "name", "length")


@query("q75_labelled_targets", f"""WITH {OD}, p AS (SELECT DISTINCT o_custkey, day FROM od), k AS (SELECT DISTINCT o_custkey FROM od),
  c AS (SELECT o_custkey, day FROM p UNION SELECT o_custkey, 0 FROM k UNION SELECT o_custkey, 2500 FROM k),
  l(i, depth, path) AS (VALUES (1, 3, 'LL'), (2, 2, 'L'), (3, 3, 'LR'), (4, 1, ''), (5, 3, 'RL'), (6, 2, 'R'), (7, 3, 'RR')),
  t AS (SELECT o_custkey, i * (2500 // 8) AS target, depth, path FROM k, l)
  SELECT o_custkey, target, CASE WHEN m > 0 AND m < 2500 THEN m ELSE -1 END AS midpoint, CAST(depth AS BIGINT) AS depth, path
  FROM (SELECT t.o_custkey, t.target, t.depth, t.path, arg_min(c.day, {{'far': abs(c.day - t.target), 'side': -c.day}}) AS m FROM t JOIN c USING (o_custkey) GROUP BY 1, 2, 3, 4)""")
def q75(spark, d):
    return primers.labelled_targets(ordered(spark, d).select("o_custkey", "day"), ["o_custkey"], "day", F.lit(2500), 3).withColumn("midpoint", F.coalesce("midpoint", F.lit(-1).cast("long")))
