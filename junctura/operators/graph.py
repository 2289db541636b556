"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from junctura.functions.checkpoints import shared_table


#: Rows for which a small table gets a task, and most rows of a task, whatever shuffle partitions the session has.
ROWS_PER_TASK, MOST_ROWS = 100_000, 1_000_000
#: Most nodes whose labels are broadcast.
BROADCAST_ROWS = 1_000_000


def tasks_of(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` rows of a few longs: few for few rows, then as many as the session's shuffle partitions, then one for each ``MOST_ROWS``, so that what a task holds stays as it is."""
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // MOST_ROWS))
    return max(1, min(-(-rows // ROWS_PER_TASK), most))


def _shortened(spread: DataFrame, nodes: int, tasks: int) -> DataFrame:
    """Labels replaced by their own label.

    Only labels that have another one are looked up, each once: in late rounds few or none, though all nodes of a component then have one label. If many
    have, those of more than ``MOST_ROWS`` nodes are looked up by a broadcast, as one task would get all their nodes.
    """
    counted = spread.groupBy("component").agg(F.count("*").alias("rows"))
    moved = spread.filter("node != component").select(F.col("node").alias("component"), F.col("component").alias("further"))
    moved = shared_table(counted.join(moved, "component").select("component", "further", "rows"), files=tasks)
    count = moved.count()
    if not count:
        return spread.select("node", "component")
    least = F.least("component", F.coalesce("further", "component")).alias("component")
    if count <= BROADCAST_ROWS:
        return shared_table(spread.join(F.broadcast(moved), "component", "left").select("node", least))
    # labels with so many nodes are few
    spread = spread.join(F.broadcast(moved.filter(F.col("rows") > MOST_ROWS).select("component", F.col("further").alias("far"))), "component", "left")
    apart = spread.filter("far IS NULL").select("node", "component").repartition(tasks_of(spread.sparkSession, nodes), "component")
    others = apart.join(moved.filter(F.col("rows") <= MOST_ROWS), "component", "left").select("node", least)
    return shared_table(others.unionByName(spread.filter("far IS NOT NULL").select("node", F.least("component", "far").alias("component"))))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100) -> DataFrame:
    """``node, component``: the smallest node of each component, for nodes that have an edge.

    Minimum labels spread over the edges, to the ends and to the nodes that label them, and are then
    shortened by looking up the label's label, so a path of n nodes takes about log n rounds. Each round is written and read again, and only
    counts reach the driver. Edges are written once as they come and counted, so a task gets ``MOST_ROWS`` of them at most however many there are. Edges with a null end are ignored;
    loops make a node of its own component; direction and repeats don't matter.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    ends = shared_table(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    spark = ends.sparkSession
    pairs = shared_table(ends.repartition(tasks_of(spark, ends.count()), "a", "b").distinct())
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    links = tasks_of(spark, 2 * pairs.count())
    # small edge tables go through few tasks, however many shuffle partitions the session has; ``coalesce`` would hold what each of them holds
    few = links < int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_node = lambda df: (df.repartition(links, "node") if few else df).groupBy("node")
    labels = shared_table(by_node(both).agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")))
    nodes = labels.count()
    tasks = tasks_of(spark, nodes)
    for _ in range(max_rounds):
        # each end of an edge hears of the other's label, and so does its own label's node
        near = labels.select(F.col("node").alias("other"), F.col("component").alias("near"))
        if nodes <= BROADCAST_ROWS:
            met = both.join(F.broadcast(near), "other")
        else:
            met = both.repartition(links, "other").join(near.repartition(links, "other"), "other")
        told = by_node(met).agg(F.min("near").alias("near"))
        heard = labels.join(told, "node").select("node", "component", "near")
        hooks = heard.groupBy(F.col("component").alias("node")).agg(F.min("near").alias("hook"))
        spread = heard.join(hooks, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near", F.coalesce("hook", "near")).alias("component"))
        held = shared_table(spread)
        if held.filter(F.col("component") != F.col("old")).isEmpty():
            return labels
        labels = _shortened(held.select("node", "component"), nodes, tasks)
    raise RuntimeError("components did not settle")
