"""Cluster files: blocks of a ``#`` header, support rows and a ``=`` line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """A row per support: ``cluster`` (place of the block), header fields, and ``frag_idx, bp_idx, left, right, d``."""
    blocks = spark.read.text(path, lineSep="=\n").filter(F.trim("value") != "")
    blocks = blocks.withColumn("cluster", F.monotonically_increasing_id()).withColumn("lines", F.filter(F.split("value", "\n"), lambda x: x != ""))
    head = F.split(F.regexp_replace(F.get("lines", F.lit(0)), "^#", ""), "\t", -1)
    rows = blocks.select("cluster", head.alias("h"), F.posexplode(F.filter("lines", lambda x: ~x.startswith("#"))).alias("place", "row")).withColumn("p", F.split("row", "\t"))
    names = ["frag_idx", "bp_idx", "left", "right", "d"]
    header = ["name", "left_contig", "right_contig"]
    return rows.select(
        "cluster", "place", *[F.get("h", F.lit(i)).alias(c) for i, c in enumerate(header)], *[F.get("h", F.lit(i + 3)).try_cast("double").alias(c) for i, c in enumerate(("mode_left", "mode_right", "mode_d"))], *[F.get("p", F.lit(i)).try_cast("long").alias(c) for i, c in enumerate(names)]
    )


def write_clusters(supports: DataFrame, modes: DataFrame, cluster: str, path: str) -> None:
    """Blocks in the same form: modes with one digit, supports sorted. ``modes`` has ``cluster, name, mode_left, mode_right, mode_d``."""
    names = ["frag_idx", "bp_idx", "left", "right", "d"]
    body = supports.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("s"))
    lines = F.array_join(F.transform("s", lambda r: F.concat_ws("\t", *[r[c].cast("string") for c in names])), "\n")
    head = F.concat(F.lit("#"), F.concat_ws("\t", "name", F.lit(""), F.lit(""), *[F.format_string("%.1f", c) for c in ("mode_left", "mode_right", "mode_d")]))
    body.join(modes, cluster).select(F.concat(head, F.lit("\n"), lines, F.lit("\n=")).alias("value")).write.text(path)
