"""Junctions between consecutive segments of a fragment, in signed coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from junctura.functions.checkpoints import shared_table


def running_sum(df: DataFrame, order: list[str | Column], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each in ``order``, which must tell rows apart; 0 for the first.

    Ranges of the order are summed up apart, and what comes before a range is the sum of one row for each: no task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.withColumn("__value", value).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = shared_table(held.withColumns({"__part": F.spark_partition_id(), "__local": F.monotonically_increasing_id()}))
    before = lambda w: F.coalesce(F.sum("__value").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row for each range, and there are as many as shuffle partitions
    totals = held.groupBy("__part").agg(F.sum("__value").alias("__value"))
    offsets = totals.select("__part", before(W.orderBy("__part")).alias("__start"))
    inside = held.withColumn("__inside", before(W.partitionBy("__part").orderBy("__local")))
    return inside.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__start") + F.col("__inside")).select(*df.columns, out)


def dense_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """0-based rank of each key among the sorted distinct keys, by ``running_sum`` over the keys alone."""
    return df.join(running_sum(df.select(key).distinct(), [key], F.lit(1), out).withColumn(out, F.col(out).cast("long")), key)


def signed(position: Column, forward: Column) -> Column:
    """Strand as sign."""
    return F.when(forward, position).otherwise(-position)


def junctions(df: DataFrame, fragment: str, order: list[str], left: str, right: str, read_start: str, read_end: str, max_distance: int | None = None) -> DataFrame:
    """One row per pair of consecutive segments: ``fragment, ordinal, a, b, d``.

    A segment runs from ``left`` to ``right`` on the reference, backward if left > right, and from
    ``read_start`` to ``read_end`` on the fragment. a is the end of one segment, negative if it runs
    forward; b the start of the next, positive if it runs forward; d the gap between them on the fragment. With
    ``max_distance`` only junctions with a smaller d count, and ordinals skip the others.
    """
    w = W.partitionBy(fragment).orderBy(*order)
    ahead = lambda c: F.lead(c).over(w)
    pairs = df.select(
        fragment, *[c for c in order if c != fragment], left, right, read_end, ahead(left).alias("__l"), ahead(right).alias("__r"), ahead(read_start).alias("__s")
    ).filter(F.col("__l").isNotNull())
    out = pairs.select(
        fragment, *[c for c in order if c != fragment],
        (-signed(F.col(right), F.col(left) <= F.col(right))).alias("a"),
        signed(F.col("__l"), F.col("__l") <= F.col("__r")).alias("b"),
        (F.col("__s") - F.col(read_end) - 1).alias("d"),
    )
    if max_distance is not None:
        out = out.filter(F.col("d") < max_distance)
    return out.withColumn("ordinal", (F.row_number().over(W.partitionBy(fragment).orderBy(*order)) - 1).cast("long")).select(fragment, "ordinal", "a", "b", "d")
