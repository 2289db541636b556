"""Sharding by a keyed permutation of global row numbers [native].

Rows get gapless numbers 0..N-1 in the order of their key. A generalised
Feistel network over Z_a x Z_b (a * b >= N, a * b - N < a) with cycle walking
maps them one to one onto 0..N-1. The shuffled place p gives shard ``p % shards``
and slot ``p div shards``: shard counts differ by one at most, slots are gapless,
and a reader can compute the place of row i, or walk a shard in slot order,
without an index. The law is ``rows``.

Edge cases: null and empty texts weigh their overhead only and have the CRC-32 of no bytes (0);
null keys come first; equal keys are told apart by the text's hash, and wholly
equal rows are interchangeable; an empty table gives an empty result. Extra
columns of the input are not carried, so their names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from junctura.functions.checkpoints import shared_table

ROUNDS = 6
WALK = 16
MODULUS = 2_147_483_647


def halves(n: int) -> tuple[int, int]:
    """The sides a, b of the network's domain: a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Multiplier, addend and second multiplier of each round, from a 64-bit linear congruence."""
    state, keys = seed & (2**64 - 1), []
    for _ in range(rounds):
        row = []
        for _ in range(3):
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            row.append(1 + (state >> 33) % (MODULUS - 1))
        keys.append(tuple(row))
    return keys


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def permuted(index: Column, n: int, seed: int) -> Column:
    """The place of row ``index`` of ``n`` rows. Walks on while the place is outside 0..n-1.

    A walk passes at most a * b - n outside places, fewer than ``WALK`` below
    n = 256; beyond, a walk of ``WALK`` steps has a chance under n ** -8. Were it
    ever to happen, the query fails rather than misplace a row.
    """
    a, b = halves(n)
    keys = round_keys(seed)

    def step(x: Column) -> Column:
        pair = F.struct((x % a).alias("l"), _div(x, a).alias("r"))
        rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("pqs", key)], F.lit(a if i % 2 == 0 else b).cast("long").alias("side")) for i, key in enumerate(keys)])

        def one(at: Column, k: Column) -> Column:
            y = (at["r"] % MODULUS * k["p"] + k["q"]) % MODULUS
            y = (y * y % MODULUS * k["s"]) % MODULUS
            return F.struct(at["r"].alias("l"), ((at["l"] + y) % k["side"]).alias("r"))

        # after an even number of rounds the sides have their own ranges again
        return F.aggregate(rounds, pair, one, lambda at: at["l"] + at["r"] * a)

    lost = F.raise_error(F.lit("cycle walk did not end")).cast("long")
    return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), step(index), lambda at, _: F.when(at < n, at).otherwise(step(at)), lambda at: F.when(at < n, at).otherwise(lost))


def numbered(df: DataFrame, order: list[str], name: str = "row_index") -> tuple[DataFrame, int]:
    """``df`` with gapless row numbers from 0 in the order of ``order`` (nulls first), and the count.

    One range exchange; the numbered rows are written as a table, for a second run of
    the exchange might cut the ranges elsewhere. Offsets are sums over a row per
    partition, whose number is a setting and not the data's.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    held = shared_table(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__local": F.monotonically_increasing_id()}))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__rows"), F.min("__local").alias("__first")).orderBy("__part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["__part"], total - r["__first"]))
        total += r["__rows"]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return held.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__local") + F.col("__start")).drop("__part", "__local", "__start"), total


def shard_rows(df: DataFrame, key: str, text: str, shards: int, seed: int = 20_240_601, overhead: int = 16) -> DataFrame:
    """Shard and slot of each row: ``key, size, text_crc32, row_index, shard, slot``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    base = df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("tie"),
    )
    rows, total = numbered(base, ["key", "tie", "size", "text_crc32"])
    place = permuted(F.col("row_index"), total, seed)
    return rows.withColumn("place", place).select(
        F.col("key").alias(key), "size", "text_crc32", "row_index", (F.col("place") % shards).cast("int").alias("shard"), _div(F.col("place"), shards).alias("slot")
    )


def write_shards(rows: DataFrame, path: str) -> None:
    """Shard files: a folder per shard, rows in slot order within each file."""
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
