"""Mixing sources to target weights by fitting subset sums.

Documents are counted by exact token length within each source. A source's
target is met by whole rounds over all its documents, then a share of each
length's count, then the rest of the budget: a bounded-knapsack dynamic
program over the lengths picks the counts whose sum comes nearest. Documents are
then selected by seeded order within their length: each length has one place in that order up to which
documents are taken. Only counts by length reach
the program, one group per source; documents never leave Spark.

Words are counted once into narrow rows (source, size, order), from which everything is decided. A row for each source and length is
then joined to the documents: broadcast after a count while there are ``BROADCAST_ROWS`` at most, so that no text moves and no
hot source or length meets in a task; beyond that by one shuffle.

Edge cases: a null text has size 0, is never taken and adds nothing; a null
source is a source of its own, last in order; null and repeated ids are rows
of their own. Rows with one id and text share a place in the order; where it is the last one, they are told
apart by their other columns, and equal rows by number. An empty table gives an empty result. Extra columns of the input are not
carried by ``mix_sources``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from junctura.functions.checkpoints import shared_table
from junctura.llm.batches import small

WORD = r"[^ \t-\r]+"
WEIGHTS = (3, 1, 2)
#: Bits of the order that name a cell: a length's cells are taken whole by count, only one of them is ranked.
CELL_BITS = 10


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of the sources (``absent, source, source_size``): ``share`` of all sizes by weight.

    No target exceeds ``cap`` times its source's size; the excess goes to the
    others by weight until none is above. In closed form the targets are
    min(cap * size, level * weight), with the level found by walking sources in
    the order in which they reach their cap. A row per source.
    """
    turn = F.row_number().over(W.orderBy("absent", "source")) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("most") / F.col("weight"), "absent", "source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source that stays under its cap fixes the level for itself and all later ones
    rows = rows.withColumn("under", F.col("level") * F.col("weight") < F.col("most"))
    rows = rows.withColumn("fixed", F.first(F.when(F.col("under"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select("absent", "source", "source_size", F.when(F.col("fixed").isNull(), F.col("most")).otherwise(F.least("most", F.col("fixed") * F.col("weight"))).alias("target"))


def fit_counts(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that the lengths sum nearest to ``budget``.

    A proportional share of every count is taken first, rounded down, then one
    more of each length, longest first, while it fits. What remains is below
    the smallest length that still has a document, or little above it; swaps are
    searched by a bounded knapsack over a window of sums: up to ``slack`` words are
    given back, and every sum up to the window is reached exactly if it can be.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    taken = [int(c * budget // total) for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, taken))
    for i in order:
        more = min(counts[i] - taken[i], rest // lengths[i])
        more = min(more, 1)
        taken[i] += more
        rest -= more * lengths[i]
    for i in order:
        more = min(counts[i] - taken[i], rest // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    # give back a few short documents, so that the program has room to choose
    for i in reversed(order):
        if rest >= 4 * lengths[order[-1]] + 2000:
            break
        back = min(taken[i], max(0, -(-(2000 - rest) // lengths[i])), 64)
        taken[i] -= back
        rest += back * lengths[i]
    full = (1 << (rest + 1)) - 1
    reach, steps = 1, []
    for i in reversed(order):
        if lengths[i] > rest or reach >> rest & 1:
            break
        left, k = min(counts[i] - taken[i], rest // lengths[i]), 1
        while left > 0:
            k = min(k, left)
            steps.append((i, k, reach))
            reach |= (reach << (k * lengths[i])) & full
            left -= k
            k *= 2
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += k
            at -= k * lengths[i]
    return taken


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """Plan of one source from its counts by length."""
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    rounds = int(target // size) if size else 0
    budget = int(round(target)) - rounds * size
    group = group.sort_values("size")
    group["more"] = fit_counts(group["size"].tolist(), group["docs"].tolist(), max(0, budget))
    group["rounds"] = rounds
    return group[["absent", "source", "size", "rounds", "more"]]


def _narrow(key: str, text: str, source: str, seed: int) -> list[Column]:
    """``absent, source, size, luck`` of a document; luck is its place in the seeded order."""
    luck = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text))
    return [F.col(source).isNull().alias("absent"), F.coalesce(F.col(source), F.lit("")).alias("source"), word_count(F.col(text)).alias("size"), luck.alias("luck")]


def _cuts(narrow: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """``absent, source, size, source_size, target, rounds, cut, take, same``: a row per source and length.

    Every document is taken ``rounds`` times, those up to luck ``cut`` once more; of the ``same`` documents just there only ``take``.
    """
    of = ["absent", "source", "size"]
    cells = shared_table(narrow.withColumn("cell", F.shiftright("luck", 64 - CELL_BITS)).groupBy(*of, "cell").agg(F.count("*").alias("n")))
    counts = cells.groupBy(*of).agg(F.sum("n").alias("docs"))
    sizes = counts.groupBy("absent", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    lengths = shared_table(counts.join(water_level(sizes, share, cap, weights), ["absent", "source"]))
    plan = lengths.filter("size > 0").groupBy("absent", "source").applyInPandas(_fit, "absent boolean, source string, size long, rounds long, more long")
    plan = shared_table(lengths.drop("docs").join(plan, of, "left").withColumn("rounds", F.coalesce("rounds", F.lit(0))).withColumn("more", F.coalesce("more", F.lit(0))))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*of).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = cells.withColumn("before", before).join(plan, of).filter("more > before AND more <= before + n").select(*of, "cell", (F.col("more") - F.col("before")).alias("room"))
    held = narrow.withColumn("cell", F.shiftright("luck", 64 - CELL_BITS)).join(small(cut), [*of, "cell"])
    ranked = held.select(*of, "luck", "room", F.row_number().over(W.partitionBy(*of).orderBy("luck")).alias("rank"), F.rank().over(W.partitionBy(*of).orderBy("luck")).alias("first"))
    last = ranked.groupBy(*of, "luck", "room", "first").agg(F.count("*").alias("same")).filter("room >= first AND room < first + same")
    last = last.select(*of, F.col("luck").alias("cut"), (F.col("room") - F.col("first") + 1).alias("take"), "same")
    return shared_table(plan.drop("more").join(last, of, "left"))


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``row`` (a struct), the columns of ``cuts`` and ``copies`` of every one of ``rows`` (``row, absent, source, size, luck``)."""
    of = ["absent", "source", "size"]
    rows = rows.join(small(cuts), of).withColumn("copies", F.col("rounds") + F.when(F.col("luck") <= F.col("cut"), 1).otherwise(0))
    if cuts.filter("take < same").isEmpty():
        return rows
    # rows that share the last place: equal ones are counted, and told apart by number
    split = F.coalesce((F.col("luck") == F.col("cut")) & (F.col("take") < F.col("same")), F.lit(False))
    tied = rows.filter(split).groupBy(*[c for c in rows.columns if c not in ("copies", "luck")]).agg(F.count("*").alias("equal"))
    before = F.sum("equal").over(W.partitionBy(*of).orderBy(F.col("row").cast("string")).rowsBetween(W.unboundedPreceding, -1))
    tied = tied.withColumn("of_these", F.least("equal", F.greatest(F.lit(0), F.col("take") - F.coalesce(before, F.lit(0)))))
    tied = tied.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("equal")))).withColumn("copies", F.col("rounds") + (F.col("number") <= F.col("of_these")).cast("int"))
    return rows.filter(~split).drop("luck").unionByName(tied.drop("equal", "of_these", "number"))


def mix_sources(df: DataFrame, key: str, text: str, source: str, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """``key, source, size, source_size, target, taken`` of each row.

    ``taken`` is the number of the document's words in the mix: a multiple of its
    size, at most ``ceil(cap)`` times.
    """
    rows = shared_table(df.select(F.struct(F.col(f"`{key}`").alias(key)).alias("row"), *_narrow(key, text, source, seed)))
    taken = _taken(rows, _cuts(rows.drop("row"), share, cap, weights))
    return taken.select(F.col(f"row.`{key}`").alias(key), F.when(~F.col("absent"), F.col("source")).alias(source), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, key: str, text: str, source: str, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mix itself: the columns of ``df``, each row as often as it is taken."""
    cuts = _cuts(shared_table(df.select(*_narrow(key, text, source, seed))), share, cap, weights)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_narrow(key, text, source, seed))
    taken = _taken(rows, cuts).filter("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
