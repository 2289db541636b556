"""CIGAR strings as arrays of struct<n, op>, with JVM-side functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the scoring: a matched base, and opening and extending a gap.
MATCH_SCORE, GAP_OPEN, GAP_EXTEND = 0.92, -1.0, -0.2


def parse(cigar: Column) -> Column:
    """``array<struct<n:int,op:string>>``; empty for ``*``."""
    pattern = F.lit(r"(\d+)([MIDNSHPX])")
    return F.zip_with(F.regexp_extract_all(cigar, pattern, 1), F.regexp_extract_all(cigar, pattern, 2), lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))


def with_ops(df: DataFrame, cigar: Column, out: str) -> DataFrame:
    """Adds the parsed operations as a column that is computed once a row.

    Used as a plain expression, ``parse`` would be copied into each place that refers to it, and run again there. A generator of one row keeps it apart.
    """
    return df.withColumn(out, F.explode(F.array(parse(cigar))))


def total(ops: Column, without: str) -> Column:
    """Sum of the lengths of operations that aren't in ``without``."""
    return F.aggregate(F.filter(ops, lambda x: ~x["op"].isin(*without)), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def fragment_length(ops: Column) -> Column:
    return total(ops, "D")


def reference_span(ops: Column) -> Column:
    return total(ops, "IHS")


def leading_clip(ops: Column) -> Column:
    return F.when((F.size(ops) > 0) & F.get(ops, F.lit(0))["op"].isin("H", "S"), F.get(ops, F.lit(0))["n"]).otherwise(0)


def trailing_clip(ops: Column) -> Column:
    last = F.get(ops, F.size(ops) - 1)
    return F.when((F.size(ops) > 1) & last["op"].isin("H", "S"), last["n"]).otherwise(0)


def fragment_interval(ops: Column, reverse: Column) -> tuple[Column, Column]:
    """First and last base on the fragment, from 1; start above end on the reverse strand."""
    n = fragment_length(ops)
    return F.when(reverse, n - leading_clip(ops)).otherwise(1 + leading_clip(ops)), F.when(reverse, 1 + trailing_clip(ops)).otherwise(n - trailing_clip(ops))


def score(ops: Column) -> Column:
    """Sum of M: 0.92 a base, I and D: -1 - 0.2 a base, clips: 0. Other operations are an error."""
    def one(x: Column) -> Column:
        known = F.when(x["op"] == "M", x["n"] * MATCH_SCORE).when(x["op"].isin("I", "D"), GAP_OPEN + GAP_EXTEND * x["n"]).when(x["op"].isin("H", "S"), F.lit(0.0))
        return known.otherwise(F.raise_error(F.lit("operation without a score")).cast("double"))

    return F.aggregate(ops, F.lit(0.0), lambda acc, x: acc + one(x))


def concatenated(first: Column, second: Column) -> Column:
    """Two operation arrays as one, equal neighbours merged."""
    kind = "array<struct<n:int,op:string>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (last["op"] == x["op"])
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["n"] + x["n"]).alias("n"), x["op"].alias("op"))))
        return F.when(same, merged).otherwise(F.concat(acc, F.array(F.struct(x["n"].alias("n"), x["op"].alias("op")))))

    return F.aggregate(F.concat(first, second), F.array().cast(kind), step)


def told(ops: Column) -> Column:
    """The CIGAR text; ``*`` for no operation."""
    return F.when(F.size(ops) == 0, "*").otherwise(F.array_join(F.transform(ops, lambda x: F.concat(x["n"].cast("string"), x["op"])), ""))


def slice_by_query(ops: Column, start: Column, end: Column) -> Column:
    """The operations of the query bases ``[start, end)``, counted from 0 after clips are dropped.

    Deletions belong to the base before them, so one at ``end`` is included. Runs get their query offsets by a running sum
    and are clipped, so no per-base array is built.
    """
    kind = "struct<at:bigint,out:array<struct<n:int,op:string>>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<n:int,op:string>>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        uses = ~x["op"].isin("D", "N")
        stop = acc["at"] + F.when(uses, x["n"]).otherwise(0)
        n = F.when(uses, F.least(stop, end) - F.greatest(acc["at"], start)).otherwise(F.when((acc["at"] > start) & (acc["at"] <= end), x["n"]).otherwise(0)).cast("int")
        return F.struct(stop.cast("long").alias("at"), F.when(n > 0, F.concat(acc["out"], F.array(F.struct(n.alias("n"), x["op"].alias("op"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.filter(ops, lambda x: ~x["op"].isin("H", "S")), zero, step, lambda acc: acc["out"])


def without_clips(ops: Column) -> Column:
    """Operations without one clip at each end."""
    lead = (leading_clip(ops) > 0).cast("int")
    return F.slice(ops, lead + 1, F.greatest(F.size(ops) - lead - (trailing_clip(ops) > 0).cast("int"), F.lit(0)))


def in_fragment_order(ops: Column, reverse: Column) -> Column:
    """Operations without clips in the order of the fragment: turned round on the reverse strand."""
    inner = without_clips(ops)
    return F.when(reverse, F.reverse(inner)).otherwise(inner)


def reference_at(ops: Column, offset: Column, start: Column, reverse: Column) -> Column:
    """Reference position that ``offset`` query bases lead to from ``start``: up, or down on the reverse strand.

    ``ops`` are in the order of the fragment. Matches before the offset count, and deletions after a base before it.
    """
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("far"))

    def step(acc: Column, x: Column) -> Column:
        n = x["n"].cast("long")
        matched = F.when(x["op"] == "M", F.greatest(F.lit(0).cast("long"), F.least(acc["at"] + n, offset) - acc["at"]))
        far = matched.when((x["op"] == "D") & (acc["at"] > 0) & (acc["at"] <= offset), n).otherwise(F.lit(0).cast("long"))
        return F.struct((acc["at"] + F.when(x["op"].isin("M", "I"), n).otherwise(0)).alias("at"), (acc["far"] + far).alias("far"))

    far = F.aggregate(ops, zero, step, lambda acc: acc["far"])
    return F.when(reverse, start - far).otherwise(start + far)


def sub_interval(ops: Column, first: Column, last: Column, reverse: Column) -> tuple[Column, Column]:
    """Query offsets before the operations number ``first`` and ``last``, from the fragment's end on the reverse strand. Deletions take no bases."""
    n = fragment_length(ops)
    before = lambda k: fragment_length(F.slice(ops, F.lit(1), k))
    side = lambda k: F.when(reverse, n - before(k)).otherwise(before(k))
    return side(first), side(last)


def expanded(ops: Column) -> Column:
    """Per query base ``struct<base, deleted, op>``: ``M``, or ``-`` for an insertion; bases deleted after it; the number of its operation.

    Clips are skipped. What is deleted after the last base isn't told, as in the sources that count n - 1 places. An array of the length
    of the query: for runs without it, see ``reference_at`` and ``slice_by_query``.
    """
    zero = F.lit(0)
    rest = lambda k: F.slice(ops, F.lit(k + 1), F.greatest(F.size(ops) - k, zero))
    pairs = F.zip_with(ops, rest(1), lambda x, y: F.struct(x["n"].alias("n"), x["op"].alias("op"), y.alias("next")))
    triples = F.zip_with(pairs, rest(2), lambda x, y: F.struct(x["n"].alias("n"), x["op"].alias("op"), x["next"].alias("next"), y["op"].alias("then")))
    runs = F.filter(F.transform(triples, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda r: r["x"]["op"].isin("M", "I"))

    def bases(r: Column) -> Column:
        x = r["x"]
        base = F.when(x["op"] == "M", "M").otherwise("-")
        plain = F.array_repeat(F.struct(base.alias("base"), zero.alias("deleted"), r["i"].alias("op")), x["n"] - 1)
        after = F.when((x["next"]["op"] == "D") & x["then"].isin("M", "I"), x["next"]["n"]).otherwise(zero)
        return F.concat(plain, F.array(F.struct(base.alias("base"), after.alias("deleted"), r["i"].alias("op"))))

    return F.flatten(F.transform(runs, bases))


#: Score of each operation by its length; others may be passed to ``score_with``.
SCORES = {"M": lambda n: n * MATCH_SCORE, "I": lambda n: GAP_OPEN + GAP_EXTEND * n, "D": lambda n: GAP_OPEN + GAP_EXTEND * n, "H": lambda n: n * 0.0, "S": lambda n: n * 0.0}


def score_with(ops: Column, scores: dict = SCORES) -> Column:
    """Sum of ``scores``, a function of its length for each operation; an operation without one is an error."""

    def one(x: Column) -> Column:
        known = F.when(F.lit(False), F.lit(0.0))
        for op, f in scores.items():
            known = known.when(x["op"] == op, f(x["n"]))
        return known.otherwise(F.raise_error(F.lit("operation without a score")).cast("double"))

    return F.aggregate(ops, F.lit(0.0), lambda acc, x: acc + one(x))
