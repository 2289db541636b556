"""Chat formatting with typed content parts [native].

A turn holds an array of parts ``struct<kind, text, ref, tokens>``. Each kind has
a rule, chosen by a visitor (``PLACEHOLDERS``): text parts are escaped and put in
place; image, audio and document parts become a placeholder control string, and
their reference, place and expanded token count are recorded in order.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Escape: ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|``, in roles a line feed becomes ``\\n`` too, so
that no control string can arise from a text and reading back is exact.

Edge cases: null text or null parts are empty, a null role is empty; null
conversation ids form one group; turns sort by turn (nulls first), then role and
content, so ties and repeated rows have one order and all stay; unknown part
kinds fall under the document rule; an empty table gives no rows. A conversation
is one row of output, so its text meets in the end; turns are formatted as rows
and joined in blocks of ``BLOCK`` turns first, so that a conversation with a
third of all turns arrives as few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
BLOCK = 256


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped``: between doubled backslashes, ``\\|`` stands for ``|``."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\|"), F.lit("|"))), "\\")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def text_parts(text: Column) -> Column:
    """A turn of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))


def flattened(parts: Column) -> tuple[Column, Column]:
    """Visits the parts: the turn's flat text, and its attachments ``struct<kind, ref, tokens>`` in order."""
    parts = F.coalesce(parts, F.array().cast("array<struct<kind:string,text:string,ref:string,tokens:bigint>>"))

    def visit(p: Column) -> Column:
        out = F.when(F.coalesce(p["kind"], F.lit("text")) == "text", escaped(F.coalesce(p["text"], F.lit(""))))
        for kind, mark in PLACEHOLDERS.items():
            out = out.when(p["kind"] == kind, F.lit(mark))
        return out.otherwise(F.lit(PLACEHOLDERS["document"]))

    attached = F.filter(parts, lambda p: F.coalesce(p["kind"], F.lit("text")) != "text")
    return F.array_join(F.transform(parts, visit), ""), F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens")))


def format_chats(df: DataFrame, conversation: str, turn: str, role: str, parts: Column) -> DataFrame:
    """A row per conversation: ``conversation, formatted, loss_spans, attachments, expanded_tokens, blocks``.

    ``loss_spans`` is an array of ``struct<start, length>`` in code points of
    ``formatted``: the contents of assistant turns. ``blocks`` is the same text in pieces of ``BLOCK`` turns, each with its
    spans counted from its own start: a span of a long conversation is cut out of a piece, not looked for from the start of all.
    """
    flat, attached = flattened(parts)
    rows = df.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), flat.alias("body"), attached.alias("attached")
    ).select("conversation", "turn", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK).alias("block"), "role", escaped_role(F.col("role")).alias("head"), "body", "attached")
    item = F.struct("turn", "head", "body", (F.col("role") == "assistant").alias("learned"), "attached")
    chunks = rows.groupBy("conversation", "block").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    text = lambda t: F.concat(F.lit(START), t["head"], F.lit("\n"), t["body"], F.lit(END + "\n"))
    # (start, length) of each turn's body within the block, by a running length
    lengths = F.transform("turns", lambda t: F.struct((F.length(t["head"]) + len(START) + 1).cast("long").alias("lead"), F.length(t["body"]).cast("long").alias("body"), t["learned"].alias("learned")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def advance(acc: Column, t: Column) -> Column:
        here = F.array(F.struct((acc["at"] + t["lead"]).alias("start"), t["body"].alias("length")))
        return F.struct((acc["at"] + t["lead"] + t["body"] + len(END) + 1).alias("at"), F.when(t["learned"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    chunks = chunks.select(
        "conversation", "block", F.array_join(F.transform("turns", text), "").alias("chunk"), F.aggregate(lengths, zero, advance).alias("mask"), F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attached")
    )
    whole = chunks.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("block", "chunk", "mask", "attached"))).alias("blocks"))

    def shift(acc: Column, b: Column) -> Column:
        return F.struct((acc["at"] + b["mask"]["at"]).alias("at"), F.concat(acc["spans"], F.transform(b["mask"]["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length")))).alias("spans"))

    return whole.select(
        F.col("conversation").alias(conversation),
        F.array_join(F.transform("blocks", lambda b: b["chunk"]), "").alias("formatted"),
        F.aggregate("blocks", zero, shift, lambda acc: acc["spans"]).alias("loss_spans"),
        F.flatten(F.transform("blocks", lambda b: b["attached"])).alias("attachments"),
        F.transform("blocks", lambda b: F.struct(b["chunk"].alias("formatted"), b["mask"]["spans"].alias("loss_spans"))).alias("blocks"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parse(t: Column) -> Column:
        body = F.substr(t, F.lit(len(START) + 1))
        cut = F.instr(body, "\n")
        return F.struct(unescaped_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(body, cut + 1)).alias("text"))

    return F.transform(turns, parse)


def masked_text(blocks: Column) -> Column:
    """All text under the loss mask, unescaped, from the ``blocks`` of a conversation."""
    own = lambda b: F.transform(b["loss_spans"], lambda s: unescaped(F.substr(b["formatted"], (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(F.flatten(F.transform(blocks, own)), "")


def turns_of(blocks: Column) -> Column:
    """The turns of a conversation, read back from its ``blocks``: ``array<struct<role, text>>``, unescaped."""
    return F.flatten(F.transform(blocks, lambda b: read_back(b["formatted"])))
