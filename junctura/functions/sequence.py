"""Scalar functions on sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def reverse_complement(s: Column) -> Column:
    """Reverse complement of upper-case ACGTN; other signs, lower case too, are only reversed."""
    return F.reverse(F.translate(s, "ACGTN", "TGCAN"))


def n_rich(s: Column, share: float = 0.4) -> Column:
    """Whether more than ``share`` of the bases are N."""
    return F.length(s) - F.length(F.replace(s, F.lit("N"), F.lit(""))) > F.length(s) * share


def wrapped(s: Column, width: int = 80) -> Column:
    """Line feeds after every ``width`` signs."""
    return F.regexp_replace(s, f"(.{{{width}}})(?!$)", "$1\n")


def segment(s: Column, first: Column, last: Column) -> Column:
    """Bases first to last, both included, counted from 1."""
    return F.substr(s, first.cast("int"), (last - first + 1).cast("int"))


def parse_region(text: Column) -> tuple[Column, Column, Column]:
    """Contig, start and end of ``contig:start-end``."""
    part = lambda i: F.regexp_extract(text, r"^(.+):(\d+)-(\d+)$", i)
    return part(1), part(2).cast("long"), part(3).cast("long")


def fusion(sequence: Column, first_start: Column, first_end: Column, second_start: Column, second_end: Column) -> Column:
    """Two windows of a sequence joined."""
    return F.concat(segment(sequence, first_start, first_end), segment(sequence, second_start, second_end))
