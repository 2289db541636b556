"""Bounds on what meets in one place: batches between Spark and Python workers, and broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROWS = 2000
BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, lean: bool = False) -> DataFrame:
    """``df``, after lowering the session's rows per Arrow batch to ``ROWS`` if they are more, and with ``lean`` their bytes to ``BYTES``.

    Texts are thousands of characters long and some far longer; at the defaults of 10,000 rows and 64 MB a
    worker, and the executor that feeds it, would hold several copies of tens of megabytes. The settings are read when a query runs, so they stay lowered.
    """
    spark = df.sparkSession
    if lean:
        spark.conf.set(_BYTES_SETTING, BYTES)
    if not 0 < int(spark.conf.get(_SETTING)) <= ROWS:
        spark.conf.set(_SETTING, ROWS)
    return df


def give_back() -> None:
    """Gives the memory that this worker no longer uses back to the system, where the system's library can do so."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: The results that workers keep from task to task.
_KEPT: list[Callable] = []


def kept(make: Callable) -> Callable:
    """``make``, whose last result a worker keeps from task to task, until a task that doesn't use it begins (see ``forget``)."""
    held = lru_cache(maxsize=1)(make)
    _KEPT.append(held)
    return held


def forget(but: Callable | None = None) -> None:
    """Lets go of what this worker keeps for other tasks than those that use ``but``. Workers serve the stages of all operators, and would hold it through all of them."""
    others = [held for held in _KEPT if held is not but and held.cache_info().currsize]
    for held in others:
        held.cache_clear()
    if others:
        give_back()


def lighter(step: Callable[[Iterator], Iterator], keeps: Callable | None = None) -> Callable[[Iterator], Iterator]:
    """``step``, which keeps nothing but ``keeps`` of what other tasks have left, and gives memory back when a task ends.

    Workers stay for the next stages, and would hold the most that any task has used.
    """

    def run(batches: Iterator) -> Iterator:
        forget(keeps)
        yield from step(batches)
        give_back()

    return run


#: Most rows of a few longs or short strings that are broadcast; more are joined by shuffles.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are ``BROADCAST_ROWS`` at most by a count."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
