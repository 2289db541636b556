"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, the folder given to ``setCheckpointDir``, or the warehouse's.

    Only a local session, as in tests, gets a temporary folder of this machine instead: other machines don't see one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        folder = getattr(context, "_junctura_folder", None)
        if folder is None:
            given = context._jsc.sc().getCheckpointDir()
            if given.isDefined():
                folder = given.get()
            elif context.master.startswith("local"):
                folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
            else:
                folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/junctura"
            context._junctura_folder = folder
    return folder.rstrip("/")


def remove_tables(spark: SparkSession) -> None:
    """Removes the tables that this process has written with ``shared_table``. Frames that were made from them can't be read any more."""
    context = spark.sparkContext
    for path in _WRITTEN:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.clear()


def shared_table(df: DataFrame, files: int | None = None, group_bytes: int | None = None, huge_rows: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    ``files`` gathers a table that is small against the work that made it, which many tasks
    have a bit of, into so many files by a last exchange. ``group_bytes`` bounds the row groups of a table with large
    rows: Parquet's default of 128 MB is held in memory by each task that writes, and decoded by each that reads.
    The writer looks at sizes after a hundred rows only; with ``huge_rows``, of which a few fill a row group or a page, it looks after each.

    Blocks on the write, so later jobs all see the same rows even if executors are lost meanwhile. A written
    table is used rather than ``checkpoint()`` for two reasons: it is columnar and compressed, and it
    starts a fresh plan, while a checkpoint keeps the constraints of the plan it was made from, which
    grow with each round of an iteration. Tables stay until ``remove_tables`` or whoever clears the folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    writer = (df if files is None else df.repartition(files)).write
    writer = writer if group_bytes is None else writer.option("parquet.block.size", group_bytes)
    (writer.option("parquet.page.size.row.check.min", 1) if huge_rows else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
