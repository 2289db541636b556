"""Stages whose results are kept: a stage that was made of the same inputs with the same parameters is read, not made again."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Stages:
    """Results of stages as tables in ``folder``, which all machines see.

    A result lies in ``folder/name/fingerprint``. The fingerprint is taken of the stage's name and parameters, of the plan of each input, and of the files that the inputs read:
    their paths, lengths and times of change. An input that is another stage's result counts by that one's fingerprint, so a change goes on to whatever
    is made of it. Writing ends with a marker that holds the schema; a folder without the marker is half-written, and is made again. Reading
    a kept result runs no job. An input that reads no file can't be told from another with the same plan and is an error.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, str] = {}
        #: Names of the stages that were made, not read, in order.
        self.made: list[str] = []

    def _path(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _of_input(self, df: DataFrame) -> list:
        files = sorted(df.inputFiles())
        if not files:
            raise ValueError("an input of a kept stage has to come from files")
        kept = {self._made[p] for p in (re.sub(r"/[^/]+$", "", f) for f in files) if p in self._made}
        told = []
        for f in files:
            if re.sub(r"/[^/]+$", "", f) not in self._made:
                place, system = self._path(f)
                status = system.getFileStatus(place)
                told.append([f, status.getLen(), status.getModificationTime()])
        # without the numbers that a session gives to its expressions, and without places
        plan = re.sub(r"#\\d+L?|\\[[^\\]]*file:[^\\]]*\\]", "", df._jdf.queryExecution().analyzed().canonicalized().toString())
        return [plan if not kept else "", sorted(kept), told]

    def fingerprint(self, name: str, inputs: list[DataFrame], parameters: dict) -> str:
        told = [name, [self._of_input(df) for df in inputs], sorted(parameters.items())]
        return hashlib.sha256(json.dumps(told, default=str).encode()).hexdigest()

    def stage(self, name: str, make: Callable[[], DataFrame], inputs: list[DataFrame], **parameters) -> DataFrame:
        """The kept result of a stage, or that of ``make``, written first."""
        mark = self.fingerprint(name, inputs, parameters)
        path = f"{self.folder}/{name}/{mark}"
        marker, system = self._path(f"{path}/_stage.json")
        if system.exists(marker):
            lines = system.open(marker)
            reader = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            schema = StructType.fromJson(json.loads(reader.toString(lines, "UTF-8")))
            lines.close()
        else:
            made = make()
            schema = StructType.fromJson(json.loads(made.schema.json()))
            made.write.mode("overwrite").parquet(path)
            out = system.create(marker, True)
            out.write(bytearray(json.dumps(schema.jsonValue()).encode()))
            out.close()
            self.made.append(name)
        df = self.spark.read.schema(schema).parquet(path)
        for f in df.inputFiles():
            self._made[re.sub(r"/[^/]+$", "", f)] = mark
        return df
