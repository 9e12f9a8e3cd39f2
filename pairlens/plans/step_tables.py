"""Tables that grow by whole increments: the step outputs of a resumable job (IO3, AG7, J3).

A step writes its new rows to a folder of their own and publishes the folder by an
empty marker file, created only after the write has succeeded. Readers list the
markers and read those folders, so what a killed run left behind is never seen, and
a rerun finds out by the published keys what is still to do. Nothing is rewritten
or appended to, which works on any file system that Spark writes to.

One job writes to a root at a time; any number may read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class StepTable:
    """The table ``name`` under ``root``: ``parts/<number>-<random>`` folders and ``published`` markers."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def parts(self) -> list[str]:
        """Published increments, oldest first."""
        return self._names("published")

    def read(self) -> DataFrame | None:
        """All published rows; None if nothing has been published."""
        names = self.parts()
        return self.spark.read.parquet(*[f"{self.path}/parts/{n}" for n in names]) if names else None

    def publish(self, rows: DataFrame) -> None:
        """Write ``rows`` as the next increment, then make it visible."""
        number = 1 + max([int(n.split("-")[0]) for n in self.parts()], default=-1)
        part = f"{number:06d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/parts/{part}")
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/published"))
        if not self._fs.createNewFile(self._hadoop.Path(f"{self.path}/published/{part}")):
            raise RuntimeError(f"increment {part} of {self.path} was published by another run")

    def sweep(self) -> list[str]:
        """Delete the folders that broken-off runs left unpublished (not while a job runs); their names."""
        stale = sorted(set(self._names("parts")) - set(self.parts()))
        for n in stale:
            if not re.fullmatch(r"\d{6}-[0-9a-f]{32}", n):
                raise RuntimeError(f"{self.path}/parts/{n} is not an increment")
            self._fs.delete(self._hadoop.Path(f"{self.path}/parts/{n}"), True)
        return stale


def increment_number() -> Column:
    """The number of the increment that a row of ``StepTable.read()`` comes from."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/parts/(\d{6})-", 1).cast("long")
