"""Tables that are replaced as a whole and read while they are.

A version is a folder of Parquet files with a name of its own. It becomes current
when its row is appended to the table's log, and only then: a write that fails,
or a task that runs twice, leaves a folder that no log row names. Readers take
the folder of the largest version in the log. One writer at a time.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.operators.sidecars import optional_table
from silvergrain.session import drop_folder

LOG = "version long, folder string, note string"


class VersionedTable:
    """A table below ``path``; every commit is its next version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        """``version, folder, note`` of all commits."""
        return optional_table(self.spark, f"{self.path}/log", LOG)

    def _latest(self):
        return self.log().orderBy(F.desc("version")).first()

    def commit(self, rows: DataFrame, note: str = "") -> int:
        """Writes ``rows`` as the next version and makes it current. They may be made from the current one."""
        latest = self._latest()
        version = latest["version"] + 1 if latest else 1
        folder = f"v{version}-{os.urandom(6).hex()}"
        rows.write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(version, folder, note)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def current(self) -> DataFrame:
        latest = self._latest()
        if not latest:
            raise ValueError(f"nothing was committed to {self.path}")
        return self.spark.read.parquet(f"{self.path}/{latest['folder']}")

    def drop_old(self, keep: int = 1) -> None:
        """Deletes the files of all but the newest ``keep`` versions; their log rows stay."""
        for row in self.log().orderBy(F.desc("version")).collect()[keep:]:
            drop_folder(f"{self.path}/{row['folder']}")
