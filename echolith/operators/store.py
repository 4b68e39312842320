"""Checkpoints kept in a folder: additions are numbered by the store, versions are only ever appended, and clearing is a version of its own.

A version is a folder of rows (under data/) and, written after it, a line of the log (under log/): what has no line is not there, so a broken addition leaves nothing to be seen.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.operators.matcher import Matcher
from echolith.operators.numbering import numbered, numbered_as_read

ROWS = "ckpt_seq long, timestamp float, duration float, hashes array<long>"
LOG = "version long, kind string, first_seq long, n long, folder string"


@dataclass(frozen=True)
class CheckpointStore:
    """The checkpoints in a folder that the driver and all executors share, as of a version (null: the latest)."""

    spark: SparkSession
    path: str
    version: int | None = None

    def log(self) -> list:
        """The versions up to this one, oldest first: a line each, however large the addition."""
        try:
            lines = self.spark.read.schema(LOG).option("recursiveFileLookup", True).json(f"{self.path}/log").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = []  # nothing was added yet
        return [x for x in lines if self.version is None or x.version <= self.version]

    def _commit(self, version: int, kind: str, first_seq: int, n: int, folder: str | None) -> None:
        """The line of a version; a version that another session wrote meanwhile is an error, and nothing is changed."""
        self.spark.createDataFrame([(version, kind, first_seq, n, folder)], LOG).coalesce(1).write.mode("error").json(f"{self.path}/log/version-{version}")

    def _next(self) -> tuple[int, int]:
        if self.version is not None:
            raise ValueError("an earlier version cannot be changed")
        log = self.log()
        return (log[-1].version + 1, log[-1].first_seq + log[-1].n) if log else (0, 0)

    def add(self, rows: DataFrame, order: list[str] | None = None) -> CheckpointStore:
        """Append rows (timestamp, duration, hashes), numbered after all that were ever added: by the columns of order (which are not kept), else as their partitions hold them."""
        version, first = self._next()
        names = ["timestamp", "duration", "hashes"]
        rows = rows.select(*names, *[F.col(c).alias(f"__order_{i}") for i, c in enumerate(order or [])])
        placed = numbered(rows, "ckpt_seq", [], [f"__order_{i}" for i in range(len(order))]) if order else numbered_as_read(rows, "ckpt_seq")
        folder = f"{self.path}/data/{uuid.uuid4()}"
        placed.select((F.col("ckpt_seq") + first).alias("ckpt_seq"), *names).write.parquet(folder)
        self._commit(version, "add", first, self.spark.read.schema(ROWS).parquet(folder).count(), folder)
        return self

    def clear(self) -> CheckpointStore:
        """Hide all that is there; earlier versions can still be read."""
        version, first = self._next()
        self._commit(version, "clear", first, 0, None)
        return self

    def as_of(self, version: int) -> CheckpointStore:
        return CheckpointStore(self.spark, self.path, version)

    def _visible(self) -> list:
        log = self.log()
        cleared = max((x.version for x in log if x.kind == "clear"), default=-1)
        return [x for x in log if x.kind == "add" and x.version > cleared]

    def count(self) -> int:
        """How many checkpoints there are, by the log alone."""
        return sum(x.n for x in self._visible())

    def checkpoints(self) -> DataFrame:
        """ckpt_seq, timestamp, duration and hashes of all checkpoints added since the last clearing."""
        folders = [x.folder for x in self._visible()]
        return self.spark.read.schema(ROWS).parquet(*folders) if folders else self.spark.createDataFrame([], ROWS)

    def matcher(self, max_drift: int = 0) -> Matcher:
        return Matcher(self.checkpoints(), max_drift)
