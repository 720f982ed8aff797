"""Lineage cuts for iterative operators.

A loop writes its state to parquet in a folder every executor can reach and reads it back. A lost
executor then costs a re-read, never a replay of the loop, and the planner sees true file sizes, so
it broadcasts a side only when that side is really small.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


# A folder for sessions in one process that name none; set by whoever starts such a session, never on a cluster.
LOCAL_FOLDER: str | None = None
_ROOTS: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and all runs in one process, ``LOCAL_FOLDER``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and LOCAL_FOLDER and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        named = LOCAL_FOLDER
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def close(spark: SparkSession) -> None:
    """Delete what operators of this application have written so far. Their results can't be read afterwards."""
    for root in _ROOTS.pop(spark.sparkContext.applicationId, []):
        _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """One run's private sub-folder of the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/grovelight-{uuid.uuid4().hex}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        self._step = 0
        self._live: dict[str, list[str]] = {}

    def cut(self, df: DataFrame, name: str = "state", keep: int = 0) -> DataFrame:
        """Write ``df`` and return the written table.

        With ``keep`` > 0 only the newest ``keep`` writes under this name stay on disk; use it for
        loop state that nothing older refers to.
        """
        self._step += 1
        path = f"{self.root}/{name}-{self._step:05d}"
        df.write.parquet(path)
        kept = self._live.setdefault(name, [])
        kept.append(path)
        while keep and len(kept) > keep:
            _delete(self.spark, kept.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def all_of(self, name: str) -> DataFrame:
        """Everything written under ``name`` so far, as one table."""
        return self.spark.read.parquet(*self._live[name])

    def has(self, name: str) -> bool:
        return bool(self._live.get(name))
