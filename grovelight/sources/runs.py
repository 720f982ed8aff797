"""Resumable runs: what is left to do, appending results, refreshing some of them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def pending(plan: DataFrame, done: DataFrame, keys: Sequence[str], expected_n: Column | int) -> DataFrame:
    """Plan rows whose result is missing or has another row count than the data."""
    expected = F.lit(expected_n) if isinstance(expected_n, int) else expected_n
    complete = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == expected)
    return plan.join(complete.select(*keys), list(keys), "left_anti")


def append_results(df: DataFrame, path: str, by: str = "method") -> None:
    df.write.mode("append").partitionBy(by).parquet(path)


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key has no new rows, plus the new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


class Ledger:
    """Results of a plan in a shared folder, one part for each key, each there once or not at all.

    A part is written under a name of its own first. It counts from the moment a small file named after the key points to it, and that
    file is only ever created, never replaced. A run that dies leaves at most parts that nothing points to, and of two runs
    that finish one key the first one's part counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self) -> dict[str, str]:
        """The committed keys and where their parts lie."""
        path, fs = self._path("commits")
        if not fs.exists(path):
            return {}
        names = [f.getPath().toString() for f in fs.listStatus(path)]
        lines = self.spark.read.text(names, wholetext=True).collect() if names else []  # one short file a key
        return dict(r["value"].rsplit("\n", 1) for r in lines if "\n" in r["value"])

    def commit(self, key: str, df: DataFrame) -> bool:
        """Write ``df`` as the part of ``key``; false if another run was first."""
        part = f"parts/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{part}")
        path, fs = self._path(f"commits/{hashlib.sha256(key.encode()).hexdigest()}")
        if fs.exists(path):
            return False
        draft, _ = self._path(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(f"{key}\n{part}".encode()))
        out.close()
        fs.mkdirs(path.getParent())
        return bool(fs.rename(draft, path))  # fails where the target has come to exist

    def results(self) -> DataFrame | None:
        """All committed parts as one table; none yet: ``None``."""
        parts = sorted(self.parts().values())
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts]) if parts else None
