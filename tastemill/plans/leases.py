"""Frames that several counts read, kept by the executors, in memory or on their disks, for as long as a result that reads them is held.

A lease counts its holders. Spark finds a kept frame by its plan, and a plan does not tell a table from its rewritten self; so a lease also knows the
state of the files it was made from, their number, bytes and time of change, and gives way to one of another state. What a lost executor held is computed again.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def files_state(spark: SparkSession, paths: Iterable[str]) -> tuple:
    """Files, bytes and latest time of change of each path; a missing one has none."""
    out = []
    for path in sorted(paths):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p):
            whole = fs.getContentSummary(p)
            out.append((path, whole.getFileCount(), whole.getLength(), fs.getFileStatus(p).getModificationTime()))
        else:
            out.append((path, 0, 0, 0))
    return tuple(out)


@dataclass
class _Lease:
    frame: DataFrame
    state: tuple
    holders: int = 0


#: By application and plan.
_LEASES: dict[tuple[str, int], _Lease] = {}


class Scope:
    """The leases of one result."""

    def __init__(self, spark: SparkSession, paths: Iterable[str] = ()):
        self.spark, self.paths, self.held = spark, tuple(paths), []
        self.state = files_state(spark, self.paths)

    def keep(self, df: DataFrame) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, df.semanticHash())
        lease = _LEASES.get(key)
        if lease and lease.state != self.state:
            lease.frame.unpersist(blocking=True)
            lease = None
        if not lease:
            lease = _LEASES[key] = _Lease(df.persist(StorageLevel.MEMORY_AND_DISK), self.state)
        lease.holders += 1
        self.held.append((key, lease))
        return df

    def release(self) -> None:
        """Gives the leases back; the last holder's release drops a frame. A second call does nothing."""
        held, self.held = self.held, []
        for key, lease in held:
            lease.holders -= 1
            if not lease.holders and _LEASES.get(key) is lease:
                del _LEASES[key]
                if self.spark.sparkContext._jsc is not None:
                    lease.frame.unpersist()

    def bind(self, result: DataFrame) -> DataFrame:
        """Releases when ``result`` is gone."""
        if self.held:
            weakref.finalize(result, self.release).atexit = False
        return result


def held() -> int:
    return len(_LEASES)
