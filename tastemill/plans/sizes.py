"""Shuffles in proportion to the tables that are read.

By default adaptive plans make as many tasks of a shuffle as there are cores, up to 64 MB of compressed rows each, so that what a task sorts and hashes
grows with the input. Above ``PART_BYTES`` a core, sessions get partitions by the bytes of the input instead; below, and once smaller tables are
read again, their own settings hold.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

PART_BYTES = 8 << 20
LARGE = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
}
PARTITIONS = "spark.sql.shuffle.partitions"

#: By application and setting: the session's own value and the one given here.
_GIVEN: dict[tuple[str, str], tuple[str, str]] = {}


def _own(spark: SparkSession, key: str) -> str:
    """The session's own value, also where another one was given here; one that was set since is its own."""
    now = spark.conf.get(key)
    own, given = _GIVEN.get((spark.sparkContext.applicationId, key), (now, None))
    return own if now == given else now


def enough(own: int, parts: int, files: int) -> int:
    """Partitions of a large shuffle. Up to ``files`` of them each task opens a file a partition, which many tasks make slow; one more and it writes one."""
    n = max(own, parts)
    return files + 1 if files // 2 < n <= files else n


def size_shuffles(spark: SparkSession, n_bytes: int) -> None:
    """Settings for queries that read ``n_bytes`` of tables; results don't depend on them."""
    parts = -(-n_bytes // PART_BYTES)
    large = parts > spark.sparkContext.defaultParallelism
    files = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    for key in (PARTITIONS, *LARGE):
        own = _own(spark, key)
        value = own if not large else str(enough(int(own), parts, files)) if key == PARTITIONS else LARGE[key]
        _GIVEN[spark.sparkContext.applicationId, key] = own, value
        spark.conf.set(key, value)
