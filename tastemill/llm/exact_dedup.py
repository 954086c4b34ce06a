"""Exact dedup over a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is digested, reduced to one row a digest, anti-joined
(sort-merge) with the index and what is new is appended.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Within a batch the row with the
largest ``doc_id`` stays; a text that an earlier batch brought stays with that batch's row. Rows that repeat a
``doc_id`` share its decision; a null ``doc_id`` stays only if no row of its group has one. An empty batch
appends nothing and returns no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path, written

ENTRY = "digest binary, keep_id bigint, group_size bigint"


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the SHA-256 of the normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """One entry a digest ever seen: ``digest, keep_id, group_size`` as of the batch that brought it.

    An index that another session made is opened by its ``path``, with the ``buckets`` it was made with.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self.path = path or new_path(spark, self.name)
            if path and self._held():
                spark.sql(
                    f"CREATE TABLE {self.name} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
                )
            else:
                self._append(spark.createDataFrame([], ENTRY))
        else:
            self.path = spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").first()["data_type"]

    def _held(self) -> bool:
        """Whether the path is there already."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _append(self, entries: DataFrame) -> None:
        (
            entries.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def add(self, docs: DataFrame) -> DataFrame:
        """Append what is new of ``docs`` and return a decision for each of its rows.

        ``doc_id, keep_id, group_size, kept, digest``; ``group_size`` counts this batch's copies and, for a text
        already known, the first batch's. A batch that is added again, as after a failure, gets its decisions again.
        """
        batch = written(digests(docs), "digests")
        groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        known = self.spark.table(self.name)
        fresh = written(groups.join(known.hint("merge"), "digest", "left_anti"), "fresh")
        self._append(fresh)
        # Both sides below are shuffled, so that Spark can split the partition of a digest with very many rows.
        entries = self.spark.read.schema(ENTRY).parquet(self.path)
        stale = groups.join(fresh.hint("merge"), "digest", "left_anti").select("digest", F.col("group_size").alias("more"), F.col("keep_id").alias("own"))
        entries = entries.join(stale, "digest", "left").select(
            "digest", "keep_id", (F.col("group_size") + F.when(F.col("own").eqNullSafe(F.col("keep_id")), 0).otherwise(F.coalesce("more", F.lit(0)))).alias("group_size"),
            F.col("more").isNull().alias("is_new"),
        )
        return batch.join(entries.hint("merge"), "digest").select(
            "doc_id", "keep_id", "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("is_new") & F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"), "digest",
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    return (index or DigestIndex(docs.sparkSession)).add(docs)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
