"""The folder that the driver and all executors share, and the cutting of plans with checkpoints in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset a local one is set once, in a single local process only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tastemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now and written to the shared folder: what follows neither plans nor computes it again, also when executors are lost.

    A kept frame's plan holds those of all frames below it, at each place that reads them; a cut one's is one scan. Spark removes the files when
    nothing refers to them any more (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
