"""Connected groups of a link table, by hooking to the smallest neighbour and pointer jumping, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: each linked node with the smallest node of its group. Null ends and self links are ignored.

    In each round every group hooks to its smallest neighbour group, chains of hooks are shortened to their roots, and links
    inside a group go. The rounds are about the logarithm of the longest path.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left = written(both, "links")
    labels = written(left.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not left.isEmpty():
        hooks = left.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        hooks = written(hooks, "hooks")
        while True:
            onward = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = written(hooks.join(onward, "to").select("a", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")), "hooks")
            hooks = jumped.select("a", "to")
            if jumped.where("moved").isEmpty():
                break
        step = hooks.withColumnRenamed("a", "component")
        labels = written(
            labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels"
        )
        from_, to = hooks.select("a", F.col("to").alias("ta")), hooks.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        left = written(left.join(from_, "a").join(to, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "links")
    return labels
