"""Ratings, movies, tags, links and genome tables made from a star schema of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENDS = 1000


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def _events(self) -> DataFrame:
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("userId"))
        rows = self.read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        at = F.col("l_shipdate").cast("timestamp")
        return rows.select(
            F.col("userId").cast("int").alias("userId"), F.col("l_partkey").cast("int").alias("movieId"),
            (F.ceil(F.col("l_quantity") / 5) / 2).cast("float").alias("rating"), F.unix_seconds(at).alias("timestamp"),
            "l_orderkey", "l_linenumber", "l_suppkey",
        )

    def ratings(self, keys: bool = False) -> DataFrame:
        """``keys`` adds the line's own keys, which break ties of time."""
        rows = self._events()
        return rows if keys else rows.select("userId", "movieId", "rating", "timestamp")

    def times(self, n: int = ENDS) -> DataFrame:
        """``timestamp``, in which the first and the last of the ratings' are those of all ratings.

        Of the ``n`` earliest lines the first one of a known order is the first rating, and so at the other end; no other line is joined with the
        orders then. Where none of them has a known order, all ratings are taken.
        """
        lines = self.read("lineitem").select("l_orderkey", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp")).where("timestamp IS NOT NULL")
        orders, found = self.read("orders"), []
        for order in (F.asc("timestamp"), F.desc("timestamp")):
            ends = lines.orderBy(order).limit(n)
            known = orders.join(F.broadcast(ends), F.col("o_orderkey") == F.col("l_orderkey"))
            found.append(known.orderBy(order).select("timestamp").first())
        if None in found:
            return self.ratings().select("timestamp")
        return orders.sparkSession.createDataFrame([(r.timestamp,) for r in found], "timestamp bigint")

    def movies(self) -> DataFrame:
        key = F.col("p_partkey")
        year = F.concat(F.lit(" ("), (1950 + key % 70).cast("string"), F.lit(")"))
        return self.read("part").select(
            key.cast("int").alias("movieId"), F.concat("p_name", F.when(key % 10 != 0, year).otherwise("")).alias("title"),
            F.when(key % 50 != 0, F.concat_ws("|", "p_type", "p_brand")).otherwise("(no genres listed)").alias("genres"),
        )

    def tags(self) -> DataFrame:
        part = self.read("part").select(F.col("p_partkey").cast("int").alias("movieId"), "p_name")
        return self._events().where("l_linenumber <= 2").join(part, "movieId").select(
            "userId", "movieId", F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("tag"), "timestamp"
        )

    def links(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.read("part").select(
            key.cast("int").alias("movieId"), (key + 1000000).alias("imdbId"), F.when(F.col("p_size") % 7 != 0, key + 2000000).alias("tmdbId")
        )

    def genome_tags(self) -> DataFrame:
        return self.read("part").select(F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int").alias("tagId"), F.col("p_brand").alias("tag")).distinct()

    def genome_scores(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").cast("int").alias("movieId"), F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int").alias("tagId"),
            (F.col("p_retailprice") / 4000).cast("float").alias("relevance"),
        )
