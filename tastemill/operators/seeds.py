"""Rules addressed by token: a table with a row for each token of each rule, in folders by a hash of the token, so that a seed reads one folder.

The table is written partitioned by ``bucket``; reading it with ``of_token`` prunes all other buckets by their folders' names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recommend as R

BUCKETS = 64
SCHEMA = (
    "antecedent array<string>, consequent array<string>, support double, confidence double, lift double, leverage double, conviction double, "
    "rule_type string, token string, bucket int"
)


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def seed_index(rules: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``token, bucket`` beside the columns of ``rules``, once for each token that a rule holds on either side."""
    rows = rules.withColumn("token", F.explode(F.array_union("antecedent", "consequent")))
    return rows.withColumn("bucket", bucket_of(F.col("token"), buckets))


def write_index(rules: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """One task writes a bucket's rows, sorted by token, so that a token's row groups are few."""
    rows = seed_index(rules, buckets).repartition("bucket").sortWithinPartitions("bucket", "token")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def of_token(index: DataFrame, token: str, buckets: int = BUCKETS) -> DataFrame:
    """The rules that hold a token; the bucket is a constant for the scan."""
    bucket = index.sparkSession.range(1).select(bucket_of(F.lit(token), buckets).alias("b")).first()["b"]
    return index.where((F.col("bucket") == bucket) & (F.col("token") == token)).drop("token", "bucket")


def of_tokens(index: DataFrame, tokens: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rules that hold one of a few tokens, each rule once."""
    rows = index.sparkSession.createDataFrame([(t,) for t in tokens], "t string").select(bucket_of(F.col("t"), buckets).alias("b")).distinct().collect()
    held = index.where(F.col("bucket").isin([r.b for r in rows]) & F.col("token").isin(tokens)).drop("token", "bucket")
    return held.dropDuplicates(["antecedent", "consequent"])


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index of exported rules; one without rules has no files, and so the schema is stated."""
    return spark.read.schema(SCHEMA).parquet(path)


def advice(
    movie_rules: DataFrame, tag_rules: DataFrame, genre_rules: DataFrame, every_genre_rule: DataFrame, movies: DataFrame, seed: str, k: int = 10,
    evidence: int = 3, tags: int = 5, **thresholds,
) -> dict[str, DataFrame]:
    """What is shown for a seed: ``recommendations`` and their ``evidence`` from movie rules, its ``tag_dna`` from movie-tag rules, and the ``semantics`` of its genres.

    The first three tables are indexes; ``every_genre_rule`` is read only for a seed whose genres no rule holds.
    """
    from ..functions import text as X
    from .present import with_titles

    own = of_token(movie_rules, seed)
    found = R.recommend(own, seed, k, **thresholds)
    genres = movies.where(X.movie_token(F.col("movieId")) == seed).select(F.explode("genres_list").alias("g")).select(X.genre_token(F.col("g")).alias("t"))
    genres = sorted({r.t for r in genres.collect()})  # of one movie
    near = of_tokens(genre_rules, genres) if genres else genre_rules.limit(0).drop("token", "bucket")
    return {
        "recommendations": with_titles(found, movies, "rec_token"),
        "evidence": R.rule_evidence(own, movies, seed, k, evidence, **thresholds),
        "tag_dna": R.tag_dna(of_token(tag_rules, seed), seed, tags),
        "semantics": R.genre_semantics(every_genre_rule if near.isEmpty() else near, genres, k),
    }
