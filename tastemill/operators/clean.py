"""Cleaners: projections to the contract columns, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def clean_movies(movies: DataFrame) -> DataFrame:
    """A missing title stays null."""
    return movies.select(
        F.col("movieId").cast("int").alias("movieId"), F.col("title").cast("string").alias("title"), X.title_year(F.col("title")).alias("year"),
        F.col("genres").cast("string").alias("genres"), X.split_genres(F.col("genres")).alias("genres_list"),
    )


def clean_ratings(ratings: DataFrame, *keep: str) -> DataFrame:
    return ratings.select(
        F.col("userId").cast("int").alias("userId"), F.col("movieId").cast("int").alias("movieId"), F.col("rating").cast("float").alias("rating"),
        F.col("timestamp").cast("bigint").alias("timestamp"), X.utc_seconds(F.col("timestamp")).alias("rating_dt_utc"), *keep,
    )


def clean_tags(tags: DataFrame) -> DataFrame:
    """Rows whose normalised tag is empty go."""
    rows = tags.select(
        F.col("userId").cast("int").alias("userId"), F.col("movieId").cast("int").alias("movieId"), F.col("tag").alias("tag_raw"),
        X.normal_tag(F.col("tag")).alias("tag_norm"), F.col("timestamp").cast("bigint").alias("timestamp"),
        X.utc_seconds(F.col("timestamp")).alias("tag_dt_utc"),
    )
    return rows.where("tag_norm <> ''")


def clean_links(links: DataFrame) -> DataFrame:
    return links.select(
        F.col("movieId").cast("int").alias("movieId"), F.col("imdbId").try_cast("bigint").alias("imdbId"), F.col("tmdbId").try_cast("bigint").alias("tmdbId")
    )


def clean_genome_tags(tags: DataFrame) -> DataFrame:
    return tags.select(F.col("tagId").cast("int").alias("tagId"), F.col("tag").cast("string").alias("tag"))


def clean_genome_scores(scores: DataFrame) -> DataFrame:
    return scores.select(
        F.col("movieId").cast("int").alias("movieId"), F.col("tagId").cast("int").alias("tagId"), F.col("relevance").cast("float").alias("relevance")
    )
