"""Readable rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def titles(movies: DataFrame) -> DataFrame:
    """``token, title``, one a movie: the smallest title; rows without a numeric id go."""
    rows = movies.select(F.col("movieId").try_cast("bigint").alias("id"), "title").where("id IS NOT NULL")
    return rows.groupBy(X.movie_token(F.col("id")).alias("token")).agg(F.min("title").alias("title"))


def with_titles(df: DataFrame, movies: DataFrame, *columns: str) -> DataFrame:
    """Adds ``<column>_title`` of token columns."""
    names = titles(movies)
    for c in columns:
        df = df.join(names.select(F.col("token").alias(c), F.col("title").alias(f"{c}_title")), c, "left")
    return df


def readable(found: DataFrame, movies: DataFrame) -> DataFrame:
    """Single-token rules with decoded sides, their text and type."""
    named = with_titles(found, movies, "antecedent", "consequent")
    a = X.join_sorted(F.array(X.decode_report(F.col("antecedent"), F.col("antecedent_title"))))
    b = X.join_sorted(F.array(X.decode_report(F.col("consequent"), F.col("consequent_title"))))
    return named.select(
        "antecedent", "consequent", a.alias("antecedent_decoded"), b.alias("consequent_decoded"), X.short_label(X.rule_text(a, b)).alias("label"),
        "support", "confidence", "lift", X.rule_type(F.array("antecedent"), F.array("consequent")).alias("rule_type"),
    )


def type_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_type").agg(F.count("*").alias("n"))


def cross_rules(readable_rules: DataFrame, limit: int = 10) -> DataFrame:
    """A report of the strongest genre-only and cross-type rules."""
    return readable_rules.where(F.col("rule_type").isin("genre_only", "cross_type")).orderBy(F.desc(F.round("lift", 9)), "antecedent", "consequent").limit(limit)
