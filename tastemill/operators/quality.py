"""Quality profiles, each one row, and the hard gates over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

HALF_STARS = [i / 2 for i in range(1, 11)]


class GateError(ValueError):
    """A hard gate failed."""


def require_columns(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise GateError(f"missing columns {missing}")


def _n(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def _rate(part: Column, whole: Column, none: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(none)).otherwise(part / whole)


def _nulls(*columns: str) -> list[Column]:
    return [F.count("*").alias("n_rows"), *(_n(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns)]


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*_nulls(*(columns or df.columns)))


def _off_scale() -> Column:
    value = F.col("rating").cast("double")
    return value.isNotNull() & ~value.isin(*HALF_STARS)


def _domain() -> list[Column]:
    value = F.col("rating").cast("double")
    return [
        F.count("*").alias("n_rows"), _n(F.col("userId").isNull()).alias("user_nulls"), _n(F.col("movieId").isNull()).alias("movie_nulls"),
        _n(value.isNull()).alias("rating_nulls"), F.min(value).alias("rating_min"), F.max(value).alias("rating_max"), _n(_off_scale()).alias("off_scale_rows"),
    ]


def rating_domain(ratings: DataFrame) -> DataFrame:
    """Nulls, range and the distinct values off the half-star scale."""
    return ratings.agg(*_domain(), F.countDistinct(F.when(_off_scale(), F.col("rating").cast("double"))).alias("off_scale_values"))


def duplicate_stats(df: DataFrame, *keys: str) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total, unique = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return groups.agg(
        total.alias("total"), (total - unique).alias("duplicates"), unique.alias("unique_rows"), _rate(total - unique, total).alias("duplicate_rate")
    )


def key_counts(facts: DataFrame, key: str) -> DataFrame:
    return facts.groupBy(key).agg(F.count("*").alias("n"))


def join_coverage(facts: DataFrame, dims: DataFrame, key: str, counted: bool = False) -> DataFrame:
    """How many fact rows and keys meet a dimension row; null keys don't. ``counted`` facts are given as their ``key_counts``."""
    by_key = facts if counted else key_counts(facts, key)
    known = dims.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    rows = by_key.join(known, by_key[key] == F.col("k"), "left")
    hit = F.col("k").isNotNull()
    total, matched = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    return rows.agg(
        total.alias("total_rows"), matched.alias("matched_rows"), (total - matched).alias("unmatched_rows"), _rate(matched, total).alias("coverage"),
        F.count(key).alias("fact_keys"), _n(hit).alias("matched_keys"), _n(~hit & F.col(key).isNotNull()).alias("unmatched_keys"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_key_rows"),
    )


def unmatched_keys(facts: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    return facts.select(key).where(F.col(key).isNotNull()).distinct().join(dims, key, "left_anti")


def matched_rows(facts: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    return facts.join(dims.select(key), key, "left_semi")


def _movie_profile() -> list[Column]:
    n, none, bare = F.count("*"), _n(F.col("year").isNull()), _n(F.size("genres_list") == 0)
    return [
        n.alias("n_rows"), none.alias("year_nulls"), _rate(none, n).alias("year_null_share"), F.min("year").alias("year_min"),
        F.max("year").alias("year_max"), bare.alias("no_genres"), _rate(bare, n).alias("no_genre_share"),
    ]


def movie_profile(movies: DataFrame) -> DataFrame:
    return movies.agg(*_movie_profile())


def tag_profile(tags: DataFrame) -> DataFrame:
    raw, norm = F.countDistinct("tag_raw"), F.countDistinct("tag_norm")
    return tags.agg(F.count("*").alias("n_rows"), raw.alias("unique_raw"), norm.alias("unique_norm"), (raw - norm).alias("reduction"), _empty_tags())


def _empty_tags() -> Column:
    return _n(F.col("tag_norm").isNull() | (F.col("tag_norm") == "")).alias("empty_norm")


def _link_coverage() -> list[Column]:
    n, imdb, tmdb = F.count("*"), _n(F.col("imdbId").isNull()), _n(F.col("tmdbId").isNull())
    return [n.alias("n_rows"), imdb.alias("imdb_missing"), _rate(n - imdb, n).alias("imdb_coverage"), tmdb.alias("tmdb_missing"), _rate(n - tmdb, n).alias("tmdb_coverage")]


def link_coverage(links: DataFrame) -> DataFrame:
    return links.agg(*_link_coverage())


def _once(*lists: list[Column]) -> list[Column]:
    """Metrics of several reports without those that come twice."""
    return list({str(c).rsplit(" AS ", 1)[-1]: c for part in lists for c in part}.values())


def watched(table: str) -> list[Column]:
    """The metrics of a clean table's gate that Spark can take while the table is written: all but those that need its distinct values."""
    return {
        "movies": _once(_nulls("movieId"), _movie_profile()), "ratings": _domain(), "tags": _once(_nulls("userId", "movieId"), [_empty_tags()]),
        "links": _once(_nulls("movieId"), _link_coverage()),
    }.get(table, [F.count("*").alias("n_rows")])


def watch(raw: DataFrame, clean, table: str) -> tuple[DataFrame, Callable[[], dict]]:
    """``clean(raw)``, whose writing also takes the metrics of its gate and ``raw_rows``; the second result gives them when it is written."""
    before, after = Observation(), Observation()
    df = clean(raw.observe(before, F.count("*").alias("raw_rows"))).observe(after, *watched(table))
    return df, lambda: {**before.get, **after.get}


def retained(seen: dict[str, dict]) -> list[dict]:
    """The rows of ``retention`` from what was seen while tables were written."""
    rate = lambda m: round(m["n_rows"] / m["raw_rows"], 6) if m["raw_rows"] else 0.0
    return [{"table": k, "raw_rows": m["raw_rows"], "clean_rows": m["n_rows"], "retention": rate(m)} for k, m in seen.items()]


def retention(raw: dict[str, DataFrame], clean: dict[str, DataFrame]) -> DataFrame:
    """Rows before and after cleaning by table."""
    out = None
    for name in raw:
        a, b = raw[name].agg(F.count("*").alias("raw_rows")), clean[name].agg(F.count("*").alias("clean_rows"))
        row = a.join(b).select(
            F.lit(name).alias("table"), "raw_rows", "clean_rows", F.round(_rate(F.col("clean_rows"), F.col("raw_rows")), 6).alias("retention")
        )
        out = row if out is None else out.unionByName(row)
    return out


def _first(df: DataFrame) -> dict:
    return df.first().asDict()


# Each gate takes what was seen while its table was written; without that it takes the same metrics from the table.


def gate_movies(movies: DataFrame, seen: dict | None = None) -> dict:
    require_columns(movies, ("movieId", "title", "year", "genres_list"))
    report = (seen or _first(movies.agg(*watched("movies")))) | _first(duplicate_stats(movies, "movieId"))
    if report["movieId_nulls"] or report["duplicates"]:
        raise GateError(f"movies: {report['movieId_nulls']} null and {report['duplicates']} repeated ids")
    return report


def gate_ratings(ratings: DataFrame, seen: dict | None = None) -> dict:
    require_columns(ratings, ("userId", "movieId", "rating", "timestamp"))
    report = dict(seen or _first(ratings.agg(*watched("ratings"))))
    if report["user_nulls"] or report["movie_nulls"]:
        raise GateError("ratings: null user or movie ids")
    off = ratings.where(_off_scale()).agg(F.count_distinct(F.col("rating").cast("double")).alias("off_scale_values"))
    report |= {"off_scale_values": 0} if not report["off_scale_rows"] else _first(off)
    report |= _first(duplicate_stats(ratings, "userId", "movieId", "timestamp"))
    report["warnings"] = ["ratings off the half-star scale"] if report["off_scale_rows"] else []
    return report


def gate_tags(tags: DataFrame, seen: dict | None = None) -> dict:
    require_columns(tags, ("userId", "movieId", "tag_norm"))
    report = dict(seen or _first(tags.agg(*watched("tags"))))
    if report["userId_nulls"] or report["movieId_nulls"] or report["empty_norm"]:
        raise GateError("tags: null keys or empty tags")
    report |= _first(tag_profile(tags)) | _first(duplicate_stats(tags, "userId", "movieId", "tag_norm", "timestamp"))
    report["warnings"] = ["repeated tag events"] if report["duplicates"] else []
    return report


def gate_links(links: DataFrame, seen: dict | None = None) -> dict:
    require_columns(links, ("movieId", "imdbId", "tmdbId"))
    report = (seen or _first(links.agg(*watched("links")))) | _first(duplicate_stats(links, "movieId"))
    if report["movieId_nulls"] or report["duplicates"]:
        raise GateError("links: null or repeated ids")
    return report


def gate_coverage(facts: DataFrame, dims: DataFrame, key: str, least: float = 0.95, counted: bool = False) -> dict:
    report = _first(join_coverage(facts, dims, key, counted))
    if report["coverage"] < least:
        raise GateError(f"only {report['coverage']:.4f} of the rows have a known {key}")
    return report
