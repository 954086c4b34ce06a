"""User and item feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

MOST_GENRES = 2000  # they become columns
SIDE_BY_SIDE = 100
RATING_STATS = ("n_ratings", "rating_mean", "rating_std", "rating_min", "rating_max")


def exploded_genres(movies: DataFrame) -> DataFrame:
    return movies.select("movieId", F.explode("genres_list").alias("genre")).distinct()


def _stats():
    value = F.col("rating").cast("double")
    return (
        F.count("*").alias("n_ratings"), F.avg(value).alias("rating_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("rating_std"),
        F.min(value).alias("rating_min"), F.max(value).alias("rating_max"),
    )


def user_base(train: DataFrame) -> DataFrame:
    return train.groupBy("userId").agg(
        *_stats(), F.min("rating_dt_utc").alias("first_dt"), F.max("rating_dt_utc").alias("last_dt"),
        F.countDistinct(F.to_date("rating_dt_utc")).alias("active_days"),
    )


def user_genre_means(train: DataFrame, movies: DataFrame) -> DataFrame:
    """Long form: ``userId, genre, mean``; the catalogue's genres are small, so Spark picks the join by size."""
    return train.select("userId", "movieId", "rating").join(exploded_genres(movies), "movieId").groupBy("userId", "genre").agg(
        F.avg(F.col("rating").cast("double")).alias("mean")
    )


def _slugs(genres: list[str], prefix: str) -> dict[str, str]:
    """Column names of genres, which must not meet."""
    names = {g: prefix + _slug(g) for g in sorted(genres)}
    if len(set(names.values())) < len(names):
        raise ValueError("genres meet in one column name")
    return names


def _slug(text: str) -> str:
    import re

    return re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", text.lower())) or "unknown"


def genre_values(movies: DataFrame) -> list[str]:
    """The distinct genres of a catalogue, which name columns; more than ``MOST_GENRES`` raise."""
    found = [r.genre for r in exploded_genres(movies).select("genre").distinct().orderBy("genre").limit(MOST_GENRES + 1).collect()]
    if len(found) > MOST_GENRES:
        raise ValueError(f"more than {MOST_GENRES} genres")
    return found


def seen(train: DataFrame, movies: DataFrame) -> DataFrame:
    """The movies that training has ratings of."""
    return movies.join(train.select("movieId").distinct(), "movieId", "left_semi")


def user_genre_prefs(train: DataFrame, movies: DataFrame) -> DataFrame:
    """Wide form: a column a genre seen in training, 0 where a user has no rating of it.

    Few genres are averaged side by side, in one grouping of the users; many are pivoted from the long form.
    """
    names = _slugs(genre_values(seen(train, movies)), "genre_pref__")
    if len(names) <= SIDE_BY_SIDE:
        rows = train.select("userId", "movieId", "rating").join(exploded_genres(movies), "movieId")
        mean = lambda g: F.avg(F.when(F.col("genre") == g, F.col("rating").cast("double")))
        return rows.groupBy("userId").agg(*(F.coalesce(mean(g), F.lit(0.0)).cast("float").alias(n) for g, n in names.items()))
    long = user_genre_means(train, movies)
    wide = long.groupBy("userId").pivot("genre", list(names)).agg(F.first("mean"))
    return wide.select("userId", *(F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).cast("float").alias(n) for g, n in names.items()))


def user_tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("userId").agg(F.count("tag_norm").alias("n_tag_events"))


def user_features(train: DataFrame, movies: DataFrame, tags: DataFrame) -> DataFrame:
    base = user_base(train).select(
        "userId", F.col("n_ratings").cast("int").alias("n_ratings"), *(F.col(c).cast("float").alias(c) for c in RATING_STATS[1:]),
        "first_dt", "last_dt", F.col("active_days").cast("int").alias("active_days"),
    )
    both = base.join(user_genre_prefs(train, movies), "userId", "left").join(user_tag_counts(tags), "userId", "left")
    prefs = [c for c in both.columns if c.startswith("genre_pref__")]
    events = F.coalesce("n_tag_events", F.lit(0)).cast("int").alias("n_tag_events")
    return both.select(*base.columns, events, *(F.coalesce(c, F.lit(0.0)).cast("float").alias(c) for c in prefs))


def item_base(train: DataFrame) -> DataFrame:
    return train.groupBy("movieId").agg(*_stats())


def item_entropy(train: DataFrame) -> DataFrame:
    """Entropy of an item's ratings over the log of the number of distinct ones; 0 for one."""
    counts = train.where("rating IS NOT NULL").groupBy("movieId", "rating").agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("movieId"))
    k = F.count("*")
    entropy = F.sum(-F.col("p") * F.ln("p"))
    return counts.select("movieId", share.alias("p")).groupBy("movieId").agg(
        F.when(k > 1, entropy / F.ln(k)).otherwise(0.0).alias("rating_entropy")
    )


def item_polarization(train: DataFrame) -> DataFrame:
    """Deviation and entropy from one count of each item's ratings, so that the ratings are read and shuffled once."""
    counts = train.where("rating IS NOT NULL").groupBy("movieId", "rating").agg(F.count("*").alias("c"))
    n, value, k = F.sum("c"), F.col("rating").cast("double"), F.count("*")
    mean = F.sum(value * F.col("c")) / n
    moments = counts.groupBy("movieId").agg(
        n.alias("n"), mean.alias("mean"), F.collect_list(F.struct(value.alias("rating"), "c")).alias("values"),
        F.when(k > 1, (F.ln(n) - F.sum(F.col("c") * F.ln("c")) / n) / F.ln(k)).otherwise(0.0).alias("rating_entropy"),
    ).where("movieId IS NOT NULL")
    off = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + (v["rating"] - F.col("mean")) * (v["rating"] - F.col("mean")) * v["c"])
    std = F.when(F.col("n") > 1, F.sqrt(off / (F.col("n") - 1))).otherwise(0.0)
    spread = F.greatest(std * (1 - F.col("rating_entropy")), F.lit(0.0))
    return moments.select("movieId", "rating_entropy", spread.alias("polarization_score"))


def item_genre_flags(movies: DataFrame) -> DataFrame:
    """Wide form over all movies' genres."""
    names = _slugs(genre_values(movies), "genre_flag__")
    wide = exploded_genres(movies).groupBy("movieId").pivot("genre", list(names)).agg(F.max(F.lit(1)))
    both = movies.select("movieId").join(wide, "movieId", "left")
    return both.select("movieId", *(F.coalesce(F.col(f"`{g}`"), F.lit(0)).cast("tinyint").alias(n) for g, n in names.items()))


def item_tags(tags: DataFrame, least: int = 10, top: int = 3) -> DataFrame:
    """``movieId, n_tag_events, top_tags`` over tags of ``least`` events or more; if no tag has so many, over all and without top tags."""
    frequency = tags.groupBy("tag_norm").agg(F.count("*").alias("freq"))
    any_frequent = frequency.agg((F.coalesce(F.max("freq"), F.lit(0)) >= least).alias("some"))
    rows = tags.select("movieId", "tag_norm").groupBy("movieId", "tag_norm").agg(F.count("*").alias("n"))
    rows = rows.join(frequency, "tag_norm").join(F.broadcast(any_frequent)).where(f"NOT some OR freq >= {int(least)}")
    counts = rows.groupBy("movieId").agg(F.sum("n").alias("n_tag_events"))
    rank = F.row_number().over(Window.partitionBy("movieId").orderBy(F.desc("n"), "tag_norm"))
    best = rows.where("some").withColumn("r", rank).where(F.col("r") <= top)
    listed = F.array_sort(F.collect_list(F.struct("r", "tag_norm")))
    names = best.groupBy("movieId").agg(F.array_join(F.transform(listed, lambda x: x["tag_norm"]), "|").alias("top_tags"))
    return counts.join(names, "movieId", "left").select("movieId", "n_tag_events", F.coalesce("top_tags", F.lit("")).alias("top_tags"))


def item_features(train: DataFrame, movies: DataFrame, tags: DataFrame, least: int = 10) -> DataFrame:
    base = item_base(train).join(item_entropy(train), "movieId", "left").withColumn("rating_entropy", F.coalesce("rating_entropy", F.lit(0.0)))
    base = base.withColumn("polarization_score", F.greatest(F.col("rating_std") * (1 - F.col("rating_entropy")), F.lit(0.0)))
    both = base.join(item_genre_flags(movies), "movieId", "left").join(item_tags(tags, least), "movieId", "left")
    flags = [c for c in both.columns if c.startswith("genre_flag__")]
    return both.select(
        "movieId", F.col("n_ratings").cast("int").alias("n_ratings"),
        *(F.col(c).cast("float").alias(c) for c in (*RATING_STATS[1:], "rating_entropy", "polarization_score")),
        F.coalesce("n_tag_events", F.lit(0)).cast("int").alias("n_tag_events"), F.coalesce("top_tags", F.lit("")).alias("top_tags"),
        *(F.coalesce(c, F.lit(0)).cast("tinyint").alias(c) for c in flags),
    )


def feature_coverage(features: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """The share of training keys that have a feature row."""
    known = features.select(key).distinct().withColumn("known", F.lit(1))
    rows = train.select(key).distinct().join(known, key, "left")
    n = F.count("*")
    return rows.agg(n.alias("keys"), F.count("known").alias("covered"), F.when(n == 0, 0.0).otherwise(F.count("known") / n).alias("coverage"))
