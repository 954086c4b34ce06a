"""Leakage-safe temporal splits and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .quality import GateError

EPSILON = 1e-10


def time_cutoff(ratings: DataFrame, fraction: float = 0.1, cutoff: str | None = None) -> DataFrame:
    """One row ``cutoff``: the given UTC time, or where ``1 - fraction`` of the time line is over."""
    if cutoff:
        return ratings.sparkSession.range(1).select(F.to_timestamp(F.lit(cutoff)).alias("cutoff"))
    return ratings.agg(X.cut_point(F.min("rating_dt_utc"), F.max("rating_dt_utc"), fraction).alias("cutoff"))


def global_split(ratings: DataFrame, fraction: float = 0.1, cutoff: str | None = None, at: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Train before the cutoff, test from it on; rows without a time are in neither. ``at`` is the one row of ``time_cutoff``, if it is at hand."""
    at = time_cutoff(ratings, fraction, cutoff) if at is None else at
    both = ratings.join(F.broadcast(at))  # one row
    names = ratings.columns
    return both.where("rating_dt_utc < cutoff").select(names), both.where("rating_dt_utc >= cutoff").select(names)


def user_split(ratings: DataFrame, fraction: float = 0.1, ties: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, test and ``userId, cutoff`` by each user's own time line. A user's only rating is in neither."""
    user = Window.partitionBy("userId")
    order = user.orderBy("rating_dt_utc", "timestamp", "movieId", "rating", *ties)
    placed = ratings.withColumn("_at", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(user))
    placed = placed.withColumn("_k", X.split_index(F.col("_n"), fraction))
    names = ratings.columns
    train = placed.where("_n >= 2 AND _at < _k").select(names)
    test = placed.where("_n >= 2 AND _at >= _k").select(names)
    return train, test, test.groupBy("userId").agg(F.min("rating_dt_utc").alias("cutoff"))


def tags_before(tags: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Tag events that do not leak: before the one cutoff, or before each user's, if there is one."""
    if "userId" in cutoff.columns:
        joined = tags.join(cutoff, "userId", "left")
        kept = joined.where("cutoff IS NULL OR tag_dt_utc < cutoff")
    else:
        kept = tags.join(F.broadcast(cutoff)).where("tag_dt_utc < cutoff")
    return kept.select(tags.columns)


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Keys of both sides; rows outside the other side's times can't be, and go before the shuffle."""
    key = ("userId", "movieId", "timestamp")

    def near(rows: DataFrame, other: DataFrame) -> DataFrame:
        span = other.agg(F.min("timestamp").alias("_low"), F.max("timestamp").alias("_high"))
        both = rows.select(*key).join(F.broadcast(span))  # one row
        return both.where("timestamp IS NULL OR timestamp BETWEEN _low AND _high").select(*key)

    return near(train, test).intersect(near(test, train))


def order_violations(train: DataFrame, test: DataFrame) -> DataFrame:
    """Users whose last training time is after their first test time."""
    last = train.groupBy("userId").agg(F.max("rating_dt_utc").alias("train_max"))
    first = test.groupBy("userId").agg(F.min("rating_dt_utc").alias("test_min"))
    return last.join(first, "userId").where("train_max > test_min")


def cold_start(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """One row: distinct test keys, those unknown to train and their share."""
    known = train.select(key).distinct().withColumn("known", F.lit(1))
    rows = test.select(key).distinct().join(known, key, "left")
    n, cold = F.count("*"), F.count_if(F.col("known").isNull()).cast("bigint")
    return rows.agg(n.alias("test_keys"), cold.alias("cold_keys"), F.when(n == 0, 0.0).otherwise(cold / n).alias("cold_rate"))


def split_sizes(train: DataFrame, test: DataFrame) -> DataFrame:
    sides = train.select(F.lit(1).alias("t")).unionByName(test.select(F.lit(0).alias("t")))
    n, t = F.count("*"), F.coalesce(F.sum("t"), F.lit(0))
    return sides.agg(t.alias("train_rows"), (n - t).alias("test_rows"), F.when(n == 0, 0.0).otherwise((n - t) / n).alias("test_fraction"))


def rating_distribution(train: DataFrame, test: DataFrame) -> DataFrame:
    def of(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col("rating").cast("double").alias("rating")).agg(F.count("*").alias("n"))
        return counts.select("rating", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))

    return of(train, "train_share").join(of(test, "test_share"), "rating")


def rating_divergence(train: DataFrame, test: DataFrame) -> DataFrame:
    """Means, sample deviations and the divergence of test from train over common values."""
    def stats(df: DataFrame, name: str) -> DataFrame:
        value = F.col("rating").cast("double")
        return df.agg(F.avg(value).alias(f"{name}_mean"), F.stddev_samp(value).alias(f"{name}_std"))

    q, p = F.col("test_share"), F.col("train_share")
    divergence = rating_distribution(train, test).agg(F.sum(q * F.ln((q + EPSILON) / (p + EPSILON))).alias("divergence"))
    return stats(train, "train").join(stats(test, "test")).join(divergence)


def validate_split(train: DataFrame, test: DataFrame, per_user: bool = False) -> dict:
    """Hard gates on order and overlap, warnings on cold start and drift."""
    if per_user:
        wrong = order_violations(train, test).count()
    else:
        a, b = train.agg(F.max("rating_dt_utc")).first()[0], test.agg(F.min("rating_dt_utc")).first()[0]
        wrong = int(a is None or b is None or a >= b)
    if wrong:
        raise GateError(f"split order violated ({wrong})")
    shared = overlap(train, test).count()
    if shared:
        raise GateError(f"{shared} rows are in both sides")
    report = split_sizes(train, test).first().asDict() | {"overlap": 0}
    warnings = []
    for key in ("userId", "movieId"):
        cold = cold_start(train, test, key).first().asDict()
        report[f"cold_{key}"] = cold
        if cold["cold_rate"] > 0.5:
            warnings.append(f"cold start of {key}: {cold['cold_rate']:.3f}")
    drift = rating_divergence(train, test).first().asDict()
    if abs(drift["divergence"] or 0) > 0.1:
        warnings.append(f"rating drift {drift['divergence']:.4f}")
    return report | drift | {"warnings": warnings}
