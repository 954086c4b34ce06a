"""An extension: the cleaners and the like filter are stateless, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.clean import clean_ratings


def stream_likes(spark: SparkSession, path: str, schema: StructType, threshold: float = 4.0) -> DataFrame:
    """Clean liked ratings of a folder of Parquet files as they come."""
    return clean_ratings(spark.readStream.schema(schema).parquet(path)).where(F.col("rating") >= threshold)


def hourly_likes(likes: DataFrame, delay: str = "1 day") -> DataFrame:
    """Likes an hour of event time, with a watermark for late ones."""
    return likes.withWatermark("rating_dt_utc", delay).groupBy(F.window("rating_dt_utc", "1 hour")).agg(F.count("*").alias("likes"))
