"""Extension (the batch design has no streams): articles ingested and aggregated as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def articles(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_tone(stream: DataFrame, ts: str = "datetime_ist", lateness: str = "6 hours", width: str = "3 hours") -> DataFrame:
    """Article count and mean tone of each ticker and time window; later articles than ``lateness`` are left out."""
    rows = stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), "ticker")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("tone_score").alias("tone")).select(F.col("window.start").alias("start"), "ticker", "n", "tone")


def first_seen(stream: DataFrame, key: str = "article_id", ts: str = "datetime_ist", lateness: str = "6 hours") -> DataFrame:
    """Each article once, as long as its repeats come within ``lateness``."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
