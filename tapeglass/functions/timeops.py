"""Time stamps, market windows and trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def int_timestamp(code: Column) -> Column:
    """yyyyMMddHHmmss in UTC as a time stamp without zone; NULL if malformed."""
    return F.try_to_timestamp(code.cast("string"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def to_local(ts: Column, settings: Settings = DEFAULT) -> Column:
    """UTC to market time (a fixed offset without daylight saving)."""
    return ts + F.expr(f"INTERVAL '{settings.zone_minutes}' MINUTE")


def time_bucket(local: Column, settings: Settings = DEFAULT) -> Column:
    """CLOSED_PRE, OPEN or CLOSED_POST; windows include their start and not their end."""
    minute = F.hour(local) * 60 + F.minute(local)
    return F.when(minute < settings.open_minute, "CLOSED_PRE").when(minute < settings.close_minute, "OPEN").when(minute.isNotNull(), "CLOSED_POST")


def is_closed(bucket: Column) -> Column:
    return F.coalesce(bucket.isin("CLOSED_POST", "CLOSED_PRE"), F.lit(False))


def on_weekday(d: Column) -> Column:
    """The first weekday on or after a date (holidays are not known)."""
    return F.date_add(d, F.when(F.dayofweek(d) == 7, 2).when(F.dayofweek(d) == 1, 1).otherwise(0))


def next_trading_day(dates: DataFrame, calendar: DataFrame, date: str = "date", day: str = "trading_day") -> DataFrame:
    """Forward as-of lookup in any calendar: adds ``next_day``, the first trading day on or after a date, else the date.

    Distinct dates and trading days are merged by year and the next day is found by one window; the rest is a date join.
    """
    from pyspark.sql import Window

    every = dates.select(F.col(date).alias("d"), F.lit(None).cast("date").alias("t")).distinct().unionByName(calendar.select(F.col(day).alias("d"), F.col(day).alias("t")))
    span = F.year("d")
    first_of_year = calendar.groupBy((F.year(day) - 1).alias("y")).agg(F.min(day).alias("f"))
    w = Window.partitionBy(span).orderBy(F.desc("d"), F.desc_nulls_last("t")).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("in_year", F.last("t", ignorenulls=True).over(w)).where("t is null").withColumn("y", span).join(first_of_year, "y", "left")
    found = found.select("d", F.coalesce("in_year", "f", "d").alias("next_day"))
    return dates.join(found, dates[date] == found["d"], "left").drop("d")


def effective_date(local: Column, bucket: Column) -> Column:
    """After the close: the next trading day after the date; otherwise the first one on or after it."""
    d = F.to_date(local)
    return on_weekday(F.when(bucket == "CLOSED_POST", F.date_add(d, 1)).otherwise(d))


#: Date windows that charts and summaries mark: label, first day, last day (none: open).
WINDOWS = (("COVID", "2020-03-01", "2020-06-30"), ("Holdout", "2024-07-01", None))


def window_label(date: Column, windows: tuple[tuple[str, str, str | None], ...] = WINDOWS) -> Column:
    """The first window that holds a date; NULL outside all."""
    label = F.lit(None).cast("string")
    for name, first, last in reversed(windows):
        inside = date >= F.to_date(F.lit(first))
        label = F.when(inside if last is None else inside & (date <= F.to_date(F.lit(last))), name).otherwise(label)
    return label


def trading_calendar(spark: SparkSession, start: str = "2019-01-01", end: str = "2027-01-01") -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("trading_day"))
    return days.where(F.weekday("trading_day") < 5)


def month_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """First and last day of each month from ``start``'s to ``end``'s."""
    first = F.explode(F.sequence(F.trunc(F.to_date(F.lit(start)), "month"), F.trunc(F.to_date(F.lit(end)), "month"), F.expr("interval 1 month")))
    return spark.range(1).select(first.alias("month_start")).select("month_start", F.last_day("month_start").alias("month_end"), F.date_format("month_start", "yyyy-MM").alias("year_month"))
