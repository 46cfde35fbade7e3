"""Event studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .stats import t_stat, with_next

SIGNAL = "signal_organic_closed"


def thresholds(train: DataFrame, signal: str = SIGNAL, settings: Settings = DEFAULT) -> DataFrame:
    """ticker, p80, p20: exact quantiles of the training rows."""
    return train.groupBy("ticker").agg(F.percentile(signal, F.lit(settings.high_quantile)).alias("p80"), F.percentile(signal, F.lit(settings.low_quantile)).alias("p20")).where("p80 is not null and p20 is not null")


def flagged(rows: DataFrame, limits: DataFrame, signal: str = SIGNAL) -> DataFrame:
    """One row an event: bull (>= p80) and bear (<= p20); a row can be both."""
    out = rows.join(limits, "ticker")
    kinds = F.array_compact(F.array(F.when(F.col(signal) >= F.col("p80"), "bull"), F.when(F.col(signal) <= F.col("p20"), "bear")))
    return out.withColumn("kind", F.explode(kinds))


def car_paths(rows: DataFrame, limits: DataFrame, abnormal: str = "abnormal_return", signal: str = SIGNAL, settings: Settings = DEFAULT) -> DataFrame:
    """kind, ticker, date, k, car: the cumulated abnormal return from two rows before to five after each event.

    The frame's values are collected in a window; an edge or a missing value shortens the list, which drops the event.
    """
    before, after = settings.event_before, settings.event_after
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-before, after)
    size = before + after + 1
    windows = rows.withColumn("__ar", F.collect_list(abnormal).over(w)).where((F.size("__ar") == size) & (F.col("article_count_total") >= settings.min_articles))
    path = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.aggregate(F.slice("__ar", F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    return flagged(windows, limits, signal).select("kind", "ticker", "date", F.posexplode(path).alias("__p", "car")).select("kind", "ticker", "date", (F.col("__p") - before).alias("k"), "car")


def car_summary(paths: DataFrame) -> DataFrame:
    """Mean, standard error and t of the path at each offset."""
    return paths.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("car").alias("car_mean"), (F.stddev_samp("car") / F.sqrt(F.count("car"))).alias("stderr"), t_stat(F.col("car")).alias("t_stat"))


def event_returns(rows: DataFrame, limits: DataFrame, signal: str = SIGNAL) -> DataFrame:
    """Mean next-row returns of bull and bear events and their difference, one row a return."""
    names = ("ret_overnight", "ret_intraday", "ret_close2close")
    nxt = with_next(rows, names).where(" and ".join(f"{n}_next is not null" for n in names))
    long = flagged(nxt, limits, signal).select("kind", F.explode(F.array(*(F.struct(F.lit(n).alias("ret"), F.col(f"{n}_next").alias("v")) for n in names))).alias("s")).select("kind", "s.*")
    bull, bear = (F.avg(F.when(F.col("kind") == k, F.col("v"))) for k in ("bull", "bear"))
    return long.groupBy("ret").agg(bull.alias("bull_mean"), bear.alias("bear_mean"), (bull - bear).alias("diff"))
