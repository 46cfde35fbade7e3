"""From scored articles to stock-day signals, and their join to returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.nulls import is_true
from ..functions.timeops import is_closed
from ..schemas import CELLS, MASTER_COLUMNS


def daily_signals(articles: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Twelve columns a (ticker, effective_date): weighted means overall and by class and window.

    One aggregate, combined before its shuffle.  A missing probability weighs half and half and is of neither class.
    """
    prob = F.col("sponsored_prob")
    tone = F.col("tone_score") / settings.tone_scale
    w_spon = F.coalesce(prob, F.lit(0.5))
    w_org = 1.0 - w_spon
    closed = is_closed(F.col("time_bucket"))
    org, spon = is_true(prob < settings.organic_below), is_true(prob > settings.sponsored_above)

    def weighted(weight: Column, mask: Column | None = None, empty: Column | None = None) -> Column:
        w, v = (weight, tone * weight) if mask is None else (F.when(mask, weight), F.when(mask, tone * weight))
        return F.when(F.coalesce(F.sum(w), F.lit(0.0)) > 0, F.try_divide(F.coalesce(F.sum(v), F.lit(0.0)), F.sum(w))).otherwise(F.lit(None) if empty is None else empty)

    zero = F.lit(0.0)
    rows = articles.where(F.col("ticker").isNotNull() & F.col("effective_date").isNotNull())
    out = rows.groupBy("ticker", "effective_date").agg(
        weighted(w_org, empty=zero).alias("organic_signal"),
        weighted(w_spon, empty=zero).alias("sponsored_signal"),
        F.count(F.lit(1)).alias("article_count_total"),
        F.sum(org.cast("long")).alias("article_count_organic"),
        F.sum(spon.cast("long")).alias("article_count_sponsored"),
        weighted(w_org, org & closed).alias(CELLS[0]),
        weighted(w_org, org & ~closed).alias(CELLS[1]),
        weighted(w_spon, spon & closed).alias(CELLS[2]),
        weighted(w_spon, spon & ~closed).alias(CELLS[3]),
    )
    return out.withColumn("net_signal", F.col("organic_signal") - F.col("sponsored_signal")).select("ticker", "effective_date", "organic_signal", "sponsored_signal", "net_signal", "article_count_total", "article_count_organic", "article_count_sponsored", *CELLS)


def article_score(tone: Column, prob: Column, closed: Column, settings: Settings = DEFAULT) -> Column:
    weight = F.when(prob.isNotNull(), F.greatest(1.0 - prob, F.lit(settings.organic_floor)))
    return tone / settings.tone_scale * weight * F.when(closed, settings.closed_weight).otherwise(settings.open_weight)


def direction(score: Column, settings: Settings = DEFAULT) -> Column:
    return F.when(score > settings.direction_threshold, "BULLISH").when(score < -settings.direction_threshold, "BEARISH").otherwise("NEUTRAL")


def batch_signals(articles: DataFrame, *, ticker: str = "ticker", date: str = "effective_date", tone: str = "tone_score", prob: str = "sponsored_prob", bucket: str = "time_bucket", settings: Settings = DEFAULT) -> DataFrame:
    """Signal, score and direction of every group.

    A probability of exactly 0 counts as one half; a missing tone or probability makes the group's signal missing and
    its direction neutral; groups of fewer than three articles are INSUFFICIENT_DATA.
    """
    p = F.when(F.col(prob) == 0, 0.5).otherwise(F.col(prob))
    score = article_score(F.col(tone), p, is_closed(F.col(bucket)), settings)
    n = F.count(F.lit(1))
    enough = n >= settings.min_articles
    raw = F.when(enough & (F.count(score) == n), F.avg(score))
    rows = articles.where(F.col(ticker).isNotNull() & F.col(date).isNotNull()).groupBy(F.col(ticker).alias("ticker"), F.col(date).alias("effective_date"))
    out = rows.agg(raw.alias("raw_signal"), n.alias("n_articles"), F.when(enough, F.sum(is_true(F.col(prob) < settings.organic_below).cast("long"))).otherwise(0).alias("n_organic"), F.when(enough, F.sum(is_true(F.col(prob) > settings.sponsored_above).cast("long"))).otherwise(0).alias("n_sponsored"))
    out = out.withColumn("pred_score", F.tanh(settings.alpha * F.col("raw_signal")))
    out = out.withColumn("direction", F.when(F.col("n_articles") < settings.min_articles, "INSUFFICIENT_DATA").otherwise(direction(F.col("pred_score"), settings)))
    return out.select("ticker", "effective_date", "raw_signal", "pred_score", "direction", "n_articles", "n_organic", "n_sponsored")


def master(signals: DataFrame, returns: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """The eighteen columns of signals joined to returns on ticker and day.

    ``dimension`` (ticker, sector, cap_tier) replaces both columns wholly if any joined value is missing, as the source
    data's convention is; unknown tickers are UNKNOWN.
    """
    s = signals.withColumnRenamed("effective_date", "date")
    out = s.join(returns, ["ticker", "date"], "inner")
    if dimension is not None:
        gaps = out.agg(*((F.count(F.lit(1)) > F.count(c)).alias(f"__no_{c}") for c in ("sector", "cap_tier")))
        dim = dimension.select("ticker", F.col("sector").alias("__sector"), F.col("cap_tier").alias("__cap_tier"))
        out = out.join(dim, "ticker", "left").crossJoin(F.broadcast(gaps))
        for c in ("sector", "cap_tier"):
            out = out.withColumn(c, F.when(F.col(f"__no_{c}"), F.coalesce(f"__{c}", F.lit("UNKNOWN"))).otherwise(F.col(c)))
    return out.select(*(c for c in MASTER_COLUMNS if c in out.columns))
