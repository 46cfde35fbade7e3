"""Schemas of the stages, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OHLCV = "ticker string, date date, Open double, High double, Low double, Close double, Volume double"
ARTICLES_RAW = "DATE bigint, SourceCommonName string, DocumentIdentifier string, V2Tone string, V2Organizations string"
TONE_FIELDS = ("tone", "positive_score", "negative_score", "polarity", "activity_ref_density", "self_group_ref_density", "word_count")
ARTICLES = ARTICLES_RAW + ", " + ", ".join(f"{f} double" for f in TONE_FIELDS) + ", datetime_ist timestamp_ntz, source_url string, source_domain string"
SIGNALS = (
    "ticker string, effective_date date, organic_signal double, sponsored_signal double, net_signal double, article_count_total bigint, "
    "article_count_organic bigint, article_count_sponsored bigint, signal_organic_closed double, signal_organic_open double, "
    "signal_sponsored_closed double, signal_sponsored_open double"
)
CELLS = ("signal_organic_closed", "signal_organic_open", "signal_sponsored_closed", "signal_sponsored_open")
MASTER_COLUMNS = (
    "ticker", "date", "sector", "cap_tier", "market_regime", *CELLS, "organic_signal", "sponsored_signal", "net_signal",
    "article_count_total", "article_count_organic", "article_count_sponsored", "ret_overnight", "ret_intraday", "ret_close2close",
)
INSTRUMENTS = "ticker string, company string, sector string, keywords array<string>, cap_tier string"


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A relation of the schema without rows."""
    return spark.createDataFrame([], ddl)
