"""The driver tables as the engine's canonical relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored articles; some tones and probabilities are missing."""
    e = table(spark, sf_dir, "events")
    local = timeops.to_local(F.col("ts").cast("timestamp_ntz"))
    out = e.select(
        F.col("event_id").alias("article_id"),
        F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string")).alias("ticker"),
        local.alias("datetime_ist"),
        F.when(F.col("event_id") % 97 != 0, (F.col("value") - 50) / 5).alias("tone_score"),
        F.when(F.col("event_id") % 89 != 0, (F.col("event_id") * 7919 % 1000) / F.lit(1000.0)).alias("sponsored_prob"),
        F.col("event_type").alias("source_domain"),
    )
    out = out.withColumn("time_bucket", timeops.time_bucket(F.col("datetime_ist")))
    return out.withColumn("effective_date", timeops.effective_date(F.col("datetime_ist"), F.col("time_bucket")))


def prices_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices of twenty tickers from events."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string")).alias("ticker"), F.to_date("ts").alias("date"), "ts", "value")
    return e.groupBy("ticker", "date").agg(F.min_by("value", "ts").alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"), F.max_by("value", "ts").alias("Close"), F.sum("value").alias("Volume"))


def index_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily index: the mean order price."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("Close"))


def prices_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of daily closes of five tickers."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return o.groupBy("ticker", "date").agg(F.avg("o_totalprice").alias("Close"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as article addresses; paths vary so that every label rule has rows."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    base = F.regexp_replace("url", r"[?#].*$", "")
    url = (
        F.when(k % 7 == 0, F.concat(base, F.lit("/sponsored/strong-growth-for-firm-1170456789.html")))
        .when(k % 7 == 1, F.concat(F.lit("https://www.Reuters.com/markets/probe-into-loss-"), k.cast("string"), F.lit("12345.html")))
        .when(k % 7 == 2, F.concat(F.lit("https://www.prnewswire.com/news-releases/proud-milestone_"), k.cast("string"), F.lit(".cms")))
        .when(k % 7 == 3, F.concat(F.lit("https://economictimes.indiatimes.com/record-results-up/articleshow/"), (k + 100000).cast("string"), F.lit(".cms")))
        .when(k % 7 == 4, F.concat(F.lit("https://zeebiz.com/story/article-quarter-"), k.cast("string"), F.lit("?x=1")))
        .otherwise(F.col("url"))
    )
    return p.select(k.alias("article_id"), url.alias("source_url"), ((k * 37 % 201 - 100) / F.lit(10.0)).alias("tone"), F.date_add(F.to_date(F.lit("2023-01-02")), (k % 400).cast("int")).alias("effective_date"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a deterministic score column."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("doc_id") * 7919 % 997
    rows = d.select("doc_id", "n_chars", "source").join(lab.select("doc_id", "quality", "toxic"), "doc_id")
    return rows.select("doc_id", "n_chars", "source", "quality", "toxic", F.least(F.lit(0.99), F.round((n / F.lit(997.0) + F.col("quality") * 0.3) / 1.3, 2)).alias("score"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model answers of every quality: fenced, malformed, out of range."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    mood = F.when(i % 3 == 0, "bullish").when(i % 3 == 1, "bearish").otherwise("neutral")
    body = lambda conf, entities='["A"]': F.concat(F.lit('{"sentiment": "'), mood, F.lit('", "confidence": '), conf, F.lit(', "rationale": "r", "entities": ' + entities + "}"))
    conf = ((i % 100) / F.lit(100.0)).cast("string")
    raw = (
        F.when(i % 11 == 0, F.concat(F.lit("```json\n"), body(conf), F.lit("\n```")))
        .when(i % 11 == 1, body(F.concat(F.lit('"'), conf, F.lit('"'))))
        .when(i % 11 == 2, body(F.lit("1.2")))
        .when(i % 11 == 3, F.concat(F.lit('{"sentiment": "'), mood, F.lit('", "confidence": 0.5, "rationale": "r"}')))
        .when(i % 11 == 4, F.lit("no answer"))
        .when(i % 11 == 5, F.lit('{"sentiment": "up", "confidence": 0.5, "rationale": "r", "entities": []}'))
        .when(i % 11 == 6, F.concat(F.lit("Sure: "), body(conf), F.lit(" done")))
        .otherwise(body(conf, "[]"))
    )
    return e.select(i.alias("article_id"), F.col("event_type").alias("bucket"), raw.alias("answer"))


def tone_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw tone strings and integer time codes, some short or malformed."""
    e = table(spark, sf_dir, "events")
    i, v = F.col("event_id"), F.round(F.col("value"), 2).cast("string")
    full = F.concat_ws(",", v, F.lit("2.5"), F.lit("1.5"), F.lit("4"), F.lit("20.25"), F.lit("0"), (i % 500).cast("string"))
    raw = F.when(i % 11 == 0, F.lit("")).when(i % 11 == 1, F.concat(v, F.lit(",x,2"))).when(i % 11 == 2, F.lit(None).cast("string")).when(i % 11 == 3, F.concat(v, F.lit(",1"))).otherwise(full)
    code = F.when(i % 13 == 0, F.lit(20241399000000)).otherwise(F.date_format(F.col("ts").cast("timestamp_ntz").cast("timestamp"), "yyyyMMddHHmmss").cast("long"))
    return e.select(i.alias("article_id"), raw.alias("V2Tone"), code.alias("DATE"))


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw news rows: each names a firm, and has the address of a page."""
    e = tone_strings(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("article_id"), "user_id"), "article_id")
    pages = urls(spark, sf_dir).select(F.col("article_id").alias("page"), F.col("source_url").alias("DocumentIdentifier"))
    count = pages.agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("least"))
    e = e.crossJoin(F.broadcast(count)).withColumn("page", F.col("least") + F.col("article_id") % F.col("pages"))
    named = F.concat(F.lit("Bank;Firm T"), (F.col("user_id") % 20).cast("string"), F.lit(" Corp;"))
    return e.join(pages, "page").select("article_id", "DATE", F.lit("web").alias("SourceCommonName"), "DocumentIdentifier", "V2Tone", named.alias("V2Organizations"))


def firms(spark: SparkSession) -> DataFrame:
    """The twenty instruments of :func:`raw_news`."""
    rows = [(f"T{i}", f"Firm T{i}", f"S{i % 4}", [f"firm t{i} corp"], "TOP10" if i < 4 else "MID" if i < 10 else "TAIL") for i in range(20)]
    return spark.createDataFrame(rows, "ticker string, company string, sector string, keywords array<string>, cap_tier string")


def entities(spark: SparkSession) -> DataFrame:
    """Ten made-up instruments with keywords that occur in the documents' invented prose."""
    words = ("then", "ation", "quel", "unge", "ciones", "ther", "lich", "eaux", "ción", "heit")
    rows = [(f"E{i}", f"Company {i}", f"S{i % 3}", [w, f"{w}er", f"x{w}"], "TOP10" if i < 3 else "TAIL") for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "ticker string, company string, sector string, keywords array<string>, cap_tier string")

