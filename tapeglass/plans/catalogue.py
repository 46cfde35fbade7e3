"""The registered queries: each applies an operator to a whole table of the driver's."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..config import DEFAULT
from ..functions import text, timeops
from ..functions.nulls import row_mean, rounded, safe_corr
from ..operators import articles as art
from ..operators import audit, events, ml, nlp, ordered, prices, sampling, signals, stats
from ..sources import adapters, files, news
from . import oracles, stages

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
BANDS = ("Q1", "Q2", "Q3", "Q4", "Q5")
#: The synthetic events span one month: its first part trains, the rest is held out.
SPLIT = "2024-01-16"


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def _dimension(spark: SparkSession) -> DataFrame:
    rows = [(f"T{i}", None if i == 19 else f"S{i % 4}", "TOP10" if i < 4 else "MID" if i < 10 else "TAIL") for i in range(19)]
    return spark.createDataFrame(rows, "ticker string, sector string, cap_tier string")


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return prices.returns(adapters.prices_short(spark, d))


def _regimes(spark: SparkSession, d: str) -> DataFrame:
    """Regimes of January 2024 by a short index: the mean event value of a day, against three rows before."""
    e = adapters.table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("Close"))
    w = Window.orderBy("date")
    r = F.try_divide(F.col("Close"), F.lag("Close", 3).over(w)) - 1
    return e.select("date", F.when(r > 0.02, "BULL").when(r < -0.02, "BEAR").otherwise("SIDEWAYS").alias("market_regime"))


def _master(spark: SparkSession, d: str) -> DataFrame:
    """Signals of at least three articles joined to returns and the day's regime."""
    sig = signals.daily_signals(adapters.articles(spark, d)).withColumnRenamed("effective_date", "date")
    rows = sig.join(_returns(spark, d), ["ticker", "date"]).where(F.col("article_count_total") >= DEFAULT.min_articles)
    return rows.join(_regimes(spark, d), "date", "left")


def _ics(spark: SparkSession, d: str) -> DataFrame:
    return stats.ic_cells(_master(spark, d))


def _abnormal(spark: SparkSession, d: str) -> DataFrame:
    index = adapters.table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("Close"))
    index = prices.pct_change(index, name="index_ret").select("date", "index_ret")
    return _master(spark, d).join(index, "date", "left").withColumn("abnormal_return", F.col("ret_close2close") - F.col("index_ret"))


@query
def time_bucket(spark, d):
    return adapters.articles(spark, d).groupBy("time_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("first_id"), F.max("article_id").alias("last_id"))


@query
def effective_date(spark, d):
    return adapters.articles(spark, d).select("article_id", "time_bucket", "effective_date")


@query
def next_trading_day(spark, d):
    days = adapters.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    cal = timeops.trading_calendar(spark, "1995-01-01", "2002-01-15")
    return timeops.next_trading_day(days, cal)


@query
def trading_calendar(spark, d):
    return timeops.trading_calendar(spark)


@query
def month_spine(spark, d):
    return timeops.month_spine(spark, "2019-12-01", "2026-03-31")


@query
def source_domain(spark, d):
    return adapters.table(spark, d, "pages").select("page_id", text.source_domain(F.col("url")).alias("source_domain"))


@query
def source_tier(spark, d):
    return adapters.urls(spark, d).select("article_id", text.source_tier(F.col("source_url")).alias("source_tier"), text.is_pr_wire(F.col("source_url")).alias("is_pr_wire"))


@query
def keyword_flags(spark, d):
    u = F.col("source_url")
    return adapters.urls(spark, d).select("article_id", text.contains_any(u, config.SPONSORED_URL_PATTERNS).alias("sponsored_url"), text.risk_flag(u).alias("risk"), text.promo_ratio(u).alias("promo_ratio"))


@query
def url_slug_title(spark, d):
    return adapters.urls(spark, d).select("article_id", text.url_title(F.col("source_url")).alias("title"))


@query
def v2tone_parse(spark, d):
    return adapters.tone_strings(spark, d).select("article_id", *(c.alias(n) for n, c in text.tone_parts(F.col("V2Tone")).items()))


@query
def processed_articles(spark, d):
    raw = adapters.tone_strings(spark, d).join(adapters.urls(spark, d).select("article_id", F.col("source_url").alias("DocumentIdentifier")), "article_id")
    raw = raw.withColumns({"SourceCommonName": F.lit("s"), "V2Organizations": F.when(F.col("article_id") % 3 == 0, "Some Reed Corp")})
    got = news.processed(news.scan(raw, "20240101", "20240131", "reed|zeebiz"))
    return got.select(F.date_format(F.col("datetime_ist").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("local"), "tone", "word_count", "source_url", "source_domain")


@query
def bucket_counts(spark, d):
    a = adapters.articles(spark, d)
    kind = F.when(F.col("sponsored_prob") < 0.3, "organic").when(F.col("sponsored_prob") > 0.7, "sponsored")
    rows = a.select(F.concat_ws("_", kind, F.when(timeops.is_closed(F.col("time_bucket")), "closed").otherwise("open")).alias("bucket"), kind.alias("k")).where("k is not null")
    out = audit.value_counts(rows.select("bucket"), "bucket")
    return out.withColumn("label", F.format_string("%s (n=%d)", "bucket", "n"))


@query
def int_timestamp_parse(spark, d):
    local = timeops.to_local(timeops.int_timestamp(F.col("DATE")))
    return adapters.tone_strings(spark, d).select("article_id", F.date_format(local.cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("local")).where("local is not null")


@query
def keyword_regex_filter(spark, d):
    pattern = text.keyword_pattern(["Tion", "L&T", "queux", "tion"])
    docs = adapters.table(spark, d, "documents")
    return docs.where(F.lower(F.coalesce("text", F.lit(""))).rlike(pattern)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query
def ticker_match_explode(spark, d):
    known = [(r["ticker"], r["keywords"]) for r in adapters.entities(spark).orderBy("ticker").collect()]
    docs = adapters.table(spark, d, "documents").select("doc_id", "text", "source")
    return art.match_entities(docs, known, ("text", "source")).select("doc_id", "ticker")


@query
def ticker_match_join(spark, d):
    docs = adapters.table(spark, d, "documents").select("doc_id", "text")
    return art.match_entities_join(docs, adapters.entities(spark), ("text",)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query
def weak_labels(spark, d):
    return art.weak_labels(adapters.urls(spark, d)).select("article_id", "source_tier", "weak_label")


@query
def label_by_tier_pivot(spark, d):
    rows = art.weak_labels(adapters.urls(spark, d)).select("source_tier", F.coalesce(F.col("weak_label").cast("int").cast("string"), F.lit("none")).alias("label"))
    return rows.groupBy("source_tier").pivot("label", ["0", "1", "none"]).count().na.fill(0).select("source_tier", F.col("0").alias("organic"), F.col("1").alias("sponsored"), F.col("none").alias("unlabelled"))


@query
def tone_rolling_var(spark, d):
    rows = adapters.articles(spark, d).withColumn("tone_score", F.coalesce("tone_score", F.lit(0.0)))
    return art.rolling_variance(rows).select("article_id", "tone_30d_variance")


@query
def cross_seed_count(spark, d):
    return art.cross_seed(adapters.articles(spark, d)).select("article_id", "cross_seed_count")


@query
def mention_burst(spark, d):
    return art.mention_burst(adapters.articles(spark, d)).select("effective_date", "mention_burst_score").distinct()


@query
def feature_matrix(spark, d):
    return _articles_with_features(spark, d).select("article_id", *art.FEATURES)


@query
def daily_signals(spark, d):
    return signals.daily_signals(adapters.articles(spark, d))


@query
def batch_signals(spark, d):
    return signals.batch_signals(adapters.articles(spark, d))


@query
def returns_panel(spark, d):
    return _returns(spark, d).select("ticker", "date", "ret_overnight", "ret_intraday", "ret_close2close")


@query
def market_regime(spark, d):
    return prices.market_regime(adapters.index_prices(spark, d))


@query
def index_pct_change(spark, d):
    return prices.pct_change(adapters.index_prices(spark, d)).select("date", "ret")


@query
def panel_with_dims(spark, d):
    p = prices.panel(adapters.prices_short(spark, d), _regimes(spark, d), _dimension(spark))
    return p.select("ticker", "date", "sector", "cap_tier", "market_regime", "ret_close2close")


@query
def master_dataset(spark, d):
    panel = prices.panel(adapters.prices_short(spark, d), _regimes(spark, d), _dimension(spark)).withColumn("sector", F.when(F.col("sector") != "S1", F.col("sector")))
    return signals.master(signals.daily_signals(adapters.articles(spark, d)), panel, _dimension(spark))


def stage_tables(spark: SparkSession, d: str) -> str:
    """A folder of the shared one with the first tables of the stages, made of the driver's."""
    folder = f"{files.shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    files.write(adapters.prices_short(spark, d), f"{folder}/quotes")
    files.write(adapters.table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("Close")), f"{folder}/index")
    files.write(news.processed(adapters.raw_news(spark, d)), f"{folder}/news")
    return folder


@query
def stage_chain(spark, d):
    """Prices, label, score, signals and master, each from the tables that the ones before wrote."""
    return stages.run(spark, stage_tables(spark, d), adapters.firms(spark))


@query
def return_consistency(spark, d):
    m, r = _master(spark, d).alias("m"), _returns(spark, d).alias("r")
    cols = ("ret_overnight", "ret_intraday", "ret_close2close")
    both = m.join(r, (F.col("m.ticker") == F.col("r.ticker")) & (F.col("m.date") == F.col("r.date")))
    return both.agg(F.count(F.lit(1)).alias("n"), *(F.max(F.abs(F.col(f"m.{c}") - F.col(f"r.{c}"))).alias(f"diff_{c}") for c in cols))


def _coverage(spark, d):
    a = adapters.articles(spark, d).where("ticker is not null")
    counts = a.groupBy("ticker", F.date_format("effective_date", "yyyy-MM").alias("year_month")).agg(F.count(F.lit(1)).alias("n"))
    months = timeops.month_spine(spark, "2023-12-01", "2024-03-01").select("year_month")
    tickers = spark.range(20).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"))
    return audit.dense(counts, tickers, months, ("ticker", "year_month"), "n")


@query
def coverage_spine(spark, d):
    return _coverage(spark, d)


@query
def coverage_bands(spark, d):
    return audit.band_counts(_coverage(spark, d), "n")


@query
def monthly_pivot(spark, d):
    a = adapters.articles(spark, d)
    p = a.groupBy(F.date_format("effective_date", "yyyy-MM").alias("year_month")).pivot("time_bucket", ["CLOSED_PRE", "OPEN", "CLOSED_POST"]).agg(F.sum("tone_score"))
    return p.select("year_month", F.col("CLOSED_PRE").alias("closed_pre"), F.col("OPEN").alias("open"), F.col("CLOSED_POST").alias("closed_post"))


@query
def monthly_top_bottom(spark, d):
    n = adapters.index_prices(spark, d).groupBy(F.date_format("date", "yyyy-MM").alias("year_month")).agg(F.count(F.lit(1)).alias("n"), F.sum("Close").alias("total"))
    top = n.orderBy(F.desc("total"), "year_month").limit(5).withColumn("side", F.lit("top"))
    return top.unionByName(n.orderBy("total", "year_month").limit(5).withColumn("side", F.lit("bottom")))


@query
def winsorize(spark, d):
    rows = _returns(spark, d).select("ticker", "date", "ret_close2close", "ret_intraday")
    return prices.winsorize(rows, ("ret_close2close", "ret_intraday"))


@query
def return_moments(spark, d):
    return audit.moments(prices.returns(adapters.prices_long(spark, d).withColumn("Open", F.col("Close"))), "ret_close2close")


@query
def readiness_summary(spark, d):
    m = _master(spark, d)
    cells = [F.sum(F.coalesce((F.col(c) != 0) & F.col("ret_intraday").isNotNull(), F.lit(False)).cast("long")).alias(f"ready_{c}") for c in ("signal_organic_closed", "signal_organic_open", "signal_sponsored_closed", "signal_sponsored_open")]
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *cells)


@query
def filter_funnel(spark, d):
    u = F.col("source_url")
    steps = [("not pr wire", ~text.is_pr_wire(u)), ("not sponsored url", ~text.contains_any(u, config.SPONSORED_URL_PATTERNS)), ("tone up to 5", F.col("tone") <= 5), ("tier 1 or 2", text.source_tier(u) <= 2)]
    return audit.funnel(adapters.urls(spark, d), steps)


@query
def prob_group_tone(spark, d):
    a = adapters.articles(spark, d).withColumn("prob_group", audit.prob_group(F.col("sponsored_prob")))
    return audit.describe(a.where("prob_group is not null"), "tone_score", "prob_group")


@query
def group_mean_difference(spark, d):
    a = adapters.articles(spark, d)
    g = audit.prob_group(F.col("sponsored_prob"))
    mean = lambda k: F.avg(F.when(g == k, F.col("tone_score")))
    return a.agg((mean("sponsored") - mean("organic")).alias("separation"), (F.abs(mean("sponsored")) - F.abs(mean("organic"))).alias("abs_separation"))


@query
def domain_stats(spark, d):
    a = adapters.articles(spark, d)
    out = a.groupBy("source_domain").agg(F.count(F.lit(1)).alias("n"), F.avg("sponsored_prob").alias("mean_prob"), F.avg("tone_score").alias("mean_tone"), F.min_by("ticker", "article_id").alias("first_ticker"))
    return out.where("n >= 5").orderBy(F.desc("mean_prob"), "source_domain").limit(20)


@query
def uncertain_zone(spark, d):
    return audit.value_counts(adapters.articles(spark, d).where(audit.uncertain(F.col("sponsored_prob"))), "source_domain", "time_bucket")


@query
def uncertain_zone_inclusive(spark, d):
    return audit.value_counts(adapters.articles(spark, d).where(audit.uncertain(F.col("sponsored_prob"), inclusive=True)), "source_domain", "time_bucket")


@query
def describe(spark, d):
    return audit.describe(adapters.articles(spark, d), "tone_score", "source_domain")


@query
def coverage_metrics(spark, d):
    s = signals.daily_signals(adapters.articles(spark, d))
    cells = ("signal_organic_closed", "signal_organic_open", "signal_sponsored_closed", "signal_sponsored_open")
    return s.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"n_{c}") for c in cells), *((100.0 * F.count(c) / F.count(F.lit(1))).alias(f"pct_{c}") for c in cells))


@query
def normalized_signals(spark, d):
    m = _master(spark, d).withColumn("organic", row_mean(F.col("signal_organic_closed"), F.col("signal_organic_open"))).withColumn("sponsored", row_mean(F.col("signal_sponsored_closed"), F.col("signal_sponsored_open")))
    train = m.where(F.col("date") < SPLIT).agg(*(f(c).alias(f"{k}_{c}") for c in ("organic", "sponsored") for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = [F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")).alias(f"{c}_norm") for c in ("organic", "sponsored")]
    return m.crossJoin(F.broadcast(train)).select("ticker", "date", *z)


@query
def daily_ic(spark, d):
    return stats.daily_ic(_master(spark, d), "net_signal", "ret_close2close")


@query
def ic_cells(spark, d):
    return _ics(spark, d)


@query
def ic_metrics(spark, d):
    return stats.ic_metrics(_ics(spark, d), "cell")


@query
def ic_tail(spark, d):
    return stats.ic_tail(_ics(spark, d), "cell")


@query
def ic_rolling_outer(spark, d):
    w = Window.orderBy("date").rowsBetween(-59, 0)
    ics = _ics(spark, d)
    one = lambda cell, name: ics.where(F.col("cell") == cell).select("date", F.avg("ic").over(w).alias(name))
    return one("organic_open", "roll_organic").join(one("sponsored_open", "roll_sponsored"), "date", "full_outer")


@query
def ic_2x2_grid(spark, d):
    return stats.wide_cells(_ics(spark, d))


@query
def ic_by_regime(spark, d):
    regimes = _master(spark, d).groupBy("date").agg(F.min_by("market_regime", "ticker").alias("regime"))
    return _ics(spark, d).join(regimes, "date", "left").groupBy("cell", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic_mean"), stats.t_stat(F.col("ic")).alias("t_stat"))


@query
def ic_holdout(spark, d):
    return stats.ic_metrics(_ics(spark, d).where(F.col("date") >= SPLIT), "cell")


@query
def ic_paired_diff(spark, d):
    g = _ics(spark, d).groupBy("date").agg(*(F.max(F.when(F.col("cell") == c, F.col("ic"))).alias(c) for c in ("organic_open", "sponsored_open")))
    x = F.col("organic_open") - F.col("sponsored_open")
    return g.agg(F.count(x).alias("n"), F.avg(x).alias("mean_diff"), stats.t_stat(x).alias("t_stat"))


@query
def ic_positional_diff(spark, d):
    ics = _ics(spark, d)
    one = lambda cell, name: ics.where(F.col("cell") == cell).select(F.row_number().over(Window.orderBy("date")).alias("i"), F.col("ic").alias(name))
    x = F.col("a") - F.col("b")
    return one("organic_open", "a").join(one("sponsored_open", "b"), "i").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_diff"), F.stddev_samp(x).alias("sd_diff"))


@query
def ic_bootstrap_ci(spark, d):
    ics = _ics(spark, d).where("cell = 'organic_open'").select("date", "ic")
    return stats.interval(stats.bootstrap_means(ics, ("ic",)), "ic")


@query
def interaction_test(spark, d):
    return stats.interaction(stats.wide_cells(_ics(spark, d)))


@query
def poisoned_metrics(spark, d):
    """The block that a missing daily correlation makes missing, over the whole sample, which the report calls its training period."""
    ic = F.col("ic")
    return _ics(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), stats.poisoned_mean(ic).alias("ic_mean"), stats.poisoned_std(ic).alias("ic_std"))


@query
def date_windows(spark, d):
    days = timeops.trading_calendar(spark).withColumn("label", timeops.window_label(F.col("trading_day")))
    return days.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("trading_day").alias("first_day"), F.max("trading_day").alias("last_day"))


@query
def event_study_car(spark, d):
    rows = _abnormal(spark, d)
    return events.car_summary(events.car_paths(rows, events.thresholds(rows.where(F.col("date") < SPLIT))))


@query
def event_returns(spark, d):
    rows = _abnormal(spark, d)
    return events.event_returns(rows, events.thresholds(rows.where(F.col("date") < SPLIT)))


def _quintiled(spark, d):
    rows = stats.with_next(_master(spark, d), ("ret_overnight", "ret_intraday", "ret_close2close"))
    rows = rows.withColumn("signal", (F.col("signal_organic_open") + F.col("signal_sponsored_open")) / 2).na.drop(subset=["signal", "ret_overnight_next", "ret_intraday_next", "ret_close2close_next"])
    return rows.withColumn("quintile", stats.quintile()).where("quintile is not null")


@query
def quintile_returns(spark, d):
    return _quintiled(spark, d).groupBy("quintile").agg(F.count(F.lit(1)).alias("n"), *((F.avg(f"{r}_next") * 100).alias(r) for r in ("ret_overnight", "ret_intraday", "ret_close2close")))


@query
def per_stock_corr(spark, d):
    # Tickers have some twenty days in these tables: more than 10 instead of the operator's 30.
    return stats.per_stock_correlation(_master(spark, d), least=10)


@query
def sentiment_corr(spark, d):
    a = adapters.articles(spark, d).where("tone_score is not null and sponsored_prob is not null")
    r = ordered.average_ranks(a.select("time_bucket", "tone_score", "sponsored_prob"), "tone_score", "time_bucket", name="rx")
    r = ordered.average_ranks(r, "sponsored_prob", "time_bucket", name="ry")
    return r.groupBy("time_bucket").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("tone_score"), F.col("sponsored_prob")).alias("pearson"), safe_corr(F.col("rx"), F.col("ry")).alias("spearman"))


@query
def ols_fit(spark, d):
    a = adapters.articles(spark, d).where("tone_score is not null and sponsored_prob is not null")
    return a.agg(F.regr_slope("tone_score", "sponsored_prob").alias("slope"), F.regr_intercept("tone_score", "sponsored_prob").alias("intercept"))


@query
def stratified_sample(spark, d):
    return sampling.stratified(adapters.articles(spark, d).select("article_id", "time_bucket"), "time_bucket", "article_id", 500)


@query
def train_split(spark, d):
    return sampling.split(adapters.articles(spark, d).select("article_id"), "article_id").groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


@query
def row_numbers(spark, d):
    return ordered.row_ids(adapters.articles(spark, d).select("article_id", "ticker"), "ticker", "article_id")


@query
def head_rows(spark, d):
    return sampling.prefix(adapters.articles(spark, d).select("article_id", "ticker"), 100, "article_id")


@query
def permuted_column(spark, d):
    return sampling.permuted(adapters.labelled_documents(spark, d).select("doc_id", "score"), "score", "doc_id", 42)


@query
def hist_bins(spark, d):
    return audit.histogram(adapters.articles(spark, d), "tone_score", 50)


@query
def return_density(spark, d):
    r = _returns(spark, d).select("ticker", "date", "ret_intraday")
    own = r.agg(F.avg("ret_intraday").alias("m"), F.stddev_samp("ret_intraday").alias("s"))
    return r.crossJoin(F.broadcast(own)).select("ticker", "date", audit.normal_pdf(F.col("ret_intraday"), F.col("m"), F.col("s")).alias("density"))


@query
def json_extract_validate(spark, d):
    return adapters.answers(spark, d).select("article_id", text.checked_answer(F.col("answer")).alias("a")).select("article_id", "a.valid", "a.message", "a.sentiment", "a.confidence", "a.score", "a.entities")


@query
def llm_bucket_breakdown(spark, d):
    a = adapters.answers(spark, d).select("bucket", text.checked_answer(F.col("answer")).alias("a"))
    return audit.value_counts(a.where("a.valid").select("bucket", F.col("a.sentiment").alias("sentiment")), "bucket", "sentiment")


@query
def auc_ap_exact(spark, d):
    return audit.auc_ap(adapters.labelled_documents(spark, d), "quality", "score")


@query
def pr_curve(spark, d):
    return audit.pr_curve(adapters.labelled_documents(spark, d), "quality", "score")


@query
def confusion_report(spark, d):
    return audit.confusion_report(adapters.labelled_documents(spark, d), "quality", "score")


@query
def union_monthly(spark, d):
    o = adapters.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"), "o_totalprice")
    early, late = o.where("year_month < '1998-01'"), o.where("year_month >= '1998-01'")
    return early.unionByName(late).groupBy("year_month").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query
def anti_join_resume(spark, d):
    loaded = adapters.table(spark, d, "orders").where("month(o_orderdate) <> 7").select(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
    return files.missing_months(timeops.month_spine(spark, "1995-01-01", "2001-08-31").select("year_month"), loaded)


@query
def month_coverage(spark, d):
    rows = adapters.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
    return files.month_coverage(timeops.month_spine(spark, "1994-11-01", "2001-10-31").select("year_month"), rows)


@query
def sector_lookup(spark, d):
    a = adapters.articles(spark, d).select("ticker").join(_dimension(spark), "ticker", "left")
    return audit.value_counts(a.select(F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"), F.coalesce("cap_tier", F.lit("UNKNOWN")).alias("cap_tier")), "sector", "cap_tier")


@query
def gain_share(spark, d):
    t = adapters.table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("gain"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("gain").alias("__t")))).select("event_type", "gain", (100 * F.col("gain") / F.col("__t")).alias("pct"))


@query
def benchmark_flags(spark, d):
    m = stats.ic_metrics(_ics(spark, d), "cell")
    return m.select("cell", stats.benchmark_flag(F.col("ic_mean"), F.when(F.col("cell").like("organic%"), F.lit(0.041)).otherwise(F.lit(0.018))).alias("flag"))


def _articles_with_features(spark, d):
    """The classifier's thirteen features and the weak label of every article."""
    rows = adapters.urls(spark, d).withColumns({"source_domain": text.source_domain(F.col("source_url")), "datetime_ist": F.col("effective_date").cast("timestamp_ntz"), "positive_score": F.col("article_id") % 10, "negative_score": -(F.col("article_id") % 7)})
    return art.engineer(art.weak_labels(rows)).select("article_id", "effective_date", F.col("weak_label").alias("label"), *art.FEATURES)


def _labelled(spark, d):
    """Labelled articles with is_train.  None is of the reference's training years, so this is the fall-back split."""
    return files.materialized(ml.with_split(files.materialized(_articles_with_features(spark, d).where("label is not null")), "article_id", "effective_date"))


@query
def dated_split(spark, d):
    rows = _articles_with_features(spark, d).where("label is not null")
    got = ml.with_split(rows, "article_id", "effective_date", ("2023-01-01", "2023-08-31"), ("2023-09-01", "2023-12-31"), least=10)
    return got.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("sponsored"), F.min("effective_date").alias("first_day"), F.max("effective_date").alias("last_day"))


@query
def gbt_scores(spark, d):
    model = ml.fit(_labelled(spark, d))
    return ml.scored(_articles_with_features(spark, d), model).select("article_id", "label", "sponsored_prob")


@query
def gain_importance(spark, d):
    return spark.createDataFrame(ml.importance(ml.fit(_labelled(spark, d))), "feature string, pct double")


@query
def permutation_importance(spark, d):
    rows = _labelled(spark, d)
    return ml.permutation_importance(rows.where("not is_train"), ml.fit(rows), art.FEATURES, "article_id")


@query
def ablation(spark, d):
    return ml.ablation(_labelled(spark, d))


@query
def circularity(spark, d):
    rows = _labelled(spark, d)
    return ml.circularity(rows, ml.fit(rows), "article_id")


@query
def p_values(spark, d):
    m = stats.ic_metrics(_ics(spark, d), "cell")
    return stats.with_p(m.select("cell", "n_days", "t_stat"), "t_stat", F.col("n_days") - 1)


@query
def verdicts(spark, d):
    m = stats.ic_metrics(_ics(spark, d), "cell")
    one = m.agg(F.max(F.when(F.col("cell") == "organic_open", F.col("ic_mean"))).alias("a"), F.max(F.when(F.col("cell") == "sponsored_open", F.col("ic_mean"))).alias("b"), F.max("t_stat").alias("t"), F.max("n_days").alias("n"))
    return stats.with_p(one, "t", F.col("n") - 1).select("a", "b", stats.verdict(F.col("a"), F.col("b"), F.col("p_value")).alias("verdict"))


@query
def text_scorer(spark, d):
    rows = adapters.urls(spark, d).select("article_id", text.url_title(F.col("source_url")).alias("title"))
    return nlp.text_scores(rows, "title")


@query
def llm_extract(spark, d):
    rows = adapters.urls(spark, d).select("article_id", text.url_title(F.col("source_url")).alias("title")).where("title is not null")
    return nlp.extracted(rows.select("article_id", text.prompt(F.col("title")).alias("prompt")), "prompt").drop("prompt")


def queries() -> dict[str, Query]:
    """The queries, with their values as they are."""
    return dict(_queries)


def compared() -> dict[str, Query]:
    """The same for a comparison with other engines, whose last digits differ: doubles are rounded, as they are in the SQL."""
    return {name: lambda spark, sf_dir, f=f: rounded(f(spark, sf_dir)) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
