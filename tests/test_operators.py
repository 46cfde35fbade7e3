"""Boundaries of single operators."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeglass import schemas
from tapeglass.functions import nulls, text, timeops
from tapeglass.operators import articles, audit, events, ml, nlp, ordered, prices, sampling, signals, stats
from tapeglass.plans import catalogue, stages
from tapeglass.sources import adapters, files, news, quotes
from tapeglass.streaming import ingest

from .conftest import DATA

TS = dt.datetime


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_time_bucket(spark):
    at = [TS(2024, 1, 5, 9, 14, 59, 999000), TS(2024, 1, 5, 9, 15), TS(2024, 1, 5, 15, 29, 59), TS(2024, 1, 5, 15, 30), TS(2024, 1, 5), None]
    assert column(spark, at, "timestamp_ntz", timeops.time_bucket) == ["CLOSED_PRE", "OPEN", "OPEN", "CLOSED_POST", "CLOSED_PRE", None]


def test_effective_date(spark):
    at = [TS(2024, 1, 5, 16), TS(2024, 1, 5, 10), TS(2024, 1, 6, 10), TS(2024, 1, 7, 23), TS(2024, 1, 4, 15, 30)]
    got = column(spark, at, "timestamp_ntz", lambda c: timeops.effective_date(c, timeops.time_bucket(c)))
    assert [d.isoformat() for d in got] == ["2024-01-08", "2024-01-05", "2024-01-08", "2024-01-08", "2024-01-05"]


def test_int_timestamp(spark):
    got = column(spark, [20240131183000, 20241399000000, None], "long", lambda c: timeops.to_local(timeops.int_timestamp(c)))
    assert got == [TS(2024, 2, 1), None, None]


def test_tiers(spark):
    urls = ["https://LIVEMINT.com/spotlight/x", "https://unknown.org", "https://prnewswire.com/a", "https://zeebiz.com", None]
    assert column(spark, urls, "string", text.source_tier) == [1, 2, 3, 2, 2]


def test_domain(spark):
    assert column(spark, ["https://www.A.com/x", "ftp://b.com", "", None], "string", text.source_domain) == ["a.com", None, None, None]


def test_title(spark):
    urls = ["https://x.com/tata-motors-q3-growth-11704567890.html", "https://x.com/results-up/articleshow/123.cms", "https://x.com/a/12345", "https://x.com/news-big-day-ahead?x=1", None, "x"]
    assert column(spark, urls, "string", text.url_title) == ["tata motors q3 growth", "results up", None, "big day ahead", None, None]


def test_tone_parts(spark):
    rows = spark.createDataFrame([("",), ("1.5,x,2",), (None,), ("nan,1",)], "t string").select(*(c.alias(n) for n, c in text.tone_parts(F.col("t")).items())).collect()
    assert [tuple(r) for r in rows] == [(0.0,) * 7, (1.5, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0), (0.0,) * 7, (0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def test_answers(spark):
    good = '{"sentiment": "bullish", "confidence": %s, "rationale": "r", "entities": ["A"]}'
    raw = ["```json\n" + good % "0.9" + "\n```", good % '"0.9"', good % "1.2", '{"sentiment": "bullish"}', '{"a": {"b": 1}}', "", None]
    got = column(spark, raw, "string", text.checked_answer)
    assert [g["valid"] for g in got] == [True, True, False, False, False, False, False]
    assert got[0]["score"] == 0.9 and got[2]["message"] == "Confidence out of range" and got[3]["message"] == "Missing field: confidence"
    assert json.loads(got[0]["entities"]) == ["A"]


def test_keyword_pattern():
    assert text.keyword_pattern(["A b", "L&T", "a B"]) == "a b|l\\&t" and text.keyword_pattern(["L&T"], quirk=True) == "l\\\\&t"


def test_weak_label_precedence(spark):
    rows = [("https://reuters.com/sponsored/x", -1.0), ("https://reuters.com/sponsored/x", 1.0), ("https://zzz.org/a", 1.0), ("https://zzz.org/b", 9.0), (None, None)]
    got = articles.weak_labels(spark.createDataFrame(rows, "source_url string, tone double")).collect()
    assert [r["weak_label"] for r in got] == [0.0, 1.0, None, 1.0, None]


def test_match_join_equals_explode(spark):
    docs = spark.createDataFrame([(1, "Label of BEL"), (2, None), (3, "nothing")], "i int, t string")
    known = [("B", ["bel", "bel x"]), ("C", ["noth"]), ("D", [])]
    a = articles.match_entities(docs, known, ("t",)).select("i", "ticker").collect()
    dim = spark.createDataFrame(known, "ticker string, keywords array<string>")
    b = articles.match_entities_join(docs, dim, ("t",)).select("i", "ticker").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) == [(1, "B"), (3, "C")]


def art(spark, rows):
    return spark.createDataFrame([("T", dt.date(2024, 1, 1), *r) for r in rows], "ticker string, effective_date date, tone_score double, sponsored_prob double, time_bucket string")


def test_daily_signal_boundaries(spark):
    r = signals.daily_signals(art(spark, [(10.0, 0.3, "OPEN"), (10.0, 0.7, "OPEN"), (10.0, None, "OPEN"), (None, 0.1, "CLOSED_PRE")])).first()
    assert (r["article_count_total"], r["article_count_organic"], r["article_count_sponsored"]) == (4, 1, 0)
    assert r["signal_organic_closed"] == 0.0 and r["signal_organic_open"] is None


def test_batch_signals(spark):
    one = signals.batch_signals(art(spark, [(10.0, 0.9, "CLOSED_PRE")] * 3)).first()
    assert math.isclose(one["raw_signal"], 0.45) and one["direction"] == "BULLISH"
    assert math.isclose(signals.batch_signals(art(spark, [(10.0, 0.0, "OPEN")] * 3)).first()["raw_signal"], 0.5)
    few = signals.batch_signals(art(spark, [(10.0, 0.1, "OPEN")] * 2)).first()
    assert few["direction"] == "INSUFFICIENT_DATA" and few["n_organic"] == 0 and few["raw_signal"] is None
    assert signals.batch_signals(art(spark, [(10.0, None, "OPEN")] * 3)).first()["direction"] == "NEUTRAL"


def test_direction_edges(spark):
    assert column(spark, [0.1, -0.1, 0.11, -0.11], "double", signals.direction) == ["NEUTRAL", "NEUTRAL", "BULLISH", "BEARISH"]


def test_rolling_variance_matches_pandas(spark):
    x = np.random.default_rng(1).normal(size=50)
    df = spark.createDataFrame([(i, "d", i, float(v)) for i, v in enumerate(x)] + [(99, None, 1, 1.0)], "article_id int, source_domain string, datetime_ist int, tone_score double")
    got = {r["article_id"]: r["tone_30d_variance"] for r in articles.rolling_variance(df).collect()}
    want = pd.Series(x).rolling(30, min_periods=5).var().fillna(0)
    assert all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in range(50)) and got[99] == 0


def test_regime_and_returns(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(70)]
    df = spark.createDataFrame([(d, 100.0 * 1.01**i) for i, d in enumerate(days)], "date date, Close double")
    got = [r["market_regime"] for r in prices.market_regime(df).orderBy("date").collect()]
    assert got[:60] == ["SIDEWAYS"] * 60 and got[60:] == ["BULL"] * 10
    assert column(spark, [0.1, -0.1, None], "double", prices.regime_of) == ["SIDEWAYS"] * 3
    one = spark.createDataFrame([("T", days[0], 0.0, 1.0), ("T", days[1], 2.0, 4.0)], "ticker string, date date, Open double, Close double")
    r = prices.returns(one).orderBy("date").collect()
    assert r[0]["ret_overnight"] is None and r[0]["ret_intraday"] is None and r[1]["ret_close2close"] == 3.0


def test_quintiles_match_qcut(spark):
    for n in (5, 7, 13, 40):
        df = spark.createDataFrame([("d", f"{i:03}", float(i)) for i in range(n)], "date string, ticker string, signal double")
        got = [r["q"] for r in df.select("signal", stats.quintile().alias("q")).orderBy("signal").collect()]
        assert got == (pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1).tolist()
    df = spark.createDataFrame([("d", str(i), float(i)) for i in range(4)], "date string, ticker string, signal double")
    assert all(r["q"] is None for r in df.select(stats.quintile().alias("q")).collect())


def test_daily_ic(spark):
    rows = [(1, 1.0, float(i)) for i in range(5)] + [(2, float(i), float(i)) for i in range(4)] + [(3, float(i), float(-i)) for i in range(6)]
    got = {r["date"]: r["ic"] for r in stats.daily_ic(spark.createDataFrame(rows, "date int, s double, r double"), "s", "r").collect()}
    assert got[1] is None and 2 not in got and math.isclose(got[3], -1.0)


def test_event_window_edges(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(10)]
    df = spark.createDataFrame([("T", d, 0.5, 1.0 if i != 9 else None, 3) for i, d in enumerate(days)], "ticker string, date date, signal_organic_closed double, abnormal_return double, article_count_total int")
    limits = spark.createDataFrame([("T", 0.5, 0.1)], "ticker string, p80 double, p20 double")
    got = events.car_paths(df, limits).collect()
    assert {r["date"] for r in got} == {days[2], days[3]} and max(r["car"] for r in got) == 8.0


def test_student_p():
    for t, dof, p in ((2.0, 10, 0.0733880348), (0.0, 5, 1.0), (-12.0, 3, 0.001246), (1.0, 1, 0.5)):
        assert math.isclose(stats.student_p(t, dof), p, rel_tol=1e-3)
    assert stats.student_p(None, 3) is None and math.isclose(stats.normal_p(1.959964), 0.05, rel_tol=1e-5)


def test_flags(spark):
    df = spark.createDataFrame([(0.04, 0.041), (-0.04, 0.041), (0.2, 0.041), (None, 0.041), (0.01, 0.041)], "v double, b double")
    assert [r[0] for r in df.select(stats.benchmark_flag(F.col("v"), F.col("b"))).collect()] == ["OK", "SIGN!", "MAG!", "N/A", "MAG!"]


def test_split_and_sample(spark):
    df = spark.range(101).select("id", (F.col("id") % 3).alias("b"))
    assert sampling.split(df, "id").where("is_train").count() == 70
    got = sampling.stratified(df, "b", "id", 50)
    assert got.count() == 50 and sampling.stratified(df, "b", "id", 500).count() == 101
    ids = ordered.row_ids(df.select("id"), "id").collect()
    assert all(r["id"] == r["row_id"] for r in ids)
    p = sampling.permuted(df, "b", "id", 3)
    assert p.groupBy("b").count().orderBy("b").collect() == df.groupBy("b").count().orderBy("b").collect()


def test_moments_match_pandas(spark):
    x = np.random.default_rng(2).exponential(size=200)
    r = audit.moments(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert math.isclose(r["skew"], pd.Series(x).skew(), rel_tol=1e-9) and math.isclose(r["kurt"], pd.Series(x).kurt(), rel_tol=1e-9)


def test_nulls(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, None)], "a double, b double")
    assert [r[0] for r in nulls.clean(df).select("a").collect()] == [None, 2.0]
    assert [r[0] for r in nulls.clean(df).select(nulls.row_mean(F.col("a"), F.col("b"))).collect()] == [1.0, 2.0]
    assert nulls.ensure_columns(df, {"c": F.lit(0.0), "a": F.lit(9.0)}).columns == ["a", "b", "c"]


def test_files(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write(spark.createDataFrame([("2024-01", 1.0), ("2024-02", float("nan"))], "year_month string, x double"), path, ("year_month",))
    files.write(spark.createDataFrame([("2024-02", 5.0)], "year_month string, x double"), path, ("year_month",))
    assert sorted(r["x"] for r in files.read(spark, path).collect()) == [1.0, 5.0]
    with pytest.raises(files.MissingTable):
        files.read(spark, str(tmp_path / "none"))
    df = files.read(spark, path)
    assert files.content_hash(df) == files.content_hash(df.orderBy(F.desc("x"))) and json.loads(files.manifest(df))["rows"] == 2
    assert files.rewrite(spark, path, lambda t: t.withColumn("x", F.lit(0.0)), "v2").endswith(".v2")
    assert schemas.empty(spark, schemas.ARTICLES).count() == 0


def test_master_dimension_quirk(spark):
    day = dt.date(2024, 1, 1)
    sig = signals.daily_signals(art(spark, [(1.0, 0.1, "OPEN")] * 3)).unionByName(signals.daily_signals(art(spark, [(1.0, 0.1, "OPEN")] * 3).withColumn("ticker", F.lit("U"))))
    ret = spark.createDataFrame([("T", day, "S9", "MID", "BULL", 0.1, 0.1, 0.1), ("U", day, None, "MID", "BULL", 0.1, 0.1, 0.1)], "ticker string, date date, sector string, cap_tier string, market_regime string, ret_overnight double, ret_intraday double, ret_close2close double")
    dim = spark.createDataFrame([("T", "S1", "TOP10")], "ticker string, sector string, cap_tier string")
    got = {r["ticker"]: (r["sector"], r["cap_tier"]) for r in signals.master(sig, ret, dim).collect()}
    assert got == {"T": ("S1", "MID"), "U": ("UNKNOWN", "MID")}


def test_text_model(spark):
    df = spark.createDataFrame([("strong growth",), ("fraud probe",), (None,)], "t string")
    assert [r["sentiment"] for r in nlp.text_scores(df, "t").collect()] == ["positive", "negative", "neutral"]
    tries = nlp.extracted(df, "t", lambda: lambda p: "no").collect()
    assert all(r["n_retries"] == 2 and r["llm_sentiment"] is None for r in tries)


def test_streaming(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, TS(2024, 1, 1), "T", 1.0), (2, TS(2024, 1, 1, 1), "T", 3.0), (3, TS(2024, 1, 2), "T", 3.0)], "article_id int, datetime_ist timestamp, ticker string, tone_score double")
    rows.write.parquet(path)
    out = ingest.windowed_tone(ingest.articles(spark, path, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
    q = out.writeStream.format("memory").queryName("tone").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT n, tone FROM tone").collect()
    assert [tuple(r) for r in got] == [(2, 2.0)]


def test_total_order(spark):
    x = np.random.default_rng(4).integers(0, 40, 500)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)], "b int, v double").repartition(7)
    got = ordered.exact_quantiles(df, "v", {"a": 0.01, "b": 0.5, "c": 0.95, "d": 1.0}).first()
    assert np.allclose(got, np.quantile(x, [0.01, 0.5, 0.95, 1.0]))
    r = ordered.average_ranks(df, "v", "b").toPandas()
    assert np.allclose(r["rank"], r.groupby("b")["v"].rank())
    none = df.where("false")
    assert ordered.exact_quantiles(none, "v", {"a": 0.5}).first()["a"] is None and ordered.row_ids(none, "v").count() == 0


def test_news_loading(spark, tmp_path):
    path = str(tmp_path / "news")
    spine = spark.createDataFrame([("2024-01",), ("2024-02",), ("2024-03",)], "year_month string")

    def fetch(month):
        if month == "2024-02":
            raise OSError("remote")
        return spark.createDataFrame([(1, 2.0)], "a int, b double")

    assert news.load_months(spark, spine, path, fetch) == [("2024-01", "loaded"), ("2024-02", "failed"), ("2024-03", "loaded")]
    assert [x for _, x in news.load_months(spark, spine, path, fetch)] == ["skipped"] * 3
    assert ("2024-02", "failed") in news.load_months(spark, spine, path, fetch, retry_failed=True)
    raw = spark.createDataFrame([(20240105120000, "x", "https://a.com/REED", "1,2", None)], schemas.ARTICLES_RAW)
    assert news.scan(raw, "20240101", "20240131", "reed").count() == 1 and news.scan(raw, "20240201", "20240229", "reed").count() == 0
    with pytest.raises(news.TooLarge):
        news.scan(raw, "20240101", "20240131", "reed", most_bytes=1)
    assert news.processed(raw).first()["source_domain"] == "a.com"


def test_quotes(spark, tmp_path):
    def source(ticker, start, end):
        if ticker == "BAD":
            raise OSError("remote")
        return [(dt.datetime(2024, 1, 3), 1, 2, 1, 2, 10), (dt.date(2024, 1, 2), 1, 2, 1, None, 10)][: 1 if ticker == "A" else None][::-1]

    got = quotes.download(spark, lambda *a: [(x[0].date() if isinstance(x[0], dt.datetime) else x[0], *x[1:]) for x in source(*a)], ["A", "BAD", "C"], "2024-01-01", "2024-02-01").collect()
    assert sorted((r["ticker"], r["date"].day) for r in got) == [("A", 3), ("C", 2), ("C", 3)]
    (tmp_path / "i.jsonl").write_text('{"ticker": "A", "company": "Co", "sector": "S", "keywords": ["co"], "cap_tier": "MID"}\n')
    assert quotes.instruments(spark, str(tmp_path / "i.jsonl")).first()["keywords"] == ["co"]
    assert quotes.file_name("^X") == "IDX_X.parquet"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_answers_are_parsed_once(spark):
    df = spark.createDataFrame([('{"sentiment": "bullish", "confidence": 0.5, "rationale": "r", "entities": []}',)], "a string").select(text.checked_answer(F.col("a")).alias("c"))
    optimized = df.select("c.valid", "c.message", "c.score", "c.entities")._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json") <= 1 and optimized.count("regexp_extract(") <= 1
    assert df.select("c.valid", "c.score").first() == (True, 0.5)


def test_entity_join_scans_texts_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Label of BEL", "x"), (2, None, "NOTHing"), (3, "", None)], "i int, t string, u string")
    known = [("B", ["bel", None]), ("C", ["noth", "othi"]), ("D", []), ("E", None), ("F", [""]), (None, ["label"])]
    dim = spark.createDataFrame(known, "ticker string, keywords array<string>")
    for size in (1, 100):
        monkeypatch.setattr(articles, "BLOCK_KEYWORDS", size)
        got = articles.match_entities_join(docs, dim, ("t", "u"))
        assert "NestedLoop" not in plan(got) and got.columns == ["i", "t", "u", "ticker"]
        assert sorted((r["i"], str(r["ticker"])) for r in got.collect()) == [(1, "B"), (1, "F"), (1, "None"), (2, "C"), (2, "F"), (3, "F")]
    assert articles.match_entities_join(docs, dim.where("false"), ("t",)).count() == 0 and articles.match_entities_join(docs.where("false"), dim, ("t",)).count() == 0


def labelled(spark, n=400):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 5))
    y = (x[:, 0] + 0.2 * r.normal(size=n) > 0).astype(float)
    rows = [(i, dt.date(2022, 1, 1) + dt.timedelta(days=i), float(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, date date, label double, is_pr_wire double, has_promo_ratio double, has_risk_words double, source_tier double, tone_score double")


def test_split_by_date(spark):
    rows = labelled(spark)
    got = ml.with_split(rows, "id", train=("2022-01-01", "2022-06-30"), valid=("2022-07-01", "2022-12-31"))
    assert {(r["is_train"], r["n"]) for r in got.groupBy("is_train").agg(F.count("*").alias("n")).collect()} == {(True, 181), (False, 184)}
    back = ml.with_split(rows, "id", train=("2020-01-01", "2020-02-01"))
    assert back.where("is_train").count() == 280 and back.count() == 400
    with pytest.raises(ValueError):
        ml.with_split(rows.limit(12), "id", train=("2020-01-01", "2020-02-01"))


def test_classifier_chain(spark, tmp_path):
    features = (*ml.RULE_FEATURES, ml.TIER_FEATURE, "tone_score")
    rows = ml.with_split(labelled(spark), "id", train=("2022-01-01", "2022-09-30"), valid=("2022-10-01", "2023-12-31")).persist()
    model = ml.fit(rows, features, depth=3, rounds=20)
    valid = rows.where("not is_train")
    full = ml.auc(valid, model)
    gain = dict(ml.importance(model, features))
    assert full > 0.93 and gain["is_pr_wire"] > 60 and abs(sum(gain.values()) - 100) < 1e-6
    ml.save(model, str(tmp_path / "m"))
    ml.save(model, str(tmp_path / "m"))
    again = ml.load(str(tmp_path / "m"))
    score = lambda m: [r["sponsored_prob"] for r in ml.scored(valid, m).orderBy("id").collect()]
    assert score(again) == score(model) and all(0 <= p <= 1 for p in score(model))
    drops = {r["feature"]: r["drop_mean"] for r in ml.permutation_importance(valid, model, features, "id", repeats=2).collect()}
    assert drops["is_pr_wire"] > 0.2 and abs(drops["source_tier"]) < 0.1
    got = ml.circularity(rows, model, "id", features, repeats=1, rounds=3).first()
    assert got["is_circular"] and got["rule_gain_pct"] > 60 and got["auc_without_rules"] < 0.65 and got["auc_full"] == full
    assert not ml.circular(60, 60, 0.65, 0.15) and ml.circular(0, 0, 0.64, 0) and ml.circular(0, 0, 0.9, 0.16) and ml.circular(61, 0, 1, 0) and ml.circular(0, 61, 1, 0)
    assert ml.feature_sets()["without rules and tier"] == tuple(f for f in articles.FEATURES if f not in features[:4])
    rows.unpersist()


def test_normal_and_student_p(spark):
    df = spark.createDataFrame([(0.0,), (1.959963984540054,), (-8.0,), (None,)], "z double")
    got = [r["p"] for r in stats.with_normal_p(df, "z", "p").collect()]
    assert got[0] == 1 and abs(got[1] - 0.05) < 1e-12 and 0 < got[2] < 1e-14 and got[3] is None
    t = [r["p"] for r in stats.with_p(df, "z", F.lit(10), "p").collect()]
    assert t[0] == 1 and abs(t[1] - 0.0784) < 1e-3 and t[3] is None


def test_poisoned_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None)], "k string, v double")
    got = {r["k"]: (r["m"], r["s"]) for r in df.groupBy("k").agg(stats.poisoned_mean(F.col("v")).alias("m"), stats.poisoned_std(F.col("v")).alias("s")).collect()}
    assert got["a"][0] == 1.5 and got["b"] == (None, None)


def test_window_labels(spark):
    days = [dt.date(2020, 2, 29), dt.date(2020, 3, 1), dt.date(2020, 6, 30), dt.date(2020, 7, 1), dt.date(2024, 7, 1), None]
    assert column(spark, days, "date", timeops.window_label) == [None, "COVID", "COVID", None, "Holdout", None]
    assert column(spark, [0.3, 0.5, 0.7, None], "double", audit.uncertain) == [False, True, False, None]
    assert column(spark, [0.3, 0.5, 0.7, None], "double", lambda c: audit.uncertain(c, inclusive=True)) == [True, True, True, None]


def test_stages_from_news_to_master(spark, tmp_path):
    firms = adapters.firms(spark)
    with pytest.raises(files.MissingTable):
        stages.signals(spark, str(tmp_path / "none"))
    folder = catalogue.stage_tables(spark, DATA)
    got = stages.run(spark, folder, firms)
    scored = files.read(spark, f"{folder}/scored")
    assert got.columns == list(schemas.MASTER_COLUMNS) and scored.where("sponsored_prob between 0 and 1").count() == scored.count() == files.read(spark, f"{folder}/labelled").count()
    want = signals.master(signals.daily_signals(scored), files.read(spark, f"{folder}/returns"), firms)
    assert got.count() == want.count() > 0 and files.content_hash(nulls.rounded(got)) == files.content_hash(nulls.rounded(want))
    model = ml.load(f"{folder}/model")
    one = ml.scored(scored.drop("sponsored_prob"), model)
    assert one.join(scored.select("article_id", "ticker", F.col("sponsored_prob").alias("p")), ["article_id", "ticker"]).where("abs(p - sponsored_prob) > 1e-12").count() == 0
    before = files.content_hash(scored)
    assert stages.run(spark, folder, firms, again=False).count() == got.count() and files.content_hash(files.read(spark, f"{folder}/scored")) == before
    with pytest.raises(stages.NothingLeft):
        stages.label(spark, folder, firms.where("ticker = 'T99'"))
