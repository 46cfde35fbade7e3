"""The same queries in DuckDB's SQL.  Shared relations are CTEs, put in front of those that use them."""

from __future__ import annotations

from .. import config


def _any(col: str, parts) -> str:
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"


CTES: dict[str, str] = {
    "art0": """SELECT event_id AS article_id, 'T' || CAST(user_id % 20 AS VARCHAR) AS ticker, ts + INTERVAL 330 MINUTE AS ist,
        CASE WHEN event_id % 97 <> 0 THEN (value - 50) / 5 END AS tone_score,
        CASE WHEN event_id % 89 <> 0 THEN CAST(event_id * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS prob, event_type AS source_domain FROM events""",
    "art1": """SELECT *, CASE WHEN hour(ist) * 60 + minute(ist) < 555 THEN 'CLOSED_PRE' WHEN hour(ist) * 60 + minute(ist) < 930 THEN 'OPEN' ELSE 'CLOSED_POST' END AS time_bucket FROM art0""",
    "art2": """SELECT *, CAST(ist AS DATE) + CAST(CASE WHEN time_bucket = 'CLOSED_POST' THEN 1 ELSE 0 END AS INTEGER) AS d FROM art1""",
    "art": """SELECT *, d + CAST(CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS effective_date,
        tone_score / 10 AS nt, coalesce(prob, 0.5) AS ws, 1 - coalesce(prob, 0.5) AS wo, time_bucket <> 'OPEN' AS closed,
        coalesce(prob < 0.3, false) AS org, coalesce(prob > 0.7, false) AS spon FROM art2""",
    "sig": """SELECT ticker, effective_date,
        CASE WHEN sum(wo) > 0 THEN coalesce(sum(nt * wo), 0) / sum(wo) ELSE 0 END AS organic_signal,
        CASE WHEN sum(ws) > 0 THEN coalesce(sum(nt * ws), 0) / sum(ws) ELSE 0 END AS sponsored_signal,
        count(*) AS article_count_total, count(*) FILTER (WHERE org) AS article_count_organic, count(*) FILTER (WHERE spon) AS article_count_sponsored,
        CASE WHEN sum(wo) FILTER (WHERE org AND closed) > 0 THEN coalesce(sum(nt * wo) FILTER (WHERE org AND closed), 0) / sum(wo) FILTER (WHERE org AND closed) END AS signal_organic_closed,
        CASE WHEN sum(wo) FILTER (WHERE org AND NOT closed) > 0 THEN coalesce(sum(nt * wo) FILTER (WHERE org AND NOT closed), 0) / sum(wo) FILTER (WHERE org AND NOT closed) END AS signal_organic_open,
        CASE WHEN sum(ws) FILTER (WHERE spon AND closed) > 0 THEN coalesce(sum(nt * ws) FILTER (WHERE spon AND closed), 0) / sum(ws) FILTER (WHERE spon AND closed) END AS signal_sponsored_closed,
        CASE WHEN sum(ws) FILTER (WHERE spon AND NOT closed) > 0 THEN coalesce(sum(nt * ws) FILTER (WHERE spon AND NOT closed), 0) / sum(ws) FILTER (WHERE spon AND NOT closed) END AS signal_sponsored_open
        FROM art GROUP BY ALL""",
    "px": """SELECT 'T' || CAST(user_id % 20 AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, arg_min(value, ts) AS o, arg_max(value, ts) AS c FROM events GROUP BY ALL""",
    "ret": """SELECT *, o / nullif(lag(c) OVER w, 0) - 1 AS ret_overnight, c / nullif(o, 0) - 1 AS ret_intraday, c / nullif(lag(c) OVER w, 0) - 1 AS ret_close2close FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "idx": """SELECT CAST(ts AS DATE) AS date, avg(value) AS c FROM events GROUP BY ALL""",
    "reg": """SELECT date, CASE WHEN c / lag(c, 3) OVER (ORDER BY date) - 1 > 0.02 THEN 'BULL' WHEN c / lag(c, 3) OVER (ORDER BY date) - 1 < -0.02 THEN 'BEAR' ELSE 'SIDEWAYS' END AS market_regime FROM idx""",
    "mst": """SELECT s.*, s.effective_date AS date, organic_signal - sponsored_signal AS net_signal, r.ret_overnight, r.ret_intraday, r.ret_close2close, g.market_regime
        FROM sig s JOIN ret r ON s.ticker = r.ticker AND s.effective_date = r.date LEFT JOIN reg g ON g.date = r.date WHERE article_count_total >= 3""",
    "nxt": """SELECT *, lead(ret_overnight) OVER w AS on_next, lead(ret_intraday) OVER w AS id_next, lead(ret_close2close) OVER w AS cc_next FROM mst WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "pairs": """SELECT * FROM (SELECT 'organic_closed' AS cell, date, signal_organic_closed AS x, on_next AS y FROM nxt UNION ALL SELECT 'organic_open', date, signal_organic_open, ret_intraday FROM nxt
        UNION ALL SELECT 'sponsored_closed', date, signal_sponsored_closed, on_next FROM nxt UNION ALL SELECT 'sponsored_open', date, signal_sponsored_open, ret_intraday FROM nxt) WHERE x IS NOT NULL AND y IS NOT NULL""",
    "ranked": """SELECT cell, date, rank() OVER (PARTITION BY cell, date ORDER BY x) + (count(*) OVER (PARTITION BY cell, date, x) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY cell, date ORDER BY y) + (count(*) OVER (PARTITION BY cell, date, y) - 1) / 2 AS ry FROM pairs""",
    "ics": """SELECT cell, date, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic FROM ranked GROUP BY cell, date HAVING count(*) >= 5""",
    "rolled": """SELECT *, avg(ic) OVER (PARTITION BY cell ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS roll FROM ics""",
    "grid": """SELECT date, max(ic) FILTER (WHERE cell = 'organic_closed') AS organic_closed, max(ic) FILTER (WHERE cell = 'organic_open') AS organic_open,
        max(ic) FILTER (WHERE cell = 'sponsored_closed') AS sponsored_closed, max(ic) FILTER (WHERE cell = 'sponsored_open') AS sponsored_open FROM ics GROUP BY date HAVING count(DISTINCT cell) = 4""",
    "ab": """SELECT m.*, m.ret_close2close - i.r AS ar FROM mst m LEFT JOIN (SELECT date, c / nullif(lag(c) OVER (ORDER BY date), 0) - 1 AS r FROM idx) i USING (date)""",
    "lim": """SELECT ticker, quantile_cont(signal_organic_closed, 0.8) AS p80, quantile_cont(signal_organic_closed, 0.2) AS p20 FROM ab WHERE date < DATE '2024-01-16' GROUP BY ticker HAVING p80 IS NOT NULL""",
    "url0": """SELECT page_id AS article_id, page_id AS k, regexp_replace(url, '[?#].*$', '') AS b, url FROM pages""",
    "urls": """SELECT article_id, CASE WHEN k % 7 = 0 THEN b || '/sponsored/strong-growth-for-firm-1170456789.html' WHEN k % 7 = 1 THEN 'https://www.Reuters.com/markets/probe-into-loss-' || k || '12345.html'
        WHEN k % 7 = 2 THEN 'https://www.prnewswire.com/news-releases/proud-milestone_' || k || '.cms' WHEN k % 7 = 3 THEN 'https://economictimes.indiatimes.com/record-results-up/articleshow/' || (k + 100000) || '.cms'
        WHEN k % 7 = 4 THEN 'https://zeebiz.com/story/article-quarter-' || k || '?x=1' ELSE url END AS source_url, CAST(k * 37 % 201 - 100 AS DOUBLE) / 10 AS tone, DATE '2023-01-02' + CAST(k % 400 AS INTEGER) AS effective_date FROM url0""",
    "ul": f"""SELECT *, lower(source_url) AS u, CASE WHEN {_any("lower(source_url)", config.TIER1_DOMAINS)} THEN 1 WHEN {_any("lower(source_url)", config.TIER2_DOMAINS)} THEN 2
        WHEN {_any("lower(source_url)", config.TIER3_DOMAINS)} THEN 3 ELSE 2 END AS source_tier FROM urls""",
    "uw": f"""SELECT *, {_any("u", config.SPONSORED_URL_PATTERNS)} AS sp, {_any("u", config.TIER3_DOMAINS[: config.PR_WIRES])} AS pr, {_any("u", config.RISK_KEYWORDS)} AS risk, {_any("u", config.ORGANIC_LABEL_DOMAINS)} AS qual,
        ({" + ".join(f"CAST(contains(u, '{w}') AS INTEGER)" for w in config.PROMO_KEYWORDS)}) / CAST({len(config.PROMO_KEYWORDS)} AS DOUBLE) AS promo FROM ul""",
    "wl": """SELECT *, CASE WHEN qual AND (tone <= 0 OR risk) THEN CAST(0 AS DOUBLE) WHEN sp OR pr OR (tone >= (SELECT quantile_cont(tone, 0.95) FROM uw) AND source_tier > 1) THEN CAST(1 AS DOUBLE) END AS weak_label FROM uw""",
    "lab": """SELECT d.doc_id, l.quality, least(0.99, round((CAST(d.doc_id * 7919 % 997 AS DOUBLE) / 997 + l.quality * CAST(0.3 AS DOUBLE)) / CAST(1.3 AS DOUBLE), 2)) AS score FROM documents d JOIN labels l USING (doc_id)""",
    "cum": """SELECT s, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM (SELECT score AS s, sum(quality) AS pos, count(*) AS n FROM lab GROUP BY score) WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)""",
    "tones": """SELECT event_id AS article_id, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 11 = 1 THEN CAST(round(value, 2) AS VARCHAR) || ',x,2' WHEN event_id % 11 = 2 THEN NULL
        WHEN event_id % 11 = 3 THEN CAST(round(value, 2) AS VARCHAR) || ',1' ELSE CAST(round(value, 2) AS VARCHAR) || ',2.5,1.5,4,20.25,0,' || (event_id % 500) END AS t, ts FROM events""",
    "ans": """SELECT event_id AS i, event_type AS bucket, CASE event_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS mood, CAST(event_id % 100 AS DOUBLE) / 100 AS conf, event_id % 11 AS m FROM events""",
    "chk": """SELECT *, CASE m WHEN 2 THEN 'Confidence out of range' WHEN 3 THEN 'Missing field: entities' WHEN 4 THEN 'Not a dict' WHEN 5 THEN 'Invalid sentiment' ELSE 'OK' END AS message FROM ans""",
    "dim": """SELECT 'T' || i AS ticker, 'S' || (i % 4) AS sector, CASE WHEN i < 4 THEN 'TOP10' WHEN i < 10 THEN 'MID' ELSE 'TAIL' END AS cap_tier FROM range(19) t(i)""",
    "oidx": """SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS c FROM orders GROUP BY ALL""",
    "oret": """SELECT date, c, c / nullif(lag(c) OVER (ORDER BY date), 0) - 1 AS r FROM oidx""",
    "cov": """SELECT t.ticker, m.year_month, coalesce(n, 0) AS n FROM (SELECT 'T' || i AS ticker FROM range(20) r(i)) t CROSS JOIN (SELECT unnest(['2023-12', '2024-01', '2024-02', '2024-03']) AS year_month) m
        LEFT JOIN (SELECT ticker, strftime(effective_date, '%Y-%m') AS year_month, count(*) AS n FROM art GROUP BY ALL) c USING (ticker, year_month)""",
    "grp": """SELECT *, CASE WHEN prob <= 0.3 THEN 'organic' WHEN prob <= 0.7 THEN 'uncertain' WHEN prob > 0.7 THEN 'sponsored' END AS prob_group FROM art""",
    "hashed": """SELECT article_id, time_bucket, ((h2 * 48271) + 42) % 1000003 AS h FROM (SELECT *, (h1 * h1 + article_id) % 1000003 AS h2 FROM (SELECT *, (article_id * 7919 + 42 * 104729) % 1000003 AS h1 FROM art))""",
}
NEEDS = {
    "art": "art0 art1 art2 art", "sig": "art0 art1 art2 art sig", "ret": "px ret", "mst": "art0 art1 art2 art sig px ret idx reg mst",
    "nxt": "art0 art1 art2 art sig px ret idx reg mst nxt", "ics": "art0 art1 art2 art sig px ret idx reg mst nxt pairs ranked ics",
    "rolled": "art0 art1 art2 art sig px ret idx reg mst nxt pairs ranked ics rolled", "grid": "art0 art1 art2 art sig px ret idx reg mst nxt pairs ranked ics grid",
    "lim": "art0 art1 art2 art sig px ret idx reg mst ab lim", "urls": "url0 urls", "wl": "url0 urls ul uw wl", "uw": "url0 urls ul uw", "lab": "lab", "cum": "lab cum", "rawurls": "url0 urls tones", "tones": "tones",
    "chk": "ans chk", "dim": "dim", "artdim": "art0 art1 art2 art dim", "oret": "oidx oret", "cov": "art0 art1 art2 art cov", "grp": "art0 art1 art2 art grp", "hashed": "art0 art1 art2 art hashed",
    "panel": "px ret idx reg dim", "mstdim": "art0 art1 art2 art sig px ret idx reg dim", "reg": "idx reg", "": "",
}

_sql: dict[str, tuple[str, str]] = {}


def _r(*names: str) -> str:
    parts = [n.rpartition(" AS ") for n in names]
    return ", ".join(f"round({e or name}, 6) AS {name}" for e, _, name in parts)


SIGNAL_COLUMNS = _r("organic_signal", "sponsored_signal", "organic_signal - sponsored_signal AS net_signal") + ", article_count_total, article_count_organic, article_count_sponsored, " + _r("signal_organic_closed", "signal_organic_open", "signal_sponsored_closed", "signal_sponsored_open")
T = "avg({0}) / nullif(stddev_samp({0}) / sqrt(count({0})), 0)"
METRICS = "SELECT cell, count(*) AS n_days, " + _r("avg(ic) AS ic_mean", "stddev_samp(ic) AS ic_std", "CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END AS icir", T.format("ic") + " AS t_stat", "100 * avg(CASE WHEN ic > 0 THEN 1 ELSE 0 END) AS hit_rate", "100 * avg(CASE WHEN roll > 0 THEN 1 ELSE 0 END) AS stability")
DESCRIBE = "count({0}) AS n, " + ", ".join(f"round({e}, 6) AS {k}" for e, k in (("avg({0})", "mean"), ("stddev_samp({0})", "std"), ("min({0})", "min"), ("quantile_cont({0}, 0.25)", "q25"), ("quantile_cont({0}, 0.5)", "q50"), ("quantile_cont({0}, 0.75)", "q75"), ("max({0})", "max")))


def _bootstrap(replicates: int, source: str, columns: str) -> str:
    """Means of resampled rows, by the same integer draws."""
    return f"""num AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM {source}), cnt AS (SELECT count(*) AS n FROM num),
        d0 AS (SELECT b, d, n, (b * 7919 + d * 104729 + 42) % 1000003 AS h1 FROM range({replicates}) rb(b), cnt, unnest(range(n)) rd(d)),
        d1 AS (SELECT b, d, n, (h1 * h1 + b) % 1000003 AS h2 FROM d0), d2 AS (SELECT b, d, n, (h2 * h2 + d) % 1000003 AS h3 FROM d1),
        d3 AS (SELECT b, ((h3 * 48271 + b * 31) % 1000003) % n AS i FROM d2), boot AS (SELECT b, {columns} FROM d3 JOIN num USING (i) GROUP BY b)"""


def _normal_p(z: str) -> str:
    """Two-sided p of a normal deviate: one minus the error function, by a series of positive terms."""
    x = f"(abs({z}) / sqrt(2))"
    terms = f"list_sum(list_transform(range(0, 400), lambda k: exp(k * ln(2) + (2 * k + 1) * ln({x}) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))"
    return f"CASE WHEN {z} = 0 THEN 1 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms}) END"


def _student_p(t: str, dof: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom: the finite sums over powers of the angle's cosine."""
    a = f"atan(abs({t}) / sqrt({dof}))"
    even = f"sin({a}) * list_sum(list_transform(range(0, CAST(({dof}) // 2 AS BIGINT)), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)) * pow(cos({a}), 2 * k)))"
    odd = f"2 / pi() * ({a} + sin({a}) * cos({a}) * coalesce(list_sum(list_transform(range(0, CAST(({dof} - 1) // 2 AS BIGINT)), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(cos({a}), 2 * k))), 0))"
    return f"(1 - CASE WHEN ({dof}) % 2 = 0 THEN {even} ELSE {odd} END)"


def _add(name: str, needs: str, sql: str) -> None:
    _sql[name] = (needs, sql)


_add("time_bucket", "art", "SELECT time_bucket, count(*) AS n, min(article_id) AS first_id, max(article_id) AS last_id FROM art GROUP BY ALL")
_add("effective_date", "art", "SELECT article_id, time_bucket, effective_date FROM art")
_add("next_trading_day", "", "SELECT date, date + CAST(CASE isodow(date) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS next_day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)")
_add("trading_calendar", "", "SELECT CAST(d AS DATE) AS trading_day FROM range(DATE '2019-01-01', DATE '2027-01-02', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6")
_add("month_spine", "", "SELECT CAST(d AS DATE) AS month_start, last_day(d) AS month_end, strftime(d, '%Y-%m') AS year_month FROM range(DATE '2019-12-01', DATE '2026-03-31', INTERVAL 1 MONTH) t(d)")
_add("source_domain", "", "SELECT page_id, nullif(lower(regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1)), '') AS source_domain FROM pages")
_add("source_tier", "uw", "SELECT article_id, source_tier, pr AS is_pr_wire FROM uw")
_add("keyword_flags", "uw", "SELECT article_id, sp AS sponsored_url, CAST(risk AS INTEGER) AS risk, round(promo, 6) AS promo_ratio FROM uw")
_add("url_slug_title", "urls", r"""SELECT article_id, CASE WHEN length(title) >= 8 AND NOT regexp_full_match(title, '[\d ]+') THEN title END AS title FROM (
    SELECT article_id, trim(regexp_replace(regexp_replace(regexp_replace(slug, '[-_]?\d{5,}$', ''), '(?i)^(article|story|news|post|blog)[-_]', ''), '[-_]+', ' ', 'g')) AS title FROM (
    SELECT article_id, CASE WHEN regexp_full_match(parts[-1], '\d+') OR lower(parts[-1]) = 'articleshow'
        THEN coalesce(list_filter(list_reverse(parts), lambda s: NOT regexp_full_match(s, '\d+') AND lower(s) <> 'articleshow' AND length(s) > 3)[1], parts[-1]) ELSE parts[-1] END AS slug FROM (
    SELECT article_id, string_split(regexp_replace(rtrim(regexp_extract(source_url, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), '(?i)\.(html?|cms|php|asp|aspx|jsp|xml|json)$', ''), '/') AS parts FROM urls)))""")
_add("v2tone_parse", "tones", "SELECT article_id, " + ", ".join(f"round(coalesce(TRY_CAST(string_split(coalesce(t, ''), ',')[{i + 1}] AS DOUBLE), 0), 6) AS {f}" for i, f in enumerate(("tone", "positive_score", "negative_score", "polarity", "activity_ref_density", "self_group_ref_density", "word_count"))) + " FROM tones")
_add("int_timestamp_parse", "", "SELECT event_id AS article_id, strftime(date_trunc('second', ts) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS local FROM events WHERE event_id % 13 <> 0")
_add("processed_articles", "rawurls", r"""SELECT strftime(date_trunc('second', ts) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS local, round(coalesce(TRY_CAST(string_split(coalesce(t, ''), ',')[1] AS DOUBLE), 0), 6) AS tone,
    round(coalesce(TRY_CAST(string_split(coalesce(t, ''), ',')[7] AS DOUBLE), 0), 6) AS word_count, source_url, nullif(lower(regexp_extract(source_url, 'https?://(?:www\.)?([^/]+)', 1)), '') AS source_domain
    FROM tones JOIN urls USING (article_id) WHERE article_id % 13 <> 0 AND (article_id % 3 = 0 OR regexp_matches(lower(source_url), 'reed|zeebiz'))""")
_add("bucket_counts", "art", """SELECT bucket, n, pct, bucket || ' (n=' || n || ')' AS label FROM (SELECT CASE WHEN org THEN 'organic' ELSE 'sponsored' END || '_' || CASE WHEN closed THEN 'closed' ELSE 'open' END AS bucket,
    count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM art WHERE org OR spon GROUP BY 1)""")
_add("keyword_regex_filter", "", "SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(lower(coalesce(text, '')), 'tion|l&t|queux') GROUP BY lang")
_WORDS = ("then", "ation", "quel", "unge", "ciones", "ther", "lich", "eaux", "ción", "heit")
_ENT = "ent AS (SELECT 'E' || (i - 1) AS ticker, w FROM (SELECT unnest([" + ", ".join(f"'{w}'" for w in _WORDS) + "]) AS w, generate_subscripts([" + ", ".join(f"'{w}'" for w in _WORDS) + "], 1) AS i))"
_add("ticker_match_explode", "", f"WITH {_ENT} SELECT doc_id, ticker FROM documents d JOIN ent e ON contains(lower(d.text), w) OR contains(lower(d.source), w)")
_add("ticker_match_join", "", f"WITH {_ENT} SELECT ticker, count(*) AS n FROM documents d JOIN ent e ON contains(lower(d.text), w) GROUP BY ticker")
_add("weak_labels", "wl", "SELECT article_id, source_tier, weak_label FROM wl")
_add("label_by_tier_pivot", "wl", "SELECT source_tier, count(*) FILTER (WHERE weak_label = 0) AS organic, count(*) FILTER (WHERE weak_label = 1) AS sponsored, count(*) FILTER (WHERE weak_label IS NULL) AS unlabelled FROM wl GROUP BY source_tier")
_VAR = "CASE WHEN count({0}) OVER w >= 5 THEN coalesce(var_samp({0}) OVER w, 0) ELSE 0 END"
_add("tone_rolling_var", "art", f"SELECT article_id, round({_VAR.format('coalesce(tone_score, 0)')}, 6) AS tone_30d_variance FROM art WINDOW w AS (PARTITION BY source_domain ORDER BY ist, article_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
_add("cross_seed_count", "art", "SELECT article_id, CAST(k AS DOUBLE) AS cross_seed_count FROM art JOIN (SELECT effective_date, count(DISTINCT source_domain) AS k FROM art GROUP BY ALL) USING (effective_date)")
_BURST = "SELECT effective_date, CASE WHEN stddev_samp(n) OVER () > 0 THEN (n - avg(n) OVER ()) / stddev_samp(n) OVER () ELSE 0 END AS z FROM (SELECT effective_date, count(*) AS n FROM {} GROUP BY ALL)"
_add("mention_burst", "art", f"SELECT effective_date, round(z, 6) AS mention_burst_score FROM ({_BURST.format('art')})")
_add("feature_matrix", "wl", f"""WITH f AS (SELECT *, nullif(lower(regexp_extract(source_url, 'https?://(?:www\\.)?([^/]+)', 1)), '') AS dom, CAST(article_id % 10 AS DOUBLE) AS ps, CAST(-(article_id % 7) AS DOUBLE) AS ns FROM wl)
    SELECT article_id, round(tone, 6) AS tone_score, ps AS positive_score, ns + 0 AS negative_score, CAST(0 AS DOUBLE) AS polarity, CAST(0 AS DOUBLE) AS word_count, round(ps / (abs(ns) + 0.001), 6) AS p_n_ratio, CAST(pr AS INTEGER) AS is_pr_wire,
    round(promo, 6) AS has_promo_ratio, CAST(risk AS INTEGER) AS has_risk_words, round(CASE WHEN dom IS NULL THEN 0 ELSE {_VAR.format("tone")} END, 6) AS tone_30d_variance,
    CAST(k AS DOUBLE) AS cross_seed_count, round(z, 6) AS mention_burst_score, source_tier FROM f JOIN (SELECT effective_date, count(DISTINCT dom) AS k FROM f GROUP BY ALL) USING (effective_date) JOIN ({_BURST.format("f")}) USING (effective_date)
    WINDOW w AS (PARTITION BY dom ORDER BY effective_date, article_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
_add("daily_signals", "sig", f"SELECT ticker, effective_date, {SIGNAL_COLUMNS} FROM sig")
_add("batch_signals", "art", """WITH s AS (SELECT *, tone_score / 10 * greatest(1 - p, 0.3) * CASE WHEN closed THEN 1.5 ELSE 1.0 END AS sc FROM (SELECT *, CASE WHEN prob = 0 THEN 0.5 ELSE prob END AS p FROM art)),
    g AS (SELECT ticker, effective_date, count(*) AS n_articles, CASE WHEN count(*) >= 3 AND count(CASE WHEN p IS NULL THEN NULL ELSE sc END) = count(*) THEN avg(sc) END AS raw_signal,
    CASE WHEN count(*) >= 3 THEN count(*) FILTER (WHERE org) ELSE 0 END AS n_organic, CASE WHEN count(*) >= 3 THEN count(*) FILTER (WHERE spon) ELSE 0 END AS n_sponsored FROM s GROUP BY ALL)
    SELECT ticker, effective_date, round(raw_signal, 6) AS raw_signal, round(tanh(1.8 * raw_signal), 6) AS pred_score, CASE WHEN n_articles < 3 THEN 'INSUFFICIENT_DATA' WHEN tanh(1.8 * raw_signal) > 0.1 THEN 'BULLISH' WHEN tanh(1.8 * raw_signal) < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction,
    n_articles, n_organic, n_sponsored FROM g""")
_add("returns_panel", "ret", "SELECT ticker, date, " + _r("ret_overnight", "ret_intraday", "ret_close2close") + " FROM ret")
_add("market_regime", "oret", """WITH w AS (SELECT date, CASE WHEN count(r) OVER v = 60 THEN product(1 + r) OVER v - 1 END AS ret60 FROM oret WINDOW v AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT date, round(ret60, 6) AS ret60, CASE WHEN ret60 > 0.1 THEN 'BULL' WHEN ret60 < -0.1 THEN 'BEAR' ELSE 'SIDEWAYS' END AS market_regime FROM w""")
_add("index_pct_change", "oret", "SELECT date, round(r, 6) AS ret FROM oret")
_add("panel_with_dims", "panel", "SELECT ticker, date, coalesce(sector, 'INDEX') AS sector, coalesce(cap_tier, 'INDEX') AS cap_tier, coalesce(market_regime, 'SIDEWAYS') AS market_regime, round(ret_close2close, 6) AS ret_close2close FROM ret LEFT JOIN dim USING (ticker) LEFT JOIN reg USING (date)")
_add("master_dataset", "mstdim", f"""SELECT s.ticker, s.effective_date AS date, coalesce(d.sector, 'UNKNOWN') AS sector, coalesce(d.cap_tier, 'INDEX') AS cap_tier, coalesce(g.market_regime, 'SIDEWAYS') AS market_regime, {SIGNAL_COLUMNS},
    {_r("ret_overnight", "ret_intraday", "ret_close2close")} FROM sig s JOIN ret r ON s.ticker = r.ticker AND s.effective_date = r.date LEFT JOIN dim d ON d.ticker = s.ticker LEFT JOIN reg g ON g.date = r.date""")
_add("return_consistency", "mst", "SELECT count(*) AS n, " + ", ".join(f"round(max(abs(m.{c} - r.{c})), 6) AS diff_{c}" for c in ("ret_overnight", "ret_intraday", "ret_close2close")) + " FROM mst m JOIN ret r ON m.ticker = r.ticker AND m.date = r.date")
_add("coverage_spine", "cov", "SELECT * FROM cov")
_add("coverage_bands", "cov", "SELECT count(*) AS cells, " + _r("100 * avg(CAST(n = 0 AS INTEGER)) AS pct_zero", "100 * avg(CAST(n IN (1, 2) AS INTEGER)) AS pct_one_two", "100 * avg(CAST(n >= 3 AS INTEGER)) AS pct_three_up") + " FROM cov")
_add("monthly_pivot", "art", "SELECT strftime(effective_date, '%Y-%m') AS year_month, " + _r(*(f"sum(tone_score) FILTER (WHERE time_bucket = '{b}') AS {b.lower()}" for b in ("CLOSED_PRE", "OPEN", "CLOSED_POST"))) + " FROM art GROUP BY ALL")
_add("monthly_top_bottom", "oret", """WITH m AS (SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS n, sum(c) AS total FROM oidx GROUP BY ALL)
    SELECT year_month, n, round(total, 6) AS total, side FROM ((SELECT *, 'top' AS side FROM m ORDER BY total DESC, year_month LIMIT 5) UNION ALL (SELECT *, 'bottom' AS side FROM m ORDER BY total, year_month LIMIT 5))""")
_WINS = "q AS (SELECT quantile_cont(ret_close2close, 0.01) AS a0, quantile_cont(ret_close2close, 0.99) AS a1, quantile_cont(ret_intraday, 0.01) AS b0, quantile_cont(ret_intraday, 0.99) AS b1 FROM ret)"
_CLIP = "CASE WHEN {0} IS NOT NULL THEN least(greatest({0}, {1}), {2}) END"


def _changed(x: str, lo: str, hi: str) -> str:
    new = _CLIP.format(x, lo, hi)
    return f"CAST(coalesce(abs({x} - {new}) > 1e-8 + 1e-5 * abs({new}), true) AS INTEGER)"


_add("winsorize", "ret", f"WITH {_WINS} SELECT ticker, date, {_changed('ret_close2close', 'a0', 'a1')} AS n_ret_close2close, round({_CLIP.format('ret_close2close', 'a0', 'a1')}, 6) AS ret_close2close, {_changed('ret_intraday', 'b0', 'b1')} AS n_ret_intraday, round({_CLIP.format('ret_intraday', 'b0', 'b1')}, 6) AS ret_intraday FROM ret, q")
_add("return_moments", "", """WITH p AS (SELECT 'C' || (o_custkey % 5) AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS c FROM orders GROUP BY ALL), r AS (SELECT c / nullif(lag(c) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS x FROM p)
    SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(skewness(x), 6) AS skew, round(kurtosis(x), 6) AS kurt FROM r""")
_add("readiness_summary", "mst", "SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, min(date) AS first_date, max(date) AS last_date, " + ", ".join(f"count(*) FILTER (WHERE {c} <> 0 AND ret_intraday IS NOT NULL) AS ready_{c}" for c in ("signal_organic_closed", "signal_organic_open", "signal_sponsored_closed", "signal_sponsored_open")) + " FROM mst")
_add("filter_funnel", "uw", """SELECT 0 AS step, 'all' AS name, count(*) AS n FROM uw UNION ALL SELECT 1, 'not pr wire', count(*) FILTER (WHERE NOT pr) FROM uw UNION ALL SELECT 2, 'not sponsored url', count(*) FILTER (WHERE NOT pr AND NOT sp) FROM uw
    UNION ALL SELECT 3, 'tone up to 5', count(*) FILTER (WHERE NOT pr AND NOT sp AND tone <= 5) FROM uw UNION ALL SELECT 4, 'tier 1 or 2', count(*) FILTER (WHERE NOT pr AND NOT sp AND tone <= 5 AND source_tier <= 2) FROM uw""")
_add("prob_group_tone", "grp", f"SELECT prob_group, {DESCRIBE.format('tone_score')} FROM grp WHERE prob_group IS NOT NULL GROUP BY prob_group")
_M = "avg(tone_score) FILTER (WHERE prob_group = '{}')"
_add("group_mean_difference", "grp", f"SELECT round({_M.format('sponsored')} - {_M.format('organic')}, 6) AS separation, round(abs({_M.format('sponsored')}) - abs({_M.format('organic')}), 6) AS abs_separation FROM grp")
_add("domain_stats", "art", "SELECT source_domain, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(tone_score), 6) AS mean_tone, arg_min(ticker, article_id) AS first_ticker FROM art GROUP BY source_domain HAVING count(*) >= 5 ORDER BY avg(prob) DESC, source_domain LIMIT 20")
_add("uncertain_zone", "art", "SELECT source_domain, time_bucket, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM art WHERE prob > 0.3 AND prob < 0.7 GROUP BY source_domain, time_bucket")
_add("uncertain_zone_inclusive", "art", "SELECT source_domain, time_bucket, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM art WHERE prob >= 0.3 AND prob <= 0.7 GROUP BY source_domain, time_bucket")
_add("describe", "art", f"SELECT source_domain, {DESCRIBE.format('tone_score')} FROM art GROUP BY source_domain")
_CELLS = ("signal_organic_closed", "signal_organic_open", "signal_sponsored_closed", "signal_sponsored_open")
_add("coverage_metrics", "sig", "SELECT count(*) AS n, " + ", ".join(f"count({c}) AS n_{c}, round(100 * count({c}) / count(*), 6) AS pct_{c}" for c in _CELLS) + " FROM sig")
_MEAN2 = "(coalesce({0}, 0) + coalesce({1}, 0)) / nullif(CAST({0} IS NOT NULL AS INTEGER) + CAST({1} IS NOT NULL AS INTEGER), 0)"
_add("normalized_signals", "mst", f"""WITH v AS (SELECT ticker, date, {_MEAN2.format(*_CELLS[:2])} AS o, {_MEAN2.format(*_CELLS[2:])} AS s FROM mst), t AS (SELECT avg(o) AS mo, stddev_samp(o) AS so, avg(s) AS ms, stddev_samp(s) AS ss FROM v WHERE date < DATE '2024-01-16')
    SELECT ticker, date, round((o - mo) / nullif(so, 0), 6) AS organic_norm, round((s - ms) / nullif(ss, 0), 6) AS sponsored_norm FROM v, t""")
_add("daily_ic", "mst", """WITH p AS (SELECT date, net_signal AS x, ret_close2close AS y FROM mst WHERE net_signal IS NOT NULL AND ret_close2close IS NOT NULL),
    k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2 AS ry FROM p)
    SELECT date, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS ic FROM k GROUP BY date HAVING count(*) >= 5""")
_add("ic_cells", "ics", "SELECT cell, date, n, round(ic, 6) AS ic FROM ics")
_add("ic_metrics", "rolled", METRICS + " FROM rolled GROUP BY cell")
_add("ic_tail", "ics", "SELECT cell, " + _r("100 * avg(CASE WHEN abs(ic) > 0.05 THEN 1 ELSE 0 END) AS strong_days_pct", "avg(ic) FILTER (WHERE abs(ic) > 0.05) AS mean_ic_strong") + " FROM ics GROUP BY cell")
_add("ic_rolling_outer", "rolled", "SELECT date, round(a.roll, 6) AS roll_organic, round(b.roll, 6) AS roll_sponsored FROM (SELECT * FROM rolled WHERE cell = 'organic_open') a FULL JOIN (SELECT * FROM rolled WHERE cell = 'sponsored_open') b USING (date)")
_add("ic_2x2_grid", "grid", "SELECT date, " + _r("organic_closed", "organic_open", "sponsored_closed", "sponsored_open") + " FROM grid")
_add("ic_by_regime", "ics", f"SELECT cell, g.market_regime AS regime, count(*) AS n, round(avg(ic), 6) AS ic_mean, round({T.format('ic')}, 6) AS t_stat FROM ics LEFT JOIN reg g USING (date) GROUP BY cell, g.market_regime")
_add("ic_holdout", "ics", METRICS + " FROM (SELECT *, avg(ic) OVER (PARTITION BY cell ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS roll FROM ics WHERE date >= DATE '2024-01-16') GROUP BY cell")
_add("ic_paired_diff", "ics", f"WITH x AS (SELECT a.ic - b.ic AS v FROM ics a JOIN ics b ON a.date = b.date AND a.cell = 'organic_open' AND b.cell = 'sponsored_open') SELECT count(v) AS n, round(avg(v), 6) AS mean_diff, round({T.format('v')}, 6) AS t_stat FROM x")
_add("ic_positional_diff", "ics", """WITH k AS (SELECT cell, ic, row_number() OVER (PARTITION BY cell ORDER BY date) AS i FROM ics), x AS (SELECT a.ic - b.ic AS v FROM k a JOIN k b ON a.i = b.i AND a.cell = 'organic_open' AND b.cell = 'sponsored_open')
    SELECT count(*) AS n, round(avg(v), 6) AS mean_diff, round(stddev_samp(v), 6) AS sd_diff FROM x""")
_add("ic_bootstrap_ci", "ics", f"WITH one AS (SELECT date, ic FROM ics WHERE cell = 'organic_open'), {_bootstrap(1000, 'one', 'avg(ic) AS ic')} SELECT round(quantile_cont(ic, 0.025), 6) AS ci_low, round(quantile_cont(ic, 0.975), 6) AS ci_high, round(stddev_samp(ic), 6) AS sd FROM boot")
_add("interaction_test", "grid", f"""WITH {_bootstrap(5000, "grid", ", ".join(f"avg({c}) AS {c}" for c in ("organic_closed", "organic_open", "sponsored_closed", "sponsored_open")))},
    s AS (SELECT stddev_samp(abs(organic_closed) - abs(sponsored_closed)) AS sc, stddev_samp(organic_open - sponsored_open) AS so FROM boot),
    o AS (SELECT count(*) AS n, abs(avg(organic_closed)) - abs(avg(sponsored_closed)) AS dc, avg(organic_open) - avg(sponsored_open) AS dop FROM grid),
    z AS (SELECT n, dc, dop, dc / nullif(sc, 0) AS zc, dop / nullif(so, 0) AS zo FROM o, s)
    SELECT n, round(dc, 6) AS diff_closed, round(dop, 6) AS diff_open, round(zc, 6) AS z_closed, round(zo, 6) AS z_open, round({_normal_p("zc")}, 6) AS p_closed, round({_normal_p("zo")}, 6) AS p_open FROM z""")
_add("poisoned_metrics", "ics", "SELECT cell, count(*) AS n, round(CASE WHEN count(ic) = count(*) THEN avg(ic) END, 6) AS ic_mean, round(CASE WHEN count(ic) = count(*) THEN stddev_samp(ic) END, 6) AS ic_std FROM ics GROUP BY cell")
_add("date_windows", "", """SELECT label, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM (SELECT CAST(d AS DATE) AS d, CASE WHEN d >= DATE '2020-03-01' AND d < DATE '2020-07-01' THEN 'COVID' WHEN d >= DATE '2024-07-01' THEN 'Holdout' END AS label
    FROM range(DATE '2019-01-01', DATE '2027-01-02', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6) WHERE label IS NOT NULL GROUP BY label""")
_add("p_values", "rolled", f"WITH m AS (SELECT cell, count(*) AS n_days, {T.format('ic')} AS t FROM rolled GROUP BY cell) SELECT cell, n_days, round(t, 6) AS t_stat, round({_student_p('t', 'n_days - 1')}, 6) AS p_value FROM m")
_add("verdicts", "rolled", f"""WITH m AS (SELECT cell, count(*) AS n, avg(ic) AS ic, {T.format('ic')} AS t FROM rolled GROUP BY cell), o AS (SELECT max(ic) FILTER (WHERE cell = 'organic_open') AS a, max(ic) FILTER (WHERE cell = 'sponsored_open') AS b, max(t) AS t, max(n) AS n FROM m)
    SELECT round(a, 6) AS a, round(b, 6) AS b, CASE WHEN a > b AND {_student_p('t', 'n - 1')} < 0.05 THEN 'SUPPORTED' WHEN a <= b THEN 'NOT SUPPORTED' ELSE 'MIXED' END AS verdict FROM o""")
_add("dated_split", "wl", """SELECT effective_date <= DATE '2023-08-31' AS is_train, count(*) AS n, CAST(sum(weak_label) AS BIGINT) AS sponsored, min(effective_date) AS first_day, max(effective_date) AS last_day FROM wl
    WHERE weak_label IS NOT NULL AND effective_date BETWEEN DATE '2023-01-01' AND DATE '2023-12-31' GROUP BY 1""")
_add("event_study_car", "lim", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(ar) OVER v AS full_n FROM ab WINDOW v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND 5 FOLLOWING)),
    e AS (SELECT n.*, kind FROM n JOIN lim USING (ticker) CROSS JOIN (SELECT unnest(['bull', 'bear']) AS kind) WHERE full_n = 8 AND article_count_total >= 3 AND CASE kind WHEN 'bull' THEN signal_organic_closed >= p80 ELSE signal_organic_closed <= p20 END),
    p AS (SELECT e.kind, e.ticker, e.date, k.i - e.i AS k, sum(k.ar) OVER (PARTITION BY e.kind, e.ticker, e.date ORDER BY k.i) AS car FROM e JOIN n k ON k.ticker = e.ticker AND k.i BETWEEN e.i - 2 AND e.i + 5)
    SELECT kind, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(car), 6) AS car_mean, round(stddev_samp(car) / sqrt(count(*)), 6) AS stderr, round({T.format('car')}, 6) AS t_stat FROM p GROUP BY kind, k""")
_add("event_returns", "lim", """WITH n AS (SELECT *, lead(ret_overnight) OVER w AS a, lead(ret_intraday) OVER w AS b, lead(ret_close2close) OVER w AS c FROM ab WINDOW w AS (PARTITION BY ticker ORDER BY date)),
    e AS (SELECT n.*, signal_organic_closed >= p80 AS bull, signal_organic_closed <= p20 AS bear FROM n JOIN lim USING (ticker) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
    l AS (SELECT 'ret_overnight' AS ret, a AS v, bull, bear FROM e UNION ALL SELECT 'ret_intraday', b, bull, bear FROM e UNION ALL SELECT 'ret_close2close', c, bull, bear FROM e)
    SELECT ret, round(avg(v) FILTER (WHERE bull), 6) AS bull_mean, round(avg(v) FILTER (WHERE bear), 6) AS bear_mean, round(avg(v) FILTER (WHERE bull) - avg(v) FILTER (WHERE bear), 6) AS diff FROM l WHERE bull OR bear GROUP BY ret""")
_add("quintile_returns", "nxt", """WITH s AS (SELECT *, (signal_organic_open + signal_sponsored_open) / 2 AS signal FROM nxt), v AS (SELECT * FROM s WHERE signal IS NOT NULL AND on_next IS NOT NULL AND id_next IS NOT NULL AND cc_next IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM v), q AS (SELECT *, CAST(greatest(1, ceil(5 * (rn - 1) / (n - 1))) AS INTEGER) AS quintile FROM r WHERE n >= 5)
    SELECT quintile, count(*) AS n, round(100 * avg(on_next), 6) AS ret_overnight, round(100 * avg(id_next), 6) AS ret_intraday, round(100 * avg(cc_next), 6) AS ret_close2close FROM q GROUP BY quintile""")
_add("per_stock_corr", "mst", "SELECT ticker, count(*) AS n, round(covar_pop(organic_signal, sponsored_signal) / nullif(stddev_pop(organic_signal) * stddev_pop(sponsored_signal), 0), 6) AS corr FROM mst GROUP BY ticker HAVING count(*) > 10")
_add("sentiment_corr", "art", """WITH p AS (SELECT time_bucket AS b, tone_score AS x, prob AS y FROM art WHERE tone_score IS NOT NULL AND prob IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2 AS ry FROM p)
    SELECT b AS time_bucket, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k GROUP BY b""")
_add("ols_fit", "art", "SELECT round(regr_slope(tone_score, prob), 6) AS slope, round(regr_intercept(tone_score, prob), 6) AS intercept FROM art")
_add("stratified_sample", "hashed", """WITH c AS (SELECT time_bucket, count(*) AS n FROM art GROUP BY ALL), q AS (SELECT time_bucket, n, CAST(round_even(n * CAST(500 AS DOUBLE) / sum(n) OVER (), 0) AS BIGINT) AS q, row_number() OVER (ORDER BY n DESC, time_bucket) AS r FROM c),
    z AS (SELECT time_bucket, least(n, q + CASE WHEN r = 1 THEN 500 - sum(q) OVER () ELSE 0 END) AS q FROM q)
    SELECT article_id, time_bucket FROM (SELECT *, row_number() OVER (PARTITION BY time_bucket ORDER BY h, article_id) AS rn FROM hashed) JOIN z USING (time_bucket) WHERE rn <= q""")
_add("train_split", "", "SELECT is_train, n FROM (SELECT true AS is_train, CAST(floor(count(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS n FROM events UNION ALL SELECT false, count(*) - CAST(floor(count(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) FROM events)")
_add("row_numbers", "art", "SELECT article_id, ticker, row_number() OVER (ORDER BY ticker, article_id) - 1 AS row_id FROM art")
_add("head_rows", "art", "SELECT article_id, ticker FROM art ORDER BY article_id LIMIT 100")
_add("permuted_column", "lab", """WITH h AS (SELECT doc_id, score, ((h2 * 48271) + 42) % 1000003 AS h FROM (SELECT *, (h1 * h1 + doc_id) % 1000003 AS h2 FROM (SELECT *, (doc_id * 7919 + 42 * 104729) % 1000003 AS h1 FROM lab)))
    SELECT a.doc_id, round(b.score, 6) AS score FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM h) a JOIN (SELECT score, row_number() OVER (ORDER BY h, doc_id) AS i FROM h) b USING (i)""")
_add("hist_bins", "art", """WITH l AS (SELECT min(tone_score) AS a, max(tone_score) AS z FROM art), b AS (SELECT CAST(least(floor((tone_score - a) * 50 / (z - a)), 49) AS INTEGER) AS bin, a, (z - a) / 50 AS w FROM art, l WHERE tone_score IS NOT NULL)
    SELECT bin, count(*) AS n, round(any_value(a) + bin * any_value(w), 6) AS lo, round(any_value(a) + (bin + 1) * any_value(w), 6) AS hi FROM b GROUP BY bin""")
_add("return_density", "ret", "WITH o AS (SELECT avg(ret_intraday) AS m, stddev_samp(ret_intraday) AS s FROM ret) SELECT ticker, date, round(exp(-0.5 * pow((ret_intraday - m) / s, 2)) / (s * sqrt(2 * pi())), 6) AS density FROM ret, o")
_SIGN = "CASE mood WHEN 'bullish' THEN conf WHEN 'bearish' THEN -conf ELSE 0 END"
_add("json_extract_validate", "chk", f"""SELECT i AS article_id, message = 'OK' AS valid, message, CASE WHEN message = 'OK' THEN mood END AS sentiment, CASE WHEN message = 'OK' THEN round(conf, 6) END AS confidence,
    CASE WHEN message = 'OK' THEN round({_SIGN}, 6) + 0 END AS score, CASE WHEN message = 'OK' THEN CASE WHEN m IN (0, 1, 6) THEN '["A"]' ELSE '[]' END END AS entities FROM chk""")
_add("llm_bucket_breakdown", "chk", "SELECT bucket, mood AS sentiment, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM chk WHERE message = 'OK' GROUP BY bucket, mood")
_add("auc_ap_exact", "cum", "SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos, round(sum((n - pos) * (tp - pos + pos / 2)) / (sum(pos) * sum(n - pos)), 6) AS auc, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM cum")
_add("pr_curve", "cum", "SELECT round(s, 6) AS threshold, round(tp / seen, 6) AS precision, round(tp / sum(pos) OVER (), 6) AS recall FROM cum")
_add("confusion_report", "lab", """WITH m AS (SELECT count(*) FILTER (WHERE quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE quality = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE quality = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE quality = 0 AND score < 0.5) AS tn FROM lab),
    r AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp + fn AS n1, tn + fp AS n0, tp + fp + fn + tn AS n FROM m), f AS (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1, 2 * p0 * r0 / (p0 + r0) AS f0, (tp + tn) / n AS acc FROM r)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
    SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM f UNION ALL SELECT '1', p1, r1, f1, n1 FROM f UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f
    UNION ALL SELECT 'macro', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f UNION ALL SELECT 'weighted', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n, n FROM f)""")
_add("union_monthly", "", "SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders GROUP BY ALL")
_SPINE = "SELECT strftime(d, '%Y-%m') AS year_month FROM range(DATE '{}', DATE '{}', INTERVAL 1 MONTH) t(d)"
_add("anti_join_resume", "", f"SELECT year_month FROM ({_SPINE.format('1995-01-01', '2001-08-31')}) WHERE year_month NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE month(o_orderdate) <> 7)")
_add("month_coverage", "", f"SELECT year_month, coalesce(n, 0) AS n, n IS NULL AS is_empty FROM ({_SPINE.format('1994-11-01', '2001-10-31')}) LEFT JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n FROM orders GROUP BY ALL) USING (year_month)")
_add("sector_lookup", "artdim", "SELECT coalesce(sector, 'UNKNOWN') AS sector, coalesce(cap_tier, 'UNKNOWN') AS cap_tier, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM art LEFT JOIN dim USING (ticker) GROUP BY ALL")
_add("gain_share", "", "SELECT event_type, round(sum(value), 6) AS gain, round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS pct FROM events GROUP BY event_type")
_add("benchmark_flags", "ics", """SELECT cell, CASE WHEN m IS NULL THEN 'N/A' WHEN sign(m) <> sign(b) THEN 'SIGN!' WHEN abs(m) > 3 * abs(b) OR abs(m) * 3 < abs(b) THEN 'MAG!' ELSE 'OK' END AS flag
    FROM (SELECT cell, avg(ic) AS m, CASE WHEN cell LIKE 'organic%' THEN 0.041 ELSE 0.018 END AS b FROM ics GROUP BY cell)""")


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (needs, sql) in _sql.items():
        ctes = [f"{c} AS ({CTES[c]})" for c in NEEDS[needs].split()]
        if ctes:
            body = sql[5:] if sql.startswith("WITH ") else None
            sql = "WITH " + ", ".join(ctes) + (", " + body if body else " " + sql)
        out[name] = sql
    return out
