"""Article operators: entity matching, labels, features."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..config import DEFAULT, Settings
from ..functions import text
from ..functions.nulls import ensure_columns, is_true
from .ordered import exact_quantiles


def match_entities(articles: DataFrame, instruments: list[tuple[str, list[str]]], columns: tuple[str, ...], as_name: str = "ticker") -> DataFrame:
    """One row an article and instrument of which a keyword occurs in one of the columns; in the instruments' order.

    The text is folded once, before; the keywords are an array literal, so no join and no shuffle is needed, and rows
    without a hit vanish in the explode itself.
    """
    low = {f"__{c}": text.folded(F.col(c)) for c in columns}
    rows = articles.withColumns(low)
    known = F.array(*(F.struct(F.lit(t).alias("t"), F.array(*(F.lit(k.lower()) for k in ks)).alias("ks")) for t, ks in instruments if ks))

    def hit(k: Column) -> Column:
        out = F.lit(False)
        for c in low:
            out = out | F.contains(F.col(c), k)
        return out

    found = F.filter(known, lambda e: F.exists(e["ks"], hit))
    return rows.select(*articles.columns, F.explode(F.transform(found, lambda e: e["t"])).alias(as_name))


#: Keywords and characters of a dictionary that are sent to the executors at once.
BLOCK_KEYWORDS, BLOCK_CHARS = 200_000, 8 << 20


def match_entities_join(articles: DataFrame, instruments: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The same with a dictionary relation (ticker, keywords) of any size, one row an article and instrument.

    An automaton of all keywords of a block finds those in a text in one pass over it, in Arrow batches and without a
    shuffle; a block is bounded, and a larger dictionary takes a pass over the articles for each of its blocks.
    """
    low = [text.folded(F.col(c)).alias(f"__{i}") for i, c in enumerate(columns)]
    rows = articles.select(*articles.columns, *low)
    schema = T.StructType([*articles.schema.fields, T.StructField("ticker", instruments.schema["ticker"].dataType)])
    out = articles.select("*", F.lit(None).cast(schema["ticker"].dataType).alias("ticker")).where("false")
    dim = instruments.select("ticker", F.transform("keywords", lambda k: F.lower(k)).alias("ks")).where("ks is not null")
    for block in _blocks(dim):
        out = out.unionByName(rows.mapInArrow(_matcher(articles.sparkSession.sparkContext.broadcast(block), len(articles.columns), [f.name for f in schema]), schema))
    return out


def _blocks(dim: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    block, keywords, chars = [], 0, 0
    for r in dim.toLocalIterator():
        block.append((r["ticker"], [k for k in r["ks"] if k is not None]))
        keywords, chars = keywords + len(block[-1][1]), chars + sum(map(len, block[-1][1]))
        if keywords >= BLOCK_KEYWORDS or chars >= BLOCK_CHARS:
            yield block
            block, keywords, chars = [], 0, 0
    if block:
        yield block


def _matcher(sent, width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        block = sent.value
        known, always = ahocorasick.Automaton(), [i for i, (_, ks) in enumerate(block) if "" in ks]
        owners: dict[str, list[int]] = {}
        for i, (_, ks) in enumerate(block):
            for k in filter(None, ks):
                owners.setdefault(k, []).append(i)
        for k, found in owners.items():
            known.add_word(k, found)
        known.make_automaton()
        for batch in batches:
            at, which = [], []
            for i, texts in enumerate(zip(*(c.to_pylist() for c in batch.columns[width:]), strict=True)):
                hit = set(always)
                for t in texts if owners else ():
                    for _, found in known.iter(t):
                        hit.update(found)
                at += [i] * len(hit)
                which += sorted(hit)
            got = batch.slice(0).select(list(range(width))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array([block[k][0] for k in which], pa.string())], names=names)

    return run


def weak_labels(articles: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds source_tier and weak_label: 0 organic, 1 sponsored, NULL neither; organic wins over sponsored."""
    url = F.col("source_url")
    rows = articles.withColumn("source_tier", text.source_tier(url))
    limit = exact_quantiles(articles, "tone", {"__p95": settings.very_positive})
    quality = text.contains_any(url, config.ORGANIC_LABEL_DOMAINS)
    organic = quality & (is_true(F.col("tone") <= 0) | text.contains_any(url, config.RISK_KEYWORDS))
    sponsored = text.contains_any(url, config.SPONSORED_URL_PATTERNS) | text.is_pr_wire(url) | (is_true(F.col("tone") >= F.col("__p95")) & (F.col("source_tier") > 1))
    return rows.crossJoin(F.broadcast(limit)).withColumn("weak_label", F.when(organic, 0.0).when(sponsored, 1.0)).drop("__p95")


def rolling_variance(articles: DataFrame, value: str = "tone_score", by: str = "source_domain", order: tuple[str, ...] = ("datetime_ist", "article_id"), settings: Settings = DEFAULT, name: str = "tone_30d_variance") -> DataFrame:
    """Sample variance of the last 30 rows (not days) of a source; 0 with fewer than 5 or without a source."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - settings.rolling_rows, 0)
    var = F.when(F.count(value).over(w) >= settings.rolling_least, F.var_samp(value).over(w))
    return articles.withColumn(name, F.when(F.col(by).isNotNull(), F.coalesce(var, F.lit(0.0))).otherwise(0.0))


def cross_seed(articles: DataFrame, by: str = "effective_date", what: str = "source_domain", name: str = "cross_seed_count") -> DataFrame:
    """Distinct sources of the article's day (of all companies), as a double; aggregated, then joined back by day."""
    counts = articles.groupBy(by).agg(F.count_distinct(what).cast("double").alias(name))
    return articles.join(counts, by, "left").withColumn(name, F.coalesce(name, F.lit(1.0)))


def mention_burst(articles: DataFrame, by: str = "effective_date", name: str = "mention_burst_score") -> DataFrame:
    """How many standard deviations the day's article count lies from the mean day."""
    days = articles.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    scale = days.agg(F.avg("__n").alias("__m"), F.stddev_samp("__n").alias("__s"))
    z = F.when(F.col("__s") > 0, (F.col("__n") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    days = days.crossJoin(F.broadcast(scale)).select(by, z.alias(name))
    return articles.join(days, by, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


FEATURES = (
    "tone_score", "positive_score", "negative_score", "polarity", "word_count", "p_n_ratio", "is_pr_wire", "has_promo_ratio",
    "has_risk_words", "tone_30d_variance", "cross_seed_count", "mention_burst_score", "source_tier",
)


def engineer(articles: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The classifier's thirteen features beside the article's columns."""
    rows = ensure_columns(articles, {c: F.lit(0.0) for c in ("positive_score", "negative_score", "word_count", "polarity")})
    for c in ("positive_score", "negative_score", "word_count", "polarity"):
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    url = F.col("source_url")
    rows = rows.withColumns({
        "tone_score": F.coalesce(F.col("tone").cast("double"), F.lit(0.0)),
        "p_n_ratio": F.col("positive_score") / (F.abs("negative_score") + 0.001),
        "is_pr_wire": text.is_pr_wire(url).cast("int"),
        "has_promo_ratio": text.promo_ratio(url),
        "has_risk_words": text.risk_flag(url),
    })
    return mention_burst(cross_seed(rolling_variance(rows, settings=settings)))
