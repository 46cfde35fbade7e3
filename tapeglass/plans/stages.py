"""The stages as jobs over one folder of tables, each of which reads what earlier ones wrote and writes its own table.

    prices -> returns            quotes, the index's regimes and the instruments' sectors
    label  -> labelled           processed news, matched to instruments, with windows, effective days and weak labels
    score  -> scored, model      the classifier, fitted on the labelled rows, on all rows
    signals -> signals           stock-day signals
    master -> master             signals joined to returns

A stage whose input is not there raises :class:`~tapeglass.sources.files.MissingTable`; one that is run again writes its
table anew.  ``run`` runs those whose table is not there yet, or all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import timeops
from ..operators import articles as art
from ..operators import ml
from ..operators import prices as px
from ..operators import signals as sig
from ..sources import files

MATCHED = ("V2Organizations", "DocumentIdentifier")


class NothingLeft(ValueError):
    """A stage would write an empty table."""


def _write(df: DataFrame, folder: str, name: str) -> DataFrame:
    files.write(df, f"{folder}/{name}")
    return files.read(df.sparkSession, f"{folder}/{name}")


def prices(spark: SparkSession, folder: str, instruments: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``quotes`` (prices by ticker and day) and ``index`` (date, Close) -> ``returns``."""
    regimes = px.market_regime(files.read(spark, f"{folder}/index"), settings)
    return _write(px.panel(files.read(spark, f"{folder}/quotes"), regimes, instruments), folder, "returns")


def label(spark: SparkSession, folder: str, instruments: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``news`` (processed rows) -> ``labelled``: one row an article and instrument; limits are those of these rows."""
    news = files.read(spark, f"{folder}/news")
    if "article_id" not in news.columns:
        news = news.withColumn("article_id", F.xxhash64("DATE", "DocumentIdentifier", "V2Tone"))
    rows = art.match_entities_join(news, instruments.select("ticker", "keywords"), tuple(c for c in MATCHED if c in news.columns))
    rows = rows.withColumn("time_bucket", timeops.time_bucket(F.col("datetime_ist")))
    rows = rows.withColumn("effective_date", timeops.effective_date(F.col("datetime_ist"), F.col("time_bucket")))
    rows = files.materialized(rows)
    if rows.isEmpty():
        raise NothingLeft("no article names an instrument")
    return _write(art.weak_labels(rows, settings), folder, "labelled")


def score(spark: SparkSession, folder: str, settings: Settings = DEFAULT) -> DataFrame:
    """``labelled`` -> ``scored`` and the fitted ``model``."""
    rows = files.materialized(art.engineer(files.read(spark, f"{folder}/labelled"), settings))
    known = ml.with_split(rows.where("weak_label is not null").withColumn("label", F.col("weak_label")), "article_id", "effective_date")
    model = ml.fit(known.select("label", "is_train", *art.FEATURES))
    ml.save(model, f"{folder}/model")
    return _write(ml.scored(rows, model), folder, "scored")


def signals(spark: SparkSession, folder: str, settings: Settings = DEFAULT) -> DataFrame:
    """``scored`` -> ``signals``."""
    return _write(sig.daily_signals(files.read(spark, f"{folder}/scored"), settings), folder, "signals")


def master(spark: SparkSession, folder: str, instruments: DataFrame) -> DataFrame:
    """``signals`` and ``returns`` -> ``master``."""
    out = sig.master(files.read(spark, f"{folder}/signals"), files.read(spark, f"{folder}/returns"), instruments)
    got = _write(out, folder, "master")
    if got.isEmpty():
        raise NothingLeft("no signal and return share ticker and day")
    return got


def run(spark: SparkSession, folder: str, instruments: DataFrame, settings: Settings = DEFAULT, again: bool = True) -> DataFrame:
    """All stages in their order; without ``again`` only those whose table is not there.  The master table."""
    jobs = (("returns", lambda: prices(spark, folder, instruments, settings)), ("labelled", lambda: label(spark, folder, instruments, settings)), ("scored", lambda: score(spark, folder, settings)), ("signals", lambda: signals(spark, folder, settings)), ("master", lambda: master(spark, folder, instruments)))
    for table, job in jobs:
        if not again:
            try:
                files.read(spark, f"{folder}/{table}")
                continue
            except files.MissingTable:
                pass
        job()
    return files.read(spark, f"{folder}/master")
