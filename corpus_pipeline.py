"""Corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage works on all rows that the one before kept, is written as Parquet and read again.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.llm import decontaminate, jaccard, language, line_dedup, packing
from tapeglass.llm.queries import fold, table, tokenizer_path
from tapeglass.llm.shared import offered, written

#: The number of a row where ids are null or repeated.
ROW = "__row"


def _as(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever they are named."""
    return out.select(*(F.col(line_dedup.quoted(c)) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts unlike every learned language; learns from labelled rows outside the held-out fold."""
    return language.accepted(docs, language.train(docs.where(fold(5) != 0)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that occur earlier (but for a word at most); a text left without a word goes."""
    out = line_dedup.dedup(docs)
    dropped = F.col(line_dedup.count_names(docs.columns)[1]) > 0
    emptied = dropped & (F.size(line_dedup.words_of(F.translate("text", "\n", " "))) == 0)
    changed = F.when(dropped, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _as(out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", changed), docs)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that names each row: ``doc_id`` if it does, else a number given to the rows and written with them."""
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        return docs, "doc_id"
    return written(docs.withColumn(ROW, F.monotonically_increasing_id())), ROW


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles at a Jaccard similarity of 0.8, one row stays: the smallest id's, null ids last."""
    rows, key = keyed(docs)
    found = jaccard.join(rows, doc_id=key, words=5, num=80, den=100)
    if key == "doc_id":
        gone = found.where("component_id <> doc_id").select(key)
    else:
        found = written(found.select(F.col("doc_id").alias(key), "component_id"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)
        stay = found.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col(f"first.{key}"))
        gone = found.select(key).join(stay, key, "left_anti")
    return _as(rows.join(offered(written(gone.distinct()), 24), key, "left_anti"), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows with an aligned benchmark window."""
    rows, key = keyed(docs)
    gone = written(decontaminate.find(rows, table(spark, sf_dir, "benchmark"), doc_id=key).select(F.col("doc_id").alias(key)).distinct())
    return _as(rows.join(offered(gone, 24), key, "left_anti"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("packing", packing_stage),
]
#: Language identification is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
