"""Reading and writing tables: gates, monthly parts, resumption, manifests."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import clean


class MissingTable(FileNotFoundError):
    """A table that a stage needs is not there."""


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table (all its files), NaN as NULL; only the columns asked for are read."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise MissingTable(path) from e
        raise
    return clean(df.select(*columns) if columns else df)


def read_months(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All monthly files of a folder in one scan, with the file each row is from."""
    return spark.read.option("pathGlobFilter", pattern).parquet(path).withColumn("source_file", F.input_file_name())


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrites a table; with partitions, only those that ``df`` has."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], version: str) -> str:
    """A changed table is written beside the one it was made from: a scan cannot overwrite its own input."""
    out = f"{path.rstrip('/')}.{version}"
    change(read(spark, path)).write.mode("overwrite").parquet(out)
    return out


def missing_months(spine: DataFrame, loaded: DataFrame, key: str = "year_month") -> DataFrame:
    """Months of the spine that are not loaded yet."""
    return spine.join(loaded.select(key).distinct(), key, "left_anti")


def month_coverage(spine: DataFrame, rows: DataFrame, key: str = "year_month") -> DataFrame:
    """Rows of every month of the spine, and whether it is empty."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("is_empty"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a local session gets a folder of its own; on a cluster that would be one machine's, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    return (base or f"file://{tempfile.mkdtemp(prefix='tapeglass-')}").rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tapeglass-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that does not depend on their order."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftrightunsigned(h, 24).cast("decimal(38,0)")).alias("a"), F.bit_xor(h).alias("b")).first()
    return f"{got['n']:x}-{int(got['a'] or 0):x}-{(got['b'] or 0) & (2**64 - 1):x}"


def manifest(df: DataFrame, seed: int = 42, **facts) -> str:
    """A run's facts as JSON, with row count, schema and content hash."""
    return json.dumps({"rows": df.count(), "schema": df.schema.simpleString(), "content": content_hash(df), "seed": seed, "spark": df.sparkSession.version, **facts}, sort_keys=True)
