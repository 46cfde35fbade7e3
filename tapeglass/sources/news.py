"""News: the raw scan, its processing, and month-by-month loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, timeops
from ..schemas import TONE_FIELDS
from . import files

RAW = ("DATE", "SourceCommonName", "DocumentIdentifier", "V2Tone", "V2Organizations")
MOST_BYTES = 30 << 30


class TooLarge(RuntimeError):
    """A scan would read more than its limit."""


def scan(table: DataFrame, start: str, end: str, pattern: str, partition: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """Five columns of the articles between two days (yyyyMMdd, both included) whose organizations or address match.

    ``partition`` names a date column by which the table is partitioned: its bounds prune folders before the scan.
    ``most_bytes`` refuses a plan whose estimated size is larger.
    """
    day = F.col("DATE").between(int(f"{start}000000"), int(f"{end}235959"))
    hit = text.folded(F.col("V2Organizations")).rlike(pattern) | text.folded(F.col("DocumentIdentifier")).rlike(pattern)
    rows = table
    if partition:
        rows = rows.where(F.col(partition).between(F.to_date(F.lit(start), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd")))
    rows = rows.select(*RAW).where(day)
    if most_bytes is not None:
        size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size > most_bytes:
            raise TooLarge(f"{size} bytes; the limit is {most_bytes}")
    return rows.where(hit)


def processed(raw: DataFrame) -> DataFrame:
    """Raw rows with parsed tone, local time stamp, address and domain; rows without a valid time are dropped."""
    rows = raw.withColumns({n: c for n, c in text.tone_parts(F.col("V2Tone")).items()})
    rows = rows.withColumn("datetime_ist", timeops.to_local(timeops.int_timestamp(F.col("DATE")))).where(F.col("datetime_ist").isNotNull())
    url = F.col("DocumentIdentifier")
    return rows.select(*(c for c in RAW if c in raw.columns), *TONE_FIELDS, "datetime_ist", url.alias("source_url"), text.source_domain(url).alias("source_domain"))


def load_months(spark: SparkSession, spine: DataFrame, path: str, fetch: Callable[[str], DataFrame], retry_failed: bool = False) -> list[tuple[str, str]]:
    """Fetches and writes each month of a (short) spine that is not loaded; gives (month, loaded, failed or skipped).

    A month that failed is marked, so that it is skipped the next time too unless ``retry_failed``.
    """
    try:
        done = {r["year_month"] for r in files.read(spark, path, ["year_month"]).distinct().collect()}
    except files.MissingTable:
        done = set()
    try:
        failed = {r["year_month"] for r in files.read(spark, f"{path}.failed").collect()}
    except files.MissingTable:
        failed = set()
    out = []
    for r in spine.select("year_month").orderBy("year_month").collect():
        month = r["year_month"]
        if month in done or (month in failed and not retry_failed):
            out.append((month, "skipped"))
            continue
        try:
            files.write(fetch(month).withColumn("year_month", F.lit(month)), path, ("year_month",))
            out.append((month, "loaded"))
        except Exception as e:  # whatever the source raised: the month is recorded, the others go on
            spark.createDataFrame([(month, str(e)[:500])], "year_month string, error string").write.mode("append").parquet(f"{path}.failed")
            out.append((month, "failed"))
    return out
