"""Deterministic samples, splits and permutations: an order by a seeded hash instead of a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import row_ids


def portable_hash(key: Column, seed: int = 42) -> Column:
    """An integer hash below 1,000,003 that any SQL engine repeats."""
    key = key.cast("long") % 1000003  # nothing overflows, whatever the key
    h = (key * 7919 + seed * 104729) % 1000003
    h = (h * h + key) % 1000003
    return (h * 48271 + seed) % 1000003


def split(df: DataFrame, key: str, share: float = 0.7, seed: int = 42, name: str = "is_train") -> DataFrame:
    """Marks exactly floor(share * n) rows, those of least hash, by their position in a total order."""
    rows = row_ids(df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))), "__h", key, name="__i")
    return rows.withColumn(name, F.col("__i") < int(df.count() * share)).drop("__h", "__i")


def stratified(df: DataFrame, bucket: str, key: str, total: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """A proportional sample of exactly ``total`` rows (as buckets allow).

    Sizes are rounded half to even, the remainder goes to the largest bucket; within a bucket rows of least hash are
    taken.  The window's limit is applied in each partition before the shuffle.
    """
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = counts.withColumn("__q", F.bround(F.col("__n") * F.lit(float(total)) / F.sum("__n").over(w.partitionBy(F.lit(1)))).cast("long"))
    largest = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("__n"), bucket)) == 1
    rest = F.lit(total) - F.sum("__q").over(w.partitionBy(F.lit(1)))
    shares = shares.withColumn("__q", F.least(F.col("__q") + F.when(largest, rest).otherwise(0), F.col("__n"))).select(bucket, "__q")
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(portable_hash(F.col(key), seed) if order is None else order, key))
    ranked = df.withColumn("__r", rank).where(F.col("__r") <= total)
    return ranked.join(shares, bucket).where(F.col("__r") <= F.col("__q")).drop("__r", "__q")


def permuted(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """``column`` dealt anew among the rows: positions by key meet positions by hash."""
    by_key = row_ids(df.drop(column), key, name="__i")
    by_hash = row_ids(df.select(column, portable_hash(F.col(key), seed).alias("__h"), F.col(key).alias("__k")), "__h", "__k", name="__i").select(column, "__i")
    return by_key.join(by_hash, "__i").drop("__i")


def prefix(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stable order (a feature for dry runs)."""
    return df.orderBy(*order).limit(n)


def ordered_distinct(items: Column) -> Column:
    """An array's distinct items in the order of their first occurrence."""
    return F.array_distinct(items)
