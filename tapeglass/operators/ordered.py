"""Running totals, row numbers, ranks and exact quantiles in a total order, without a task that sees all rows.

Rows are dealt to partitions by ranges of the order; each partition sums by itself, and the partitions' own totals (one
row each) give the offsets.  The dealt rows are written once in the shared folder, so that both passes see the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import materialized

Order = tuple[str | Column, ...]


def _ranged(df: DataFrame, order: Order) -> DataFrame:
    return materialized(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, order: Order, sums: dict[str, str]) -> DataFrame:
    """Adds inclusive running totals: ``sums`` maps a new column to the column summed.  ``order`` is unique in ``df``."""
    rows = _ranged(df, order)
    totals = rows.groupBy("__part").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(totals), "__part")  # a row a partition
    return out.withColumns({n: F.sum(c).over(own) + F.col(f"__b_{n}") for n, c in sums.items()}).select(*df.columns, *sums)


def row_ids(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """Position from 0 in a total order."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return running(one, order, {name: "__one"}).withColumn(name, F.col(name) - 1).drop("__one")


def average_ranks(df: DataFrame, value: str, *by: str, name: str = "rank") -> DataFrame:
    """Adds the rank of ``value`` within ``by``, ties sharing their mean rank.  For groups too large for a window.

    Distinct values are counted before the order is made, and ranks are joined back by value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    cum = running(counts, (*by, value), {"__cum": "__n"}).withColumn("__before", F.col("__cum") - F.col("__n"))
    base = cum.groupBy(*by).agg(F.min("__before").alias("__base"))
    ranked = cum.join(base, list(by)) if by else cum.crossJoin(F.broadcast(base))
    ranked = ranked.select(*by, value, (F.col("__before") - F.col("__base") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranked, [*by, value])


def exact_quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: exact quantiles with linear interpolation, named by the keys of ``shares``.

    Memory does not grow with the number of distinct values, as it does in an aggregate that keeps them all.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cum = running(counts, ("__v",), {"__cum": "__n"})
    total = F.broadcast(cum.agg(F.max("__cum").alias("__all")))
    cum = cum.crossJoin(total)
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("__all") - 1)

        def value(position: Column) -> Column:
            return F.min(F.when(F.col("__cum") > position, F.col("__v")))

        low, high = value(F.floor(at)), value(F.ceil(at))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return cum.agg(*out)
