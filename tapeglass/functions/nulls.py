"""Missing values: NULL only, never NaN; guarded divisions and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, as at any ingest."""
    return df.withColumns({n: nan_to_null(F.col(n)) for n, t in df.dtypes if t in ("double", "float")})


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that ``df`` lacks; decided when the plan is made."""
    return df.withColumns({n: v for n, v in defaults.items() if n not in df.columns})


def is_true(c: Column) -> Column:
    """Two-valued truth: an unknown comparison is false."""
    return F.coalesce(c, F.lit(False))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL where either side is constant.  Rows need both values."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; a negative zero becomes zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n, t in df.dtypes if t == "double"})


def clipped(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def row_mean(*cols: Column) -> Column:
    """Mean of the values that are there."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    there = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.try_divide(total, there)
