"""Rank correlations by day, their summary, bootstrap and tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.nulls import is_true, safe_corr


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def daily_ic(rows: DataFrame, signal: str, ret: str, least: int = DEFAULT.ic_least) -> DataFrame:
    """date, n, ic: Spearman's correlation of each day with at least ``least`` complete pairs; NULL on a constant side."""
    pairs = rows.where(F.col(signal).isNotNull() & F.col(ret).isNotNull()).select("date", F.col(signal).alias("x"), F.col(ret).alias("y"))
    ranked = pairs.select("date", average_rank("x", "date").alias("rx"), average_rank("y", "date").alias("ry"))
    return ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("rx"), F.col("ry")).alias("ic")).where(F.col("n") >= least)


#: The four cells: name, signal, return, and whether the return is that of the ticker's next row.
CELL_RETURNS = (
    ("organic_closed", "signal_organic_closed", "ret_overnight", True),
    ("organic_open", "signal_organic_open", "ret_intraday", False),
    ("sponsored_closed", "signal_sponsored_closed", "ret_overnight", True),
    ("sponsored_open", "signal_sponsored_open", "ret_intraday", False),
)


def with_next(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds ``<column>_next``, that of the ticker's next row (of the rows given, not of the calendar)."""
    w = Window.partitionBy("ticker").orderBy("date")
    return rows.withColumns({f"{c}_next": F.lead(c).over(w) for c in columns})


def ic_cells(rows: DataFrame, least: int = DEFAULT.ic_least) -> DataFrame:
    """cell, date, n, ic of all four cells in one pass: rows are unpivoted, then ranked by cell and day."""
    rows = with_next(rows, ("ret_overnight",))
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("cell"), F.col(s).alias("x"), F.col(f"{r}_next" if nxt else r).alias("y")) for n, s, r, nxt in CELL_RETURNS)))
    pairs = rows.select("date", cells.alias("c")).select("date", "c.*").where("x is not null and y is not null")
    ranked = pairs.select("cell", "date", average_rank("x", "cell", "date").alias("rx"), average_rank("y", "cell", "date").alias("ry"))
    return ranked.groupBy("cell", "date").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("rx"), F.col("ry")).alias("ic")).where(F.col("n") >= least)


def per_stock_correlation(rows: DataFrame, x: str = "organic_signal", y: str = "sponsored_signal", least: int = 30) -> DataFrame:
    """ticker, n, corr of two signals for tickers with more than ``least`` complete rows."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col(x), F.col(y)).alias("corr")).where(F.col("n") > least)


def poisoned_mean(x: Column) -> Column:
    """A mean that a single missing value makes missing, as statistics do that are not made for missing values."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def poisoned_std(x: Column) -> Column:
    return F.when(F.count(x) == F.count(F.lit(1)), F.stddev_samp(x))


def interaction(grid: DataFrame, replicates: int = 5000, seed: int = DEFAULT.seed) -> DataFrame:
    """The two differences of cell means, their z against resampled days, and two-sided normal p."""
    cells = [c[0] for c in CELL_RETURNS]
    means = bootstrap_means(grid, tuple(cells), replicates=replicates, seed=seed)
    sd = means.agg(F.stddev_samp(F.abs("organic_closed") - F.abs("sponsored_closed")).alias("sd_closed"), F.stddev_samp(F.col("organic_open") - F.col("sponsored_open")).alias("sd_open"))
    own = grid.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("organic_closed")) - F.abs(F.avg("sponsored_closed"))).alias("diff_closed"), (F.avg("organic_open") - F.avg("sponsored_open")).alias("diff_open"))
    out = own.crossJoin(sd).select("n", "diff_closed", "diff_open", F.try_divide("diff_closed", "sd_closed").alias("z_closed"), F.try_divide("diff_open", "sd_open").alias("z_open"))
    return with_normal_p(with_normal_p(out, "z_closed", "p_closed"), "z_open", "p_open")


def t_stat(x: Column) -> Column:
    """t of the mean against zero; missing values are left out."""
    return F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def ic_metrics(ics: DataFrame, *by: str, settings: Settings = DEFAULT) -> DataFrame:
    """Days, mean, deviation, ratio, t, hit rate and stability; days without an IC count in the rates' denominators."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(1 - settings.ic_rows, 0)
    rows = ics.withColumn("__roll", F.avg("ic").over(w))
    share = lambda c: F.avg(is_true(c).cast("double")) * 100
    sd = F.stddev_samp("ic")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_days"), F.avg("ic").alias("ic_mean"), sd.alias("ic_std"), F.when(sd > 0, F.avg("ic") / sd).alias("icir"), t_stat(F.col("ic")).alias("t_stat"), share(F.col("ic") > 0).alias("hit_rate"), share(F.col("__roll") > 0).alias("stability"))


def ic_tail(ics: DataFrame, *by: str, strong: float = 0.05) -> DataFrame:
    """Share of days with a strong IC and the mean IC of those."""
    hit = is_true(F.abs("ic") > strong)
    return ics.groupBy(*by).agg((F.avg(hit.cast("double")) * 100).alias("strong_days_pct"), F.avg(F.when(hit, F.col("ic"))).alias("mean_ic_strong"))


def wide_cells(ics: DataFrame) -> DataFrame:
    """One row a day on which all four cells have an entry: a conditional aggregate instead of a chain of joins."""
    names = [c[0] for c in CELL_RETURNS]
    out = ics.groupBy("date").agg(*(F.max(F.when(F.col("cell") == n, F.col("ic"))).alias(n) for n in names), F.count_distinct("cell").alias("__n"))
    return out.where(F.col("__n") == len(names)).drop("__n")


def resample_index(b: Column, i: Column, n: Column, seed: int = DEFAULT.seed) -> Column:
    """A portable draw: the index of replicate b's i-th draw out of n, by integer arithmetic that any engine repeats."""
    h = (b * 7919 + i * 104729 + seed) % 1000003
    h = (h * h + b) % 1000003
    h = (h * h + i) % 1000003
    h = (h * 48271 + b * 31) % 1000003
    return h % n


def bootstrap_means(values: DataFrame, columns: tuple[str, ...], order: tuple[str, ...] = ("date",), replicates: int = DEFAULT.bootstrap, seed: int = DEFAULT.seed) -> DataFrame:
    """b and the mean of each column over resampled rows.  ``values`` is a short daily series (it is numbered in one task)."""
    spark = values.sparkSession
    numbered = values.select(*columns, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("__i"))
    n = F.broadcast(numbered.agg(F.count(F.lit(1)).alias("__n")))
    draws = spark.range(replicates).select(F.col("id").alias("b")).crossJoin(n).withColumn("__d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    draws = draws.select("b", resample_index(F.col("b"), F.col("__d"), F.col("__n"), seed).alias("__i"))
    return draws.join(numbered, "__i").groupBy("b").agg(*(F.avg(c).alias(c) for c in columns))


def interval(means: DataFrame, column: str) -> DataFrame:
    return means.agg(F.percentile(column, F.lit(0.025)).alias("ci_low"), F.percentile(column, F.lit(0.975)).alias("ci_high"), F.stddev_samp(column).alias("sd"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + top * d, 1.0 + top / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def student_p(t: float | None, dof: float | None) -> float | None:
    """Two-sided p of Student's t, by the regularized incomplete beta function."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return None
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def normal_p(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def _student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([student_p(None if pd.isna(a) else a, None if pd.isna(b) else b) for a, b in zip(t, dof, strict=True)], dtype="float64")


def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_p(None if pd.isna(x) else x) for x in z], dtype="float64")


def with_p(rows: DataFrame, t: str, dof: Column, name: str = "p_value") -> DataFrame:
    """Adds Student's two-sided p, in Arrow batches."""
    return rows.withColumn(name, F.pandas_udf(_student_p, "double")(F.col(t), dof.cast("double")))


def with_normal_p(rows: DataFrame, z: str, name: str = "p_value") -> DataFrame:
    return rows.withColumn(name, F.pandas_udf(_normal_p, "double")(F.col(z)))


def corr_t(r: Column, n: Column) -> Column:
    """t of a correlation of n pairs."""
    return r * F.sqrt(F.try_divide(n - 2, 1 - r * r))


def verdict(mean_a: Column, mean_b: Column, p: Column) -> Column:
    """SUPPORTED if the first mean is significantly larger, NOT SUPPORTED if smaller, else MIXED."""
    return F.when((mean_a > mean_b) & (p < 0.05), "SUPPORTED").when(mean_a <= mean_b, "NOT SUPPORTED").otherwise("MIXED")


def benchmark_flag(value: Column, benchmark: Column, times: float = 3.0) -> Column:
    """OK, SIGN! (other sign), MAG! (off by more than ``times`` either way) or N/A."""
    return F.when(value.isNull() | benchmark.isNull(), "N/A").when(F.signum(value) != F.signum(benchmark), "SIGN!").when((F.abs(value) > times * F.abs(benchmark)) | (F.abs(value) * times < F.abs(benchmark)), "MAG!").otherwise("OK")


def quintile(signal: str = "signal", by: str = "date", tie: str = "ticker") -> Column:
    """1 to 5 by rank within the day, as quantile cuts of the ranks give (``ntile`` deals differently)."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(signal, tie))
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return F.when(n >= 5, F.greatest(F.lit(1), F.ceil(F.try_divide(5 * (rn - 1), n - 1))).cast("int"))
