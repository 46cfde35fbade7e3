"""Returns and market regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .ordered import exact_quantiles


def returns(prices: DataFrame) -> DataFrame:
    """Adds ret_overnight, ret_intraday and ret_close2close."""
    before = F.lag("Close").over(Window.partitionBy("ticker").orderBy("date"))
    rows = prices.withColumn("__before", before)
    return rows.withColumns({"ret_overnight": F.try_divide("Open", "__before") - 1, "ret_intraday": F.try_divide("Close", "Open") - 1, "ret_close2close": F.try_divide("Close", "__before") - 1}).drop("__before")


def pct_change(series: DataFrame, value: str = "Close", name: str = "ret") -> DataFrame:
    """Change against the row before, of one short daily series."""
    w = Window.orderBy("date")
    return series.withColumn(name, F.try_divide(F.col(value), F.lag(value).over(w)) - 1)


def regime_of(ret: Column, settings: Settings = DEFAULT) -> Column:
    return F.when(ret > settings.bull_above, "BULL").when(ret < settings.bear_below, "BEAR").otherwise("SIDEWAYS")


def market_regime(index: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """date, ret60, market_regime from the compounded returns of the last 60 rows of an index (all 60 must be there)."""
    w = Window.orderBy("date").rowsBetween(1 - settings.regime_rows, 0)
    rows = pct_change(index, name="__r")
    full = F.count("__r").over(w) == settings.regime_rows
    return rows.withColumn("ret60", F.when(full, F.product(1 + F.col("__r")).over(w) - 1)).select("date", "ret60", regime_of(F.col("ret60"), settings).alias("market_regime"))


def panel(prices: DataFrame, regimes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Returns with sector, cap_tier (INDEX for what the dimension lacks) and the day's regime (SIDEWAYS by default)."""
    rows = returns(prices).join(dimension.select("ticker", "sector", "cap_tier"), "ticker", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("INDEX")) for c in ("sector", "cap_tier")})
    return rows.join(regimes.select("date", "market_regime"), "date", "left").withColumn("market_regime", F.coalesce("market_regime", F.lit("SIDEWAYS")))


def winsorize(rows: DataFrame, columns: tuple[str, ...], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clips each column at its exact quantiles; ``n_<column>`` flags rows that changed (missing ones count as changed)."""
    out = rows
    for c in columns:
        out = out.crossJoin(F.broadcast(exact_quantiles(rows, c, {f"__lo_{c}": low, f"__hi_{c}": high})))
        x, lo, hi = F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        new = F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))
        out = out.withColumn(f"n_{c}", F.coalesce(F.abs(x - new) > F.lit(1e-8) + F.lit(1e-5) * F.abs(new), F.lit(True)).cast("int")).withColumn(c, new)
    return out.drop(*(f"__{k}_{c}" for c in columns for k in ("lo", "hi")))
