"""Coverage, descriptions, histograms and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import is_true
from .ordered import running


def describe(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """count, mean, std, min, quartiles, max in one aggregate."""
    c = F.col(column)
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q.alias("__q"), F.max(c).alias("max"))
    return out.select(*by, "n", "mean", "std", "min", *(F.get("__q", F.lit(i)).alias(k) for i, k in enumerate(("q25", "q50", "q75"))), "max")


def moments(rows: DataFrame, column: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    c, n = F.col(column), F.count(column).cast("double")
    skew = F.skewness(c) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), skew.alias("skew"), kurt.alias("kurt"))


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, n, lo, hi of equal bins from the least to the greatest value; the last bin includes its end."""
    limits = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    at = F.least(F.floor(F.try_divide((F.col(column) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo"))), F.lit(bins - 1)).cast("int")
    out = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(limits)).withColumn("bin", F.coalesce(at, F.lit(0)))
    width = (F.col("__hi") - F.col("__lo")) / bins
    return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("__lo")).alias("__a"), F.first(width).alias("__w")).select("bin", "n", (F.col("__a") + F.col("bin") * F.col("__w")).alias("lo"), (F.col("__a") + (F.col("bin") + 1) * F.col("__w")).alias("hi"))


def value_counts(rows: DataFrame, *by: str) -> DataFrame:
    """n and its share in percent, by value."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select(*by, "n", (100.0 * F.col("n") / F.col("__t")).alias("pct"))


def dense(rows: DataFrame, left: DataFrame, right: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """``value`` on every combination of two small spines, 0 where there is none."""
    return left.crossJoin(F.broadcast(right)).join(rows, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def funnel(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows that pass each step and all before it, in one pass: step, name, n."""
    passed, sums = F.lit(True), [F.struct(F.lit(0).alias("step"), F.lit("all").alias("name"), F.count(F.lit(1)).alias("n"))]
    for i, (name, cond) in enumerate(steps, 1):
        passed = passed & is_true(cond)
        sums.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.coalesce(F.sum(passed.cast("long")), F.lit(0)).alias("n")))
    return rows.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def _cumulative(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and rows at each distinct score and above it."""
    by = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return running(by, (F.desc("s"),), {"tp": "pos", "seen": "n"})


def auc_ap(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC (ties count half) and average precision (step sum)."""
    c = _cumulative(rows, label, score)
    neg = F.col("n") - F.col("pos")
    above = F.col("tp") - F.col("pos")
    total_pos, total_neg = F.sum("pos"), F.sum(neg)
    auc = F.try_divide(F.sum(neg * (above + F.col("pos") / 2)), total_pos * total_neg)
    ap = F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), total_pos)
    return c.agg(F.sum("n").alias("n"), total_pos.alias("n_pos"), auc.alias("auc"), ap.alias("average_precision"))


def pr_curve(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """threshold, precision, recall at each distinct score."""
    c = _cumulative(rows, label, score)
    total = c.agg(F.sum("pos").alias("__p"))
    return c.crossJoin(F.broadcast(total)).select(F.col("s").alias("threshold"), (F.col("tp") / F.col("seen")).alias("precision"), F.try_divide("tp", "__p").alias("recall"))


def confusion_report(rows: DataFrame, label: str = "label", score: str = "score", at: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of each class, and accuracy, macro and weighted rows."""
    y, p = F.col(label) == 1, F.col(score) >= at
    cnt = lambda c: F.sum(c.cast("long"))
    m = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(cnt(y & p).alias("tp"), cnt(~y & p).alias("fp"), cnt(y & ~p).alias("fn"), cnt(~y & ~p).alias("tn"))
    m = m.select("*", *(F.coalesce(F.try_divide(a, b), F.lit(0.0)).alias(k) for k, a, b in (("p1", F.col("tp"), F.expr("tp + fp")), ("r1", F.col("tp"), F.expr("tp + fn")), ("p0", F.col("tn"), F.expr("tn + fn")), ("r0", F.col("tn"), F.expr("tn + fp")))))
    m = m.select("*", *(F.coalesce(F.try_divide(2 * F.col(f"p{k}") * F.col(f"r{k}"), F.col(f"p{k}") + F.col(f"r{k}")), F.lit(0.0)).alias(f"f{k}") for k in (0, 1)), F.expr("tp + fn").alias("n1"), F.expr("tn + fp").alias("n0"), F.expr("tp + fp + fn + tn").alias("n"))
    c = F.col
    accuracy = (c("tp") + c("tn")) / c("n")
    mean = lambda k: (c(f"{k}0") + c(f"{k}1")) / 2
    weighted = lambda k: (c(f"{k}0") * c("n0") + c(f"{k}1") * c("n1")) / c("n")
    row = lambda name, p, r, f, n: F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support"))
    rows = F.array(row("0", c("p0"), c("r0"), c("f0"), c("n0")), row("1", c("p1"), c("r1"), c("f1"), c("n1")), row("accuracy", accuracy, accuracy, accuracy, c("n")), row("macro", mean("p"), mean("r"), mean("f"), c("n")), row("weighted", weighted("p"), weighted("r"), weighted("f"), c("n")))
    return m.select(F.explode(rows).alias("r")).select("r.*")


def prob_group(prob: Column) -> Column:
    """organic (up to 0.3), uncertain (up to 0.7), sponsored: bins closed on the right."""
    return F.when((prob >= 0) & (prob <= 0.3), "organic").when((prob > 0.3) & (prob <= 0.7), "uncertain").when((prob > 0.7) & (prob <= 1), "sponsored")


def uncertain(prob: Column, inclusive: bool = False) -> Column:
    """Between 0.3 and 0.7: without the bounds, or (as one report takes it) with them."""
    return (prob >= 0.3) & (prob <= 0.7) if inclusive else (prob > 0.3) & (prob < 0.7)


def band_counts(rows: DataFrame, count: str) -> DataFrame:
    """Share of cells with 0, 1-2 and 3 or more."""
    c = F.col(count)
    share = lambda x: (100.0 * F.avg(x.cast("double")))
    return rows.agg(F.count(F.lit(1)).alias("cells"), share(c == 0).alias("pct_zero"), share((c >= 1) & (c <= 2)).alias("pct_one_two"), share(c >= 3).alias("pct_three_up"))


def normal_pdf(x: Column, mean: Column, std: Column) -> Column:
    return F.exp(-F.lit(0.5) * F.pow((x - mean) / std, F.lit(2.0))) / (std * F.sqrt(F.lit(2.0) * F.pi()))
