"""Quality rules by host: rule failures are aggregated by domain, rates are shrunk towards an empirical beta prior, and
the host's verdict is joined back to its documents.

Cases: a null text is empty (no words: it fails ``too_short``); a row with a null host has no host verdict and is judged
by its own rules; repeated rows are judged (and counted) each for itself; an empty table gives an empty table; only the
columns named by the parameters are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import bounded, chunks, lean
from .shared import offered, written
from .textstats import basic

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules that decide on a document by itself.
BASE_RULES = {"too_short": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words"}
#: Rules that only count against the host.
HOST_RULES = {"symbols": "10 * n_symbols > word_chars", "dup_lines": "5 * n_dup_lines > n_words"}


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(2)):
            got = basic(c)
            keys = [batch.column(k).slice(c.first, c.n) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(got[k].astype(np.int64)) for k in STATS)], names=["doc_id", "host", *STATS])


def document_stats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """doc_id, host and the statistics of every whole text."""
    rows = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(_stats), "doc_id long, host string, " + ", ".join(f"{k} long" for k in STATS))


def host_verdicts(stats: DataFrame, rules: dict[str, str], max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, a shrunk failure rate for each rule, host_failed.

    The prior of a rule is the beta distribution whose mean and variance are those of the hosts' rates, less the
    variance that sampling alone gives.  Counts by host are combined before the shuffle; the prior is one row.
    """
    counts = stats.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.expr(f"cast({e} as long)")).alias(f"f_{r}") for r, e in rules.items()))
    counts = written(counts)
    means = counts.agg(F.sum("n_docs").alias("all_n"), F.count(F.lit(1)).alias("hosts"), *(F.try_divide(F.sum(f"f_{r}"), F.sum("n_docs")).alias(f"m_{r}") for r in rules))
    spread = counts.crossJoin(F.broadcast(means)).groupBy("all_n", "hosts", *(f"m_{r}" for r in rules)).agg(*(F.sum(F.col("n_docs") * F.pow(F.col(f"f_{r}") / F.col("n_docs") - F.col(f"m_{r}"), F.lit(2.0))).alias(f"s_{r}") for r in rules))

    def strength(r: str) -> Column:
        m = F.col(f"m_{r}")
        own = m * (1 - m)
        between = F.col(f"s_{r}") / F.col("all_n") - own * F.col("hosts") / F.col("all_n")
        return F.least(F.greatest(F.when(between > 0, F.try_divide(own, between) - 1).otherwise(F.lit(1e6)), F.lit(1.0)), F.lit(1e6))

    prior = spread.select(*(F.col(f"m_{r}") for r in rules), *(strength(r).alias(f"k_{r}") for r in rules))
    rates = {r: (F.col(f"f_{r}") + F.col(f"k_{r}") * F.col(f"m_{r}")) / (F.col("n_docs") + F.col(f"k_{r}")) for r in rules}
    failed = F.lit(False)
    for rate in rates.values():
        failed = failed | (rate > max_rate)
    return counts.crossJoin(F.broadcast(prior)).select("host", "n_docs", *(rate.alias(f"rate_{r}") for r, rate in rates.items()), failed.alias("host_failed"))


def judge(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", host: str = "source", base_rules: dict[str, str] = BASE_RULES, host_rules: dict[str, str] = HOST_RULES, max_rate: float = 0.5) -> DataFrame:
    """doc_id, host, the statistics, base_failed, host_failed and kept of every document.

    The statistics (a few dozen bytes a document) are written once; host verdicts join them by broadcast while their
    counted size is under the bound, else by a shuffle in which adaptive execution splits a host that holds many rows.
    """
    stats = written(document_stats(docs, text, doc_id, host))
    verdicts = host_verdicts(stats, {**base_rules, **host_rules}, max_rate)
    failed = F.lit(False)
    for e in base_rules.values():
        failed = failed | F.expr(e)
    out = stats.join(offered(written(verdicts.select("host", "host_failed")), 64), "host", "left")
    out = out.withColumn("base_failed", failed).withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.select("doc_id", "host", *STATS, "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
