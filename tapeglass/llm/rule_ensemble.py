"""Quality classifier: a sparse rule ensemble.

Statistics of whole texts are split by small trees; every path from a root to a node becomes a conjunctive rule; lasso
logistic regression gives most rules the weight zero; the rest are compiled into one Spark column expression.

The fit uses a bounded sample of labelled rows (``FIT_ROWS``, those whose key has the least hash) on the driver; scores
are computed for every row.  Cases: a null or empty text has zero statistics and is scored like any; repeated rows get
equal scores; of several labels of one id the least counts; without labelled rows, or with one class only, the score is
that class's smoothed share; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import bounded, chunks, lean
from .textstats import FEATURES, rich

#: The most labelled rows used for the fit.
FIT_ROWS = 20_000
TREES, DEPTH, MIN_LEAF, BINS = 40, 3, 15, 48
PENALTIES = (0.03, 0.01, 0.004, 0.0015)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1)):
            got = rich(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), *(pa.array(got[k]) for k in FEATURES)], names=["doc_id", *FEATURES])


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the statistics of every whole text."""
    rows = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(_features), "doc_id long, " + ", ".join(f"{k} double" for k in FEATURES))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, threshold)


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, names: tuple[str, ...] = FEATURES) -> Column:
        """The compiled expression: a logistic function of the weights of the rules that hold."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for i, above, at in rule:
                holds = holds & ((F.col(names[i]) > at) if above else (F.col(names[i]) <= at))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _bins(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1), edges


def _grow(binned: np.ndarray, edges: list[np.ndarray], target: np.ndarray, weight: np.ndarray, use: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """The rules of all nodes of one tree of least squares, and its prediction."""
    rules: list[Rule] = []
    value = np.zeros(len(target))
    open_nodes: list[tuple[np.ndarray, Rule]] = [(np.arange(len(target)), ())]
    while open_nodes:
        rows, rule = open_nodes.pop()
        w, t = weight[rows], target[rows] * weight[rows]
        mean = t.sum() / max(w.sum(), 1e-9)
        best = (1e-9, -1, -1)
        if len(rule) < depth and len(rows) >= 2 * MIN_LEAF:
            for j in use:
                if not len(edges[j]):
                    continue
                size = len(edges[j]) + 1
                b = binned[rows, j]
                cn, cw, ct = (np.cumsum(np.bincount(b, weights=v, minlength=size))[:-1] for v in (None, w, t))
                ok = (cn >= MIN_LEAF) & (len(rows) - cn >= MIN_LEAF)
                if not ok.any():
                    continue
                wl, wr = np.maximum(cw, 1e-9), np.maximum(w.sum() - cw, 1e-9)
                gain = np.where(ok, ct**2 / wl + (t.sum() - ct) ** 2 / wr - t.sum() ** 2 / max(w.sum(), 1e-9), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], int(j), k)
        if best[1] < 0:
            value[rows] = mean
            continue
        _, j, k = best
        at = float(edges[j][k])
        left = binned[rows, j] <= k
        for part, above in ((rows[left], False), (rows[~left], True)):
            new = (*rule, (j, above, at))
            rules.append(new)
            open_nodes.append((part, new))
    return rules, value


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for i, above, at in rule:
        ok &= (x[:, i] > at) if above else (x[:, i] <= at)
    return ok


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _lasso(z: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Weighted logistic regression with an absolute penalty, by accelerated proximal steps; the intercept is free."""
    n = w.sum()
    step = 1.0 / (0.25 * float(np.linalg.eigvalsh((z.T * w) @ z / n)[-1] + 1) + 1e-9)
    beta, ahead, b0, a0, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0.0, 0.0, 1.0
    for _ in range(rounds):
        r = w * (_sigmoid(z @ ahead + a0) - y) / n
        new, n0 = ahead - step * (z.T @ r), a0 - step * r.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, a0 = new + (t - 1) / t2 * (new - beta), n0 + (t - 1) / t2 * (n0 - b0)
        beta, b0, t = new, n0, t2
    return b0, beta


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    """The ensemble of statistics ``x`` and labels ``y`` (0 or 1); classes count equally; a fifth picks the penalty."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    binned, edges = _bins(x)
    rules: dict[Rule, None] = {}
    f = np.zeros(len(y))
    for _ in range(TREES):
        rows = rng.random(len(y)) < 0.7
        use = rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)]
        found, _ = _grow(binned[rows], edges, (y - _sigmoid(f))[rows], w[rows], use, int(rng.integers(1, DEPTH + 1)))
        rules.update(dict.fromkeys(found))
        if found:
            _, value = _grow(binned, edges, y - _sigmoid(f), w, use, 2)
            f += 0.4 * 4 * value
    names = list(rules)
    hold = np.stack([_holds(r, x) for r in names], axis=1).astype(float) if names else np.zeros((len(y), 0))
    share = hold.mean(axis=0)
    keep = (share > 0.002) & (share < 0.998)
    names, hold = [r for r, k in zip(names, keep, strict=True) if k], hold[:, keep]
    _, first = np.unique(hold, axis=1, return_index=True)
    first = np.sort(first)
    names, hold = [names[i] for i in first], hold[:, first]
    if not names:
        return Ensemble(0.0)
    centre, scale = hold.mean(axis=0), hold.std(axis=0)
    z = (hold - centre) / scale
    test = rng.random(len(y)) < 0.2
    best: tuple[float, float] | None = None
    for penalty in PENALTIES:
        b0, beta = _lasso(z[~test], y[~test], w[~test], penalty, 200)
        p = np.clip(_sigmoid(z[test] @ beta + b0), 1e-6, 1 - 1e-6)
        loss = -(w[test] * (y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))).sum() / max(w[test].sum(), 1e-9)
        if best is None or loss < best[0]:
            best = (loss, penalty)
    b0, beta = _lasso(z, y, w, best[1])
    used = np.flatnonzero(np.abs(beta) > 1e-4)
    weights = beta / scale
    return Ensemble(float(b0 - (weights[used] * centre[used]).sum()), [(names[i], float(weights[i])) for i in used])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> Ensemble:
    """An ensemble from those labelled rows (at most ``fit_rows``) whose key has the least hash."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    chosen = [(r["doc_id"], r["label"]) for r in chosen.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(fit_rows).collect()]
    if not chosen:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    wanted = F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int"))  # at most fit_rows rows
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id", "left_semi")
    got = features(rows).join(wanted, "doc_id").toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    return fit(got[list(FEATURES)].to_numpy(float), got["label"].to_numpy(float))


def scored(docs: DataFrame, model: Ensemble, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) of every whole text: one pass without a shuffle."""
    out = features(docs, text, doc_id).select("doc_id", model.score().alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
