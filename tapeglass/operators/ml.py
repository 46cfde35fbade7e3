"""The sponsored-article classifier: split, fit, score, importance, ablation, circularity, save and load."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .articles import FEATURES
from .audit import auc_ap
from .sampling import permuted, split

#: The features that repeat the labelling rules, and the one that stands for the source.
RULE_FEATURES = ("is_pr_wire", "has_promo_ratio", "has_risk_words")
TIER_FEATURE = "source_tier"
#: Rounds at most, of the model and of an ablated one, and repeats of a permutation.
ROUNDS, ABLATION_ROUNDS, REPEATS = 500, 300, 5


def with_split(rows: DataFrame, key: str, date: str = "date", train: tuple[str, str] = ("2020-01-01", "2022-12-31"), valid: tuple[str, str] = ("2023-01-01", "2023-12-31"), least: int = 100, abort: int = 10) -> DataFrame:
    """Adds is_train by date; fewer than ``least`` training rows fall back to a 70/30 split, and fewer than ``abort`` after that are an error."""
    t = F.col(date).between(*train)
    dated = rows.where(t | F.col(date).between(*valid)).withColumn("is_train", t)
    if dated.where("is_train").count() >= least:
        return dated
    parted = split(rows, key)
    if parted.where("is_train").count() < abort:
        raise ValueError("too few labelled rows")
    return parted


def fit(rows: DataFrame, features: tuple[str, ...] = FEATURES, label: str = "label", depth: int = 5, rounds: int = ROUNDS, rate: float = 0.05, seed: int = 42, unsplit_rounds: int = 20) -> PipelineModel:
    """Boosted trees with classes weighted alike.

    Where ``is_train`` marks held-out rows, up to ``rounds`` with early stopping on these: a round that does not lower their
    error ends the fit (the library stops at the first such round and has no patience).  Without them nothing would stop it:
    ``unsplit_rounds``.
    """
    held = "is_train" in rows.columns
    train = rows.where("is_train") if held else rows
    share = train.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"] or 0.5
    weight = F.when(F.col(label) == 1, (1 - share) / max(share, 1e-9)).otherwise(1.0)
    data = rows.withColumn("__w", weight).withColumn("__label", F.col(label).cast("double"))
    gbt = GBTClassifier(featuresCol="__x", labelCol="__label", weightCol="__w", maxDepth=depth, maxIter=rounds if held else unsplit_rounds, stepSize=rate, seed=seed, featureSubsetStrategy="0.8", subsamplingRate=0.8)
    if held:
        data = data.withColumn("__valid", ~F.col("is_train"))
        gbt = gbt.setValidationIndicatorCol("__valid")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep"), gbt]).fit(data)


def save(model: PipelineModel, path: str) -> None:
    """Writes the model to a folder that all machines see, over an earlier one."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scored(rows: DataFrame, model: PipelineModel, name: str = "sponsored_prob") -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(rows).withColumn(name, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).drop("__x", "rawPrediction", "probability", "prediction")


def auc(rows: DataFrame, model: PipelineModel, label: str = "label") -> float:
    """Area under the curve of the model's scores; one half where only one class is there."""
    got = auc_ap(scored(rows, model, "score"), label).first()["auc"]
    return 0.5 if got is None else float(got)


def importance(model: PipelineModel, features: tuple[str, ...] = FEATURES) -> list[tuple[str, float]]:
    """Shares of gain in percent, the largest first."""
    values = model.stages[-1].featureImportances.toArray()
    total = float(values.sum()) or 1.0
    return sorted(((f, 100 * float(v) / total) for f, v in zip(features, values, strict=True)), key=lambda x: -x[1])


def permutation_importance(rows: DataFrame, model: PipelineModel, features: tuple[str, ...], key: str, label: str = "label", repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """feature, mean and deviation of the AUC lost when one feature is dealt anew; ``rows``: the validation slice."""
    base = auc(rows, model, label)
    out = [(f, base - auc(permuted(rows, f, key, seed + r), model, label)) for f in features for r in range(repeats)]
    return rows.sparkSession.createDataFrame(out, "feature string, drop double").groupBy("feature").agg(F.avg("drop").alias("drop_mean"), F.stddev_pop("drop").alias("drop_std"))


def feature_sets(features: tuple[str, ...] = FEATURES) -> dict[str, tuple[str, ...]]:
    """All features, those without the labelling rules, and those without rules and source tier."""
    no_rules = tuple(f for f in features if f not in RULE_FEATURES)
    return {"all": features, "without rules": no_rules, "without rules and tier": tuple(f for f in no_rules if f != TIER_FEATURE)}


def ablation(rows: DataFrame, sets: dict[str, tuple[str, ...]] | None = None, label: str = "label", rounds: int = ABLATION_ROUNDS) -> DataFrame:
    """feature_set, auc: that of a model fitted for each set of features, on the rows held out by ``is_train``."""
    valid = rows.where("not is_train")
    got = [(k, auc(valid, fit(rows, fs, label, rounds=rounds), label)) for k, fs in (sets or feature_sets()).items()]
    return rows.sparkSession.createDataFrame(got, "feature_set string, auc double")


def circular(gain_pct: float, drop_pct: float, auc_without: float, auc_drop: float) -> bool:
    """Whether the labelling rules dominate the model."""
    return gain_pct > 60 or drop_pct > 60 or auc_without < 0.65 or auc_drop > 0.15


def circularity(rows: DataFrame, model: PipelineModel, key: str, features: tuple[str, ...] = FEATURES, label: str = "label", repeats: int = REPEATS, rounds: int = ABLATION_ROUNDS) -> DataFrame:
    """One row: the rule features' shares of gain and of lost AUC, the AUC with and without them, and the verdict."""
    valid = rows.where("not is_train")
    gain = dict(importance(model, features))
    drops = {r["feature"]: r["drop_mean"] for r in permutation_importance(valid, model, features, key, label, repeats).collect()}
    total = sum(drops.values())
    rule_drop = 100 * sum(drops[f] for f in RULE_FEATURES) / total if total > 0 else 0.0
    rule_gain = sum(gain[f] for f in RULE_FEATURES)
    full = auc(valid, model, label)
    without = {r["feature_set"]: r["auc"] for r in ablation(rows, {k: v for k, v in feature_sets(features).items() if k != "all"}, label, rounds).collect()}
    bare = without["without rules"]
    return rows.sparkSession.createDataFrame([Row(rule_gain_pct=float(rule_gain), tier_gain_pct=float(gain[TIER_FEATURE]), rule_drop_pct=float(rule_drop), auc_full=full, auc_without_rules=bare, auc_without_tier=without["without rules and tier"], is_circular=circular(rule_gain, rule_drop, bare, full - bare))])
