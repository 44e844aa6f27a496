"""Training, calibration and scoring with Spark ML; tree boosters, TPE and SHAP have Spark stand-ins (see README)."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.encode import fill_for_model
from tallyforge.operators.metrics import auc, brier
from tallyforge.operators.profile import quoted
from tallyforge.operators.split import k_folds

# Probability bounds, calibration and adoption thresholds.
PD_FLOOR, PD_CAP, LEAST_CALIBRATION, ADOPT_GAIN, OVERFIT_GAP = 0.0003, 0.9999, 100, 0.0005, 0.12
FILL = -999.0


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=[f"__{k}" for k in range(len(features))], outputCol="__x").transform(
        fill_for_model(df, features, FILL).withColumns({f"__{k}": quoted(c).cast("double") for k, c in enumerate(features)})
    ).drop(*[f"__{k}" for k in range(len(features))])


def estimator(kind: str, label: str, seed: int = 42, weight: str | None = None, valid: str | None = None, **params):
    """gbt, rf or lr; ``valid`` marks rows that stop boosting early."""
    if kind == "gbt":
        e = GBTClassifier(featuresCol="__x", labelCol=label, seed=seed, **({"maxIter": 20, "maxDepth": 4, "stepSize": 0.1} | params))
        if valid:
            e = e.setValidationIndicatorCol(valid)
    elif kind == "rf":
        e = RandomForestClassifier(featuresCol="__x", labelCol=label, seed=seed, **({"numTrees": 30, "maxDepth": 6} | params))
    elif kind == "lr":
        e = LogisticRegression(featuresCol="__x", labelCol=label, **({"regParam": 0.01, "maxIter": 50} | params))
    else:
        raise ValueError(f"unknown model {kind}")
    return e.setWeightCol(weight) if weight else e


def probability(df: DataFrame, model: Model, name: str = "score") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def importance(model: Model, features: Sequence[str]) -> dict[str, float]:
    """Split gains, or the size of the coefficients."""
    v = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return {c: abs(float(v[k])) for k, c in enumerate(features)}


def ablation_importance(df: DataFrame, model: Model, features: Sequence[str], label: str) -> dict[str, float]:
    """The AUC lost when a column is replaced by its mean: a model-agnostic explanation."""
    base = auc(probability(assembled(df, features), model), "score", label).first().auc or 0.5
    out = {}
    for c in features:
        mean = df.agg(F.avg(quoted(c).cast("double"))).first()[0]
        flat = df.withColumn(c, F.lit(mean).cast("double"))
        out[c] = base - (auc(probability(assembled(flat, features), model), "score", label).first().auc or 0.5)
    return out


def scaled_budget(seconds: float, rows: int, base: int = 100_000) -> float:
    """A time budget that grows with the rows, by up to ten times."""
    return seconds * min(max(rows / base, 1.0), 10.0)


SPACE: dict[str, dict[str, Sequence]] = {
    "gbt": {"maxDepth": (2, 3, 4, 5), "maxIter": (10, 20, 40), "stepSize": (0.05, 0.1, 0.2), "subsamplingRate": (0.7, 0.85, 1.0)},
    "rf": {"numTrees": (20, 40, 80), "maxDepth": (4, 6, 8), "minInstancesPerNode": (1, 5, 20)},
    "lr": {"regParam": (0.0, 0.001, 0.01, 0.1), "elasticNetParam": (0.0, 0.5)},
}


@dataclass
class Trial:
    kind: str
    params: dict
    score: float


def search(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, kinds: Sequence[str] = ("lr", "rf", "gbt"), trials: int = 6, seconds: float = 600, seed: int = 42, weight: str | None = None) -> list[Trial]:
    """Seeded random search over models and parameters, best first; stops at the time budget."""
    rng, end = random.Random(seed), time.monotonic() + seconds
    a, b = assembled(train, features).cache(), assembled(valid, features).cache()
    out: list[Trial] = []
    try:
        plan = [(k, {}) for k in kinds]
        plan += [(k := rng.choice(list(kinds)), {n: rng.choice(list(v)) for n, v in SPACE[k].items()}) for _ in range(max(trials - len(plan), 0))]
        for kind, params in plan[:trials]:
            if out and time.monotonic() > end:
                break
            model = estimator(kind, label, seed, weight, **params).fit(a)
            out.append(Trial(kind, params, auc(probability(b, model), "score", label).first().auc or 0.5))
    finally:
        a.unpersist()
        b.unpersist()
    return sorted(out, key=lambda t: -t.score)


def adopt(new: float | None, old: float | None, gain: float = ADOPT_GAIN) -> bool:
    """A re-tuned model replaces the old one for a real gain only."""
    return new is not None and (old is None or new >= old + gain)


@dataclass
class Calibrator:
    """Isotonic (points of a step-linear map) or sigmoid (a logistic map of the score), with bounds."""

    kind: str = "none"
    points: tuple[tuple[float, float], ...] = ()
    slope: float = 1.0
    offset: float = 0.0

    def apply(self, s: Column) -> Column:
        if self.kind == "sigmoid":
            s = 1 / (1 + F.exp(-(F.lit(self.slope) * s + F.lit(self.offset))))
        elif self.kind == "isotonic" and self.points:
            xs, ys = (F.array(*[F.lit(float(p[k])) for p in self.points]) for k in (0, 1))
            at = F.size(F.filter(xs, lambda x: x <= s))
            n = len(self.points)
            x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
            s = F.when(at == 0, F.lit(float(self.points[0][1]))).when(at >= n, F.lit(float(self.points[-1][1]))).otherwise(y0 + (s - x0) * F.try_divide(y1 - y0, x1 - x0))
        return F.greatest(F.least(s, F.lit(PD_CAP)), F.lit(PD_FLOOR))


def fit_calibrator(oof: DataFrame, score: str, label: str, kind: str = "isotonic", most_points: int = 1000) -> Calibrator:
    """Needs 100 out-of-fold rows of two classes; otherwise only the bounds apply."""
    n, pos = oof.agg(F.count("*"), F.sum(quoted(label).cast("long"))).first()
    if n < LEAST_CALIBRATION or pos in (0, n, None):
        return Calibrator()
    if kind == "sigmoid":
        rows = VectorAssembler(inputCols=[score], outputCol="__s").transform(oof.select(score, quoted(label).cast("double").alias("__l")))
        m = LogisticRegression(featuresCol="__s", labelCol="__l").fit(rows)
        return Calibrator("sigmoid", (), float(m.coefficients[0]), float(m.intercept))
    m = IsotonicRegression(featuresCol="__s", labelCol="__l").fit(oof.select(quoted(score).cast("double").alias("__s"), quoted(label).cast("double").alias("__l")))
    pts = list(zip(m.boundaries.toArray().tolist(), m.predictions.toArray().tolist(), strict=True))
    step = max(1, len(pts) // most_points)
    return Calibrator("isotonic", tuple(dict.fromkeys([*pts[::step], pts[-1]])))


@dataclass
class Scorer:
    """Models of one feature set, averaged, calibrated and bounded."""

    models: list[Model]
    features: list[str]
    calibrator: Calibrator = field(default_factory=Calibrator)

    def score(self, df: DataFrame, keys: Sequence[str] = (), raw: bool = False, strict: bool = True) -> DataFrame:
        """Keys with the score (and ``raw_score``)."""
        if lost := [c for c in self.features if c not in df.columns]:
            if strict:
                raise ValueError(f"features are missing: {lost}")
            df = df.withColumns({c: F.lit(None).cast("double") for c in lost})
        out = assembled(df, self.features)
        for k, m in enumerate(self.models):
            out = probability(out, m, f"__s{k}")
        mean = sum((F.col(f"__s{k}") for k in range(len(self.models))), F.lit(0.0)) / len(self.models)
        out = out.withColumn("raw_score", mean).withColumn("score", self.calibrator.apply(F.col("raw_score")))
        drop = ["__x", *[f"__s{k}" for k in range(len(self.models))], *([] if raw else ["raw_score"])]
        return out.select(*keys, *(["raw_score"] if raw else []), "score") if keys else out.drop(*drop)

    def predict(self, df: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
        return self.score(df, keys).withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def fit_final(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], kind: str = "gbt", params: dict | None = None, folds: int = 3, seeds: int = 2, calibration: str = "isotonic", weight: str | None = None) -> tuple[Scorer, DataFrame]:
    """K-fold models give out-of-fold scores, which fit the calibrator; then models of several seeds on all rows."""
    rows = k_folds(train, folds, label, keys, name="__fold").cache()
    parts = []
    for k in range(folds):
        m = estimator(kind, label, 42 + k, weight, **(params or {})).fit(assembled(rows.where(F.col("__fold") != k), features))
        parts.append(probability(assembled(rows.where(F.col("__fold") == k), features), m, "oof").select(*keys, label, "__fold", "oof"))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    cal = fit_calibrator(oof, "oof", label, calibration)
    whole = assembled(rows, features).cache()
    models = [estimator(kind, label, 100 + s, weight, **(params or {})).fit(whole) for s in range(seeds)]
    whole.unpersist()
    rows.unpersist()
    return Scorer(models, list(features), cal), oof


def evaluate(scorer: Scorer, parts: dict[str, DataFrame], label: str) -> dict[str, dict[str, float]]:
    """AUC and Brier score of each part, raw and calibrated, to four digits."""
    out = {}
    for name, df in parts.items():
        s = scorer.score(df, raw=True)
        out[name] = {f"{m}{tag}": round(v, 4) if (v := f(s, col, label).first()[0]) is not None else math.nan for tag, col in (("_raw", "raw_score"), ("", "score")) for m, f in (("auc", auc), ("brier", brier))}
    return out


def overfit_gap(reference: float, holdout: float) -> float:
    return (reference - holdout) / reference if reference else 0.0


def guard_overfit(reference: float, holdout: float, refit: Callable[[], tuple[float, object]], current: object, most: float = OVERFIT_GAP) -> tuple[object, bool]:
    """Refit with stronger regularisation where the gap is too wide; keep it only if the holdout is no worse."""
    if overfit_gap(reference, holdout) <= most:
        return current, False
    score, other = refit()
    return (other, True) if score >= holdout else (current, False)
