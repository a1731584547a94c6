"""Baselines, scaler, logistic regression, boosted trees and calibrators on the public ML API."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import ValidationError

THRESHOLD = 0.5


def scored(rows: DataFrame, p: Column, model: str, threshold: float = THRESHOLD) -> DataFrame:
    return rows.withColumns({"model_name": F.lit(model), "p_up": p, "y_pred": (p >= threshold).cast("int")})


def prior_baseline(train: DataFrame, rows: DataFrame, label: str = "y_true") -> DataFrame:
    """Every row gets the training mean of the label: a one-row aggregate, broadcast."""
    mean = train.agg(F.avg(F.col(label).cast("double")).alias("_p"))
    return scored(rows.crossJoin(F.broadcast(mean)), F.col("_p"), "prior").drop("_p")


def momentum_baseline(train: DataFrame, rows: DataFrame, signal: str = "log_return_60m", alpha: float = 1.0, label: str = "y_true") -> DataFrame:
    """Smoothed share of ups by the sign of the signal; the class is the sign itself, whatever the share."""
    up = F.col(signal) > 0
    y = F.col(label).cast("double")
    def share(c: Column) -> Column:
        return (F.coalesce(F.sum(F.when(c, y)), F.lit(0.0)) + alpha) / (F.count_if(c) + 2 * alpha)
    fit = train.agg(share(up).alias("_up"), share(~up).alias("_down"))
    out = rows.crossJoin(F.broadcast(fit))
    return out.withColumns({"model_name": F.lit("momentum"), "p_up": F.when(up, F.col("_up")).otherwise(F.col("_down")), "y_pred": up.cast("int")}).drop("_up", "_down")


def scaler(train: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of each feature over the training rows; a constant feature is divided by 1."""
    row = train.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    return {n: (row[f"m_{n}"], row[f"s_{n}"] or 1.0) for n in names}


def scaled(rows: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({n: (F.col(n) - m) / s for n, (m, s) in fit.items()})


def assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with the feature vector; a NULL or NaN feature raises."""
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(rows)


@dataclass
class Logistic:
    names: list[str]
    scale: dict[str, tuple[float, float]]
    coefficients: list[float]
    intercept: float

    def probability(self) -> Column:
        """The probability as a plain expression: scoring needs no ML stage."""
        z = F.lit(self.intercept)
        for n, w in zip(self.names, self.coefficients, strict=True):
            m, s = self.scale[n]
            z = z + (F.col(n) - m) / s * w
        return 1 / (1 + F.exp(-z))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(n, float(w)) for n, w in zip(self.names, self.coefficients, strict=True)], "feature string, value double")


def fit_logistic(train: DataFrame, names: list[str], label: str = "y_true", c: float = 1.0, max_iter: int = 2000, tol: float = 1e-6) -> Logistic:
    """L2 logistic regression with strength 1 / C on scaled features, the intercept free."""
    n = train.count()
    fit = scaler(train, names)
    rows = assembled(scaled(train, fit), names).select("features", F.col(label).cast("double").alias("label"))
    model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol).fit(rows)
    return Logistic(names, fit, list(map(float, model.coefficients)), float(model.intercept))


@dataclass(frozen=True)
class TreeParams:
    """Boosted trees: what the public classifier has of depth, rate, rows per tree, bins and least rows per leaf."""

    name: str = "trees"
    max_depth: int = 4
    step_size: float = 0.05
    rounds: int = 200
    subsampling: float = 0.8
    max_bins: int = 256
    min_rows: int = 50
    seed: int = 42

    def check(self) -> TreeParams:
        errors = []
        if not 1 <= self.max_depth <= 30:
            errors.append("max_depth")
        if not 0 < self.step_size <= 1:
            errors.append("step_size")
        if not 0 < self.subsampling <= 1:
            errors.append("subsampling")
        if self.rounds < 1 or self.max_bins < 2 or self.min_rows < 1:
            errors.append("rounds, max_bins or min_rows")
        if errors:
            raise ValidationError(errors)
        return self

    def classifier(self, rounds: int | None = None) -> GBTClassifier:
        return GBTClassifier(
            maxDepth=self.max_depth, stepSize=self.step_size, maxIter=rounds or self.rounds, subsamplingRate=self.subsampling, maxBins=self.max_bins,
            minInstancesPerNode=self.min_rows, seed=self.seed, featuresCol="features", labelCol="label",
        )


def vectors(rows: DataFrame, names: list[str], label: str = "y_true") -> DataFrame:
    return assembled(rows, names).withColumn("label", F.col(label).cast("double"))


def learning_curve(model: GBTClassificationModel, rows: DataFrame) -> list[float]:
    """The loss on rows after each tree."""
    return list(model.evaluateEachIteration(rows))


def best_rounds(curve: list[float], patience: int) -> int:
    """Trees up to the least loss before `patience` rounds pass without a better one."""
    best = 0
    for k, loss in enumerate(curve):
        if loss < curve[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


@dataclass
class Trees:
    names: list[str]
    model: GBTClassificationModel
    rounds: int
    curve: list[float] = field(default_factory=list)

    def score(self, rows: DataFrame, name: str = "trees") -> DataFrame:
        out = self.model.transform(assembled(rows, self.names))
        return scored(out, vector_to_array("probability")[1], name).drop("features", "rawPrediction", "probability", "prediction")

    def importances(self) -> list[tuple[str, float, int]]:
        """(feature, normalised gain, rank); unused features have 0."""
        gain = [float(x) for x in self.model.featureImportances.toArray()]
        order = sorted(range(len(gain)), key=lambda k: (-gain[k], k))
        return [(self.names[k], gain[k], r + 1) for r, k in enumerate(order)]


def fit_trees(inner_train: DataFrame, early_stop: DataFrame, outer_train: DataFrame, names: list[str], params: TreeParams, patience: int = 20, label: str = "y_true") -> Trees:
    """Chooses the number of trees on the inner split, then fits that many on all outer training rows."""
    params.check()
    selector = params.classifier().fit(vectors(inner_train, names, label))
    curve = learning_curve(selector, vectors(early_stop, names, label))
    rounds = best_rounds(curve, patience)
    return Trees(names, params.classifier(rounds).fit(vectors(outer_train, names, label)), rounds, curve)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_trees(path: str, names: list[str]) -> Trees:
    model = GBTClassificationModel.load(path)
    return Trees(names, model, model.getNumTrees)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass
class Calibrator:
    """UNCALIBRATED, PLATT (a logistic curve over the logit) or ISOTONIC (a step line, interpolated, held at its ends)."""

    method: str
    slope: float = 1.0
    shift: float = 0.0
    boundaries: list[float] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    epsilon: float = 1e-6

    def apply(self, p: Column) -> Column:
        if self.method == "PLATT":
            return 1 / (1 + F.exp(-(X.logit(p, self.epsilon) * self.slope + self.shift)))
        if self.method == "ISOTONIC":
            return F.when(p.isNotNull(), X.clip01(F.when(p < self.boundaries[0], F.lit(self.values[0])).otherwise(self._line(p))))
        return p

    def _line(self, p: Column) -> Column:
        """The value at p on the line through the knots, by bisection over their array: any number of knots is one expression."""
        knots, values = (F.from_json(F.lit(json.dumps(x)), "array<double>") for x in (self.boundaries, self.values))
        last = len(self.boundaries) - 1
        low, high = F.lit(0), F.lit(last + 1)
        turns = F.sequence(F.lit(1), F.lit(max(1, last.bit_length() + 1)))

        def halved(s: Column, _: Column) -> Column:
            middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
            right = (middle <= last) & (F.get(knots, middle) <= p)
            return F.struct(F.when(right, middle).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(middle).alias("high"))

        k = F.aggregate(turns, F.struct(low.alias("low"), high.alias("high")), halved, lambda s: s["low"])
        a, b, u, v = F.get(knots, k), F.get(knots, k + 1), F.get(values, k), F.get(values, k + 1)
        return F.when(b.isNull(), u).otherwise(u + (p - a) / (b - a) * (v - u))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def save_calibrator(calibrator: Calibrator, path: str) -> str:
    """Writes the calibrator as JSON; returns the SHA-256 of its canonical form."""
    from ..sources.io import write_json

    write_json(path, calibrator.to_dict())
    return hashlib.sha256(canonical_json(calibrator.to_dict()).encode()).hexdigest()


def load_calibrator(path: str) -> Calibrator:
    from ..sources.io import read_json

    return Calibrator(**read_json(path))


def reload_difference(rows: DataFrame, trees: Trees, calibrator: Calibrator, trees_path: str, calibrator_path: str, most: int = 2048) -> float:
    """The largest difference between the probabilities of a model and of what was read back from its files, over at most so many rows."""
    sample = rows.orderBy("dataset_row_id").limit(most)
    again, calibrated = load_trees(trees_path, trees.names), load_calibrator(calibrator_path)
    a = trees.score(sample).select("dataset_row_id", calibrator.apply(F.col("p_up")).alias("a"))
    b = again.score(sample).select("dataset_row_id", calibrated.apply(F.col("p_up")).alias("b"))
    return a.join(b, "dataset_row_id").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] or 0.0


def fit_calibrator(method: str, rows: DataFrame, epsilon: float = 1e-6, label: str = "y_true") -> Calibrator:
    if method == "UNCALIBRATED":
        return Calibrator(method)
    y = F.col(label).cast("double").alias("label")
    if method == "PLATT":
        x = assembled(rows.select(X.logit(F.col("p_up"), epsilon).alias("z"), y), ["z"])
        n = x.count()
        model = LogisticRegression(regParam=1e-6 / n, standardization=False, maxIter=200, tol=1e-10).fit(x)
        return Calibrator(method, float(model.coefficients[0]), float(model.intercept), epsilon=epsilon)
    if method == "ISOTONIC":
        model = IsotonicRegression(featuresCol="p", labelCol="label").fit(rows.select(F.col("p_up").alias("p"), y))
        return Calibrator(method, boundaries=list(map(float, model.boundaries)), values=list(map(float, model.predictions)))
    raise ValidationError([f"unknown calibration method {method}"])


def forward_folds(names: list[str]) -> list[tuple[list[str], str]]:
    """(earlier folds, evaluated fold) in order; the first fold has nothing before it."""
    ordered = sorted(names)
    return [(ordered[:k], ordered[k]) for k in range(1, len(ordered))]


def forward_calibrated(predictions: DataFrame, methods: tuple[str, ...] = ("UNCALIBRATED", "PLATT", "ISOTONIC")) -> DataFrame:
    """(method, calibration_fold, …) rows of each fold after the first, calibrated on the folds before it."""
    folds = sorted(r[0] for r in predictions.select("fold_name").distinct().collect())
    out = None
    for before, fold in forward_folds(folds):
        for method in methods:
            fit = fit_calibrator(method, predictions.where(F.col("fold_name").isin(before)))
            part = predictions.where(F.col("fold_name") == fold)
            part = part.withColumns({"method": F.lit(method), "calibration_fold": F.lit(fold), "p_up": fit.apply(F.col("p_up"))})
            part = part.withColumn("y_pred", (F.col("p_up") >= THRESHOLD).cast("int"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValidationError(["forward calibration needs two folds"])
    return out


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def frozen(candidates: list[dict]) -> tuple[list[dict], str]:
    """Candidate definitions with unique names, and the SHA-256 of their canonical JSON."""
    names = [c["name"] for c in candidates]
    if len(set(names)) != len(names):
        raise ValidationError(["candidate names repeat"])
    return [dict(c) for c in candidates], hashlib.sha256(canonical_json(candidates).encode()).hexdigest()


def ids_sha256(rows: DataFrame, c: str) -> DataFrame:
    """(sha256) of an id column's sorted text lines; one value a partition of ids would not do, so ids are gathered: for id lists, not tables."""
    return rows.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string"))), 256).alias("sha256"))


def finite_or_none(x: float) -> float | None:
    return x if x is not None and math.isfinite(x) else None
