"""Metrics of predictions (y_true, p_up, y_pred) by groups and overlapping subsets, calibration tables and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

MARGINS = (1.0, 2.5, 5.0, 10.0)
#: sklearn's clipping of probabilities: the double epsilon.
EPSILON = 2.220446049250313e-16
COUNTED = [
    "sample_count", "positive_count", "negative_count", "positive_ratio", "accuracy", "tn", "fp", "fn", "tp", "mean_p", "predicted_positive_ratio", "precision",
    "recall", "f1", "specificity", "npv", "balanced_accuracy", "mcc", "log_loss", "brier",
]
METRICS = [*COUNTED, "roc_auc", "average_precision", "ap_lift"]


def subset_names() -> list[str]:
    return ["DENSE", "NONOVERLAP_OFFSET_00", *[f"OFFSET_{k:02d}" for k in range(0, 60, 5)], "ALL_MARGINS", *[f"ABS_RETURN_GE_{X.risk_suffix(t)}BPS" for t in MARGINS]]


def subsets() -> dict[str, Column]:
    """The 19 overlapping evaluation subsets of a prediction row."""
    at, size = F.col("evaluation_offset_minutes"), F.col("abs_future_return_bps_60m")
    out = {"DENSE": F.lit(True), "NONOVERLAP_OFFSET_00": F.col("is_primary_nonoverlap_evaluation")}
    out |= {f"OFFSET_{k:02d}": at == k for k in range(0, 60, 5)}
    out |= {"ALL_MARGINS": F.lit(True)} | {f"ABS_RETURN_GE_{X.risk_suffix(t)}BPS": size >= t for t in MARGINS}
    return out


def with_subsets(predictions: DataFrame) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets().items()]))
    return predictions.withColumn("subset_name", F.explode(names))


def counted_metrics() -> dict[str, Column]:
    """Everything that sums of a group give, as aggregate expressions."""
    y, z, p = F.col("y_true"), F.col("y_pred"), F.col("p_up")
    count = lambda a, b: F.count_if((y == a) & (z == b))
    tn, fp, fn, tp, n = count(0, 0), count(0, 1), count(1, 0), count(1, 1), F.count(F.lit(1))
    d = lambda c: c.cast("double")
    recall, specificity, precision = X.safe_div(tp, tp + fn), X.safe_div(tn, tn + fp), X.safe_div(tp, tp + fp)
    root = F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn))
    held = F.greatest(F.least(p, F.lit(1 - EPSILON)), F.lit(EPSILON))
    return {
        "sample_count": n, "positive_count": F.count_if(y == 1), "negative_count": F.count_if(y == 0), "positive_ratio": F.avg(d(y)), "accuracy": X.safe_div(tp + tn, n),
        "tn": tn, "fp": fp, "fn": fn, "tp": tp, "mean_p": F.avg(p), "predicted_positive_ratio": F.avg(d(z)), "precision": precision, "recall": recall,
        "f1": X.safe_div(2 * tp, 2 * tp + fp + fn), "specificity": specificity, "npv": X.safe_div(tn, tn + fn), "balanced_accuracy": (recall + specificity) / 2,
        "mcc": F.coalesce(F.try_divide(d(tp) * d(tn) - d(fp) * d(fn), root), F.lit(0.0)),
        "log_loss": -F.avg(F.when(y == 1, F.ln(held)).otherwise(F.ln(1 - held))), "brier": F.avg(F.pow(p - y, F.lit(2))),
    }


def ranked_metrics(rows: DataFrame, by: list[str], buckets: int = 256) -> DataFrame:
    """(by, roc_auc, average_precision): exact with ties, from counts per distinct score.

    Running counts go down the scores in two steps, inside ranges of the score and across the ranges, so that no task
    orders all scores of a group. A group of one class has a NULL AUC; without positives AP is NULL.
    """
    y = F.col("y_true")
    scores = rows.groupBy(*by, F.col("p_up").alias("_p")).agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"))
    scores = scores.withColumn("_at", F.least(F.floor(F.greatest(F.col("_p"), F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int"))
    ranges = scores.groupBy(*by, "_at").agg(F.sum("_pos").alias("_rp"), F.sum("_neg").alias("_rn"))
    above = Window.partitionBy(*by).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ranges = ranges.select(
        *by, "_at", F.coalesce(F.sum("_rp").over(above), F.lit(0)).alias("_ap"), F.coalesce(F.sum("_rn").over(above), F.lit(0)).alias("_an"),
        F.sum("_rp").over(whole).alias("_all_pos"), F.sum("_rn").over(whole).alias("_all_neg"),
    )
    inside = Window.partitionBy(*by, "_at").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    run = scores.withColumns({"_ip": F.sum("_pos").over(inside), "_in": F.sum("_neg").over(inside)}).join(ranges, [*by, "_at"])
    run = run.withColumns({"_tp": F.col("_ap") + F.col("_ip"), "_k": F.col("_ap") + F.col("_ip") + F.col("_an") + F.col("_in")})
    pairs = F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2))
    hits = F.sum(F.col("_pos") * F.col("_tp") / F.col("_k"))
    positives, negatives = F.first("_all_pos"), F.first("_all_neg")
    return run.groupBy(*by).agg(
        F.try_divide(pairs, (positives * negatives).cast("double")).alias("roc_auc"), F.try_divide(hits, positives.cast("double")).alias("average_precision")
    )


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """One metric row per group."""
    counted = rows.groupBy(*by).agg(*[c.alias(n) for n, c in counted_metrics().items()])
    out = counted.join(ranked_metrics(rows, by), by, "left")
    out = out.withColumn("ap_lift", X.safe_div(F.col("average_precision"), F.col("positive_ratio")))
    return out.withColumn("auc_reason", F.when(F.col("roc_auc").isNull(), "single_class_validation_subset")).select(*by, *METRICS, "auc_reason")


def subset_metrics(predictions: DataFrame, by: tuple[str, ...] = ("model_name", "fold_name")) -> DataFrame:
    """Metric rows of all 19 subsets of every group, empty subsets with zero counts and the reason empty_subset."""
    found = metrics(with_subsets(predictions), [*by, "subset_name"])
    names = predictions.sparkSession.createDataFrame([(n,) for n in subset_names()], "subset_name string")
    wanted = predictions.select(*by).distinct().crossJoin(F.broadcast(names))
    out = wanted.join(found, [*by, "subset_name"], "left")
    empty = F.col("sample_count").isNull()
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("sample_count", "positive_count", "negative_count", "tn", "fp", "fn", "tp")}
    return out.withColumn("auc_reason", F.when(empty, "empty_subset").otherwise(F.col("auc_reason"))).withColumns(zeros)


def fold_summary(fold_metrics: DataFrame, names: list[str], by: tuple[str, ...] = ("model_name", "subset_name")) -> DataFrame:
    """Macro mean and sample deviation over the folds of each metric, and the folds with the best and worst AUC."""
    rows = fold_metrics.select(*by, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(by), names, "metric", "value")
    macro = rows.groupBy(*by, "metric").agg(F.avg("value").alias("macro_mean"), F.stddev_samp("value").alias("macro_std"))
    key = F.struct("roc_auc", "fold_name")
    best = fold_metrics.where("roc_auc IS NOT NULL").groupBy(*by).agg(F.max_by("fold_name", key).alias("best_fold"), F.min_by("fold_name", key).alias("worst_fold"))
    return macro.join(best, list(by), "left")


def equal_width_bin(p: Column, bins: int) -> Column:
    """The bin of [k / bins, (k + 1) / bins); 1 falls into the last."""
    out = F.lit(0)
    for k in range(1, bins):
        out = F.when(p >= F.lit(k / bins), F.lit(k)).otherwise(out)
    return out


def with_bins(rows: DataFrame, bins: int, strategy: str = "equal_width", tie: str = "dataset_row_id", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with bin; equal_frequency is floor(rank * bins / n) in the order of (p, tie), which is not ntile.

    Ranks are counted inside ranges of the probability and across them, so that no task orders all rows of a group.
    """
    if strategy == "equal_width":
        return rows.withColumn("bin", equal_width_bin(F.col("p_up"), bins))
    ranges, here = 256, list(by)
    at = F.least(F.floor(F.greatest(F.col("p_up"), F.lit(0.0)) * ranges), F.lit(ranges - 1)).cast("int")
    rows = rows.withColumn("_at", at)
    counts = rows.groupBy(*here, "_at").agg(F.count(F.lit(1)).alias("_m"))
    below = Window.partitionBy(*here).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(c).alias(f"_{c}") for c in here], F.col("_at").alias("_range"), F.coalesce(F.sum("_m").over(below), F.lit(0)).alias("_below"),
        F.sum("_m").over(Window.partitionBy(*here)).alias("_n"),
    )
    same = F.col("_at") == F.col("_range")
    for c in here:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.row_number().over(Window.partitionBy(*here, "_at").orderBy("p_up", tie))
    out = rows.withColumn("_inside", inside).join(counts, same)
    place = F.floor((F.col("_below") + F.col("_inside") - 1) * bins / F.col("_n")).cast("int")
    return out.withColumn("bin", place).drop("_at", "_range", "_below", "_n", "_inside", *[f"_{c}" for c in here])


def calibration_table(binned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_up").alias("mean_p"), F.avg(F.col("y_true").cast("double")).alias("observed"), F.min("p_up").alias("min_p"), F.max("p_up").alias("max_p")
    ).withColumn("gap", F.abs(F.col("mean_p") - F.col("observed")))


def calibration_errors(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ece, mce): mean gap weighted by rows, and the largest gap."""
    return table.groupBy(*by).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def deltas(table: DataFrame, model: str, baseline: str, names: list[str], keys: tuple[str, ...] = ("fold_name", "subset_name")) -> DataFrame:
    """Metric differences model - baseline for every key that both have."""
    a = table.where(F.col("model_name") == model).select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    b = table.where(F.col("model_name") == baseline).select(*keys, *names)
    return a.join(b, list(keys)).select(*keys, F.lit(model).alias("model_name"), F.lit(baseline).alias("baseline_name"), *[(F.col(f"_{n}") - F.col(n)).alias(f"delta_{n}") for n in names])


def win_counts(fold_metrics: DataFrame, models: list[str], metric: str = "roc_auc") -> DataFrame:
    """Fold x model pivot of a metric with the best model of each fold (the first by name of equals)."""
    wide = fold_metrics.groupBy("fold_name").pivot("model_name", models).agg(F.first(metric))
    best = F.greatest(*models)
    winner = F.lit(None).cast("string")
    for m in reversed(models):
        winner = F.when(F.col(m) == best, F.lit(m)).otherwise(winner)
    return wide.withColumn("winner", winner)


def paired(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("dataset_row_id",), tolerance: float = 0.0) -> DataFrame:
    """Counts of a full join of two models' predictions: rows on one side only, unequal labels, unequal probabilities."""
    x = a.select(*keys, F.col("y_true").alias("_y"), F.col("p_up").alias("_p"))
    y = b.select(*keys, "y_true", "p_up")
    j = x.join(y, list(keys), "full_outer")
    return j.agg(
        F.count_if(F.col("_y").isNotNull() & F.col("y_true").isNotNull()).alias("both"), F.count_if(F.col("y_true").isNull()).alias("only_first"),
        F.count_if(F.col("_y").isNull()).alias("only_second"), F.count_if(F.col("_y") != F.col("y_true")).alias("label_conflicts"),
        F.count_if(F.abs(F.col("_p") - F.col("p_up")) > tolerance).alias("probability_differences"), F.max(F.abs(F.col("_p") - F.col("p_up"))).alias("max_difference"),
    )


def prediction_faults(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of counts that must all be 0: missing and foreign ids, repeated (model, id), probabilities out of range."""
    ids = expected.select("dataset_row_id").distinct()
    keyed = predictions.groupBy("model_name", "dataset_row_id").agg(F.count(F.lit(1)).alias("n"))
    # models are counted for each id, so that ids and models are never multiplied out
    models = predictions.agg(F.count_distinct("model_name").alias("_models"))
    have = keyed.groupBy("dataset_row_id").agg(F.count(F.lit(1)).alias("_have"))
    gaps = ids.join(have, "dataset_row_id", "left").crossJoin(F.broadcast(models))
    missing = gaps.agg(F.coalesce(F.sum(F.col("_models") - F.coalesce("_have", F.lit(0))), F.lit(0)).alias("missing_rows"))
    foreign = predictions.join(ids, "dataset_row_id", "left_anti").agg(F.count(F.lit(1)).alias("foreign_rows"))
    repeated = keyed.agg(F.count_if(F.col("n") > 1).alias("repeated_rows"))
    p = F.col("p_up")
    bad = predictions.agg(F.count_if(~X.finite(p) | (p < 0) | (p > 1)).alias("bad_probabilities"))
    return missing.crossJoin(foreign).crossJoin(repeated).crossJoin(bad)


def drift(test: DataFrame, development: DataFrame, names: list[str]) -> DataFrame:
    """Test minus out-of-fold metrics by model and subset."""
    keys = ["model_name", "subset_name"]
    a = test.select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    return a.join(development.select(*keys, *names), keys).select(*keys, *[(F.col(f"_{n}") - F.col(n)).alias(f"drift_{n}") for n in names])


def wide_to_long(wide: DataFrame, models: list[str], threshold: float = 0.5) -> DataFrame:
    """Columns p_up_<model> turned into rows (model_name, p_up, y_pred)."""
    columns = [f"p_up_{m}" for m in models]
    keys = [c for c in wide.columns if c not in columns]
    long = wide.unpivot(keys, columns, "model_name", "p_up").withColumn("model_name", F.substring("model_name", 6, 1000))
    return long.withColumn("y_pred", (F.col("p_up") >= threshold).cast("int"))


def stability(values: DataFrame, feature: str = "feature", value: str = "value", fold: str = "fold_name", top: int = 10) -> DataFrame:
    """Mean, deviation, sign agreement, median rank by size and top counts of a per-fold feature value."""
    order = Window.partitionBy(fold).orderBy(F.desc(F.abs(value)), feature)
    ranked = values.withColumn("_rank", F.row_number().over(order))
    positive = F.count_if(F.col(value) > 0)
    return ranked.groupBy(feature).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (F.greatest(positive, F.count_if(F.col(value) < 0)) / F.count(F.lit(1))).alias("sign_consistency"),
        F.median("_rank").alias("median_rank"), F.count_if(F.col("_rank") <= top).alias("top_count"),
    )
