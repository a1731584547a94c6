"""The training dataset: features joined to labels, row ids, purged time splits, and their summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .labels import distribution
from .ordered import row_numbers


@dataclass(frozen=True)
class Fold:
    """A validation range [start, end) in epoch milliseconds."""

    name: str
    start: int
    end: int


def join_audit(features: DataFrame, labels: DataFrame, names: list[str], interval: int, horizon: int) -> DataFrame:
    """Every row of either table, joined in full on decision_time, with the checks and the reasons of exclusion."""
    f = features.select(
        "decision_time", F.col("feature_open_time").alias("f_open"), F.col("continuity_segment_id").alias("f_segment"), F.col("is_model_candidate").alias("f_candidate"),
        "is_final_feature_candidate", "has_nonfinite_feature", "feature_missing_count", X.all_of([X.finite(n) for n in names]).alias("features_all_finite"), F.lit(True).alias("_f"),
    )
    y = labels.select(
        "decision_time", F.col("open_time").alias("l_open"), F.col("continuity_segment_id").alias("l_segment"), "entry_minute_open_time", "settlement_minute_open_time",
        "label_up_60m", "future_simple_return_60m", "abs_future_return_bps_60m", "margin_sample_weight", "is_valid_proxy_label", "is_final_model_label_candidate", F.lit(True).alias("_l"),
    )
    j = f.join(y, "decision_time", "full_outer")
    ef, el = F.col("_f").isNotNull(), F.col("_l").isNotNull()
    no = F.lit(False)
    time_ok = X.all_of([
        F.col("f_open") == F.col("decision_time") - interval, F.col("entry_minute_open_time") == F.col("decision_time"),
        F.col("settlement_minute_open_time") == F.col("decision_time") + horizon,
    ])
    segment_ok = F.coalesce(F.col("f_segment") == F.col("l_segment"), no)
    fc, lc = F.coalesce("is_final_feature_candidate", no), F.coalesce("is_final_model_label_candidate", no)
    fin = F.coalesce("features_all_finite", no)
    target = F.col("label_up_60m").isNotNull()
    final = X.all_of([ef, el, fc, lc, fin, F.col("label_up_60m").isin(0, 1), time_ok, segment_ok])
    why = X.reasons([
        (~ef, "FEATURE_ROW_MISSING"), (~el, "LABEL_ROW_MISSING"), (ef & ~F.coalesce("f_candidate", no), "NOT_MODEL_CANDIDATE"), (ef & ~fc, "INCOMPLETE_FEATURES"),
        (el & ~lc, "INVALID_LABEL"), (ef & el & ~segment_ok, "SEGMENT_MISMATCH"), (ef & el & ~time_ok, "TIME_RELATION_ERROR"),
        (ef & (F.coalesce("has_nonfinite_feature", no) | ~fin), "NONFINITE_FEATURE"), (el & ~target, "MISSING_TARGET"), (el & ~F.coalesce("is_valid_proxy_label", no), "INVALID_LABEL"),
    ])
    return j.withColumns({
        "exists_in_feature_table": ef, "exists_in_label_table": el, "final_intersection_candidate": final, "time_relation_ok": time_ok,
        "continuity_segment_id_match": segment_ok, "label_up_60m_present": target, "exclusion_reason": why,
        "feature_open_time": F.coalesce("f_open", "l_open"), "continuity_segment_id": F.coalesce("f_segment", "l_segment"),
    }).drop("_f", "_l", "f_open", "l_open", "f_segment", "l_segment", "f_candidate")


def dataset(audit: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """The rows that pass the audit, numbered from 0 in time order, with their features, target and margins."""
    kept = audit.where("final_intersection_candidate").select(
        "decision_time", "continuity_segment_id", "entry_minute_open_time", "settlement_minute_open_time", "label_up_60m", "future_simple_return_60m",
        "abs_future_return_bps_60m", F.col("margin_sample_weight").cast("float").alias("margin_sample_weight"),
    )
    rows = kept.join(features.select("decision_time", *names), "decision_time")
    return row_numbers(rows, "decision_time", [], "dataset_row_id")


def split_role(test_start: int) -> Column:
    d, s = F.col("decision_time"), F.col("settlement_minute_open_time")
    return F.when(d >= test_start, "FINAL_TEST").when(s >= test_start, "PURGED_BEFORE_FINAL_TEST").otherwise("DEVELOPMENT")


def fold_role(fold: Fold) -> Column:
    """TRAIN before the validation range, VALIDATION in it, purged where the settlement crosses a border."""
    d, s = F.col("decision_time"), F.col("settlement_minute_open_time")
    return (
        F.when(F.col("final_split_role") != "DEVELOPMENT", "FINAL_TEST_EXCLUDED")
        .when((d < fold.start) & (s < fold.start), "TRAIN")
        .when(d < fold.start, "PURGED_BEFORE_VALIDATION")
        .when((d < fold.end) & (s < fold.end), "VALIDATION")
        .when(d < fold.end, "PURGED_AT_VALIDATION_END")
        .otherwise("OUTSIDE_FOLD")
    )


def splits(data: DataFrame, test_start: int, folds: list[Fold], interval: int = 60_000, horizon: int = 3_600_000, offset: int = 0) -> DataFrame:
    out = data.select("dataset_row_id", "decision_time", "settlement_minute_open_time").withColumn("final_split_role", split_role(test_start))
    out = out.withColumns({f"{f.name}_role": fold_role(f) for f in folds})
    at = F.expr(f"(decision_time % {horizon}) div {interval}").cast("int")
    return out.withColumns({"evaluation_offset_minutes": at, "is_primary_nonoverlap_evaluation": at == offset})


def joined(data: DataFrame, split: DataFrame) -> DataFrame:
    return data.join(split, ["dataset_row_id", "decision_time", "settlement_minute_open_time"])


def long_roles(split: DataFrame, folds: list[Fold]) -> DataFrame:
    """(…, fold_name, role), a row for each fold."""
    names = [f"{f.name}_role" for f in folds]
    keys = [c for c in split.columns if c not in names]
    return split.unpivot(keys, names, "fold_name", "role").withColumn("fold_name", F.regexp_replace("fold_name", "_role$", ""))


def fold_manifest(data: DataFrame, split: DataFrame, folds: list[Fold]) -> DataFrame:
    rows = long_roles(joined(data, split), folds)
    role = F.col("role")
    def when(r: str, c: Column) -> Column:
        return F.when(role == r, c)
    d, y = F.col("decision_time"), F.col("label_up_60m").cast("double")
    return rows.groupBy("fold_name").agg(
        F.count_if(role == "TRAIN").alias("train_rows"), F.count_if(role == "VALIDATION").alias("validation_rows"),
        F.count_if(role.startswith("PURGED")).alias("purged_rows"), F.min(when("TRAIN", d)).alias("train_start"), F.max(when("TRAIN", d)).alias("train_end"),
        F.min(when("VALIDATION", d)).alias("validation_start"), F.max(when("VALIDATION", d)).alias("validation_end"),
        F.avg(when("TRAIN", y)).alias("train_up_ratio"), F.avg(when("VALIDATION", y)).alias("validation_up_ratio"),
    )


def split_summary(data: DataFrame, split: DataFrame, folds: list[Fold]) -> DataFrame:
    """Return moments of every named subset: the whole, split roles, fold roles, and the non-overlapping rows."""
    j = joined(data, split)
    names = [F.lit("ALL"), F.col("final_split_role"), F.when(F.col("is_primary_nonoverlap_evaluation"), F.lit("NONOVERLAP"))]
    names += [F.concat(F.lit(f"{f.name}:"), F.col(f"{f.name}_role")) for f in folds]
    rows = j.withColumn("subset_name", F.explode(F.array_compact(F.array(*names))))
    parts = distribution(F.col("future_simple_return_60m"), (0.05, 0.5, 0.95))
    return rows.groupBy("subset_name").agg(F.avg(F.col("label_up_60m").cast("double")).alias("up_ratio"), *[c.alias(n) for n, c in parts.items()])


def time_distribution(data: DataFrame, split: DataFrame, part: str) -> DataFrame:
    period = X.calendar(F.col("decision_time"))[part].cast("string")
    return joined(data, split).groupBy("final_split_role", period.alias("period")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("label_up_60m").cast("double")).alias("up_ratio"), F.avg("abs_future_return_bps_60m").alias("mean_abs_bps")
    )


def exclusion_histogram(audit: DataFrame) -> DataFrame:
    """Rows per reason; a row counts once for each of its reasons."""
    return audit.where("exclusion_reason <> ''").select(F.explode(F.split("exclusion_reason", ";")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def excluded_samples(audit: DataFrame, n: int = 200) -> DataFrame:
    return audit.where("NOT final_intersection_candidate").orderBy("decision_time").limit(n).select("decision_time", "continuity_segment_id", "exclusion_reason")


def inner_split(train: DataFrame, validation_start: int, window: int) -> DataFrame:
    """Training rows with inner_role: EARLY_STOP in the window before the validation range, INNER_TRAIN before it, PURGED where the settlement crosses."""
    start = validation_start - window
    d, s = F.col("decision_time"), F.col("settlement_minute_open_time")
    return train.withColumn("inner_role", F.when(d >= start, "EARLY_STOP").when(s < start, "INNER_TRAIN").otherwise("INNER_PURGED"))


def fold_errors(data: DataFrame, split: DataFrame, fold: Fold) -> list[str]:
    """What breaks the fold's rules: shared rows, leaking settlements, rows out of range, missing classes. One pass."""
    role = F.col(f"{fold.name}_role")
    train, validation = role == "TRAIN", role == "VALIDATION"
    d, s, y = F.col("decision_time"), F.col("settlement_minute_open_time"), F.col("label_up_60m")
    checks = {
        "training settlement reaches the validation range": F.count_if(train & (s >= fold.start)),
        "validation row out of range": F.count_if(validation & ((d < fold.start) | (d >= fold.end) | (s >= fold.end))),
        "final test row in fold": F.count_if((train | validation) & (F.col("final_split_role") != "DEVELOPMENT")),
        "empty training set": F.when(F.count_if(train) == 0, 1).otherwise(0),
        "empty validation set": F.when(F.count_if(validation) == 0, 1).otherwise(0),
        "training set of one class": F.when(F.count_distinct(F.when(train, y)) < 2, 1).otherwise(0),
    }
    row = joined(data, split).agg(*[c.alias(n) for n, c in checks.items()]).first().asDict()
    return [f"{fold.name}: {n} ({k})" for n, k in row.items() if k]
