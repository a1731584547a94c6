"""Rules that select candidates and calibrations, accept or fail models, and guard the one use of the final test."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import ValidationError


def rank_candidates(summary: DataFrame, band: float = 0.0005) -> DataFrame:
    """Candidates in order of preference: those within the band of the best AUC first, then by nine keys.

    summary: model_name, roc_auc, nonoverlap_auc, worst_fold_auc, offset_auc_range, fold_auc_std, log_loss, brier, complexity.
    """
    best = F.max("roc_auc").over(Window.partitionBy())
    tied = (best - F.col("roc_auc")) <= band
    keys = [
        F.desc("_tied"), F.when(F.col("_tied"), F.lit(0.0)).otherwise(-F.col("roc_auc")), F.desc("nonoverlap_auc"), F.desc("worst_fold_auc"), F.asc("offset_auc_range"),
        F.asc("fold_auc_std"), F.asc("log_loss"), F.asc("brier"), F.asc("complexity"), F.asc("model_name"),
    ]
    return summary.withColumn("_tied", tied).withColumn("rank", F.row_number().over(Window.orderBy(*keys))).withColumnRenamed("_tied", "in_auc_band")


def qualify(summary: DataFrame, limits: dict[str, float]) -> DataFrame:
    """summary with the reasons for which a candidate does not qualify; limits: least and greatest values by metric."""
    tests = []
    for name, limit in sorted(limits.items()):
        kind, metric = name.split("_", 1)
        value = F.col(metric)
        ok = value >= limit if kind == "min" else value <= limit
        tests.append((~F.coalesce(ok, F.lit(False)), name.upper()))
    out = summary.withColumn("failures", X.reasons(tests))
    return out.withColumn("qualified", F.col("failures") == "")


def material_gain(comparison: DataFrame, auc_gain: float, loss_gain: float, folds_won: int) -> DataFrame:
    """comparison (model_name, delta_roc_auc, delta_log_loss, winning_folds) with conditions A (AUC) and B (loss)."""
    a = (F.col("delta_roc_auc") >= auc_gain) & (F.col("winning_folds") >= folds_won)
    b = (F.col("delta_log_loss") <= -loss_gain) & (F.col("delta_roc_auc") >= 0)
    return comparison.withColumns({"condition_a": a, "condition_b": b, "is_material": X.any_of([a, b])})


def recommendation(stats: DataFrame, min_auc_gain: float, min_folds: int) -> DataFrame:
    """stats (auc_gain, nonoverlap_gain, winning_folds, gates_passed) with one of three outcomes."""
    good = X.all_of([F.col("gates_passed"), F.col("auc_gain") >= min_auc_gain, F.col("nonoverlap_gain") > 0, F.col("winning_folds") >= min_folds])
    none = X.any_of([~F.col("gates_passed"), F.col("auc_gain") <= 0])
    return stats.withColumn("recommendation", F.when(none, "KEEP_BASELINE").when(good, "PROCEED_TO_TUNING").otherwise("INCONCLUSIVE"))


def select_calibration(pooled: DataFrame, wins: DataFrame, tolerance: float = 2e-4, gain: float = 1e-4, years: int = 3) -> DataFrame:
    """The calibration methods ranked, with the selected one.

    pooled: method, log_loss, brier, ece, complexity. Methods within the tolerance of the least log loss come first, then
    by Brier score, ECE, complexity and name. The first is selected if it is not materially better than
    UNCALIBRATED only when it is UNCALIBRATED itself: wins (method, winning_years) and the gain decide.
    """
    least = F.min("log_loss").over(Window.partitionBy())
    near = F.col("log_loss") - least <= tolerance
    order = Window.orderBy(F.desc("_near"), F.when(F.col("_near"), F.lit(0.0)).otherwise(F.col("log_loss")), "brier", "ece", "complexity", "method")
    raw = F.max(F.when(F.col("method") == "UNCALIBRATED", F.col("log_loss"))).over(Window.partitionBy())
    ranked = pooled.join(wins, "method", "left").withColumn("_near", near)
    ranked = ranked.withColumns({"rank": F.row_number().over(order), "log_loss_gain": raw - F.col("log_loss")})
    material = (F.col("method") == "UNCALIBRATED") | ((F.col("log_loss_gain") >= gain) & (F.coalesce("winning_years", F.lit(0)) >= years))
    first = F.max(F.when((F.col("rank") == 1) & material, F.col("method"))).over(Window.partitionBy())
    return ranked.withColumn("selected", F.col("method") == F.coalesce(first, F.lit("UNCALIBRATED"))).drop("_near")


def assess_final(row: DataFrame, strong: float = 0.53, weak: float = 0.5) -> DataFrame:
    """row (auc, nonoverlap_auc, baseline_auc, all_gates_passed) with READY_FOR_RESEARCH_DEPLOYMENT, WEAK or FAILED_FINAL_VALIDATION."""
    failed = X.any_of([~F.col("all_gates_passed"), F.col("auc") <= weak, F.col("nonoverlap_auc") <= weak])
    ready = X.all_of([F.col("auc") >= strong, F.col("nonoverlap_auc") >= strong, F.col("auc") > F.col("baseline_auc")])
    return row.withColumn("assessment", F.when(failed, "FAILED_FINAL_VALIDATION").when(ready, "READY_FOR_RESEARCH_DEPLOYMENT").otherwise("WEAK_BUT_VALID"))


def engineering_gates(checks: dict[str, bool]) -> dict[str, bool]:
    """The checks with all_passed, their conjunction."""
    return checks | {"all_passed": all(checks.values())}


def best_and_worst(table: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """(by, best, worst) names by a value, ties by name."""
    return table.groupBy(*by).agg(
        F.max_by(name, F.struct(F.col(value), F.col(name))).alias("best"), F.min_by(name, F.struct(F.col(value), F.col(name))).alias("worst"),
        (F.max(value) - F.min(value)).alias("range"),
    )


@dataclass
class OneShotTest:
    """The order that a final test must keep: select, freeze, fit, save, lock; then the test rows are read once.

    Every step is recorded; one out of order, a second reading, or inputs that changed since the lock raise.
    """

    steps: list[str] = field(default_factory=list)
    hashes: dict[str, str] = field(default_factory=dict)
    lock: str = ""
    ORDER = ("calibration_selected", "configuration_frozen", "final_model_fitted", "model_saved", "protocol_locked", "test_read", "evaluated")

    def done(self, step: str) -> None:
        if len(self.steps) >= len(self.ORDER) or step != self.ORDER[len(self.steps)]:
            raise ValidationError([f"step {step} out of order after {self.steps}"])
        self.steps.append(step)

    def lock_with(self, payload: str, hashes: dict[str, str]) -> str:
        self.done("protocol_locked")
        self.hashes = dict(hashes)
        self.lock = hashlib.sha256((payload + repr(sorted(hashes.items()))).encode()).hexdigest()
        return self.lock

    def read_test(self, rows: DataFrame, hashes: dict[str, str]) -> DataFrame:
        if hashes != self.hashes:
            raise ValidationError([f"input {k} changed after the lock" for k in set(hashes) | set(self.hashes) if hashes.get(k) != self.hashes.get(k)])
        self.done("test_read")
        return rows

