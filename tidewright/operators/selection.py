"""Selection on real predictions: keys of tuned candidates, calibration methods by year, and the assessment of the final test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M

#: Less is simpler; decides between methods that are equal in all else.
COMPLEXITY = {"UNCALIBRATED": 0, "PLATT": 1, "ISOTONIC": 2}
NONOVERLAP = "NONOVERLAP_OFFSET_00"


def pooled(predictions: DataFrame, by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Metric rows of the 19 subsets over the rows of all folds together."""
    return M.subset_metrics(predictions, by)


def candidate_keys(predictions: DataFrame, complexity: dict[str, int]) -> DataFrame:
    """One row a candidate with the keys that gates.rank_candidates takes.

    AUC, log loss and Brier score are of all folds' rows pooled, the non-overlapping AUC of those at offset 0, the
    offset range lies between the pooled AUCs of the best and the worst offset, and the worst AUC and the deviation are
    over the folds.
    """
    whole = pooled(predictions)
    offset = F.col("subset_name").startswith("OFFSET_")
    dense, apart = F.col("subset_name") == "DENSE", F.col("subset_name") == NONOVERLAP
    one = lambda test, c: F.max(F.when(test, F.col(c)))
    keys = whole.groupBy("model_name").agg(
        one(dense, "roc_auc").alias("roc_auc"), one(apart, "roc_auc").alias("nonoverlap_auc"), one(dense, "log_loss").alias("log_loss"), one(dense, "brier").alias("brier"),
        (one(offset, "roc_auc") - F.min(F.when(offset, F.col("roc_auc")))).alias("offset_auc_range"), F.avg(F.when(offset, F.col("roc_auc"))).alias("offset_macro_auc"),
    )
    folds = M.metrics(predictions, ["model_name", "fold_name"]).groupBy("model_name").agg(
        F.min("roc_auc").alias("worst_fold_auc"), F.coalesce(F.stddev_samp("roc_auc"), F.lit(0.0)).alias("fold_auc_std"), F.count_if(F.col("roc_auc") >= 0.5).alias("folds_above_half")
    )
    size = F.create_map(*[x for n, k in complexity.items() for x in (F.lit(n), F.lit(k))])
    return keys.join(folds, "model_name").withColumn("complexity", size[F.col("model_name")])


def gains_over(predictions: DataFrame, reference: str) -> DataFrame:
    """(model_name, delta_roc_auc, delta_log_loss, nonoverlap_gain, winning_folds) of every other model against the reference."""
    def against(table: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
        base = table.where(F.col("model_name") == reference).select(*keys, *[F.col(c).alias(f"_{c}") for c in names])
        mine = table.where(F.col("model_name") != reference)
        j = mine.join(base, keys) if keys else mine.crossJoin(F.broadcast(base))
        return j.select("model_name", *keys, *[(F.col(c) - F.col(f"_{c}")).alias(n) for c, n in names.items()])

    whole = pooled(predictions)
    dense = against(whole.where("subset_name = 'DENSE'"), [], {"roc_auc": "delta_roc_auc", "log_loss": "delta_log_loss"})
    apart = against(whole.where(F.col("subset_name") == NONOVERLAP), [], {"roc_auc": "nonoverlap_gain"})
    folds = against(M.metrics(predictions, ["model_name", "fold_name"]), ["fold_name"], {"roc_auc": "gain"})
    wins = folds.groupBy("model_name").agg(F.count_if(F.col("gain") > 0).alias("winning_folds"))
    return dense.join(apart, "model_name", "left").join(wins, "model_name", "left")


def calibration_metrics(forward: DataFrame, bins: int = 10) -> DataFrame:
    """Metrics with both calibration errors by (method, calibration_fold, subset_name), the folds together as POOLED.

    forward: models.forward_calibrated. Subsets are DENSE and the non-overlapping rows.
    """
    folds = F.explode(F.array(F.col("calibration_fold"), F.lit("POOLED")))
    sets = F.explode(F.array_compact(F.array(F.lit("DENSE"), F.when(F.col("is_primary_nonoverlap_evaluation"), F.lit(NONOVERLAP)))))
    rows = forward.withColumn("calibration_fold", folds).withColumn("subset_name", sets)
    by = ["method", "calibration_fold", "subset_name"]
    out = M.metrics(rows, by)
    for strategy in ("equal_width", "equal_frequency"):
        binned = M.with_bins(rows, bins, strategy, by=tuple(by))
        errors = M.calibration_errors(M.calibration_table(binned, tuple(by)), tuple(by))
        out = out.join(errors.withColumnsRenamed({"ece": f"ece_{strategy}", "mce": f"mce_{strategy}"}), by, "left")
    return out


def choose_calibration(
    table: DataFrame, tolerance: float = 2e-4, loss_gain: float = 2e-4, brier_gain: float = 1e-4, loss_slack: float = 1e-4, years: int = 3
) -> DataFrame:
    """The methods of calibration_metrics ranked, with primary (the first) and selected.

    Non-overlapping rows count: methods within the tolerance of the least pooled log loss come first, in the order of Brier
    score, dense log loss, equal-frequency ECE, worst year's log loss and complexity. The first is selected if it is
    UNCALIBRATED or materially better: (A) less log loss by the gain, no more on all rows, and better in enough years; or (B) a
    lower Brier score by the gain, hardly more log loss, and a better Brier score in enough years.
    """
    at = lambda fold, subset: (F.col("calibration_fold") == fold) & (F.col("subset_name") == subset)
    one = lambda test, c: F.max(F.when(test, F.col(c)))
    year = (F.col("calibration_fold") != "POOLED") & (F.col("subset_name") == NONOVERLAP)
    rows = table.groupBy("method").agg(
        one(at("POOLED", NONOVERLAP), "log_loss").alias("log_loss"), one(at("POOLED", NONOVERLAP), "brier").alias("brier"), one(at("POOLED", "DENSE"), "log_loss").alias("dense_log_loss"),
        one(at("POOLED", NONOVERLAP), "ece_equal_frequency").alias("ece"), one(year, "log_loss").alias("worst_log_loss"),
    )
    rank_of = F.create_map(*[x for n, k in COMPLEXITY.items() for x in (F.lit(n), F.lit(k))])
    rows = rows.withColumn("complexity", rank_of[F.col("method")])
    # the raw row of a year stands beside the others in a window: a join would compute the table twice, and with sums in another order
    # a method could win against its own numbers
    raw, one_year = F.col("method") == "UNCALIBRATED", Window.partitionBy("calibration_fold")
    won = lambda c: F.count_if(F.col(c) < F.col(f"raw_{c}")).alias
    years_of = table.where(year).withColumns({f"raw_{c}": F.max(F.when(raw, F.col(c))).over(one_year) for c in ("log_loss", "brier")})
    years_of = years_of.withColumn("has_raw", F.max(raw).over(one_year)).where("has_raw")
    wins = years_of.groupBy("method").agg(won("log_loss")("loss_wins"), won("brier")("brier_wins"))
    whole = Window.partitionBy()
    rows = rows.join(wins, "method", "left").withColumn("near", F.col("log_loss") - F.min("log_loss").over(whole) <= tolerance)
    order = [F.desc("near"), F.when(F.col("near"), F.lit(0.0)).otherwise(F.col("log_loss")), "brier", "dense_log_loss", "ece", "worst_log_loss", "complexity"]
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    base = lambda c: F.max(F.when(F.col("method") == "UNCALIBRATED", F.col(c))).over(whole)
    a = (F.col("log_loss") <= base("log_loss") - loss_gain) & (F.col("dense_log_loss") <= base("dense_log_loss")) & (F.col("loss_wins") >= years)
    b = (F.col("brier") <= base("brier") - brier_gain) & (F.col("log_loss") <= base("log_loss") + loss_slack) & (F.col("brier_wins") >= years)
    rows = rows.withColumns({"condition_a": F.coalesce(a, F.lit(False)), "condition_b": F.coalesce(b, F.lit(False))})
    good = (F.col("rank") == 1) & ((F.col("method") == "UNCALIBRATED") | F.col("condition_a") | F.col("condition_b"))
    first = F.max(F.when(good, F.col("method"))).over(whole)
    return rows.withColumn("selected", F.col("method") == F.coalesce(first, F.lit("UNCALIBRATED"))).withColumn("primary", F.col("rank") == 1)


def against_development(test: DataFrame, development: DataFrame, test_model: str, development_model: str) -> DataFrame:
    """Test minus out-of-fold metrics of the dense and the non-overlapping rows: (subset_name, delta_…)."""
    names = ["roc_auc", "log_loss", "brier", "mcc"]
    pick = lambda t, m: t.where((F.col("model_name") == m) & F.col("subset_name").isin("DENSE", NONOVERLAP))
    a = pick(test, test_model).select("subset_name", *[F.col(n).alias(f"_{n}") for n in names])
    return a.join(pick(development, development_model).select("subset_name", *names), "subset_name").select("subset_name", *[(F.col(f"_{n}") - F.col(n)).alias(f"delta_{n}") for n in names])


def assess_test(table: DataFrame, model: str, logistic: str, prior: str, gates_passed: bool, floor: float = 0.49, slack: float = 0.001) -> DataFrame:
    """(assessment) from subset metrics of the final test.

    FAILED_FINAL_VALIDATION if a gate failed or an AUC does not exceed the floor; READY_FOR_RESEARCH_DEPLOYMENT if both AUCs
    exceed one half, the non-overlapping one the logistic baseline's, and its log loss the prior's by no more than the
    slack; else WEAK_SIGNAL_RESEARCH_ONLY.
    """
    one = lambda m, s, c: F.max(F.when((F.col("model_name") == m) & (F.col("subset_name") == s), F.col(c)))
    row = table.agg(
        one(model, "DENSE", "roc_auc").alias("dense"), one(model, NONOVERLAP, "roc_auc").alias("apart"), one(model, NONOVERLAP, "log_loss").alias("loss"),
        one(logistic, NONOVERLAP, "roc_auc").alias("logistic"), one(prior, NONOVERLAP, "log_loss").alias("prior"),
    )
    failed = F.lit(not gates_passed) | (F.col("dense") <= floor) | (F.col("apart") <= floor)
    ready = (F.col("dense") > 0.5) & (F.col("apart") > 0.5) & (F.col("apart") > F.col("logistic")) & (F.col("loss") <= F.col("prior") + slack)
    said = F.when(failed, "FAILED_FINAL_VALIDATION").when(F.coalesce(ready, F.lit(False)), "READY_FOR_RESEARCH_DEPLOYMENT").otherwise("WEAK_SIGNAL_RESEARCH_ONLY")
    return row.withColumn("assessment", said)
