"""Queries of the metric, comparison, selection and estimator operators over labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import gates as G
from ..operators import metrics as M
from ..operators import models as E
from ..sources import adapt as A
from .registry import chain, query

ROWS = """y AS (SELECT doc_id AS dataset_row_id, quality AS y_true, doc_id * 300000 AS decision_time, 'fold_' || CAST(doc_id % 5 AS VARCHAR) AS fold_name,
  (doc_id * 37 % 300) / 10 AS abs_future_return_bps_60m, CAST(doc_id % 12 * 5 AS INTEGER) AS evaluation_offset_minutes, doc_id % 12 = 0 AS is_primary_nonoverlap_evaluation FROM labels),
rows AS (SELECT y.*, model_name, ((dataset_row_id * k + 300 * y_true) % 1000) / 1000 AS p_up, CAST(((dataset_row_id * k + 300 * y_true) % 1000) / 1000 >= 0.5 AS INTEGER) AS y_pred
  FROM y, (VALUES ('logistic', 7919), ('momentum', 104729), ('trees', 15485863)) m(model_name, k))"""

COUNTED = """count(*) AS sample_count, count_if(y_true = 1) AS positive_count, count_if(y_true = 0) AS negative_count, avg(y_true) AS positive_ratio, avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy,
  count_if(y_true = 0 AND y_pred = 0) AS tn, count_if(y_true = 0 AND y_pred = 1) AS fp, count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 1 AND y_pred = 1) AS tp, avg(p_up) AS mean_p, avg(y_pred) AS predicted_positive_ratio,
  -avg(CASE WHEN y_true = 1 THEN ln(greatest(least(p_up, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) ELSE ln(1 - greatest(least(p_up, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) END) AS log_loss,
  avg(pow(p_up - y_true, 2)) AS brier"""
DERIVED = """tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tn / nullif(tn + fp, 0) AS specificity, tn / nullif(tn + fn, 0) AS npv,
  (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy,
  coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc"""
DOUBLES = "positive_ratio accuracy mean_p predicted_positive_ratio log_loss brier precision recall f1 specificity npv balanced_accuracy mcc"


def metric_sql(rows: str, by: str) -> str:
    """Metric rows by mean ranks and by descending ranks, which is not how the operator counts them."""
    keys = " AND ".join(f"c.{k.strip()} = r.{k.strip()}" for k in by.split(","))
    return f"""counted AS (SELECT {by}, {COUNTED} FROM {rows} GROUP BY {by}),
ranked AS (SELECT {by}, y_true, p_up, rank() OVER (PARTITION BY {by} ORDER BY p_up) + (count(*) OVER (PARTITION BY {by}, p_up) - 1) / 2 AS rk,
  count(*) OVER (PARTITION BY {by} ORDER BY p_up DESC) AS k, sum(y_true) OVER (PARTITION BY {by} ORDER BY p_up DESC) AS hit FROM {rows}),
curve AS (SELECT {by}, (sum(rk) FILTER (WHERE y_true = 1) - count_if(y_true = 1) * (count_if(y_true = 1) + 1) / 2) / nullif(CAST(count_if(y_true = 1) AS DOUBLE) * count_if(y_true = 0), 0) AS roc_auc,
  sum(hit / k) FILTER (WHERE y_true = 1) / nullif(count_if(y_true = 1), 0) AS average_precision FROM ranked GROUP BY {by}),
scored AS (SELECT c.*, {DERIVED}, r.roc_auc, r.average_precision, r.average_precision / nullif(c.positive_ratio, 0) AS ap_lift FROM counted c JOIN curve r ON {keys})"""


ALL = ", ".join(M.METRICS)
ALL_DOUBLES = DOUBLES + " roc_auc average_precision ap_lift"
SUBSETS = "subs AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS subset_name, * FROM rows WHERE {w}"
    for n, w in [
        ("DENSE", "true"), ("NONOVERLAP_OFFSET_00", "is_primary_nonoverlap_evaluation"), *[(f"OFFSET_{k:02d}", f"evaluation_offset_minutes = {k}") for k in range(0, 60, 5)],
        ("ALL_MARGINS", "true"), *[(f"ABS_RETURN_GE_{X.risk_suffix(t)}BPS", f"abs_future_return_bps_60m >= {t}") for t in M.MARGINS],
    ]
) + ")"


@query("m01_m08_metrics", chain(ROWS, metric_sql("rows", "model_name"), then=f"SELECT model_name, {ALL} FROM scored"), ALL_DOUBLES)
def m01(spark, sf):
    return M.metrics(A.model_rows(spark, sf), ["model_name"]).drop("auc_reason")


@query("p30_subsets", chain(ROWS, SUBSETS, then="SELECT subset_name, count(*) AS n FROM subs GROUP BY 1"))
def p30(spark, sf):
    return M.with_subsets(A.model_rows(spark, sf)).groupBy("subset_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m09_m10_subset_metrics",
    chain(
        ROWS, SUBSETS, metric_sql("subs", "model_name, fold_name, subset_name"),
        "dim AS (SELECT DISTINCT model_name, fold_name FROM rows)", "names AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in M.subset_names()) + "]) AS subset_name)",
        then="SELECT d.model_name, d.fold_name, n.subset_name, coalesce(s.sample_count, 0) AS sample_count, s.accuracy, s.roc_auc, s.average_precision, s.log_loss, CASE WHEN s.sample_count IS NULL THEN 'empty_subset' WHEN s.roc_auc IS NULL THEN 'single_class_validation_subset' END AS auc_reason FROM dim d CROSS JOIN names n LEFT JOIN scored s ON s.model_name = d.model_name AND s.fold_name = d.fold_name AND s.subset_name = n.subset_name",
    ),
    "accuracy roc_auc average_precision log_loss",
)
def m10(spark, sf):
    return M.subset_metrics(A.model_rows(spark, sf)).select("model_name", "fold_name", "subset_name", "sample_count", "accuracy", "roc_auc", "average_precision", "log_loss", "auc_reason")


BINS = "binned AS (SELECT *, least(CAST(floor(p_up * 10) AS INTEGER), 9) AS bin FROM rows)"


@query("m11_m13_reliability", chain(ROWS, BINS, then="SELECT model_name, bin, count(*) AS n, avg(p_up) AS mean_p, avg(y_true) AS observed, min(p_up) AS min_p, max(p_up) AS max_p, abs(avg(p_up) - avg(y_true)) AS gap FROM binned GROUP BY 1, 2"), "mean_p observed min_p max_p gap")
def m11(spark, sf):
    return M.calibration_table(M.with_bins(A.model_rows(spark, sf), 10), ("model_name",))


@query("m13_ece_mce", chain(ROWS, BINS, "t AS (SELECT model_name, bin, count(*) AS n, abs(avg(p_up) - avg(y_true)) AS gap FROM binned GROUP BY 1, 2)", then="SELECT model_name, sum(gap * n) / sum(n) AS ece, max(gap) AS mce FROM t GROUP BY 1"), "ece mce")
def m13(spark, sf):
    return M.calibration_errors(M.calibration_table(M.with_bins(A.model_rows(spark, sf), 10), ("model_name",)), ("model_name",))


FREQUENT = "binned AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY model_name ORDER BY p_up, dataset_row_id) - 1) * 7 / count(*) OVER (PARTITION BY model_name)) AS INTEGER) AS bin FROM rows)"


@query("m12_w16_equal_frequency", chain(ROWS, FREQUENT, then="SELECT model_name, bin, count(*) AS n, avg(p_up) AS mean_p, avg(y_true) AS observed FROM binned GROUP BY 1, 2"), "mean_p observed")
def m12(spark, sf):
    t = M.calibration_table(M.with_bins(A.model_rows(spark, sf), 7, "equal_frequency", by=("model_name",)), ("model_name",))
    return t.select("model_name", "bin", "n", "mean_p", "observed")


FOLDS = (ROWS, metric_sql("rows", "model_name, fold_name"))


def fold_metrics(spark, sf) -> DataFrame:
    return M.metrics(A.model_rows(spark, sf), ["model_name", "fold_name"])


@query("a33_fold_summary", chain(*FOLDS, "l AS (SELECT model_name, fold_name, unnest(['accuracy', 'roc_auc', 'log_loss']) AS metric, unnest([accuracy, roc_auc, log_loss]) AS v FROM scored)", "b AS (SELECT model_name, arg_max(fold_name, {'a': roc_auc, 'f': fold_name}) AS best_fold, arg_min(fold_name, {'a': roc_auc, 'f': fold_name}) AS worst_fold FROM scored GROUP BY 1)", then="SELECT model_name, metric, avg(v) AS macro_mean, stddev_samp(v) AS macro_std, any_value(best_fold) AS best_fold, any_value(worst_fold) AS worst_fold FROM l JOIN b USING (model_name) GROUP BY 1, 2"), "macro_mean macro_std")
def a33(spark, sf):
    return M.fold_summary(fold_metrics(spark, sf), ["accuracy", "roc_auc", "log_loss"], ("model_name",))


@query("a34_pivot_wins", chain(*FOLDS, "p AS (SELECT fold_name, max(roc_auc) FILTER (WHERE model_name = 'logistic') AS logistic, max(roc_auc) FILTER (WHERE model_name = 'momentum') AS momentum, max(roc_auc) FILTER (WHERE model_name = 'trees') AS trees FROM scored GROUP BY 1)", then="SELECT *, CASE WHEN logistic >= momentum AND logistic >= trees THEN 'logistic' WHEN momentum >= trees THEN 'momentum' ELSE 'trees' END AS winner FROM p"), "logistic momentum trees")
def a34(spark, sf):
    return M.win_counts(fold_metrics(spark, sf), ["logistic", "momentum", "trees"])


@query("j10_m14_paired_deltas", chain(*FOLDS, then="SELECT a.fold_name, 'trees' AS model_name, 'logistic' AS baseline_name, a.roc_auc - b.roc_auc AS delta_roc_auc, a.log_loss - b.log_loss AS delta_log_loss FROM scored a JOIN scored b USING (fold_name) WHERE a.model_name = 'trees' AND b.model_name = 'logistic'"), "delta_roc_auc delta_log_loss")
def m14(spark, sf):
    return M.deltas(fold_metrics(spark, sf), "trees", "logistic", ["roc_auc", "log_loss"], ("fold_name",))


@query("j10_paired_predictions", chain(ROWS, then="SELECT count(*) AS both, CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second, CAST(0 AS BIGINT) AS label_conflicts, count_if(a.p_up <> b.p_up) AS probability_differences, max(abs(a.p_up - b.p_up)) AS max_difference FROM rows a JOIN rows b USING (dataset_row_id) WHERE a.model_name = 'trees' AND b.model_name = 'logistic'"), "max_difference")
def j10(spark, sf):
    rows = A.model_rows(spark, sf)
    return M.paired(rows.where("model_name = 'trees'"), rows.where("model_name = 'logistic'"))


@query("m15_drift", chain(*FOLDS, then="SELECT a.model_name, 'DENSE' AS subset_name, a.roc_auc - b.roc_auc AS drift_roc_auc, a.brier - b.brier AS drift_brier FROM scored a JOIN scored b USING (model_name) WHERE a.fold_name = 'fold_4' AND b.fold_name = 'fold_0'"), "drift_roc_auc drift_brier")
def m15(spark, sf):
    f = fold_metrics(spark, sf).withColumn("subset_name", F.lit("DENSE"))
    return M.drift(f.where("fold_name = 'fold_4'"), f.where("fold_name = 'fold_0'"), ["roc_auc", "brier"])


@query("m16_j11_metric_table", chain(ROWS, metric_sql("rows", "model_name"), BINS, "t AS (SELECT model_name, bin, count(*) AS n, abs(avg(p_up) - avg(y_true)) AS gap FROM binned GROUP BY 1, 2)", "e AS (SELECT model_name, sum(gap * n) / sum(n) AS ece, max(gap) AS mce FROM t GROUP BY 1)", then="SELECT s.model_name, s.roc_auc, s.brier, e.ece, e.mce FROM scored s LEFT JOIN e USING (model_name)"), "roc_auc brier ece mce")
def m16(spark, sf):
    rows = A.model_rows(spark, sf)
    errors = M.calibration_errors(M.calibration_table(M.with_bins(rows, 10), ("model_name",)), ("model_name",))
    return M.metrics(rows, ["model_name"]).join(errors, "model_name", "left").select("model_name", "roc_auc", "brier", "ece", "mce")


@query("p20_prediction_contract", chain(ROWS, then="SELECT CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS foreign_rows, CAST(0 AS BIGINT) AS repeated_rows, CAST(0 AS BIGINT) AS bad_probabilities"))
def p20(spark, sf):
    return M.prediction_faults(A.model_rows(spark, sf), A.table(spark, sf, "labels").withColumnRenamed("doc_id", "dataset_row_id"))


@query("u02_wide_to_long", chain(ROWS, then="SELECT dataset_row_id, model_name, p_up, y_pred FROM rows"), "p_up")
def u02(spark, sf):
    rows = A.model_rows(spark, sf)
    wide = rows.groupBy("dataset_row_id").pivot("model_name", ["logistic", "momentum", "trees"]).agg(F.first("p_up"))
    wide = wide.withColumnsRenamed({m: f"p_up_{m}" for m in ("logistic", "momentum", "trees")})
    return M.wide_to_long(wide, ["logistic", "momentum", "trees"])


VALUES = "vals AS (SELECT fold_name, 'f' || CAST(dataset_row_id % 17 AS VARCHAR) AS feature, sum(p_up - 0.5) AS value FROM rows WHERE model_name = 'trees' GROUP BY 1, 2)"
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY fold_name ORDER BY round(abs(value), 9) DESC, feature) AS rk FROM vals)"


def feature_values(spark, sf) -> DataFrame:
    rows = A.model_rows(spark, sf).where("model_name = 'trees'")
    return rows.groupBy("fold_name", F.concat(F.lit("f"), F.pmod("dataset_row_id", F.lit(17)).cast("string")).alias("feature")).agg(F.round(F.sum(F.col("p_up") - 0.5), 9).alias("value"))


@query("a35_a36_w15_stability", chain(ROWS, VALUES, RANKED, then="SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, greatest(count_if(round(value, 9) > 0), count_if(round(value, 9) < 0)) / count(*) AS sign_consistency, median(rk) AS median_rank, count_if(rk <= 5) AS top_count FROM r GROUP BY 1"), "mean std sign_consistency median_rank")
def a35(spark, sf):
    return M.stability(feature_values(spark, sf), top=5)


@query("o09_best_and_worst", chain(*FOLDS, then="SELECT model_name, arg_max(fold_name, {'v': accuracy, 'f': fold_name}) AS best, arg_min(fold_name, {'v': accuracy, 'f': fold_name}) AS worst, max(accuracy) - min(accuracy) AS range FROM scored GROUP BY 1"), "range")
def o09(spark, sf):
    return G.best_and_worst(fold_metrics(spark, sf), ["model_name"], "fold_name", "accuracy")


SUMMARY = """s AS (SELECT model_name, avg(roc_auc) AS roc_auc, max(roc_auc) AS nonoverlap_auc, min(roc_auc) AS worst_fold_auc, max(roc_auc) - min(roc_auc) AS offset_auc_range,
  stddev_samp(roc_auc) AS fold_auc_std, avg(log_loss) AS log_loss, avg(brier) AS brier, length(model_name) AS complexity FROM scored GROUP BY 1)"""


def candidate_summary(spark, sf) -> DataFrame:
    f = fold_metrics(spark, sf)
    return f.groupBy("model_name").agg(
        F.avg("roc_auc").alias("roc_auc"), F.max("roc_auc").alias("nonoverlap_auc"), F.min("roc_auc").alias("worst_fold_auc"), (F.max("roc_auc") - F.min("roc_auc")).alias("offset_auc_range"),
        F.stddev_samp("roc_auc").alias("fold_auc_std"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"),
    ).withColumn("complexity", F.length("model_name"))


@query("a37_candidate_summary", chain(*FOLDS, SUMMARY, then="SELECT model_name, roc_auc, worst_fold_auc, offset_auc_range, fold_auc_std, log_loss, brier FROM s"), "roc_auc worst_fold_auc offset_auc_range fold_auc_std log_loss brier")
def a37(spark, sf):
    return candidate_summary(spark, sf).select("model_name", "roc_auc", "worst_fold_auc", "offset_auc_range", "fold_auc_std", "log_loss", "brier")


@query("o08_rank_candidates", chain(*FOLDS, SUMMARY, "b AS (SELECT *, max(roc_auc) OVER () - roc_auc <= 0.02 AS tied FROM s)", then="SELECT model_name, tied AS in_auc_band, CAST(row_number() OVER (ORDER BY tied DESC, CASE WHEN tied THEN 0 ELSE -roc_auc END, nonoverlap_auc DESC, worst_fold_auc DESC, offset_auc_range, fold_auc_std, log_loss, brier, complexity, model_name) AS INTEGER) AS rank FROM b"))
def o08(spark, sf):
    return G.rank_candidates(candidate_summary(spark, sf), 0.02).select("model_name", "in_auc_band", "rank")


@query("g09_qualification", chain(*FOLDS, SUMMARY, then="SELECT model_name, concat_ws(';', CASE WHEN NOT log_loss <= 0.8 THEN 'MAX_LOG_LOSS' END, CASE WHEN NOT worst_fold_auc >= 0.55 THEN 'MIN_WORST_FOLD_AUC' END) AS failures, log_loss <= 0.8 AND worst_fold_auc >= 0.55 AS qualified FROM s"))
def g09(spark, sf):
    return G.qualify(candidate_summary(spark, sf), {"max_log_loss": 0.8, "min_worst_fold_auc": 0.55}).select("model_name", "failures", "qualified")


DELTA = "d AS (SELECT a.model_name, avg(a.roc_auc - b.roc_auc) AS delta_roc_auc, avg(a.log_loss - b.log_loss) AS delta_log_loss, count_if(a.roc_auc > b.roc_auc) AS winning_folds FROM scored a JOIN scored b USING (fold_name) WHERE b.model_name = 'logistic' GROUP BY 1)"


def delta_table(spark, sf) -> DataFrame:
    f = fold_metrics(spark, sf)
    base = f.where("model_name = 'logistic'").select("fold_name", F.col("roc_auc").alias("b_auc"), F.col("log_loss").alias("b_loss"))
    j = f.join(F.broadcast(base), "fold_name")
    return j.groupBy("model_name").agg(F.avg(F.col("roc_auc") - F.col("b_auc")).alias("delta_roc_auc"), F.avg(F.col("log_loss") - F.col("b_loss")).alias("delta_log_loss"), F.count_if(F.col("roc_auc") > F.col("b_auc")).alias("winning_folds"))


@query("g09_material_gain", chain(*FOLDS, DELTA, then="SELECT model_name, winning_folds, delta_roc_auc >= 0.005 AND winning_folds >= 3 AS condition_a, delta_log_loss <= -0.001 AND delta_roc_auc >= 0 AS condition_b, (delta_roc_auc >= 0.005 AND winning_folds >= 3) OR (delta_log_loss <= -0.001 AND delta_roc_auc >= 0) AS is_material FROM d"))
def g09_gain(spark, sf):
    return G.material_gain(delta_table(spark, sf), 0.005, 0.001, 3).select("model_name", "winning_folds", "condition_a", "condition_b", "is_material")


@query("g08_recommendation", chain(*FOLDS, DELTA, then="SELECT model_name, CASE WHEN delta_roc_auc <= 0 THEN 'KEEP_BASELINE' WHEN delta_roc_auc >= 0.002 AND winning_folds >= 3 THEN 'PROCEED_TO_TUNING' ELSE 'INCONCLUSIVE' END AS recommendation FROM d"))
def g08(spark, sf):
    stats = delta_table(spark, sf).withColumns({"auc_gain": F.col("delta_roc_auc"), "nonoverlap_gain": F.col("delta_roc_auc"), "gates_passed": F.lit(True)})
    return G.recommendation(stats, 0.002, 3).select("model_name", "recommendation")


CAL = """c AS (SELECT CASE model_name WHEN 'logistic' THEN 'UNCALIBRATED' WHEN 'momentum' THEN 'PLATT' ELSE 'ISOTONIC' END AS method, round(avg(log_loss), 9) AS log_loss, round(avg(brier), 9) AS brier, 0.0 AS ece, length(model_name) AS complexity FROM scored GROUP BY model_name),
w AS (SELECT CASE model_name WHEN 'logistic' THEN 'UNCALIBRATED' WHEN 'momentum' THEN 'PLATT' ELSE 'ISOTONIC' END AS method, winning_folds AS winning_years FROM d)"""


@query("g10_o10_calibration_selection", chain(*FOLDS, DELTA, CAL, "r AS (SELECT *, log_loss - min(log_loss) OVER () <= 0.02 AS near, max(log_loss) FILTER (WHERE method = 'UNCALIBRATED') OVER () - log_loss AS gain FROM c JOIN w USING (method))", "k AS (SELECT *, CAST(row_number() OVER (ORDER BY near DESC, CASE WHEN near THEN 0 ELSE log_loss END, brier, ece, complexity, method) AS INTEGER) AS rank FROM r)", "f AS (SELECT coalesce(max(method) FILTER (WHERE rank = 1 AND (method = 'UNCALIBRATED' OR (gain >= 0.0001 AND winning_years >= 3))), 'UNCALIBRATED') AS chosen FROM k)", then="SELECT method, rank, method = chosen AS selected FROM k, f"))
def g10(spark, sf):
    name = F.when(F.col("model_name") == "logistic", "UNCALIBRATED").when(F.col("model_name") == "momentum", "PLATT").otherwise("ISOTONIC")
    pooled = candidate_summary(spark, sf).select(name.alias("method"), F.round("log_loss", 9).alias("log_loss"), F.round("brier", 9).alias("brier"), F.lit(0.0).alias("ece"), "complexity")
    wins = delta_table(spark, sf).select(name.alias("method"), F.col("winning_folds").alias("winning_years"))
    return G.select_calibration(pooled, wins, tolerance=0.02).select("method", "rank", "selected")


@query("g11_final_assessment", chain(*FOLDS, SUMMARY, then="SELECT model_name, CASE WHEN roc_auc <= 0.5 OR worst_fold_auc <= 0.5 THEN 'FAILED_FINAL_VALIDATION' WHEN roc_auc >= 0.53 AND worst_fold_auc >= 0.53 AND roc_auc > 0.52 THEN 'READY_FOR_RESEARCH_DEPLOYMENT' ELSE 'WEAK_BUT_VALID' END AS assessment FROM s"))
def g11(spark, sf):
    row = candidate_summary(spark, sf).select("model_name", F.col("roc_auc").alias("auc"), F.col("worst_fold_auc").alias("nonoverlap_auc"), F.lit(0.52).alias("baseline_auc"), F.lit(True).alias("all_gates_passed"))
    return G.assess_final(row).select("model_name", "assessment")


@query("e01_prior_baseline", chain(ROWS, "t AS (SELECT avg(y_true) AS p FROM y WHERE fold_name <> 'fold_4')", then="SELECT dataset_row_id, p AS p_up, CAST(p >= 0.5 AS INTEGER) AS y_pred FROM y, t WHERE fold_name = 'fold_4'"), "p_up")
def e01(spark, sf):
    y = A.model_rows(spark, sf).where("model_name = 'trees'")
    return E.prior_baseline(y.where("fold_name <> 'fold_4'"), y.where("fold_name = 'fold_4'").drop("p_up", "y_pred")).select("dataset_row_id", "p_up", "y_pred")


SIGNAL = "sig AS (SELECT *, dataset_row_id * 31 % 101 - 50 AS log_return_60m FROM y)"


@query("e02_momentum_baseline", chain(ROWS, SIGNAL, "t AS (SELECT (coalesce(sum(y_true) FILTER (WHERE log_return_60m > 0), 0) + 1) / (count_if(log_return_60m > 0) + 2) AS up, (coalesce(sum(y_true) FILTER (WHERE NOT log_return_60m > 0), 0) + 1) / (count_if(NOT log_return_60m > 0) + 2) AS down FROM sig WHERE fold_name <> 'fold_4')", then="SELECT dataset_row_id, CASE WHEN log_return_60m > 0 THEN up ELSE down END AS p_up, CAST(log_return_60m > 0 AS INTEGER) AS y_pred FROM sig, t WHERE fold_name = 'fold_4'"), "p_up")
def e02(spark, sf):
    y = A.model_rows(spark, sf).where("model_name = 'trees'").withColumn("log_return_60m", F.pmod(F.col("dataset_row_id") * 31, F.lit(101)) - 50).drop("p_up", "y_pred")
    return E.momentum_baseline(y.where("fold_name <> 'fold_4'"), y.where("fold_name = 'fold_4'")).select("dataset_row_id", "p_up", "y_pred")


def learning_rows(spark, sf) -> DataFrame:
    y = A.model_rows(spark, sf)
    wide = y.groupBy("dataset_row_id", "y_true", "fold_name").pivot("model_name", ["logistic", "momentum", "trees"]).agg(F.first("p_up"))
    return wide.withColumnsRenamed({"logistic": "x1", "momentum": "x2", "trees": "x3"})


@query("e03_standard_scaler", chain(ROWS, "w AS (SELECT dataset_row_id, fold_name, max(p_up) FILTER (WHERE model_name = 'logistic') AS x1, max(p_up) FILTER (WHERE model_name = 'momentum') AS x2 FROM rows GROUP BY 1, 2)", "t AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM w WHERE fold_name <> 'fold_4')", then="SELECT dataset_row_id, (x1 - m1) / s1 AS x1, (x2 - m2) / s2 AS x2 FROM w, t"), "x1 x2")
def e03(spark, sf):
    rows = learning_rows(spark, sf)
    return E.scaled(rows, E.scaler(rows.where("fold_name <> 'fold_4'"), ["x1", "x2"])).select("dataset_row_id", "x1", "x2")


@query("e04_e08_logistic_regression")
def e04(spark, sf):
    rows = learning_rows(spark, sf)
    model = E.fit_logistic(rows.where("fold_name <> 'fold_4'"), ["x1", "x2", "x3"])
    return E.scored(rows.where("fold_name = 'fold_4'"), model.probability(), "logistic").select("dataset_row_id", "p_up", "y_pred")


@query("e06_e09_e10_boosted_trees")
def e06(spark, sf):
    rows = learning_rows(spark, sf)
    train = rows.where("fold_name <> 'fold_4'")
    fit = E.fit_trees(train.where("fold_name <> 'fold_3'"), train.where("fold_name = 'fold_3'"), train, ["x1", "x2", "x3"], E.TreeParams(rounds=10, max_depth=3, min_rows=5), patience=3)
    return fit.score(rows.where("fold_name = 'fold_4'")).select("dataset_row_id", "p_up", "y_pred")


@query("e11_e12_forward_calibration")
def e12(spark, sf):
    rows = A.model_rows(spark, sf).where("model_name = 'trees'")
    return M.metrics(E.forward_calibrated(rows), ["method", "calibration_fold"]).select("method", "calibration_fold", "sample_count", "log_loss", "brier")


FROZEN = """c AS (SELECT 'candidate_' || k AS name, 3 + k % 3 AS max_depth, CASE WHEN k < 3 THEN 0.1 ELSE 0.05 END AS step_size, k FROM range(6) t(k)),
d AS (SELECT sha256('[' || string_agg('{"max_depth":' || max_depth || ',"name":"' || name || '","step_size":' || CAST(CAST(step_size AS DOUBLE) AS VARCHAR) || '}', ',' ORDER BY k) || ']') AS definitions_sha256 FROM c)"""


@query("e13_frozen_candidates", chain(FROZEN, then="SELECT name, CAST(max_depth AS INTEGER) AS max_depth, CAST(step_size AS DOUBLE) AS step_size, definitions_sha256 FROM c, d"))
def e13(spark, sf):
    candidates = [{"name": f"candidate_{k}", "max_depth": 3 + k % 3, "step_size": 0.1 / (1 + k // 3)} for k in range(6)]
    kept, digest = E.frozen(candidates)
    return spark.createDataFrame([(c["name"], c["max_depth"], c["step_size"], digest) for c in kept], "name string, max_depth int, step_size double, definitions_sha256 string")


@query("n14_logit", chain(ROWS, then="SELECT dataset_row_id, model_name, ln(greatest(least(p_up, 1 - 1e-6), 1e-6) / (1 - greatest(least(p_up, 1 - 1e-6), 1e-6))) AS z, greatest(least(p_up * 2 - 0.5, 1), 0) AS c FROM rows"), "z c")
def n14(spark, sf):
    p = F.col("p_up")
    return A.model_rows(spark, sf).select("dataset_row_id", "model_name", X.logit(p).alias("z"), X.clip01(p * 2 - 0.5).alias("c"))


@query("j07_attach_metadata", chain(ROWS, then="SELECT r.dataset_row_id, r.model_name, r.p_up, y.fold_name, y.y_true FROM rows r LEFT JOIN y USING (dataset_row_id)"), "p_up")
def j07(spark, sf):
    rows = A.model_rows(spark, sf)
    y = rows.where("model_name = 'trees'").select("dataset_row_id", "fold_name", "y_true")
    return rows.select("dataset_row_id", "model_name", "p_up").join(y, "dataset_row_id", "left")


@query("j12_candidate_parameters", chain(*FOLDS, SUMMARY, "p AS (SELECT * FROM (VALUES ('trees', 4), ('logistic', 1)) t(model_name, depth))", then="SELECT s.model_name, s.roc_auc, p.depth FROM s LEFT JOIN p USING (model_name)"), "roc_auc")
def j12(spark, sf):
    params = spark.createDataFrame([("trees", 4), ("logistic", 1)], "model_name string, depth int")
    return candidate_summary(spark, sf).select("model_name", "roc_auc").join(F.broadcast(params), "model_name", "left")
