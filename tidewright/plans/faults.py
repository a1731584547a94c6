"""Queries of the check suites over tables with planted faults, of the file sources, and of the selections on subset metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import checks as K
from ..operators import dataset as D
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import selection as SE
from ..sources import adapt as A
from ..sources import io as IO
from ..sources.scratch import Scratch
from .evaluation import ROWS, SUBSETS, metric_sql
from .market import DAY, FOLD_DAYS, LABELS15, QUARTER, SPLIT, START, TRADES, _split, labels15
from .registry import chain, query


def counts(**tests: str) -> str:
    """The rows (check, violations) of counted conditions over the table planted."""
    return " UNION ALL ".join(f"""SELECT '{n}' AS "check", count_if({t}) AS violations FROM planted""" for n, t in tests.items())


def where(test, value, column: str):
    return F.when(test, value).otherwise(F.col(column))


@query("p16_trade_faults", chain(TRADES, "planted AS (SELECT agg_trade_id AS i FROM trades)", then=counts(missing_time="i % 17 = 0", bad_price="i % 11 = 0", bad_quantity="i % 13 = 0", wrong_quote="i % 19 = 0", both_sides="i % 23 = 0")))
def p16_faults(spark, sf):
    i = F.col("agg_trade_id")
    t = A.plain_trades(spark, sf).withColumns({"trade_time": where(i % 17 == 0, None, "trade_time"), "price": where(i % 11 == 0, -F.col("price"), "price"), "quantity": where(i % 13 == 0, 0.0, "quantity")})
    t = t.withColumn("quote_quantity", F.col("price") * F.col("quantity") + F.when(i % 19 == 0, 1.0).otherwise(0.0))
    return K.violations(t.withColumn("is_active_sell", where(i % 23 == 0, F.col("is_active_buy"), "is_active_sell")), K.trade_suite())


@query("p06_aggregate_faults", chain(TRADES, f"planted AS (SELECT DISTINCT trade_time // {QUARTER} AS b FROM trades)", then=counts(sides_base="b % 7 = 0", sides_quote="b % 11 = 0", sides_count="b % 13 = 0", vwap_above_high="b % 5 = 0", vwap_below_low="b % 5 = 1")))
def p06_faults(spark, sf):
    b = F.expr(f"open_time div {QUARTER}")
    bars = A.trade_bars(spark, sf, QUARTER).withColumns({
        "active_buy_base_volume": where(b % 7 == 0, F.col("active_buy_base_volume") + F.col("base_volume"), "active_buy_base_volume"),
        "active_sell_quote_volume": where(b % 11 == 0, F.col("active_sell_quote_volume") - F.col("quote_volume"), "active_sell_quote_volume"),
        "active_buy_trade_count": where(b % 13 == 0, F.col("active_buy_trade_count") + 1, "active_buy_trade_count"),
        "trade_vwap": F.when(b % 5 == 0, F.col("trade_high") * 1.1).when(b % 5 == 1, F.col("trade_low") * 0.9).otherwise(F.col("trade_vwap")),
    })
    return K.violations(bars, K.aggregate_suite())


PLANTED = f"planted AS (SELECT *, decision_time // {5 * QUARTER} % 7 AS k FROM labels60)"


@query("p17_label_faults", chain(*LABELS15, PLANTED, then=counts(
    label_without_validity="NOT is_valid_proxy_label AND k = 1", valid_without_label="is_valid_proxy_label AND k = 0", label_not_binary="k = 1",
    sign_disagrees="is_valid_proxy_label AND k = 1 AND future_simple_return_60m > 0", weight_out_of_range="k IN (2, 3)",
)))
def p17_faults(spark, sf):
    k = F.expr(f"(decision_time div {5 * QUARTER}) % 7")
    y = labels15(spark, sf).withColumn("label_up_60m", F.when(k == 0, None).when(k == 1, F.lit(2)).otherwise(F.col("label_up_60m").cast("int")))
    return K.violations(y.withColumn("margin_sample_weight", F.when(k == 2, 0.1).when(k == 3, 3.0).otherwise(F.col("margin_sample_weight"))), K.label_suite())


@query("p17_dataset_faults", chain(*SPLIT, "planted AS (SELECT dataset_row_id AS i FROM split)", then=counts(target_missing="i % 7 = 0", entry_time="i % 11 = 0", settlement_not_later="i % 13 = 0", negative_row_id="i % 5 = 1")))
def p17_dataset_faults(spark, sf):
    i = F.col("dataset_row_id")
    data = _split(spark, sf)[0].withColumns({
        "label_up_60m": where(i % 7 == 0, None, "label_up_60m"), "entry_minute_open_time": where(i % 11 == 0, F.col("decision_time") + 1, "entry_minute_open_time"),
        "settlement_minute_open_time": where(i % 13 == 0, F.col("decision_time"), "settlement_minute_open_time"), "dataset_row_id": where(i % 5 == 1, -i, "dataset_row_id"),
    })
    return K.violations(data, K.dataset_suite())


LEAKY = "leaky AS (SELECT *, CASE WHEN dataset_row_id % 9 = 0 THEN 'TRAIN' WHEN dataset_row_id % 9 = 1 THEN 'VALIDATION' ELSE fold_a_role END AS role FROM split)"
A_START, A_END = (f"({START} + {d * DAY})" for d in FOLD_DAYS[0])


@query("g06_fold_faults", chain(*SPLIT, LEAKY, """n AS (SELECT 'training settlement reaches the validation range' AS fault, count(*) FILTER (WHERE role = 'TRAIN' AND settlement_minute_open_time >= """ + A_START + """) AS rows FROM leaky
  UNION ALL SELECT 'validation row out of range', count(*) FILTER (WHERE role = 'VALIDATION' AND (decision_time < """ + A_START + " OR decision_time >= " + A_END + " OR settlement_minute_open_time >= " + A_END + """)) FROM leaky
  UNION ALL SELECT 'final test row in fold', count(*) FILTER (WHERE role IN ('TRAIN', 'VALIDATION') AND final_split_role <> 'DEVELOPMENT') FROM leaky)""", then="SELECT 'fold_a: ' || fault || ' (' || rows || ')' AS error FROM n WHERE rows > 0"))
def g06_faults(spark, sf):
    data, split, folds = _split(spark, sf)
    i = F.col("dataset_row_id")
    split = split.withColumn("fold_a_role", F.when(i % 9 == 0, "TRAIN").when(i % 9 == 1, "VALIDATION").otherwise(F.col("fold_a_role")))
    return spark.createDataFrame([(e,) for e in D.fold_errors(data, split, folds[0])], "error string")


@query("p20_prediction_faults", chain(ROWS, then="""SELECT count_if(dataset_row_id % 7 = 0 AND model_name = 'trees') + 3 * (SELECT count(*) FROM labels WHERE doc_id % 13 = 5 AND doc_id % 7 <> 0)
  + 2 * (SELECT count(*) FROM labels WHERE doc_id % 13 = 5 AND doc_id % 7 = 0) AS missing_rows,
  count_if(dataset_row_id % 13 = 5 AND NOT (dataset_row_id % 7 = 0 AND model_name = 'trees')) + count_if(dataset_row_id % 13 = 5 AND dataset_row_id % 11 = 2 AND NOT (dataset_row_id % 7 = 0 AND model_name = 'trees')) AS foreign_rows, count_if(dataset_row_id % 11 = 2 AND NOT (dataset_row_id % 7 = 0 AND model_name = 'trees')) AS repeated_rows,
  count_if(dataset_row_id % 17 = 3 AND NOT (dataset_row_id % 7 = 0 AND model_name = 'trees')) + count_if(dataset_row_id % 17 = 3 AND dataset_row_id % 11 = 2 AND NOT (dataset_row_id % 7 = 0 AND model_name = 'trees')) AS bad_probabilities FROM rows"""))
def p20_faults(spark, sf):
    i = F.col("dataset_row_id")
    rows = A.model_rows(spark, sf).where(~((i % 7 == 0) & (F.col("model_name") == "trees"))).select("dataset_row_id", "model_name", "p_up")
    rows = rows.withColumn("p_up", where(i % 17 == 3, 1.5, "p_up"))
    rows = rows.unionByName(rows.where(i % 11 == 2)).withColumn("dataset_row_id", where(i % 13 == 5, i + 10**12, "dataset_row_id"))
    return M.prediction_faults(rows, A.table(spark, sf, "labels").withColumnRenamed("doc_id", "dataset_row_id"))


ODD = "f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'NaN'::DOUBLE WHEN l_partkey % 5 = 1 THEN 'inf'::DOUBLE WHEN l_partkey % 5 = 2 THEN NULL ELSE l_extendedprice - 50000 END AS x FROM lineitem)"


@query("p03_nonfinite_values", chain(ODD, then="SELECT l_orderkey, l_linenumber, coalesce(isfinite(x), false) AS is_finite, coalesce(isfinite(x) AND x > 0, false) AS positive, coalesce(isfinite(x) AND x >= 0, false) AS nonnegative FROM f"))
def p03_odd(spark, sf):
    k = F.col("l_partkey") % 5
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(F.col("l_extendedprice") - 50000)
    f = A.table(spark, sf, "lineitem").withColumn("x", x)
    no = F.lit(False)
    return f.select("l_orderkey", "l_linenumber", *[F.coalesce(c, no).alias(n) for n, c in (("is_finite", X.finite("x")), ("positive", X.finite_positive("x")), ("nonnegative", X.finite_nonnegative("x")))])


# files


def written_events(spark, sf) -> tuple[Scratch, DataFrame]:
    return Scratch(spark, "files"), A.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "NA").otherwise(F.col("event_type")).alias("event_type"), "value")


NAMED = "CASE WHEN event_id % 5 = 0 THEN 'NA' ELSE event_type END AS event_type"


@query("s01_text_csv", f"SELECT CAST(event_id AS VARCHAR) AS event_id, {NAMED}, round(value, 6) AS value FROM events", "value")
def s01(spark, sf):
    scratch, rows = written_events(spark, sf)
    rows.write.option("header", True).csv(f"{scratch.root}/events")
    return IO.text_csv(spark, f"{scratch.root}/events").withColumn("value", F.col("value").cast("double"))


@query("s02_typed_csv", f"SELECT event_id, {NAMED}, value FROM events", "value")
def s02(spark, sf):
    scratch, rows = written_events(spark, sf)
    rows.write.option("header", True).csv(f"{scratch.root}/events")
    return IO.typed_csv(spark, f"{scratch.root}/events", rows.schema)


@query("s15_s17_appended_csv", "SELECT kind, count(*) AS n, sum(event_id) AS total FROM (SELECT event_type AS kind, event_id FROM events UNION ALL SELECT event_type, event_id FROM events WHERE value > 10) GROUP BY 1")
def s15(spark, sf):
    scratch, e = Scratch(spark, "files"), A.table(spark, sf, "events").select(F.col("event_type").alias("kind"), "event_id", "value")
    IO.append_csv(e.drop("value"), f"{scratch.root}/log")
    IO.append_csv(e.where("value > 10").drop("value"), f"{scratch.root}/log")
    rows = IO.text_csv(spark, f"{scratch.root}/log")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id").cast("long")).alias("total"))


# features on one-minute bars


@query("f01_f63_minute_features")
def f63_minutes(spark, sf):
    return FE.features(A.bars(spark, sf, 60_000)).select("open_time", "continuity_segment_id", *FE.FEATURES)


# selections on subset metrics


FOLDED = f"folds AS (WITH {metric_sql('rows', 'model_name, fold_name')} SELECT * FROM scored)"
KEYS = """keys AS (SELECT model_name, max(roc_auc) FILTER (WHERE subset_name = 'DENSE') AS roc_auc, max(roc_auc) FILTER (WHERE subset_name = 'NONOVERLAP_OFFSET_00') AS nonoverlap_auc,
  max(log_loss) FILTER (WHERE subset_name = 'DENSE') AS log_loss, max(brier) FILTER (WHERE subset_name = 'DENSE') AS brier,
  max(roc_auc) FILTER (WHERE starts_with(subset_name, 'OFFSET_')) - min(roc_auc) FILTER (WHERE starts_with(subset_name, 'OFFSET_')) AS offset_auc_range,
  avg(roc_auc) FILTER (WHERE starts_with(subset_name, 'OFFSET_')) AS offset_macro_auc FROM scored GROUP BY 1)"""
POOLED = (ROWS, SUBSETS, metric_sql("subs", "model_name, subset_name"), FOLDED, KEYS)


@query("a37_o08_candidate_keys", chain(*POOLED, "w AS (SELECT model_name, min(roc_auc) AS worst_fold_auc, coalesce(stddev_samp(roc_auc), 0) AS fold_auc_std, count_if(roc_auc >= 0.5) AS folds_above_half FROM folds GROUP BY 1)", then="SELECT k.*, w.worst_fold_auc, w.fold_auc_std, w.folds_above_half, CASE k.model_name WHEN 'trees' THEN 2 ELSE 1 END AS complexity FROM keys k JOIN w USING (model_name)"), "roc_auc nonoverlap_auc log_loss brier offset_auc_range offset_macro_auc worst_fold_auc fold_auc_std")
def candidate_keys(spark, sf):
    return SE.candidate_keys(A.model_rows(spark, sf), {"trees": 2, "logistic": 1, "momentum": 1})


@query("g08_g09_gains_over_a_reference", chain(*POOLED, "w AS (SELECT a.model_name, count_if(a.roc_auc > b.roc_auc) AS winning_folds FROM folds a JOIN folds b USING (fold_name) WHERE b.model_name = 'logistic' GROUP BY 1)", then="SELECT a.model_name, a.roc_auc - b.roc_auc AS delta_roc_auc, a.log_loss - b.log_loss AS delta_log_loss, a.nonoverlap_auc - b.nonoverlap_auc AS nonoverlap_gain, w.winning_folds FROM keys a JOIN keys b ON b.model_name = 'logistic' JOIN w ON w.model_name = a.model_name WHERE a.model_name <> 'logistic'"), "delta_roc_auc delta_log_loss nonoverlap_gain")
def gains(spark, sf):
    return SE.gains_over(A.model_rows(spark, sf), "logistic")


METHOD = "CASE model_name WHEN 'logistic' THEN 'UNCALIBRATED' WHEN 'momentum' THEN 'PLATT' ELSE 'ISOTONIC' END AS method"
BY = "method, calibration_fold, subset_name"
CALIBRATED = (
    ROWS, f"m AS (SELECT *, {METHOD} FROM rows)", "folded AS (SELECT fold_name AS calibration_fold, * FROM m UNION ALL SELECT 'POOLED', * FROM m)",
    "cal AS (SELECT 'DENSE' AS subset_name, * FROM folded UNION ALL SELECT 'NONOVERLAP_OFFSET_00', * FROM folded WHERE is_primary_nonoverlap_evaluation)", metric_sql("cal", BY),
    f"binned AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY {BY} ORDER BY p_up, dataset_row_id) - 1) * 10 / count(*) OVER (PARTITION BY {BY})) AS INTEGER) AS often, least(CAST(floor(p_up * 10) AS INTEGER), 9) AS wide FROM cal)",
    f"eo AS (SELECT {BY}, sum(gap * n) / sum(n) AS ece, max(gap) AS mce FROM (SELECT {BY}, often, count(*) AS n, abs(avg(p_up) - avg(y_true)) AS gap FROM binned GROUP BY {BY}, often) GROUP BY {BY})",
    f"ew AS (SELECT {BY}, sum(gap * n) / sum(n) AS ece, max(gap) AS mce FROM (SELECT {BY}, wide, count(*) AS n, abs(avg(p_up) - avg(y_true)) AS gap FROM binned GROUP BY {BY}, wide) GROUP BY {BY})",
    f"caltable AS (SELECT s.*, eo.ece AS ece_equal_frequency, eo.mce AS mce_equal_frequency, ew.ece AS ece_equal_width, ew.mce AS mce_equal_width FROM scored s LEFT JOIN eo USING ({BY}) LEFT JOIN ew USING ({BY}))",
)


def forward_rows(spark, sf) -> DataFrame:
    name = F.when(F.col("model_name") == "logistic", "UNCALIBRATED").when(F.col("model_name") == "momentum", "PLATT").otherwise("ISOTONIC")
    return A.model_rows(spark, sf).withColumns({"method": name, "calibration_fold": F.col("fold_name")})


@query("m16_calibration_metrics", chain(*CALIBRATED, then=f"SELECT {BY}, sample_count, roc_auc, log_loss, brier, ece_equal_width, mce_equal_width, ece_equal_frequency, mce_equal_frequency FROM caltable"), "roc_auc log_loss brier ece_equal_width mce_equal_width ece_equal_frequency mce_equal_frequency")
def calibration_metrics(spark, sf):
    table = SE.calibration_metrics(forward_rows(spark, sf))
    return table.select("method", "calibration_fold", "subset_name", "sample_count", "roc_auc", "log_loss", "brier", "ece_equal_width", "mce_equal_width", "ece_equal_frequency", "mce_equal_frequency")


@query("g10_calibration_choice", chain(
    *CALIBRATED,
    """p AS (SELECT method, max(log_loss) FILTER (WHERE calibration_fold = 'POOLED' AND subset_name <> 'DENSE') AS loss, max(brier) FILTER (WHERE calibration_fold = 'POOLED' AND subset_name <> 'DENSE') AS brier,
  max(log_loss) FILTER (WHERE calibration_fold = 'POOLED' AND subset_name = 'DENSE') AS dense, max(ece_equal_frequency) FILTER (WHERE calibration_fold = 'POOLED' AND subset_name <> 'DENSE') AS ece,
  max(log_loss) FILTER (WHERE calibration_fold <> 'POOLED' AND subset_name <> 'DENSE') AS worst, CASE method WHEN 'UNCALIBRATED' THEN 0 WHEN 'PLATT' THEN 1 ELSE 2 END AS complexity FROM caltable GROUP BY 1)""",
    "y2 AS (SELECT method, calibration_fold, log_loss, brier FROM caltable WHERE calibration_fold <> 'POOLED' AND subset_name <> 'DENSE')",
    "w AS (SELECT a.method, count_if(a.log_loss < b.log_loss) AS loss_wins, count_if(a.brier < b.brier) AS brier_wins FROM y2 a JOIN y2 b USING (calibration_fold) WHERE b.method = 'UNCALIBRATED' GROUP BY 1)",
    "u AS (SELECT * FROM p WHERE method = 'UNCALIBRATED')",
    """r AS (SELECT p.method, w.loss_wins, w.brier_wins, CAST(row_number() OVER (ORDER BY p.loss - (SELECT min(loss) FROM p) <= 0.05 DESC, CASE WHEN p.loss - (SELECT min(loss) FROM p) <= 0.05 THEN 0 ELSE p.loss END, p.brier, p.dense, p.ece, p.worst, p.complexity) AS INTEGER) AS rank,
  p.loss <= u.loss - 0.0002 AND p.dense <= u.dense AND w.loss_wins >= 3 AS condition_a, p.brier <= u.brier - 0.0001 AND p.loss <= u.loss + 0.0001 AND w.brier_wins >= 3 AS condition_b FROM p JOIN w USING (method), u)""",
    then="SELECT method, rank, loss_wins, brier_wins, condition_a, condition_b, method = coalesce((SELECT method FROM r WHERE rank = 1 AND (method = 'UNCALIBRATED' OR condition_a OR condition_b)), 'UNCALIBRATED') AS selected FROM r",
))
def calibration_choice(spark, sf):
    return SE.choose_calibration(SE.calibration_metrics(forward_rows(spark, sf)), tolerance=0.05).select("method", "rank", "loss_wins", "brier_wins", "condition_a", "condition_b", "selected")


@query("g11_assessment_of_the_test", chain(*POOLED, """l AS (SELECT max(log_loss) FILTER (WHERE model_name = 'trees' AND subset_name = 'NONOVERLAP_OFFSET_00') AS mine, max(log_loss) FILTER (WHERE model_name = 'momentum' AND subset_name = 'NONOVERLAP_OFFSET_00') AS prior FROM scored)""", then="""SELECT t.roc_auc AS dense, t.nonoverlap_auc AS apart, l.mine AS loss, g.nonoverlap_auc AS logistic, l.prior AS prior,
  CASE WHEN t.roc_auc <= 0.49 OR t.nonoverlap_auc <= 0.49 THEN 'FAILED_FINAL_VALIDATION' WHEN t.roc_auc > 0.5 AND t.nonoverlap_auc > 0.5 AND t.nonoverlap_auc > g.nonoverlap_auc AND l.mine <= l.prior + 0.001 THEN 'READY_FOR_RESEARCH_DEPLOYMENT' ELSE 'WEAK_SIGNAL_RESEARCH_ONLY' END AS assessment
  FROM keys t, keys g, l WHERE t.model_name = 'trees' AND g.model_name = 'logistic'"""), "dense apart loss logistic prior")
def assessment(spark, sf):
    return SE.assess_test(M.subset_metrics(A.model_rows(spark, sf), ("model_name",)), "trees", "logistic", "momentum", True)


@query("m15_test_against_development", chain(*POOLED, then="SELECT a.subset_name, a.roc_auc - b.roc_auc AS delta_roc_auc, a.log_loss - b.log_loss AS delta_log_loss, a.brier - b.brier AS delta_brier, a.mcc - b.mcc AS delta_mcc FROM scored a JOIN scored b USING (subset_name) WHERE a.model_name = 'trees' AND b.model_name = 'logistic' AND subset_name IN ('DENSE', 'NONOVERLAP_OFFSET_00')"), "delta_roc_auc delta_log_loss delta_brier delta_mcc")
def against_development(spark, sf):
    table = M.subset_metrics(A.model_rows(spark, sf), ("model_name",))
    return SE.against_development(table, table, "trees", "logistic")
