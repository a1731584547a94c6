import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import dataset as D
from tidewright.operators import gates as G
from tidewright.operators import metrics as M
from tidewright.operators import models as E
from tidewright.operators import selection as SE
from tidewright.plans import stages as S
from tidewright.schema import ValidationError

H = 3_600_000


def rows_of(spark, y, p, **more):
    data = [(k, a, float(b), int(b >= 0.5)) for k, (a, b) in enumerate(zip(y, p, strict=True))]
    df = spark.createDataFrame(data, "dataset_row_id long, y_true int, p_up double, y_pred int")
    return df.withColumns({k: F.lit(v) for k, v in ({"model_name": "m", "fold_name": "f"} | more).items()})


def brute(y, p):
    pos, neg = [a for a, t in zip(p, y, strict=True) if t], [a for a, t in zip(p, y, strict=True) if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    ap, hit = 0.0, 0
    for s in sorted(set(p), reverse=True):
        new = sum(t for t, a in zip(y, p, strict=True) if a == s)
        hit += new
        ap += new / max(1, len(pos)) * hit / sum(a >= s for a in p)
    return auc, ap if pos else None


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 10)), min_size=1, max_size=40))
def test_ranked_metrics(spark, pairs):
    y, p = [a for a, _ in pairs], [b / 10 for _, b in pairs]
    r = M.metrics(rows_of(spark, y, p), ["model_name"]).first()
    for got, want in zip((r["roc_auc"], r["average_precision"]), brute(y, p), strict=True):
        assert (got is None) == (want is None) and (want is None or math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12))
    assert (r["auc_reason"] == "single_class_validation_subset") == (len(set(y)) == 1)


def test_counted_metrics(spark):
    r = M.metrics(rows_of(spark, [1, 1, 0, 0, 1], [0.9, 0.2, 0.6, 0.1, 0.8]), ["model_name"]).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (2, 1, 1, 1) and math.isclose(r["precision"], 2 / 3) and math.isclose(r["brier"], (0.01 + 0.64 + 0.36 + 0.01 + 0.04) / 5)
    one = M.metrics(rows_of(spark, [1, 1], [0.9, 0.8]), ["model_name"]).first()
    assert one["mcc"] == 0 and one["specificity"] is None and one["balanced_accuracy"] is None


def test_calibration_bins(spark):
    t = M.calibration_table(M.with_bins(rows_of(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), 2))
    e = M.calibration_errors(t).first()
    assert math.isclose(e["ece"], 0.15) and math.isclose(e["mce"], 0.15)
    t = M.calibration_table(M.with_bins(rows_of(spark, [0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.8, 0.9]), 2, "equal_frequency"))
    assert sorted(r["n"] for r in t.collect()) == [2, 3]
    assert M.with_bins(rows_of(spark, [1], [1.0]), 10).first()["bin"] == 9


def test_subsets(spark):
    df = rows_of(spark, [1, 0], [0.9, 0.2], evaluation_offset_minutes=0, abs_future_return_bps_60m=3.0, is_primary_nonoverlap_evaluation=True)
    got = {r["subset_name"]: r for r in M.subset_metrics(df).collect()}
    assert len(got) == 19 and got["OFFSET_05"]["auc_reason"] == "empty_subset" and got["OFFSET_05"]["sample_count"] == 0 and got["OFFSET_05"]["accuracy"] is None
    assert got["ABS_RETURN_GE_2_5BPS"]["sample_count"] == 2 and got["ABS_RETURN_GE_5BPS"]["sample_count"] == 0


def test_prediction_contract(spark):
    good = rows_of(spark, [1, 0, 1], [0.9, 0.2, 0.4])
    ids = spark.range(3).withColumnRenamed("id", "dataset_row_id")
    assert sum(M.prediction_faults(good, ids).first()) == 0
    bad = good.where("dataset_row_id > 0").unionByName(rows_of(spark, [1, 0], [1.5, 0.2]).withColumn("dataset_row_id", F.col("dataset_row_id") + 2))
    assert tuple(M.prediction_faults(bad, ids).first()) == (1, 1, 1, 1)


def test_baselines(spark):
    train = spark.createDataFrame([(0.1, 1), (0.2, 0), (-0.1, 0), (0.0, 0)], "log_return_60m double, y_true int")
    rows = spark.createDataFrame([(0.01, 0), (0.0, 1)], "log_return_60m double, k int")
    got = E.momentum_baseline(train, rows).orderBy("k").collect()
    assert [(r["p_up"], r["y_pred"]) for r in got] == [(0.5, 1), (0.25, 0)]
    prior = E.prior_baseline(spark.createDataFrame([(1,), (0,), (1,), (0,)], "y_true int"), rows).collect()
    assert [(r["p_up"], r["y_pred"]) for r in prior] == [(0.5, 1)] * 2


def learning(spark, n=400):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(3, 2)
        rows.append((k, a, b, int(a + 0.3 * rng.gauss(0, 1) > 0)))
    return spark.createDataFrame(rows, "dataset_row_id long, x1 double, x2 double, y_true int")


def test_logistic_solves_its_objective(spark):
    import numpy as np

    df = learning(spark)
    model = E.fit_logistic(df, ["x1", "x2"])
    pdf = df.toPandas()
    x = (pdf[["x1", "x2"]] - pdf[["x1", "x2"]].mean()) / pdf[["x1", "x2"]].std(ddof=0)
    w, b = np.array(model.coefficients), model.intercept
    p = 1 / (1 + np.exp(-(x.to_numpy() @ w + b)))
    gradient = x.to_numpy().T @ (p - pdf["y_true"].to_numpy()) + w
    assert np.abs(gradient).max() < 0.05 and abs((p - pdf["y_true"]).sum()) < 0.05
    scored = E.scored(df, model.probability(), "l").orderBy("dataset_row_id").toPandas()["p_up"].to_numpy()
    assert np.allclose(scored, p, atol=1e-9)


def test_trees_calibrators_and_selection_of_rounds(spark, tmp_path):
    df = learning(spark, 200)
    fit = E.fit_trees(df.where("dataset_row_id < 120"), df.where("dataset_row_id >= 120"), df, ["x1", "x2"], E.TreeParams(rounds=4, max_depth=2, min_rows=2), patience=2)
    assert 1 <= fit.rounds <= 4 and len(fit.curve) == 4 and abs(sum(g for _, g, _ in fit.importances()) - 1) < 1e-9
    scored = fit.score(df)
    E.save_model(fit.model, str(tmp_path / "m"))
    again = E.load_trees(str(tmp_path / "m"), ["x1", "x2"]).score(df)
    assert M.paired(scored, again).first()["probability_differences"] == 0
    for method in ("UNCALIBRATED", "PLATT", "ISOTONIC"):
        p = [r[0] for r in scored.select(E.fit_calibrator(method, scored).apply(F.col("p_up"))).collect()]
        assert all(0 <= x <= 1 for x in p)
    assert E.best_rounds([3, 2, 2.5, 2.6, 1], 2) == 2 and E.best_rounds([3, 2, 1], 5) == 3
    with pytest.raises(ValidationError):
        E.TreeParams(step_size=0).check()
    with pytest.raises(ValidationError):
        E.frozen([{"name": "a"}, {"name": "a"}])


def test_isotonic_expression_equals_the_model(spark):
    c = E.Calibrator("ISOTONIC", boundaries=[0.2, 0.4, 0.4, 0.8], values=[0.1, 0.3, 0.5, 0.9])
    df = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0)], "p double")
    assert [round(r[0], 9) for r in df.select(c.apply(F.col("p"))).collect()] == [0.1, 0.1, 0.2, 0.5, 0.7, 0.9, 0.9]


def test_splits(spark):
    import datetime as dt

    ms = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)
    times = [ms(2019, 12, 31, 22, 55), ms(2019, 12, 31, 23), ms(2020, 1, 1), ms(2020, 12, 31, 23), ms(2021, 1, 1), ms(2024, 12, 31, 22, 55), ms(2024, 12, 31, 23), ms(2025, 1, 1)]
    data = spark.createDataFrame([(k, t, t + H) for k, t in enumerate(times)], "dataset_row_id long, decision_time long, settlement_minute_open_time long")
    folds = [D.Fold("fold_2020", ms(2020, 1, 1), ms(2021, 1, 1)), D.Fold("fold_2021", ms(2021, 1, 1), ms(2022, 1, 1))]
    got = D.splits(data, ms(2025, 1, 1), folds).orderBy("dataset_row_id").collect()
    assert [r["final_split_role"] for r in got][-3:] == ["DEVELOPMENT", "PURGED_BEFORE_FINAL_TEST", "FINAL_TEST"]
    assert [r["fold_2020_role"] for r in got] == ["TRAIN", "PURGED_BEFORE_VALIDATION", "VALIDATION", "PURGED_AT_VALIDATION_END", "OUTSIDE_FOLD", "OUTSIDE_FOLD", "FINAL_TEST_EXCLUDED", "FINAL_TEST_EXCLUDED"]
    assert got[4]["fold_2021_role"] == "VALIDATION" and got[0]["evaluation_offset_minutes"] == 55


def test_gates(spark):
    pooled = spark.createDataFrame([("UNCALIBRATED", 0.6870, 0.25, 0.0, 0), ("PLATT", 0.6860, 0.25, 0.0, 1), ("ISOTONIC", 0.6861, 0.25, 0.0, 2)], "method string, log_loss double, brier double, ece double, complexity int")
    wins = spark.createDataFrame([("PLATT", 4), ("ISOTONIC", 4)], "method string, winning_years int")
    pick = lambda p: [r["method"] for r in G.select_calibration(p, wins).collect() if r["selected"]]
    assert pick(pooled) == ["PLATT"]
    assert pick(pooled.withColumn("log_loss", F.when(F.col("method") == "PLATT", 0.68695).when(F.col("method") == "ISOTONIC", 0.68696).otherwise(0.687))) == ["UNCALIBRATED"]
    final = lambda a, n: G.assess_final(spark.createDataFrame([(a, n, 0.52, True)], "auc double, nonoverlap_auc double, baseline_auc double, all_gates_passed boolean")).first()["assessment"]
    assert final(0.53, 0.54) == "READY_FOR_RESEARCH_DEPLOYMENT" and final(0.53, 0.49) == "FAILED_FINAL_VALIDATION" and final(0.51, 0.52) == "WEAK_BUT_VALID"
    assert G.engineering_gates({"a": True, "b": False})["all_passed"] is False


def test_one_shot_protocol(spark):
    guard = G.OneShotTest()
    for s in G.OneShotTest.ORDER[:4]:
        guard.done(s)
    with pytest.raises(ValidationError):
        guard.done("test_read")
    assert len(guard.lock_with("config", {"data": "1"})) == 64
    with pytest.raises(ValidationError):
        guard.read_test(spark.range(1), {"data": "2"})
    assert guard.read_test(spark.range(1), {"data": "1"}).count() == 1
    with pytest.raises(ValidationError):
        guard.read_test(spark.range(1), {"data": "1"})


def test_isotonic_with_thousands_of_knots_and_a_saved_calibrator(spark, tmp_path):
    rng = np.random.default_rng(2)
    knots = np.unique(np.sort(rng.random(3000)))
    values = np.sort(rng.random(len(knots)))
    fit = E.Calibrator("ISOTONIC", boundaries=knots.tolist(), values=values.tolist())
    p = np.concatenate([[0.0, 1.0, knots[0], knots[-1]], knots[5:9], rng.random(300)])
    df = spark.createDataFrame([(float(x),) for x in p] + [(None,)], "p double")
    E.save_calibrator(fit, str(tmp_path / "c.json"))
    for c in (fit, E.load_calibrator(str(tmp_path / "c.json"))):
        got = [r[0] for r in df.select(c.apply(F.col("p"))).collect()]
        assert got[-1] is None and np.allclose(got[:-1], np.interp(p, knots, values), atol=1e-12)
    one = E.Calibrator("ISOTONIC", boundaries=[0.4], values=[0.3])
    assert {r[0] for r in df.where("p IS NOT NULL").select(one.apply(F.col("p"))).collect()} == {0.3}


def test_metric_differences_sees_nulls_and_missing_rows(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 3.0), ("z", 1.0, 1.0)], "k string, m double, n double")
    b = spark.createDataFrame([("x", 1.0, 0.5), ("y", 2.0, 3.0), ("w", 1.0, 1.0)], "k string, m double, n double")
    assert S.metric_differences(a, a, ["k"], ["m", "n"]) == 0
    assert S.metric_differences(a, b, ["k"], ["m", "n"]) == 3
    assert S.metric_differences(a, a.withColumn("m", F.col("m") + 1e-6), ["k"], ["m", "n"]) == 3


def test_calibration_choice_on_the_default_and_the_small_gains(spark):
    def table(platt, isotonic):
        rows = []
        for method, loss in (("UNCALIBRATED", 0.6870), ("PLATT", platt), ("ISOTONIC", isotonic)):
            for fold in ("fold_2021", "fold_2022", "fold_2023", "fold_2024", "POOLED"):
                for subset in ("DENSE", "NONOVERLAP_OFFSET_00"):
                    rows.append((method, fold, subset, loss, loss / 3, 0.01))
        return spark.createDataFrame(rows, "method string, calibration_fold string, subset_name string, log_loss double, brier double, ece_equal_frequency double")

    chosen = lambda t: SE.choose_calibration(t).where("selected").first()["method"]
    assert chosen(table(0.6860, 0.6861)) == "PLATT" and chosen(table(0.68695, 0.68696)) == "UNCALIBRATED" and chosen(table(0.7, 0.71)) == "UNCALIBRATED"


def test_calibration_choice_compares_a_method_with_its_own_numbers(spark):
    rows = [(method, fold, subset, 0.687, 0.229, 0.01) for method in ("UNCALIBRATED", "PLATT") for fold in ["POOLED", *(f"fold_{k}" for k in range(30))] for subset in ("DENSE", "NONOVERLAP_OFFSET_00")]
    table = spark.createDataFrame(rows, "method string, calibration_fold string, subset_name string, log_loss double, brier double, ece_equal_frequency double")
    # sums whose last digits differ each time they are computed, as those of many executors do
    noisy = F.udf(lambda x: x + random.random() * 1e-12, "double").asNondeterministic()
    table = table.withColumns({"log_loss": noisy("log_loss"), "brier": noisy("brier")})
    got = {r["method"]: (r["loss_wins"], r["brier_wins"]) for r in SE.choose_calibration(table).collect()}
    assert got["UNCALIBRATED"] == (0, 0) and got["PLATT"] != (0, 0)


def test_assessment_of_the_final_test(spark):
    def said(auc, apart, gates=True):
        rows = [("m", "DENSE", auc, 0.68), ("m", "NONOVERLAP_OFFSET_00", apart, 0.68), ("l", "NONOVERLAP_OFFSET_00", 0.52, 0.69), ("p", "NONOVERLAP_OFFSET_00", None, 0.693)]
        return SE.assess_test(spark.createDataFrame(rows, "model_name string, subset_name string, roc_auc double, log_loss double"), "m", "l", "p", gates).first()["assessment"]

    assert said(0.53, 0.54) == "READY_FOR_RESEARCH_DEPLOYMENT" and said(0.53, 0.49) == "FAILED_FINAL_VALIDATION"
    assert said(0.53, 0.51) == "WEAK_SIGNAL_RESEARCH_ONLY" and said(0.53, 0.54, gates=False) == "FAILED_FINAL_VALIDATION"
