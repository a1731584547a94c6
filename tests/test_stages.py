import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import dataset as D
from tidewright.operators import models as E
from tidewright.plans import manifest as MF
from tidewright.plans import stages as S
from tidewright.schema import ValidationError

M0 = 1_662_076_800_000
NAMES = ["log_return_1m", "log_return_3m", "signed_body_ratio", "close_location"]


def raw_tables(spark, n=1500):
    rng = np.random.default_rng(1)
    close = 100 + np.cumsum(rng.standard_normal(n) * 0.2)
    open_ = np.concatenate(([100.0], close[:-1]))
    t = M0 + np.arange(n) * 60000
    bars = pd.DataFrame({
        "open_time": t, "open": open_, "high": np.maximum(open_, close) + 0.1, "low": np.minimum(open_, close) - 0.1, "close": close, "volume": 2.0, "close_time": t + 59999,
        "quote_volume": open_ + close, "number_of_trades": 2, "taker_buy_base_volume": 1.0, "taker_buy_quote_volume": open_,
    })
    two = pd.DataFrame({
        "agg_trade_id": np.arange(2 * n), "price": np.column_stack((open_, close)).ravel(), "quantity": 1.0, "trade_time": np.column_stack((t, t + 30000)).ravel(),
        "is_buyer_maker": ["false", "true"] * n,
    })
    return spark.createDataFrame(two), spark.createDataFrame(bars)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    end = M0 + 1500 * 60000
    folds = [D.Fold("fold_1", M0 + 700 * 60000, M0 + 900 * 60000), D.Fold("fold_2", M0 + 900 * 60000, M0 + 1100 * 60000)]
    config = S.Config(horizon=180_000, history=(3, 5), future=(1, 3, 4), sample=1, test_start=end - 300 * 60000, folds=folds, features=NAMES, trees=E.TreeParams(rounds=3, max_depth=2, min_rows=5), early_stop_window=150 * 60000, patience=2)
    run = S.Run(spark, str(tmp_path_factory.mktemp("run")), config)
    return run


def test_stages_from_raw_rows_to_the_final_test(spark, run, tmp_path, monkeypatch):
    from tidewright.operators import features as FE

    trades, bars = raw_tables(spark)
    small = [c for c in ("has_history_240m", "has_future_61m")]
    run.clean(trades, bars)
    run.model_base()
    base = run.table("model_base")
    for c, have in zip(small, ("has_history_5m", "has_future_4m"), strict=True):
        base = base.withColumn(c, F.col(have))
    kept = spark.createDataFrame(base.toPandas())
    run.save(kept, "model_base")
    run.overlap()
    assert run.table("overlap").where("join_status <> 'both'").count() == 0
    run.labels()
    run.features()
    run.dataset()
    run.baselines(signal="log_return_3m")
    run.trees()
    assert S.revalidate(run) == []
    ranking = run.tune([E.TreeParams(name="a", rounds=2, max_depth=2, min_rows=5), E.TreeParams(name="b", rounds=2, max_depth=3, min_rows=5)]).collect()
    assert sorted(r["rank"] for r in ranking) == [1, 2]
    result = run.final(run.config.trees)
    assert result["sample_count"] > 200 and 0 <= result["roc_auc"] <= 1
    report = json.loads(open(run.at("reports/stage9.json")).read())
    assert report["facts"]["calibration"] in ("UNCALIBRATED", "PLATT", "ISOTONIC") and report["telemetry"]["total_seconds"] > 0
    assert FE.FEATURES[0] == "log_return_1m"
    assert report["facts"]["assessment"] in ("FAILED_FINAL_VALIDATION", "READY_FOR_RESEARCH_DEPLOYMENT", "WEAK_SIGNAL_RESEARCH_ONLY") and report["facts"]["gates"]["all_passed"]
    final = run.table("final_predictions")
    assert {r[0] for r in final.select("model_name").distinct().collect()} == {"trees_raw", "trees_calibrated", "prior", "momentum", "logistic"}
    assert run.table("final_metrics").count() == 5 * 19 and S.revalidate(run) == []
    assert json.loads(open(run.at("inference_manifest.json")).read())["calibration"] == report["facts"]["calibration"]
    kept = spark.createDataFrame(run.table("tree_predictions").toPandas())
    run.save(kept.withColumn("p_up", F.when(F.col("dataset_row_id") % 50 == 0, 0.99).otherwise(F.col("p_up"))), "tree_predictions")
    found = S.revalidate(run)
    assert "tree_predictions changed after the lock" in found and any("metric rows differ" in e for e in found)
    run.save(kept, "tree_predictions")


def test_a_changed_input_stops_the_final_test(spark, run, monkeypatch):
    calls = []

    def hashes():
        calls.append(1)
        return {"dataset": str(len(calls))}

    monkeypatch.setattr(run, "input_hashes", hashes)
    with pytest.raises(ValidationError) as e:
        run.final(run.config.trees)
    assert "changed after the lock" in str(e.value.errors)


def test_audit(spark, run, tmp_path):
    trades, bars = raw_tables(spark, 20)
    for df, name in ((trades, "t"), (bars, "b")):
        df.toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    run.audit(str(tmp_path / "t.csv"), str(tmp_path / "b.csv"))
    assert run.table("audit/bars").count() == 11
    assert "milliseconds" in open(run.at("reports/stage0.md")).read()


def test_manifests_and_config():
    m = MF.feature_manifest(["a", "b"])
    assert MF.check_manifest(m, ["b", "a", "c"]) == ["a", "b"]
    with pytest.raises(ValidationError) as e:
        MF.check_manifest(m | {"names": ["b", "a", "z"]}, ["a"])
    assert len(e.value.errors) == 3
    with pytest.raises(ValidationError):
        MF.feature_manifest(["a", "a"])
    with pytest.raises(ValidationError):
        MF.feature_manifest(["future_return"])
    assert MF.window_of("volume_ratio_5_60") == 60 and MF.family("ema_distance_5") == "trend" and len(MF.feature_dictionary()) == 63
    with pytest.raises(ValidationError) as e:
        S.Config(horizon=61_000, folds=[D.Fold("x", 5, 4)], test_start=0).check()
    assert len(e.value.errors) == 3
