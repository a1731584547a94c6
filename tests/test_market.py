import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.operators import bars as B
from tidewright.operators import checks as K
from tidewright.operators import clean as C
from tidewright.operators import labels as L
from tidewright.operators import ordered as O
from tidewright.schema import BAR, ValidationError, assert_schema, assert_unique, schema_errors

M0 = 1_662_076_800_000
BARS = "open_time long, open double, high double, low double, close double, volume double, quote_volume double, close_time long"


def test_clean_bars(spark):
    rows = [
        (0, 100, 105, 99, 101, 1, 59999), (60000, 101, 106, 100, 102, 1, 119999), (60000, 102, 107, 101, 103, 2, 119999), (120000, 0, 105, 0, 101, 1, 179999),
        (180000, 101, 105, 99, 102, -1, 239999), (240000, 101, 100, 99, 102, 1, 299999), (300000, 103, 104, 102, 103, 1, 333333), (360000, 103, 105, 102, 104, 1, 419999), (540000, 104, 106, 103, 105, 1, 599999),
    ]
    raw = spark.createDataFrame([(t, *map(float, (o, h, lo, c, v, 1)), ct, k) for k, (t, o, h, lo, c, v, ct) in enumerate(rows)], BARS + ", _ord long")
    done = C.clean_bars(raw)
    got = {r["open_time"]: r for r in done.rows.collect()}
    assert sorted(got) == [0, 60000, 300000, 360000, 540000] and got[60000]["close"] == 103
    counts = done.counts.first()
    assert (counts["distinct_times"], counts["non_positive_price"], counts["negative_volume"]) == (8, 1, 1) and counts["bad_price_order"] >= 1
    assert [tuple(r) for r in done.side["repairs"].collect()] == [(300000, 333333, 359999)]
    assert got[300000]["continuity_segment_id"] == got[360000]["continuity_segment_id"] != got[540000]["continuity_segment_id"]
    assert got[540000]["gap_before_bars"] == 2 and done.side["gaps"].count() == 2
    assert C.longest_segment(done.rows).first()["bars"] == 2


def test_clean_trades(spark):
    rows = [
        (1, 100, 1, 1000, "False"), (2, 101, 1, 1001, "True"), (2, 102, 2, 1002, "0"), (4, 103, 1, 1002, "1"), (5, 0, 1, 1003, "false"), (6, 104, 0, 1004, "TRUE"),
        (7, 105, 1, 1005, "not_bool"), (8, 106, 1, 70000, "FALSE"),
    ]
    raw = spark.createDataFrame([(i, float(p), float(q), t, m, k) for k, (i, p, q, t, m) in enumerate(rows)], "agg_trade_id long, price double, quantity double, trade_time long, is_buyer_maker string, _ord long")
    done = C.clean_trades(raw)
    got = {r["agg_trade_id"]: r for r in done.rows.collect()}
    assert sorted(got) == [1, 2, 4, 8] and got[2]["price"] == 102 and got[2]["is_active_buy"] and not got[2]["is_buyer_maker"]
    assert got[4]["is_active_sell"] and got[4]["id_gap_before"] == 1 and done.counts.first()["bad_maker_flag"] == 1
    assert done.side["same_time"].first()["groups"] == 1 and C.long_quiet(done.rows, 60000).first()["intervals"] == 1


def minute_bars(spark, n, start=M0, skip=()):
    rows = [(start + k * 60000, 100.0, 101.0, 99.0, 100.5, 1.0, 100.0, start + k * 60000 + 59999) for k in range(n) if k not in skip]
    return spark.createDataFrame(rows, BARS)


def test_positions_at_the_borders(spark):
    bars = C.with_positions(C.segments(minute_bars(spark, 305), 60000), 60000)
    got = {r["segment_row_number"]: r for r in bars.collect()}
    assert not got[238]["has_history_240m"] and got[239]["has_history_240m"] and got[243]["has_future_61m"] and not got[244]["has_future_61m"]
    assert got[239]["is_model_candidate"] and not got[244]["is_model_candidate"] and got[4]["is_prediction_time_5m"] and not got[5]["is_prediction_time_5m"]


def test_short_steps_open_segments(spark):
    times = [0, 60000, 90000, 150000, 330000]
    bars = C.segments(spark.createDataFrame([(t,) for t in times], "open_time long"), 60000)
    assert [(r["continuity_segment_id"], r["gap_before_bars"]) for r in bars.orderBy("open_time").collect()] == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2)]


@pytest.mark.parametrize("width", [1, 7, 10**6])
def test_global_order_in_buckets(spark, width):
    rows = [(k * k % 97, k) for k in range(80)]
    df = spark.createDataFrame(rows, "t long, i long")
    want = sorted(rows)
    got = O.running_sum(O.global_lag(df, "t", ["i"], {"before": "i"}, width), "t", ["i"], F.col("i"), "total", width)
    got = O.row_numbers(got, "t", ["i"], "n", width).orderBy("t", "i").collect()
    total = 0
    for k, r in enumerate(got):
        total += want[k][1]
        assert (r["t"], r["i"], r["n"], r["total"], r["before"]) == (*want[k], k, total, want[k - 1][1] if k else None)


def trades(spark, rows):
    t = spark.createDataFrame([(i, float(p), float(q), at, m) for i, p, q, at, m in rows], "agg_trade_id long, price double, quantity double, trade_time long, is_buyer_maker boolean")
    t = t.withColumns({"quote_quantity": F.col("price") * F.col("quantity"), "is_active_buy": ~F.col("is_buyer_maker"), "is_active_sell": F.col("is_buyer_maker")})
    return C.with_id_gaps(t)


def test_trade_bars(spark):
    rows = [(1, 100, 1, M0, True), (2, 102, 2, M0 + 999, False), (4, 104, 1, M0 + 5000, False), (5, 106, 1, M0 + 55000, True), (8, 110, 1, M0 + 60000, True), (9, 112, 1, M0 + 119999, True)]
    a, b = B.boundary_flags(B.aggregate_trades(trades(spark, rows))).orderBy("open_time").collect()
    assert (a["agg_trade_count"], a["base_volume"], a["quote_volume"], a["active_buy_base_volume"], a["active_sell_base_volume"]) == (4, 5, 514, 3, 2)
    assert math.isclose(a["trade_flow_imbalance_base"], 0.2) and math.isclose(a["trade_vwap"], 514 / 5)
    assert [a[f"{n}_trade_count"] for n in ("first_1s", "first_5s", "first_10s", "last_5s")] == [2, 2, 3, 1]
    assert (a["id_gap_event_count"], a["internal_missing_agg_trade_id_count"]) == (1, 1) and (b["cross_minute_id_gap_event_count"], b["cross_minute_missing_agg_trade_id_count"]) == (1, 2)
    assert a["is_first_bar_of_file"] and b["is_last_bar_of_file"]
    same = B.aggregate_trades(trades(spark, [(1, 100, 1, M0, True), (2, 101, 1, M0, True)])).first()
    assert same["agg_trade_count"] == 2 and same["active_buy_vwap"] is None and same["active_sell_vwap"] == 100.5


def test_reconcile(spark):
    agg = B.boundary_flags(B.aggregate_trades(trades(spark, [(1, 100, 1, M0, False), (2, 101, 1, M0 + 1000, True), (3, 102, 1, M0 + 55000, False), (4, 200, 1, M0 + 60000, False)])))
    other = spark.createDataFrame([(M0, 100.0, 102.0, 100.0, 102.0, 3.0, 303.0, 3, 2.0, 202.0), (M0 + 60000, 200.0, 200.0, 200.0, 200.0, 1.0, 200.0, 1, 1.0, 200.0), (M0 + 600000, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1.0, 1.0)], BAR)
    rows = B.reconcile(agg, other).orderBy("open_time").collect()
    assert [r["join_status"] for r in rows] == ["both", "both"] and rows[0]["base_volume_relative_error"] == 0 and rows[0]["first_price_minus_open_bps"] == 0
    assert not rows[0]["is_reliable_overlap_minute"] and rows[0]["volume_match_good"]
    assert [r["join_status"] for r in B.reconcile(agg, other.where(F.col("open_time") == M0)).orderBy("open_time").collect()] == ["both", "agg_only"]
    kinds = {(r["grouping"], r["bucket"]): r["bars"] for r in B.bucketed_gaps(agg, F.lit(3), F.lit(1.0)).collect()}
    assert len(kinds) == 7 and kinds[("missing_ids", "1-5")] == 2 and kinds[("missing_ids", ">100")] == 0


def label_bars(spark, rows):
    schema = "open_time long, open double, continuity_segment_id long, decision_time long, is_prediction_time_5m boolean, is_model_candidate boolean, has_future_61m boolean"
    return spark.createDataFrame([(t, float(o) if o is not None else None, s, t + 60000, p, p, p) for t, o, s, p in rows], schema)


def test_labels(spark):
    bars = label_bars(spark, [(M0 - 60000, 1, 0, True), (M0, 100, 0, False), (M0 + 120000, 999, 0, False), (M0 + 3_600_000, 101, 0, False)])
    r = L.full_labels(bars).collect()
    assert len(r) == 1 and (r[0]["entry_price_proxy"], r[0]["settlement_price_proxy"], r[0]["label_up_60m"]) == (100, 101, 1) and math.isclose(r[0]["future_simple_return_60m"], 0.01)
    crossing = label_bars(spark, [(M0 - 60000, 1, 0, True), (M0, 100, 0, False), (M0 + 3_600_000, 101, 1, False)])
    r = L.full_labels(crossing).first()
    assert not r["is_valid_proxy_label"] and r["label_up_60m"] is None and L.invalid_details(L.full_labels(crossing)).first()["crosses_segments"]
    with pytest.raises(ValidationError):
        L.full_labels(crossing, strict=True)


@pytest.mark.parametrize("settle,bps,bucket,weight,label", [(100.05, 5.0, "[5, 10)", 0.5, 1), (99.975, 2.5, "[2.5, 5)", 0.25, 0), (100.0, 0.0, "[0, 1)", 0.25, 0)])
def test_margins(spark, settle, bps, bucket, weight, label):
    r = L.full_labels(label_bars(spark, [(M0 - 60000, 1, 0, True), (M0, 100, 0, False), (M0 + 3_600_000, settle, 0, False)])).first()
    assert (r["abs_future_return_bps_60m"], r["margin_bucket"], r["margin_sample_weight"], r["label_up_60m"]) == (bps, bucket, weight, label)
    assert r["boundary_risk_2_5bps"] == (bps < 2.5) and r["boundary_risk_10bps"] == (bps < 10)


def test_margin_bucket_edges(spark):
    values = [0, 0.999, 1, 2.5, 5, 10, 25, 50, None]
    got = [r[0] for r in spark.createDataFrame([(None if v is None else float(v), k) for k, v in enumerate(values)], "v double, k int").orderBy("k").select(X.margin_bucket(F.col("v"))).collect()]
    assert got == ["[0, 1)", "[0, 1)", "[1, 2.5)", "[2.5, 5)", "[5, 10)", "[10, 25)", "[25, 50)", "[50, +inf)", None]


def test_agreement(spark):
    rows = [(1, 1)] * 30 + [(0, 0)] * 20 + [(1, 0)] * 27 + [(0, 1)] * 23 + [(None, 1), (1, None)]
    r = L.agreement_by(spark.createDataFrame(rows, "a int, b int"), "a", "b", []).first()
    assert (r["n"], r["agree"], r["flips"], r["up_to_down"], r["down_to_up"]) == (100, 50, 50, 23, 27)
    assert math.isclose(r["wilson_low"], 0.4038315303659956, rel_tol=1e-9) and math.isclose(r["wilson_high"], 0.5961684696340044, rel_tol=1e-9)
    flat = L.agreement_by(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b", []).first()
    assert flat["kappa"] is None and flat["mcc"] is None


def test_spearman_with_ties(spark):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1.0, 2, 2, 3, 5, 8, 8, 8, None], "b": [2.0, 1, 4, 4, 6, 9, 7, 7, 3]})
    r = L.correlations(spark.createDataFrame([(None if pd.isna(a) else a, b) for a, b in pdf.itertuples(index=False)], "a double, b double"), "a", "b").first()
    ranks = pdf.dropna().rank()
    assert r["n"] == 8 and math.isclose(r["spearman"], ranks["a"].corr(ranks["b"]), rel_tol=1e-9)


def test_constraints(spark):
    good = C.segments(minute_bars(spark, 5).withColumns({"taker_buy_base_volume": F.lit(0.5)}), 60000)
    K.require(good, K.bar_suite(60000))
    bad = good.withColumn("taker_buy_base_volume", F.lit(2.0)).withColumn("high", F.lit(1.0))
    with pytest.raises(ValidationError) as e:
        K.require(bad, K.bar_suite(60000))
    assert len(e.value.errors) == 3
    assert K.forbidden_fields(["close", "future_x", "has_future_61m", "label_up_60m"]) == ["future_x", "label_up_60m"]
    with pytest.raises(ValidationError):
        assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    with pytest.raises(ValidationError):
        assert_schema(good, BAR)
    assert schema_errors(spark.createDataFrame([], BAR), BAR) == []
    assert [r[0] for r in K.same_ids(spark.range(3), spark.range(1, 5), "id").select("only_first").collect()] == [1]


def test_scalars(spark):
    r = spark.range(1).select(
        X.parse_bool(F.lit(" TRUE ")).alias("t"), X.parse_bool(F.lit("0")).alias("f"), X.parse_bool(F.lit("not_bool")).alias("n"), X.number(F.lit("1e3")).alias("x"), X.number(F.lit("NaN")).alias("nan"),
        X.neutral_div(F.lit(1.0), F.lit(0.0), F.lit(False), 7.0).alias("null"), X.neutral_div(F.lit(1.0), F.lit(2.0), F.lit(True), 7.0).alias("seven"),
        X.utc_text(F.lit(M0)).alias("utc"), X.utc_millis(F.lit("2022-09-02T00:00:00Z")).alias("ms"), X.epoch_unit(F.lit(1_662_076_800)).alias("unit"),
        X.reasons([(F.lit(True), "A"), (F.lit(False), "B"), (F.lit(True), "A"), (F.lit(None).cast("boolean"), "C")]).alias("why"), X.abs_bps(F.lit(-0.00025)).alias("bps"),
    ).first()
    assert (r["t"], r["f"], r["n"], r["x"], r["nan"], r["null"], r["seven"], r["utc"], r["ms"], r["unit"], r["why"], r["bps"]) == (True, False, None, 1000.0, None, None, 7.0, "2022-09-02T00:00:00Z", M0, "seconds", "A", 2.5)


@pytest.mark.parametrize("width", [60_000, 180_000, 10**9])
def test_runs_in_any_buckets(spark, width):
    times = [M0 + k * 60_000 for k in (0, 1, 2, 5, 6, 6.5, 7, 20, 21, 40)]
    got = sorted((r["t"], r["previous"], r["run"]) for r in O.runs(spark.createDataFrame([(int(t),) for t in times], "t long"), "t", 60_000, width).collect())
    want, run = [], 0
    for k, t in enumerate(times):
        run += k > 0 and t - times[k - 1] != 60_000
        want.append((int(t), int(times[k - 1]) if k else None, run))
    assert got == want and O.runs(spark.createDataFrame([], "t long"), "t", 60_000).count() == 0


def test_even_width(spark):
    df = spark.range(0, 10_000)
    assert O.even_width(df, "id") == 100 and O.even_width(df.limit(0), "id") == 1 and O.even_width(df.limit(1), "id") == 1


def test_a_stored_table_is_computed_once(spark):
    from tidewright.sources.scratch import stored

    t = stored(spark.range(5).withColumn("x", F.rand()), "t")
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, t.collect())) and "Rand" not in t._jdf.queryExecution().toString()
