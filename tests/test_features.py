import math

import numpy as np
import pandas as pd
import pytest

from tidewright.operators import clean as C
from tidewright.operators import features as FE

SUNDAY = 1_641_600_000_000  # 2022-01-08T00:00Z, a Saturday


def frame(n, start=SUNDAY, flat=False, seed=0):
    rng = np.random.default_rng(seed)
    close = 100 + (np.zeros(n) if flat else np.cumsum(rng.standard_normal(n) * 0.3) + 20)
    open_ = close if flat else close + rng.standard_normal(n) * 0.05
    spread = 0 if flat else 0.2
    quote = np.zeros(n) if flat else rng.uniform(50, 400, n)
    return pd.DataFrame({
        "open_time": start + np.arange(n) * 60000, "open": open_, "high": np.maximum(open_, close) + spread, "low": np.minimum(open_, close) - spread, "close": close,
        "volume": 0.0 if flat else quote / close, "quote_volume": quote, "number_of_trades": 0 if flat else rng.integers(1, 50, n), "taker_buy_base_volume": 0.0,
        "taker_buy_quote_volume": quote * rng.uniform(0, 1, n),
    })


def computed(spark, pdf, block=FE.BLOCK, halo=FE.HALO):
    bars = spark.createDataFrame(pdf.astype({"number_of_trades": "int64"}))
    out = FE.features(C.with_positions(C.segments(bars, 60000), 60000), block, halo)
    return out.select("open_time", "continuity_segment_id", *FE.FEATURES).toPandas().sort_values("open_time", ignore_index=True)


def test_against_pandas(spark):
    pdf = frame(330)
    got = computed(spark, pdf)
    c, h, lo, o, q = pdf["close"], pdf["high"], pdf["low"], pdf["open"], pdf["quote_volume"]
    lr = np.log(c / c.shift(1))
    tr = pd.concat([h - lo, (h - c.shift(1)).abs(), (lo - c.shift(1)).abs()], axis=1).max(axis=1)
    atr = tr.rolling(14).mean()
    up, down = (lr.clip(lower=0) ** 2).rolling(60).sum(), (lr.clip(upper=0) ** 2).rolling(60).sum()
    ema = c.ewm(span=20, adjust=False).mean()
    slope = c.rolling(60).apply(lambda y: np.polyfit(np.arange(60), y, 1)[0]) / c.rolling(60).mean()
    ratio = pdf["taker_buy_quote_volume"] / q
    want = {
        "log_return_15m": np.log(c / c.shift(15)), "efficiency_ratio_60m": (c - c.shift(60)).abs() / c.diff().abs().rolling(60).sum(), "realized_volatility_30m": lr.rolling(30).std(ddof=0),
        "normalized_atr_14": atr / c, "semivariance_imbalance_60m": (up - down) / (up + down), "ema_distance_20": ((c - ema) / atr).where(np.arange(330) >= 19),
        "normalized_slope_60m": slope, "range_position_120m": (c - lo.rolling(120).min()) / (h.rolling(120).max() - lo.rolling(120).min()),
        "vwap_distance_60m": (c - q.rolling(60).sum() / pdf["volume"].rolling(60).sum()) / atr, "signed_body_mean_5m": ((c - o) / (h - lo)).rolling(5).mean(),
        "log_quote_volume_zscore_60m": (np.log1p(q) - np.log1p(q).rolling(60).mean()) / np.log1p(q).rolling(60).std(ddof=0),
        "taker_buy_quote_ratio_15m": pdf["taker_buy_quote_volume"].rolling(15).sum() / q.rolling(15).sum(), "buy_pressure_std_15m": ratio.rolling(15).std(ddof=0),
        "buy_pressure_persistence_15m": (ratio > 0.5).astype(float).rolling(15).mean(),
    }
    for name, series in want.items():
        x, y = got[name].to_numpy(dtype=float), series.to_numpy(dtype=float)
        assert np.array_equal(np.isnan(x), np.isnan(y)), name
        assert np.nanmax(np.abs(x - y)) < 1e-9, name


def test_blocks_with_halos_change_nothing(spark):
    pdf = frame(700, seed=3)
    whole, cut = computed(spark, pdf), computed(spark, pdf, block=600, halo=599)
    names = [n for n in FE.FEATURES if not n.startswith("ema")]
    assert np.nanmax(np.abs(whole[names].to_numpy(dtype=float) - cut[names].to_numpy(dtype=float))) < 1e-9
    assert np.nanmax(np.abs(whole["ema_distance_60"] - cut["ema_distance_60"])) < 1e-6
    assert len(cut) == 700


def test_flat_bars_are_neutral(spark):
    got = computed(spark, frame(150, flat=True)).iloc[130]
    want = {
        "efficiency_ratio_60m": 0, "volatility_ratio_5_60": 1, "normalized_atr_14": 0, "semivariance_imbalance_60m": 0, "range_position_60m": 0.5, "support_distance_60m": 0,
        "resistance_distance_60m": 0, "vwap_distance_60m": 0, "signed_body_ratio": 0, "upper_wick_ratio": 0, "close_location": 0.5, "is_zero_volume_1m": 1, "volume_ratio_5_60": 0,
        "taker_buy_quote_ratio_1m": 0.5, "taker_buy_quote_ratio_60m": 0.5, "log_quote_volume_zscore_60m": 0, "log_trade_count_zscore_60m": 0,
    }
    assert {n: got[n] for n in want} == want


def test_segments_do_not_share_windows(spark):
    a, b = frame(80), frame(130, start=SUNDAY + 200 * 60000, seed=9)
    got = computed(spark, pd.concat([a, b], ignore_index=True))
    first = got[got["continuity_segment_id"] == 1].iloc[0]
    assert math.isnan(first["log_return_120m"]) and math.isnan(first["normalized_slope_60m"])


@pytest.mark.parametrize("cut", [255])
def test_prefix_and_future_invariance(spark, cut):
    pdf = frame(300, seed=5)
    whole, prefix = computed(spark, pdf), computed(spark, pdf.iloc[:cut])
    other = pdf.copy()
    other.loc[cut:, ["open", "high", "low", "close"]] *= 3
    changed = computed(spark, other)
    for t in (prefix, changed):
        x, y = whole[FE.FEATURES].iloc[cut - 1].to_numpy(dtype=float), t[FE.FEATURES].iloc[cut - 1].to_numpy(dtype=float)
        assert np.allclose(x, y, atol=1e-9, equal_nan=True)


def test_table_and_calendar(spark):
    bars = C.with_positions(C.segments(spark.createDataFrame(frame(310).astype({"number_of_trades": "int64"})), 60000), 60000)
    table = FE.feature_table(FE.features(bars)).toPandas().sort_values("decision_time")
    row = table.iloc[0]
    assert row["is_weekend"] == 1 and math.isclose(row["time_sin"], math.sin(2 * math.pi * 5 / 1440), rel_tol=1e-6)
    assert len(FE.FEATURES) == len(set(FE.FEATURES)) == 63 and table["is_feature_complete"].iloc[-1] and not table["is_feature_complete"].iloc[0]
