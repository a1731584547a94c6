"""The 63 trailing-window features of a bar, computed per gap-free segment without look-ahead.

Segments are cut into blocks of positions with a halo of earlier rows (ordered.haloed), so that one long segment is
dealt to many tasks. Windows count bars; a window is NULL until it is full. The exponential averages, the one recursive
measure, are folded in Python along each block: the halo is long enough that its seed has no weight left in a double.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import exprs as X
from .ordered import haloed

EMA_SPANS = (5, 20, 60, 120)
#: (1 - 2 / 121) ** 4096 is below 1e-29.
BLOCK, HALO = 131_072, 4096

#: The features' names in their contractual order.
FEATURES = [
    "log_return_1m", "log_return_3m", "log_return_5m", "log_return_10m", "log_return_15m", "log_return_30m", "log_return_60m", "log_return_120m",
    "momentum_acceleration_5_30", "momentum_acceleration_15_60", "efficiency_ratio_15m", "efficiency_ratio_60m", "up_candle_ratio_15m",
    "realized_volatility_5m", "realized_volatility_15m", "realized_volatility_30m", "realized_volatility_60m", "realized_volatility_120m",
    "volatility_ratio_5_60", "volatility_ratio_15_120", "normalized_atr_14", "normalized_atr_60", "semivariance_imbalance_60m",
    "ema_distance_5", "ema_distance_20", "ema_distance_60", "ema_distance_120", "ema_spread_5_20", "ema_spread_20_60",
    "normalized_slope_15m", "normalized_slope_60m", "range_position_30m", "range_position_60m", "range_position_120m",
    "support_distance_60m", "resistance_distance_60m", "vwap_distance_60m", "signed_body_ratio", "absolute_body_ratio",
    "upper_wick_ratio", "lower_wick_ratio", "close_location", "signed_body_mean_5m", "upper_wick_mean_15m", "lower_wick_mean_15m",
    "is_zero_volume_1m", "log_quote_volume_zscore_60m", "volume_ratio_5_60", "volume_ratio_15_60", "taker_buy_quote_ratio_1m",
    "taker_buy_quote_ratio_5m", "taker_buy_quote_ratio_15m", "taker_buy_quote_ratio_60m", "buy_pressure_change_5_60",
    "buy_pressure_persistence_15m", "buy_pressure_std_15m", "log_trade_count_zscore_60m", "log_avg_trade_quote_size_zscore_60m",
    "time_sin", "time_cos", "weekday_sin", "weekday_cos", "is_weekend",
]


def with_emas(blocks: DataFrame, keys: list[str], spans: tuple[int, ...] = EMA_SPANS) -> DataFrame:
    """blocks with ema_<span> of close: e = a x + (1 - a) e', a = 2 / (span + 1), seeded with the block's first close.

    Whole blocks lie in order in their partitions, and only the last averages are carried from batch to batch, so that
    neither the length of a block nor the number of short ones costs memory or calls.
    """
    schema = StructType(list(blocks.schema.fields))
    for s in spans:
        schema.add(f"ema_{s}", "double")
    names = [f"ema_{s}" for s in spans]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        held: list[float] = []
        for pdf in batches:
            if not len(pdf):
                continue
            at = pdf[keys].to_numpy()
            starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            close = pdf["close"].to_numpy(dtype=np.float64).tolist()
            out: list[list[float]] = [[] for _ in spans]
            for low, high in zip(starts, starts[1:]):
                same = tuple(at[low]) == last
                for k, span in enumerate(spans):
                    a = 2 / (span + 1)
                    run = accumulate(close[low:high], lambda e, x, a=a: a * x + (1 - a) * e, initial=held[k] if same else None)
                    out[k] += islice(run, 1, None) if same else run
                last, held = tuple(at[low]), [x[-1] for x in out]
            yield pdf.assign(**dict(zip(names, out, strict=True)))

    return blocks.repartition(*keys).sortWithinPartitions(*keys, "open_time").mapInPandas(fold, schema)


class Rolling:
    """Window expressions over the last k rows of a block; NULL until k values are there."""

    def __init__(self, keys: list[str], order: str = "open_time"):
        self.run = Window.partitionBy(*keys).orderBy(order)

    def lag(self, c: str, k: int = 1) -> Column:
        return F.lag(c, k).over(self.run)

    def full(self, c: str, k: int, aggregate) -> Column:
        w = self.run.rowsBetween(-(k - 1), 0)
        return F.when(F.count(c).over(w) == k, aggregate(c).over(w))

    def sum(self, c: str, k: int) -> Column:
        return self.full(c, k, F.sum)

    def mean(self, c: str, k: int) -> Column:
        return self.full(c, k, F.avg)

    def std(self, c: str, k: int) -> Column:
        return self.full(c, k, F.stddev_pop)

    def high(self, c: str, k: int) -> Column:
        return self.full(c, k, F.max)

    def low(self, c: str, k: int) -> Column:
        return self.full(c, k, F.min)


def zero(c: str | Column) -> Column:
    return F.coalesce(X.col(c) == 0, F.lit(False))


def features(bars: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """bars (see clean.with_positions) with the 63 features as doubles. Four layers of expressions, one window each."""
    keys = ["continuity_segment_id", "_block"]
    df = with_emas(haloed(bars, "segment_row_number", block, halo), keys)
    r = Rolling(keys)
    c, o, h, l = (F.col(x).cast("double") for x in ("close", "open", "high", "low"))
    q, v, n = (F.col(x).cast("double") for x in ("quote_volume", "volume", "number_of_trades"))
    body = h - l
    flat = zero(body)
    t = F.timestamp_millis("decision_time")
    minute, day = F.hour(t) * 60 + F.minute(t), F.weekday(t)
    base = {
        "_prev": r.lag("close"),
        "_up": (c > o).cast("double"),
        "signed_body_ratio": X.neutral_div(c - o, body, flat, 0.0),
        "absolute_body_ratio": X.neutral_div(F.abs(c - o), body, flat, 0.0),
        "upper_wick_ratio": X.neutral_div(h - F.greatest(o, c), body, flat, 0.0),
        "lower_wick_ratio": X.neutral_div(F.least(o, c) - l, body, flat, 0.0),
        "close_location": X.neutral_div(c - l, body, flat, 0.5),
        "is_zero_volume_1m": (zero("volume") | zero("quote_volume")).cast("int"),
        "_log_quote": F.log1p(q),
        "taker_buy_quote_ratio_1m": X.neutral_div(F.col("taker_buy_quote_volume"), q, zero("quote_volume"), 0.5),
        "_log_count": F.log1p(n),
        "_log_size": F.log1p(X.neutral_div(q, n, zero("number_of_trades"), 0.0)),
        "_row": F.col("segment_row_number").cast("double"),
        "time_sin": F.sin(2 * math.pi * minute / 1440),
        "time_cos": F.cos(2 * math.pi * minute / 1440),
        "weekday_sin": F.sin(2 * math.pi * day / 7),
        "weekday_cos": F.cos(2 * math.pi * day / 7),
        "is_weekend": (day >= 5).cast("int"),
    }
    base |= {f"log_return_{k}m": X.log_return(c, r.lag("close", k)) for k in (1, 3, 5, 10, 15, 30, 60, 120)}
    base |= {f"_move_{k}": F.abs(c - r.lag("close", k)) for k in (1, 15, 60)}
    df = df.withColumns(base)

    lr = F.col("log_return_1m")
    df = df.withColumns({
        "_range": F.when(F.col("_prev").isNull(), h - l).otherwise(F.greatest(h - l, F.abs(h - F.col("_prev")), F.abs(l - F.col("_prev")))),
        "_gain2": F.when(lr.isNotNull(), F.pow(F.greatest(lr, F.lit(0.0)), F.lit(2))),
        "_loss2": F.when(lr.isNotNull(), F.pow(F.least(lr, F.lit(0.0)), F.lit(2))),
        "_buys": F.coalesce((F.col("taker_buy_quote_ratio_1m") > 0.5).cast("double"), F.lit(0.0)),
        "_row_close": F.col("_row") * c,
    })

    rolled = {
        "_path_15": r.sum("_move_1", 15), "_path_60": r.sum("_move_1", 60), "up_candle_ratio_15m": r.mean("_up", 15),
        **{f"realized_volatility_{k}m": r.std("log_return_1m", k) for k in (5, 15, 30, 60, 120)},
        "_atr_14": r.mean("_range", 14), "_atr_60": r.mean("_range", 60), "_gains": r.sum("_gain2", 60), "_losses": r.sum("_loss2", 60),
        **{f"_sum_close_{k}": r.sum("close", k) for k in (15, 60)}, **{f"_sum_row_close_{k}": r.sum("_row_close", k) for k in (15, 60)},
        **{f"_high_{k}": r.high("high", k) for k in (30, 60, 120)}, **{f"_low_{k}": r.low("low", k) for k in (30, 60, 120)},
        "_volume_60": r.sum("volume", 60), **{f"_quote_{k}": r.sum("quote_volume", k) for k in (5, 15, 60)},
        **{f"_taker_{k}": r.sum("taker_buy_quote_volume", k) for k in (5, 15, 60)},
        "signed_body_mean_5m": r.mean("signed_body_ratio", 5), "upper_wick_mean_15m": r.mean("upper_wick_ratio", 15), "lower_wick_mean_15m": r.mean("lower_wick_ratio", 15),
        "buy_pressure_persistence_15m": r.mean("_buys", 15), "buy_pressure_std_15m": r.std("taker_buy_quote_ratio_1m", 15),
        **{f"_mean{x}": r.mean(x, 60) for x in ("_log_quote", "_log_count", "_log_size")}, **{f"_std{x}": r.std(x, 60) for x in ("_log_quote", "_log_count", "_log_size")},
    }
    df = df.withColumns(rolled)

    def over_atr(top: Column) -> Column:
        return X.neutral_div(top, F.col("_atr_14"), zero(top) & zero("_atr_14"), 0.0)

    def slope(k: int) -> Column:
        xs, xx = k * (k - 1) / 2, (k - 1) * k * (2 * k - 1) / 6
        y = F.col(f"_sum_close_{k}")
        xy = F.col(f"_sum_row_close_{k}") - (F.col("_row") - (k - 1)) * y
        b = (k * xy - xs * y) / (k * xx - xs * xs)
        return X.neutral_div(b, y / k, zero(b) & zero(y / k), 0.0)

    def zscore(x: str) -> Column:
        return X.neutral_div(F.col(x) - F.col(f"_mean{x}"), F.col(f"_std{x}"), zero(f"_std{x}"), 0.0)

    row = F.col("segment_row_number")
    vwap = X.neutral_div(F.col("_quote_60"), F.col("_volume_60"), zero("_volume_60"), None)
    final = {
        "momentum_acceleration_5_30": F.col("log_return_5m") / 5 - F.col("log_return_30m") / 30,
        "momentum_acceleration_15_60": F.col("log_return_15m") / 15 - F.col("log_return_60m") / 60,
        **{f"efficiency_ratio_{k}m": X.neutral_div(F.col(f"_move_{k}"), F.col(f"_path_{k}"), zero(f"_path_{k}") & zero(f"_move_{k}"), 0.0) for k in (15, 60)},
        **{f"volatility_ratio_{a}_{b}": X.neutral_div(F.col(f"realized_volatility_{a}m"), F.col(f"realized_volatility_{b}m"), zero(f"realized_volatility_{a}m") & zero(f"realized_volatility_{b}m"), 1.0) for a, b in ((5, 60), (15, 120))},
        **{f"normalized_atr_{k}": X.neutral_div(F.col(f"_atr_{k}"), c, zero(f"_atr_{k}") & zero("close"), 0.0) for k in (14, 60)},
        "semivariance_imbalance_60m": X.neutral_div(F.col("_gains") - F.col("_losses"), F.col("_gains") + F.col("_losses"), zero("_gains") & zero("_losses"), 0.0),
        **{f"ema_distance_{s}": F.when(row >= s - 1, over_atr(c - F.col(f"ema_{s}"))) for s in EMA_SPANS},
        "ema_spread_5_20": F.when(row >= 19, over_atr(F.col("ema_5") - F.col("ema_20"))),
        "ema_spread_20_60": F.when(row >= 59, over_atr(F.col("ema_20") - F.col("ema_60"))),
        "normalized_slope_15m": slope(15),
        "normalized_slope_60m": slope(60),
        **{f"range_position_{k}m": X.neutral_div(c - F.col(f"_low_{k}"), F.col(f"_high_{k}") - F.col(f"_low_{k}"), zero(F.col(f"_high_{k}") - F.col(f"_low_{k}")), 0.5) for k in (30, 60, 120)},
        "support_distance_60m": over_atr(c - F.col("_low_60")),
        "resistance_distance_60m": over_atr(F.col("_high_60") - c),
        "vwap_distance_60m": F.when(zero("_volume_60"), F.lit(0.0)).otherwise(over_atr(c - vwap)),
        "log_quote_volume_zscore_60m": zscore("_log_quote"),
        **{f"volume_ratio_{k}_60": X.neutral_div(F.col(f"_quote_{k}") / k, F.col("_quote_60") / 60, zero("_quote_60"), 0.0) for k in (5, 15)},
        **{f"taker_buy_quote_ratio_{k}m": X.neutral_div(F.col(f"_taker_{k}"), F.col(f"_quote_{k}"), zero(f"_quote_{k}"), 0.5) for k in (5, 15, 60)},
        "log_trade_count_zscore_60m": zscore("_log_count"),
        "log_avg_trade_quote_size_zscore_60m": zscore("_log_size"),
    }
    df = df.withColumns(final).withColumn("buy_pressure_change_5_60", F.col("taker_buy_quote_ratio_5m") - F.col("taker_buy_quote_ratio_60m"))
    return df.where(~F.col("_halo")).select(*bars.columns, *[F.col(x).cast("double").alias(x) for x in FEATURES])


def feature_table(computed: DataFrame, names: list[str] = FEATURES, version: str = "v1") -> DataFrame:
    """The rows at prediction instants with metadata, missing counts and the features as floats."""
    out = computed.where("is_prediction_time_5m")
    missing = sum((F.col(x).isNull().cast("short") for x in names[1:]), F.col(names[0]).isNull().cast("short"))
    bad = X.any_of([F.isnan(x) | (F.abs(x) == float("inf")) for x in names])
    out = out.withColumns({"feature_set_version": F.lit(version), "feature_missing_count": missing.cast("short"), "has_nonfinite_feature": bad})
    out = out.withColumn("is_feature_complete", (F.col("feature_missing_count") == 0) & ~F.col("has_nonfinite_feature"))
    out = out.withColumn("is_final_feature_candidate", F.col("is_feature_complete") & F.col("is_model_candidate"))
    return out.select(
        F.col("open_time").alias("feature_open_time"), "decision_time", "continuity_segment_id", "segment_row_number", "has_history_240m", "has_future_61m",
        "is_prediction_time_5m", "is_model_candidate", "feature_set_version", "feature_missing_count", "has_nonfinite_feature", "is_feature_complete",
        "is_final_feature_candidate", *[F.col(x).cast("float").alias(x) for x in names],
    )


def long_form(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, value): columns turned into rows by one stack."""
    return df.select(*keys, *[F.col(x).cast("double").alias(x) for x in names]).unpivot(keys, names, "feature", "value")


def feature_summary(df: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    from .labels import distribution

    rows = long_form(df, names, ["decision_time"])
    parts = distribution(F.col("value"), (0.01, 0.25, 0.5, 0.75, 0.99))
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"), *[c.alias(n) for n, c in parts.items()])


def completeness(df: DataFrame, by: list[Column]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_feature_complete").alias("complete"), F.avg(F.col("feature_missing_count").cast("double")).alias("mean_missing")
    )


def neutral_counts(computed: DataFrame, bars_only: tuple[str, ...] = ("is_zero_volume_1m",)) -> DataFrame:
    """How often neutral values stand for undefined ratios, over all bars before sampling."""
    flat = F.col("high") - F.col("low") == 0
    return computed.agg(
        F.count_if(flat).alias("zero_candle_range"), F.count_if(F.col("is_zero_volume_1m") == 1).alias("zero_volume_1m"),
        F.count_if((F.col("efficiency_ratio_15m") == 0) & flat).alias("flat_efficiency_15m"),
        F.count_if(F.col("range_position_60m") == 0.5).alias("middle_range_position_60m"), F.count_if(F.col("taker_buy_quote_ratio_1m") == 0.5).alias("even_taker_ratio_1m"),
    )


def float_report(computed: DataFrame, names: list[str]) -> DataFrame:
    """What the cast of each feature to float loses: (feature, max_abs_error, max_rel_error, sign_changes, overflows)."""
    rows = long_form(computed, names, ["open_time"])
    x, y = F.col("value"), F.col("value").cast("float").cast("double")
    return rows.groupBy("feature").agg(
        F.max(F.abs(y - x)).alias("max_abs_error"), F.max(F.try_divide(F.abs(y - x), F.abs(x))).alias("max_rel_error"),
        F.count_if(F.signum(x) != F.signum(y)).alias("sign_changes"), F.count_if((F.abs(x) < float("inf")) & (F.abs(y) == float("inf"))).alias("overflows"),
    )


def range_checks(df: DataFrame, limits: dict[str, tuple[float, float]], tolerance: float = 1e-6) -> DataFrame:
    """(feature, violations) of values outside [low, high] by more than the tolerance."""
    rows = long_form(df, list(limits), ["decision_time"])
    low = F.create_map(*[x for n, (a, _) in limits.items() for x in (F.lit(n), F.lit(float(a)))])
    high = F.create_map(*[x for n, (_, b) in limits.items() for x in (F.lit(n), F.lit(float(b)))])
    v, f = F.col("value"), F.col("feature")
    return rows.groupBy("feature").agg(F.count_if((v < low[f] - tolerance) | (v > high[f] + tolerance)).alias("violations"))


def incomplete_samples(table: DataFrame, n: int = 200) -> DataFrame:
    return table.where("NOT is_feature_complete").orderBy("decision_time").limit(n).select("decision_time", "continuity_segment_id", "feature_missing_count")
