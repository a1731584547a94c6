"""Bars from trades in one grouped pass, and their reconciliation with bars of another source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

FIRST_SECONDS, LAST_SECONDS = (1, 2, 5, 10), (1, 5)


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def aggregate_trades(trades: DataFrame, interval: int = 60_000, first: tuple[int, ...] = FIRST_SECONDS, last: tuple[int, ...] = LAST_SECONDS, quantiles: bool = True) -> DataFrame:
    """Bars of clean trades (see clean.with_id_gaps), all measures in one groupBy with conditional aggregates.

    Prices first and last are by (time, id). Sums are pre-aggregated before the shuffle; exact quantiles gather
    counts of distinct sizes and can be left out.
    """
    t = trades.withColumns({"open_time": X.floor_to(F.col("trade_time"), interval), "_offset": F.pmod("trade_time", F.lit(interval))})
    at = F.struct("trade_time", "agg_trade_id")
    buy, sell = F.col("is_active_buy"), F.col("is_active_sell")
    base, quote, price = F.col("quantity"), F.col("quote_quantity"), F.col("price")
    same = F.coalesce(X.floor_to(F.col("previous_time"), interval) == F.col("open_time"), F.lit(False))
    inner, cross = F.when(same, F.col("id_gap_before")).otherwise(0), F.when(same, 0).otherwise(F.col("id_gap_before"))
    measures = {
        "agg_trade_count": F.count(F.lit(1)),
        "first_agg_trade_id": F.min_by("agg_trade_id", at),
        "last_agg_trade_id": F.max_by("agg_trade_id", at),
        "first_trade_price": F.min_by("price", at),
        "last_trade_price": F.max_by("price", at),
        "trade_high": F.max("price"),
        "trade_low": F.min("price"),
        "base_volume": F.sum(base),
        "quote_volume": F.sum(quote),
        "active_buy_base_volume": F.coalesce(F.sum(F.when(buy, base)), F.lit(0.0)),
        "active_sell_base_volume": F.coalesce(F.sum(F.when(sell, base)), F.lit(0.0)),
        "active_buy_quote_volume": F.coalesce(F.sum(F.when(buy, quote)), F.lit(0.0)),
        "active_sell_quote_volume": F.coalesce(F.sum(F.when(sell, quote)), F.lit(0.0)),
        "active_buy_trade_count": F.count_if(buy),
        "active_sell_trade_count": F.count_if(sell),
        "mean_trade_base_size": F.avg(base),
        "max_trade_base_size": F.max(base),
        "mean_trade_quote_size": F.avg(quote),
        "max_trade_quote_size": F.max(quote),
        "_price2": F.sum(price * price * base),
        "internal_missing_agg_trade_id_count": F.sum(inner),
        "id_gap_event_count": F.count_if(inner > 0),
        "maximum_internal_id_gap": F.max(inner),
        "cross_minute_missing_agg_trade_id_count": F.sum(cross),
        "cross_minute_id_gap_event_count": F.count_if(cross > 0),
        "maximum_cross_minute_id_gap": F.max(cross),
    }
    if quantiles:
        measures |= {f"_q_{n}": F.percentile(c, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))) for n, c in (("base", base), ("quote", quote))}
    windows = [(f"first_{s}s", F.col("_offset") < s * 1000) for s in first] + [(f"last_{s}s", F.col("_offset") >= interval - s * 1000) for s in last]
    for name, inside in windows:
        measures |= {f"{name}_trade_count": F.count_if(inside), f"_{name}_q": F.sum(F.when(inside, quote)), f"_{name}_b": F.sum(F.when(inside, base))}
    out = t.groupBy("open_time").agg(*[c.alias(n) for n, c in measures.items()])
    vwap = ratio(F.col("quote_volume"), F.col("base_volume"))
    out = out.withColumn("trade_vwap", vwap)
    derived = {
        "active_buy_vwap": ratio(F.col("active_buy_quote_volume"), F.col("active_buy_base_volume")),
        "active_sell_vwap": ratio(F.col("active_sell_quote_volume"), F.col("active_sell_base_volume")),
        "volume_weighted_price_std": F.sqrt(F.greatest(ratio(F.col("_price2"), F.col("base_volume")) - F.col("trade_vwap") * F.col("trade_vwap"), F.lit(0.0))),
        "price_range_ratio": ratio(F.col("trade_high") - F.col("trade_low"), F.col("first_trade_price")),
        "active_buy_base_ratio": ratio(F.col("active_buy_base_volume"), F.col("base_volume")),
        "active_buy_quote_ratio": ratio(F.col("active_buy_quote_volume"), F.col("quote_volume")),
        "trade_flow_imbalance_base": ratio(F.col("active_buy_base_volume") - F.col("active_sell_base_volume"), F.col("base_volume")),
        "trade_flow_imbalance_quote": ratio(F.col("active_buy_quote_volume") - F.col("active_sell_quote_volume"), F.col("quote_volume")),
        "has_internal_id_gap": F.col("id_gap_event_count") > 0,
        "has_any_id_gap": F.col("id_gap_event_count") + F.col("cross_minute_id_gap_event_count") > 0,
    }
    if quantiles:
        derived |= {f"{q}_trade_{n}_size": F.col(f"_q_{n}")[k] for n in ("base", "quote") for k, q in enumerate(("median", "p90", "p99"))}
    derived |= {f"vwap_{name}": ratio(F.col(f"_{name}_q"), F.col(f"_{name}_b")) for name, _ in windows}
    derived |= {f"has_trade_in_{name}": F.col(f"{name}_trade_count") > 0 for name, _ in windows if name in ("first_1s", "first_5s", "last_1s", "last_5s")}
    out = out.withColumns(derived)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def boundary_flags(bars: DataFrame) -> DataFrame:
    """Bars with the flags of the file's first and last bar, which may be partial."""
    ends = bars.agg(F.min("open_time").alias("_low"), F.max("open_time").alias("_high"))
    out = bars.crossJoin(F.broadcast(ends))
    out = out.withColumns({"is_first_bar_of_file": F.col("open_time") == F.col("_low"), "is_last_bar_of_file": F.col("open_time") == F.col("_high")})
    return out.withColumn("is_boundary_partial_minute", F.col("is_first_bar_of_file") | F.col("is_last_bar_of_file")).drop("_low", "_high")


def as_bars(agg: DataFrame) -> DataFrame:
    """Trade bars in the shape of exchange bars."""
    return agg.select(
        "open_time", F.col("first_trade_price").alias("open"), F.col("trade_high").alias("high"), F.col("trade_low").alias("low"), F.col("last_trade_price").alias("close"),
        F.col("base_volume").alias("volume"), "quote_volume", F.col("agg_trade_count").alias("number_of_trades"),
        F.col("active_buy_base_volume").alias("taker_buy_base_volume"), F.col("active_buy_quote_volume").alias("taker_buy_quote_volume"),
    )


OVERLAP_AGG = (
    "agg_trade_count", "first_trade_price", "last_trade_price", "trade_high", "trade_low", "trade_vwap", "first_5s_trade_count",
    "vwap_first_1s", "vwap_first_5s", "vwap_first_10s", "vwap_last_5s", "is_boundary_partial_minute",
)


def reconcile(agg: DataFrame, bars: DataFrame, epsilon: float = 1e-12, volume_limits: tuple[float, float] = (1e-6, 1e-3), price_limits: tuple[float, float] = (0.1, 1.0), rule: dict | None = None) -> DataFrame:
    """Trade bars and exchange bars of the trades' time range, joined in full, with errors, tiers and reliability."""
    rule = {"max_volume": volume_limits[1], "max_price_bps": price_limits[1], "exclude_boundary": True, "need_first_5s": True} | (rule or {})
    span = agg.agg(F.min("open_time").alias("_low"), F.max("open_time").alias("_high"))
    k = bars.join(F.broadcast(span), F.col("open_time").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
    k = k.select("open_time", *[F.col(c).alias(f"kline_{c}") for c in k.columns if c != "open_time"], F.lit(True).alias("_k"))
    volumes = ("base_volume", "quote_volume", "active_buy_base_volume", "active_buy_quote_volume")
    a = agg.select("open_time", *OVERLAP_AGG, *[F.col(c).alias(f"agg_{c}") for c in volumes], F.lit(True).alias("_a"))
    j = a.join(k, "open_time", "full_outer")
    both = F.col("_a").isNotNull() & F.col("_k").isNotNull()
    j = j.withColumn("join_status", F.when(both, "both").when(F.col("_a").isNotNull(), "agg_only").otherwise("kline_only"))
    j = j.withColumn("kline_vwap", F.when(F.col("kline_volume") > 0, F.try_divide("kline_quote_volume", "kline_volume")))
    pairs = {"base_volume": "kline_volume", "quote_volume": "kline_quote_volume", "active_buy_base_volume": "kline_taker_buy_base_volume", "active_buy_quote_volume": "kline_taker_buy_quote_volume"}
    errors = {}
    for name, other in pairs.items():
        x, y = F.col(f"agg_{name}"), F.col(other)
        errors[f"{name}_abs_error"] = F.abs(x - y)
        errors[f"{name}_relative_error"] = X.relative_error(x, y, y, epsilon)
        errors[f"{name}_signed_relative_error"] = X.relative_error(x, y, y, epsilon, signed=True)
    errors["agg_to_kline_trade_count_ratio"] = F.col("agg_trade_count") / F.greatest(F.col("kline_number_of_trades").cast("double"), F.lit(epsilon))
    errors["trade_count_difference"] = F.col("agg_trade_count") - F.col("kline_number_of_trades")
    prices = {
        "first_price_minus_open_bps": ("first_trade_price", "kline_open"),
        "last_price_minus_close_bps": ("last_trade_price", "kline_close"),
        "high_minus_kline_high_bps": ("trade_high", "kline_high"),
        "low_minus_kline_low_bps": ("trade_low", "kline_low"),
        "agg_vwap_minus_kline_vwap_bps": ("trade_vwap", "kline_vwap"),
    }
    errors |= {n: X.bps(F.col(x), F.col(y), epsilon) for n, (x, y) in prices.items()}
    errors |= {f"vwap_first_{s}s_minus_open_bps": X.bps(F.col(f"vwap_first_{s}s"), F.col("kline_open"), epsilon) for s in (1, 5, 10)}
    errors["vwap_last_5s_minus_close_bps"] = X.bps(F.col("vwap_last_5s"), F.col("kline_close"), epsilon)
    j = j.withColumns(errors)
    j = j.withColumns({
        "max_abs_price_error_bps": X.row_max([F.abs(n) for n in prices]),
        "max_volume_relative_error": F.greatest("base_volume_relative_error", "quote_volume_relative_error"),
    })
    both = F.col("join_status") == "both"
    tiers = {}
    for kind, value, (warn, severe) in (("volume", "max_volume_relative_error", volume_limits), ("price", "max_abs_price_error_bps", price_limits)):
        x = F.col(value)
        tiers |= {
            f"{kind}_match_good": both & X.all_of([x <= warn]),
            f"{kind}_match_warning": both & X.all_of([x > warn, x <= severe]),
            f"{kind}_match_severe": both & X.all_of([x > severe]),
        }
    needs = [both, F.col("base_volume_relative_error") <= rule["max_volume"], F.col("quote_volume_relative_error") <= rule["max_volume"], F.col("max_abs_price_error_bps") <= rule["max_price_bps"]]
    if rule["exclude_boundary"]:
        needs.append(~F.coalesce("is_boundary_partial_minute", F.lit(False)))
    if rule["need_first_5s"]:
        needs.append(F.coalesce("first_5s_trade_count", F.lit(0)) > 0)
    return j.withColumns(tiers | {"is_reliable_overlap_minute": X.all_of(needs)}).drop("_a", "_k")


def bucketed_gaps(overlap: DataFrame, gaps: Column, error: Column) -> DataFrame:
    """Errors by buckets of missing ids, (a, b], with a row for every bucket, and by whether there is any gap."""
    edges = [(-1, 0, "0"), (0, 5, "1-5"), (5, 20, "6-20"), (20, 100, "21-100"), (100, None, ">100")]
    name = F.lit(None).cast("string")
    for low, high, label in reversed(edges):
        inside = (gaps > low) & (gaps <= high) if high is not None else gaps > low
        name = F.when(inside, label).otherwise(name)
    rows = overlap.select(F.explode(F.array(
        F.struct(F.lit("missing_ids").alias("grouping"), name.alias("bucket")),
        F.struct(F.lit("any_gap").alias("grouping"), F.when(gaps > 0, "gap").otherwise("no_gap").alias("bucket")),
    )).alias("g"), error.alias("e")).select("g.*", "e")
    found = rows.where("bucket IS NOT NULL").groupBy("grouping", "bucket").agg(F.count(F.lit(1)).alias("bars"), F.avg("e").alias("mean_error"), F.max("e").alias("max_error"))
    wanted = [("missing_ids", label) for _, _, label in edges] + [("any_gap", "gap"), ("any_gap", "no_gap")]
    dim = overlap.sparkSession.createDataFrame(wanted, "grouping string, bucket string")
    return F.broadcast(dim).join(found, ["grouping", "bucket"], "left").withColumn("bars", F.coalesce("bars", F.lit(0)))
