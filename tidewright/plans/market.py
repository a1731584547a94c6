"""Queries of the market operators over the events table, as trades and as 15-minute and 1-hour bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import bars as B
from ..operators import checks as K
from ..operators import clean as C
from ..operators import dataset as D
from ..operators import features as FE
from ..operators import labels as L
from ..operators import ordered
from ..operators import profile as P
from ..sources import adapt as A
from ..sources.scratch import stored
from .registry import chain, query

QUARTER, HOUR = 900_000, 3_600_000

TRADES = """trades AS (
  SELECT event_id AS agg_trade_id, epoch_us(ts) // 1000 AS trade_time, 100.0 + value AS price, CAST(1 + user_id % 10 AS DOUBLE) AS quantity,
         event_type IN ('error', 'view') AS is_buyer_maker FROM events)"""
GAPPED = """seen AS (
  SELECT *, price * quantity AS quote_quantity, NOT is_buyer_maker AS buy, lag(agg_trade_id) OVER (ORDER BY trade_time, agg_trade_id) AS previous_id,
         lag(trade_time) OVER (ORDER BY trade_time, agg_trade_id) AS previous_time FROM trades),
gapped AS (
  SELECT *, CASE WHEN agg_trade_id - previous_id > 1 THEN agg_trade_id - previous_id - 1 ELSE 0 END AS id_gap_before, trade_time - previous_time AS time_gap_before FROM seen)"""


def bars_sql(step: int) -> str:
    return f"""bars AS (
  SELECT trade_time // {step} * {step} AS open_time, arg_min(price, {{'t': trade_time, 'i': agg_trade_id}}) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, {{'t': trade_time, 'i': agg_trade_id}}) AS close, sum(quantity) AS volume, sum(quote_quantity) AS quote_volume, count(*) AS number_of_trades,
         coalesce(sum(quantity) FILTER (WHERE buy), 0) AS taker_buy_base_volume, coalesce(sum(quote_quantity) FILTER (WHERE buy), 0) AS taker_buy_quote_volume
  FROM gapped GROUP BY 1)"""


def segments_sql(step: int) -> str:
    return f"""stepped AS (
  SELECT *, lag(open_time) OVER (ORDER BY open_time) AS previous_open_time, open_time - lag(open_time) OVER (ORDER BY open_time) AS delta FROM bars),
segmented AS (
  SELECT *, CASE WHEN delta > {step} THEN delta // {step} - 1 ELSE 0 END AS gap_before_bars,
         CAST(sum(CASE WHEN delta <> {step} THEN 1 ELSE 0 END) OVER (ORDER BY open_time) AS BIGINT) AS continuity_segment_id FROM stepped)"""


def positions_sql(step: int, history: tuple[int, ...] = (5, 15, 30, 60, 120, 240), future: tuple[int, ...] = (1, 60, 61)) -> str:
    flags = [f"segment_row_number >= {k - 1} AS has_history_{k}m" for k in history] + [f"minutes_until_segment_end >= {k} AS has_future_{k}m" for k in future]
    return f"""numbered AS (
  SELECT *, open_time + {step} AS decision_time, row_number() OVER (PARTITION BY continuity_segment_id ORDER BY open_time) - 1 AS segment_row_number,
         count(*) OVER (PARTITION BY continuity_segment_id) AS segment_length FROM segmented),
ended AS (SELECT *, segment_length - 1 - segment_row_number AS minutes_until_segment_end FROM numbered),
positioned AS (
  SELECT *, {", ".join(flags)}, decision_time % {5 * step} = 0 AS is_prediction_time_5m,
         decision_time % {5 * step} = 0 AND segment_row_number >= {max(history) - 1} AND minutes_until_segment_end >= {max(future)} AS is_model_candidate FROM ended)"""


BASE15 = (TRADES, GAPPED, bars_sql(QUARTER), segments_sql(QUARTER), positions_sql(QUARTER))
BASE60 = (TRADES, GAPPED, bars_sql(HOUR), segments_sql(HOUR), positions_sql(HOUR))


def labels_sql(step: int, horizon: int) -> str:
    return f"""priced AS (
  SELECT p.*, p.decision_time AS entry_minute_open_time, p.decision_time + {horizon} AS settlement_minute_open_time, e.open AS entry_price_proxy, s.open AS settlement_price_proxy,
         e.open_time IS NOT NULL AS entry_row_exists, s.open_time IS NOT NULL AS settlement_row_exists,
         coalesce(e.continuity_segment_id = s.continuity_segment_id AND e.continuity_segment_id = p.continuity_segment_id, false) AS same_segment
  FROM positioned p LEFT JOIN segmented e ON e.open_time = p.decision_time LEFT JOIN segmented s ON s.open_time = p.decision_time + {horizon}
  WHERE p.is_prediction_time_5m),
valid AS (
  SELECT *, entry_row_exists AND settlement_row_exists AND same_segment AND coalesce(entry_price_proxy > 0 AND settlement_price_proxy > 0, false) AS is_valid_proxy_label FROM priced),
returned AS (
  SELECT *, CASE WHEN is_valid_proxy_label THEN settlement_price_proxy / entry_price_proxy - 1 END AS future_simple_return_60m,
         CASE WHEN is_valid_proxy_label THEN ln(settlement_price_proxy / entry_price_proxy) END AS future_log_return_60m,
         CASE WHEN is_valid_proxy_label THEN CAST(settlement_price_proxy > entry_price_proxy AS INTEGER) END AS label_up_60m FROM valid),
sized AS (SELECT *, round_even(abs(future_simple_return_60m) * 10000, 9) AS abs_future_return_bps_60m FROM returned),
labels60 AS (
  SELECT *, CASE WHEN abs_future_return_bps_60m >= 50 THEN '[50, +inf)' WHEN abs_future_return_bps_60m >= 25 THEN '[25, 50)' WHEN abs_future_return_bps_60m >= 10 THEN '[10, 25)'
                 WHEN abs_future_return_bps_60m >= 5 THEN '[5, 10)' WHEN abs_future_return_bps_60m >= 2.5 THEN '[2.5, 5)' WHEN abs_future_return_bps_60m >= 1 THEN '[1, 2.5)'
                 WHEN abs_future_return_bps_60m >= 0 THEN '[0, 1)' END AS margin_bucket,
         coalesce(abs_future_return_bps_60m < 1, false) AS boundary_risk_1bps, coalesce(abs_future_return_bps_60m < 2.5, false) AS boundary_risk_2_5bps,
         coalesce(abs_future_return_bps_60m < 5, false) AS boundary_risk_5bps, coalesce(abs_future_return_bps_60m < 10, false) AS boundary_risk_10bps,
         CASE WHEN abs_future_return_bps_60m IS NOT NULL THEN greatest(least(abs_future_return_bps_60m / 10, 1), 0.25) END AS margin_sample_weight,
         is_valid_proxy_label AND is_model_candidate AS is_final_model_label_candidate FROM sized)"""


HORIZON15 = 8 * QUARTER
LABELS15 = (*BASE15, labels_sql(QUARTER, HORIZON15))


def bars15(spark, sf):
    return A.bars(spark, sf, QUARTER)


def labels15(spark, sf):
    return L.full_labels(bars15(spark, sf), HORIZON15)


# scans, predicates and trades


@query("s03_parquet_pruned_scan", "SELECT event_id, value FROM events", "value")
def s03(spark, sf):
    return A.table(spark, sf, "events").select("event_id", "value")


@query("s04_parquet_pushed_predicate", "SELECT event_id, user_id FROM events WHERE event_id <= 500 AND user_id >= 10")
def s04(spark, sf):
    return A.table(spark, sf, "events").where("event_id <= 500 AND user_id >= 10").select("event_id", "user_id")


@query("s14_json_row_normalize", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def s14(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("p02_to_number", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS x FROM events", "x")
def p02(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", X.number(F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))).alias("x"))


@query(
    "p03_p04_finite_predicates",
    "SELECT l_orderkey, l_linenumber, l_partkey, true AS is_finite, l_extendedprice - 50000 > 0 AS positive, l_discount >= 0 AS nonnegative FROM lineitem",
)
def p03(spark, sf):
    x = A.table(spark, sf, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", X.finite("l_extendedprice").alias("is_finite"), X.finite_positive(F.col("l_extendedprice") - 50000).alias("positive"), X.finite_nonnegative("l_discount").alias("nonnegative"))


@query(
    "p05_p06_tolerances",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_discount <= l_tax + 0.01 + 0.1 * abs(l_tax) AS bounded, abs(l_discount - l_tax) <= 0.005 + 1e-10 * abs(l_tax) AS equal FROM lineitem",
)
def p05(spark, sf):
    x = A.table(spark, sf, "lineitem")
    d, t = F.col("l_discount"), F.col("l_tax")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", X.within_upper_bound(d, t, 0.01, 0.1).alias("bounded"), X.close_to(d, t, 0.005).alias("equal"))


@query(
    "p07_bool_parser",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN true WHEN event_type = 'click' THEN false WHEN event_type = 'error' THEN true END AS flag FROM events""",
)
def p07(spark, sf):
    e = A.table(spark, sf, "events")
    text = F.when(F.col("event_type") == "view", " TRUE ").when(F.col("event_type") == "click", "0").when(F.col("event_type") == "error", "1").otherwise("not_bool")
    return e.select("event_id", X.parse_bool(text).alias("flag"))


@query("p07_bad_flag_examples", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def p07_bad(spark, sf):
    return C.bad_flag_values(A.table(spark, sf, "events"), "event_type")


@query(
    "p09_p11_clean_trades",
    chain(TRADES, GAPPED, then="SELECT agg_trade_id, trade_time, price, quantity, is_buyer_maker, quote_quantity, buy AS is_active_buy, is_buyer_maker AS is_active_sell, id_gap_before FROM gapped"),
    "price quantity quote_quantity",
)
def p09(spark, sf):
    raw = C.with_file_order(A.raw_trades(spark, sf))
    return C.clean_trades(raw).rows.select("agg_trade_id", "trade_time", "price", "quantity", "is_buyer_maker", "quote_quantity", "is_active_buy", "is_active_sell", "id_gap_before")


@query("p09_trade_fault_counts", "SELECT count(*) AS distinct_ids, CAST(0 AS BIGINT) AS missing_time, count_if(value - 480 <= -100) AS bad_price, CAST(0 AS BIGINT) AS bad_quantity, count_if(event_type = 'signup') AS bad_maker_flag FROM events")
def p09_counts(spark, sf):
    raw = C.with_file_order(A.raw_trades(spark, sf)).withColumn("price", F.col("price") - 480)
    kinds = A.table(spark, sf, "events").select(F.col("event_id").alias("agg_trade_id"), "event_type")
    raw = raw.join(kinds, "agg_trade_id").withColumn("is_buyer_maker", F.when(F.col("event_type") == "signup", "maybe").otherwise(F.col("is_buyer_maker"))).drop("event_type")
    return C.clean_trades(raw).counts


@query(
    "w01_keep_last",
    "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
def w01(spark, sf):
    return C.keep_last(A.table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("_o")), ["user_id"], "_o").drop("_o")


@query("w02_keep_first", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def w02(spark, sf):
    return C.keep_first(A.table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("_o")), ["user_id"], "_o").drop("_o")


@query("w07_trade_gaps", chain(TRADES, GAPPED, then="SELECT agg_trade_id, previous_id, id_gap_before, time_gap_before FROM gapped"))
def w07(spark, sf):
    return A.trades(spark, sf).select("agg_trade_id", "previous_id", "id_gap_before", "time_gap_before")


@query("w08_order_violations", chain(TRADES, then="SELECT count_if(q < 0) AS violations FROM (SELECT quantity - lag(quantity) OVER (ORDER BY agg_trade_id) AS q FROM trades)"))
def w08(spark, sf):
    trades = A.plain_trades(spark, sf)
    return C.order_violations(trades, "quantity", "agg_trade_id", ordered.even_width(trades, "agg_trade_id"))


@query("w09_long_quiet", chain(TRADES, GAPPED, then="SELECT count_if(time_gap_before > 600000) AS intervals, max(time_gap_before) AS longest FROM gapped"))
def w09(spark, sf):
    return C.long_quiet(A.trades(spark, sf), 600_000)


@query(
    "a39_same_time_groups",
    "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, coalesce(max(n), 0) AS largest FROM (SELECT epoch_us(ts) // 60000000 AS t, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1)",
)
def a39(spark, sf):
    return C.same_time_groups(A.trades(spark, sf).withColumn("trade_time", F.expr("trade_time div 60000")))


# bars


BAR_COLUMNS = "agg_trade_count first_agg_trade_id last_agg_trade_id first_trade_price last_trade_price trade_high trade_low base_volume quote_volume active_buy_base_volume active_sell_base_volume trade_vwap active_buy_vwap active_sell_vwap volume_weighted_price_std price_range_ratio active_buy_base_ratio trade_flow_imbalance_base trade_flow_imbalance_quote"


@query(
    "a04_a08_trade_bars",
    chain(
        TRADES, GAPPED,
        then=f"""SELECT trade_time // {QUARTER} * {QUARTER} AS open_time, count(*) AS agg_trade_count, arg_min(agg_trade_id, {{'t': trade_time, 'i': agg_trade_id}}) AS first_agg_trade_id,
  arg_max(agg_trade_id, {{'t': trade_time, 'i': agg_trade_id}}) AS last_agg_trade_id, arg_min(price, {{'t': trade_time, 'i': agg_trade_id}}) AS first_trade_price,
  arg_max(price, {{'t': trade_time, 'i': agg_trade_id}}) AS last_trade_price, max(price) AS trade_high, min(price) AS trade_low, sum(quantity) AS base_volume,
  sum(quote_quantity) AS quote_volume, coalesce(sum(quantity) FILTER (WHERE buy), 0) AS active_buy_base_volume, coalesce(sum(quantity) FILTER (WHERE NOT buy), 0) AS active_sell_base_volume,
  sum(quote_quantity) / sum(quantity) AS trade_vwap, sum(quote_quantity) FILTER (WHERE buy) / sum(quantity) FILTER (WHERE buy) AS active_buy_vwap,
  sum(quote_quantity) FILTER (WHERE NOT buy) / sum(quantity) FILTER (WHERE NOT buy) AS active_sell_vwap,
  round(sqrt(greatest(sum(price * price * quantity) / sum(quantity) - pow(sum(quote_quantity) / sum(quantity), 2), 0)), 4) AS volume_weighted_price_std,
  (max(price) - min(price)) / arg_min(price, {{'t': trade_time, 'i': agg_trade_id}}) AS price_range_ratio,
  coalesce(sum(quantity) FILTER (WHERE buy), 0) / sum(quantity) AS active_buy_base_ratio,
  (coalesce(sum(quantity) FILTER (WHERE buy), 0) - coalesce(sum(quantity) FILTER (WHERE NOT buy), 0)) / sum(quantity) AS trade_flow_imbalance_base,
  (coalesce(sum(quote_quantity) FILTER (WHERE buy), 0) - coalesce(sum(quote_quantity) FILTER (WHERE NOT buy), 0)) / sum(quote_quantity) AS trade_flow_imbalance_quote
FROM gapped GROUP BY 1""",
    ),
    "first_trade_price last_trade_price trade_high trade_low base_volume quote_volume active_buy_base_volume active_sell_base_volume trade_vwap active_buy_vwap active_sell_vwap volume_weighted_price_std price_range_ratio active_buy_base_ratio trade_flow_imbalance_base trade_flow_imbalance_quote",
)
def a04(spark, sf):
    bars = A.trade_bars(spark, sf, QUARTER).select("open_time", *BAR_COLUMNS.split())
    # the difference of squares leaves a few parts in 1e10: four digits are compared
    return bars.withColumn("volume_weighted_price_std", F.round(F.when(F.col("volume_weighted_price_std") > 1e-3, F.col("volume_weighted_price_std")).otherwise(0.0), 4))


@query(
    "a05_bar_quantiles",
    chain(TRADES, GAPPED, then=f"""SELECT trade_time // {QUARTER} * {QUARTER} AS open_time, quantile_cont(quantity, 0.5) AS median_trade_base_size, quantile_cont(quantity, 0.9) AS p90_trade_base_size,
  quantile_cont(quantity, 0.99) AS p99_trade_base_size, quantile_cont(quote_quantity, 0.5) AS median_trade_quote_size, quantile_cont(quote_quantity, 0.9) AS p90_trade_quote_size FROM gapped GROUP BY 1"""),
    "median_trade_base_size p90_trade_base_size p99_trade_base_size median_trade_quote_size p90_trade_quote_size", 5,
)
def a05(spark, sf):
    names = ["median_trade_base_size", "p90_trade_base_size", "p99_trade_base_size", "median_trade_quote_size", "p90_trade_quote_size"]
    return A.trade_bars(spark, sf, QUARTER, quantiles=True).select("open_time", *names)


def window_sql(name: str, test: str) -> str:
    return f"count_if({test}) AS {name}_trade_count, sum(quote_quantity) FILTER (WHERE {test}) / sum(quantity) FILTER (WHERE {test}) AS vwap_{name}"


@query(
    "a09_sub_window_vwap",
    chain(TRADES, GAPPED, then=f"""SELECT trade_time // {HOUR} * {HOUR} AS open_time, {window_sql("first_60s", f"trade_time % {HOUR} < 60000")}, {window_sql("first_600s", f"trade_time % {HOUR} < 600000")},
  {window_sql("last_300s", f"trade_time % {HOUR} >= {HOUR - 300000}")} FROM gapped GROUP BY 1"""),
    "vwap_first_60s vwap_first_600s vwap_last_300s",
)
def a09(spark, sf):
    bars = B.aggregate_trades(A.trades(spark, sf), HOUR, first=(60, 600), last=(300,), quantiles=False)
    return bars.select("open_time", *[f"{c}" for n in ("first_60s", "first_600s", "last_300s") for c in (f"{n}_trade_count", f"vwap_{n}")])


THINNED = "trades AS (SELECT * FROM (SELECT event_id * 2 + (user_id % 2) AS agg_trade_id, epoch_us(ts) // 1000 AS trade_time, 100.0 + value AS price, CAST(1 + user_id % 10 AS DOUBLE) AS quantity, event_type IN ('error', 'view') AS is_buyer_maker FROM events))"


@query(
    "a10_a11_id_gaps_and_edges",
    chain(
        THINNED, GAPPED,
        f"placed AS (SELECT *, trade_time // {QUARTER} * {QUARTER} AS open_time, coalesce(previous_time // {QUARTER} * {QUARTER} = trade_time // {QUARTER} * {QUARTER}, false) AS same FROM gapped)",
        then="""SELECT open_time, CAST(sum(CASE WHEN same THEN id_gap_before ELSE 0 END) AS BIGINT) AS internal_missing_agg_trade_id_count, count_if(same AND id_gap_before > 0) AS id_gap_event_count,
  max(CASE WHEN same THEN id_gap_before ELSE 0 END) AS maximum_internal_id_gap, CAST(sum(CASE WHEN same THEN 0 ELSE id_gap_before END) AS BIGINT) AS cross_minute_missing_agg_trade_id_count,
  count_if(NOT same AND id_gap_before > 0) AS cross_minute_id_gap_event_count, max(CASE WHEN same THEN 0 ELSE id_gap_before END) AS maximum_cross_minute_id_gap,
  open_time = (SELECT min(open_time) FROM placed) AS is_first_bar_of_file, open_time = (SELECT max(open_time) FROM placed) AS is_last_bar_of_file FROM placed GROUP BY open_time""",
    ),
)
def a10(spark, sf):
    users = A.table(spark, sf, "events").select(F.col("event_id").alias("agg_trade_id"), F.pmod("user_id", F.lit(2)).alias("odd"))
    t = A.trades(spark, sf).drop("previous_id", "previous_time", "id_gap_before", "time_gap_before").join(users, "agg_trade_id")
    t = C.with_id_gaps(t.withColumn("agg_trade_id", F.col("agg_trade_id") * 2 + F.col("odd")).drop("odd"))
    bars = B.boundary_flags(B.aggregate_trades(t, QUARTER, quantiles=False))
    return bars.select("open_time", "internal_missing_agg_trade_id_count", "id_gap_event_count", "maximum_internal_id_gap", "cross_minute_missing_agg_trade_id_count", "cross_minute_id_gap_event_count", "maximum_cross_minute_id_gap", "is_first_bar_of_file", "is_last_bar_of_file")


@query(
    "p08_p10_clean_bars",
    chain(*BASE15[:4], then=f"SELECT open_time, open, close, open_time + {QUARTER - 1} AS close_time, open_time % 7 = 0 AS close_time_repaired, continuity_segment_id, gap_before_bars FROM segmented"),
    "open close",
)
def p08(spark, sf):
    raw = B.as_bars(A.trade_bars(spark, sf, QUARTER)).withColumn("close_time", F.col("open_time") + F.when(F.col("open_time") % 7 == 0, 5).otherwise(QUARTER - 1))
    raw = C.with_file_order(raw)
    return C.clean_bars(raw, QUARTER).rows.select("open_time", "open", "close", "close_time", "close_time_repaired", "continuity_segment_id", "gap_before_bars")


@query("p08_bar_fault_counts", chain(*BASE15[:3], then="SELECT count(*) AS distinct_times, count_if(low - 150 <= 0 OR low - 150 > high) AS non_positive_price, CAST(0 AS BIGINT) AS negative_volume, count_if(low - 150 > least(open, close, high) OR high < greatest(open, close, low - 150)) AS bad_price_order FROM bars"))
def p08_counts(spark, sf):
    raw = C.with_file_order(B.as_bars(A.trade_bars(spark, sf, QUARTER)).withColumns({"low": F.col("low") - 150, "close_time": F.col("open_time") + (QUARTER - 1)}))
    return C.clean_bars(raw, QUARTER).counts


@query("p10_close_time_repairs", chain(*BASE15[:3], then=f"SELECT open_time, open_time + 5 AS close_time, open_time + {QUARTER - 1} AS expected_close_time FROM bars WHERE open_time % 7 = 0"))
def p10(spark, sf):
    raw = B.as_bars(A.trade_bars(spark, sf, QUARTER)).withColumn("close_time", F.col("open_time") + F.when(F.col("open_time") % 7 == 0, 5).otherwise(QUARTER - 1))
    return C.clean_bars(C.with_file_order(raw), QUARTER).side["repairs"]


@query("w03_w04_segments", chain(*BASE15[:4], then="SELECT open_time, previous_open_time, delta, gap_before_bars, continuity_segment_id FROM segmented"))
def w03(spark, sf):
    return bars15(spark, sf).select("open_time", "previous_open_time", "delta", "gap_before_bars", "continuity_segment_id")


@query("w05_gap_report", chain(*BASE15[:4], then=f"SELECT previous_open_time, open_time, delta, gap_before_bars AS missing_bars, continuity_segment_id - 1 AS previous_segment_id, continuity_segment_id AS segment_id FROM segmented WHERE delta <> {QUARTER}"))
def w05(spark, sf):
    return C.gap_report(bars15(spark, sf), QUARTER)


@query("w06_longest_segment", chain(*BASE15[:4], then="SELECT continuity_segment_id, min(open_time) AS start_time, max(open_time) AS end_time, count(*) AS bars FROM segmented GROUP BY 1 ORDER BY bars DESC, continuity_segment_id LIMIT 1"))
def w06(spark, sf):
    return C.longest_segment(bars15(spark, sf))


@query("w10_interval_histogram", chain(*BASE15[:4], then="SELECT delta, count(*) AS n FROM segmented WHERE delta IS NOT NULL GROUP BY 1 ORDER BY n DESC, delta LIMIT 10"))
def w10(spark, sf):
    return C.interval_histogram(bars15(spark, sf))


FLAGS = "segment_row_number segment_length minutes_until_segment_end has_history_5m has_history_60m has_history_240m has_future_1m has_future_60m has_future_61m is_prediction_time_5m is_model_candidate"


@query("p12_w11_w12_g01_model_base", chain(*BASE15, then=f"SELECT open_time, decision_time, {', '.join(FLAGS.split())} FROM positioned"))
def w11(spark, sf):
    return bars15(spark, sf).select("open_time", "decision_time", *FLAGS.split())


@query("w13_global_positions", chain(*BASE15[:3], then="SELECT open_time, row_number() OVER (ORDER BY open_time) - 1 AS global_row, count(*) OVER () - row_number() OVER (ORDER BY open_time) AS global_until_end FROM bars"))
def w13(spark, sf):
    return C.global_positions(bars15(spark, sf)).select("open_time", "global_row", "global_until_end")


@query("a12_segment_summary", chain(*BASE15, then="SELECT continuity_segment_id, min(open_time) AS start_time, max(open_time) AS end_time, count(*) AS bars, count_if(is_prediction_time_5m) AS prediction_rows, count_if(is_model_candidate) AS candidates FROM positioned GROUP BY 1"))
def a12(spark, sf):
    return bars15(spark, sf).groupBy("continuity_segment_id").agg(F.min("open_time").alias("start_time"), F.max("open_time").alias("end_time"), F.count(F.lit(1)).alias("bars"), F.count_if("is_prediction_time_5m").alias("prediction_rows"), F.count_if("is_model_candidate").alias("candidates"))


@query("a13_candidate_rollup", chain(*BASE15, "dated AS (SELECT year(make_timestamp(decision_time * 1000)) AS year, month(make_timestamp(decision_time * 1000)) AS month, is_prediction_time_5m AS p FROM positioned)", then="SELECT year, month, count_if(p) AS candidates FROM dated GROUP BY year, month UNION ALL SELECT year, NULL, count_if(p) FROM dated GROUP BY year"))
def a13(spark, sf):
    cal = X.calendar(F.col("decision_time"))
    rows = bars15(spark, sf).select(cal["year"].cast("long").alias("year"), cal["month"].cast("long").alias("month"), "is_prediction_time_5m")
    return rows.rollup("year", "month").agg(F.count_if("is_prediction_time_5m").alias("candidates")).where("year IS NOT NULL")


# reconciliation


SHIFTED = f"""shifted AS (
  SELECT open_time + CASE WHEN open_time % {11 * QUARTER} = 0 THEN 1 ELSE 0 END * 0 AS open_time, open, high, low, close, volume * (1 + (open_time // {QUARTER}) % 5 / 1000.0) AS volume,
         quote_volume, number_of_trades, taker_buy_base_volume, taker_buy_quote_volume FROM bars WHERE open_time % {13 * QUARTER} <> 0)"""


def overlap(spark, sf):
    agg = A.trade_bars(spark, sf, QUARTER)
    other = B.as_bars(agg).where(F.col("open_time") % (13 * QUARTER) != 0)
    other = other.withColumn("volume", F.col("volume") * (1 + F.expr(f"(open_time div {QUARTER}) % 5") / 1000.0))
    return B.reconcile(agg, other, volume_limits=(0.0015, 0.0035), rule={"need_first_5s": False})


JOINED = f"""j AS (
  SELECT a.open_time, CASE WHEN k.open_time IS NULL THEN 'agg_only' ELSE 'both' END AS join_status, abs(a.volume - k.volume) / greatest(abs(k.volume), 1e-12) AS base_volume_relative_error,
         abs(a.quote_volume / a.volume - k.quote_volume / k.volume) / greatest(abs(k.quote_volume / k.volume), 1e-12) * 10000 AS price_error,
         a.open_time IN ((SELECT min(open_time) FROM bars), (SELECT max(open_time) FROM bars)) AS edge
  FROM bars a LEFT JOIN shifted k USING (open_time))"""


@query(
    "j01_p28_p29_overlap",
    chain(*BASE15[:3], SHIFTED, JOINED, then="""SELECT open_time, join_status, base_volume_relative_error, price_error AS max_abs_price_error_bps,
  join_status = 'both' AND coalesce(base_volume_relative_error <= 0.0015, false) AS volume_match_good,
  join_status = 'both' AND coalesce(base_volume_relative_error > 0.0015 AND base_volume_relative_error <= 0.0035, false) AS volume_match_warning,
  join_status = 'both' AND coalesce(base_volume_relative_error > 0.0035, false) AS volume_match_severe,
  join_status = 'both' AND NOT edge AND coalesce(base_volume_relative_error <= 0.0035 AND price_error <= 1, false) AS is_reliable_overlap_minute FROM j"""),
    "base_volume_relative_error max_abs_price_error_bps", 5,
)
def j01(spark, sf):
    return overlap(spark, sf).select("open_time", "join_status", "base_volume_relative_error", "max_abs_price_error_bps", "volume_match_good", "volume_match_warning", "volume_match_severe", "is_reliable_overlap_minute")


@query(
    "a14_hourly_rollup",
    chain(*BASE15[:3], SHIFTED, JOINED, then=f"SELECT open_time // {HOUR} * {HOUR} AS hour, count(*) AS bars, count_if(join_status = 'both') AS matched, avg(base_volume_relative_error) AS mean_error, median(base_volume_relative_error) AS median_error FROM j GROUP BY 1"),
    "mean_error median_error",
)
def a14(spark, sf):
    o = overlap(spark, sf).withColumn("hour", X.floor_to(F.col("open_time"), HOUR))
    e = F.col("base_volume_relative_error")
    return o.groupBy("hour").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("join_status") == "both").alias("matched"), F.avg(e).alias("mean_error"), F.median(e).alias("median_error"))


@query(
    "a15_gap_buckets",
    chain(*BASE15[:3], "g AS (SELECT number_of_trades - 1 AS gaps, high - low AS e FROM bars)", """named AS (
  SELECT 'missing_ids' AS grouping, CASE WHEN gaps <= 0 THEN '0' WHEN gaps <= 5 THEN '1-5' WHEN gaps <= 20 THEN '6-20' WHEN gaps <= 100 THEN '21-100' ELSE '>100' END AS bucket, e FROM g
  UNION ALL SELECT 'any_gap', CASE WHEN gaps > 0 THEN 'gap' ELSE 'no_gap' END, e FROM g)""",
          "dim AS (SELECT * FROM (VALUES ('missing_ids', '0'), ('missing_ids', '1-5'), ('missing_ids', '6-20'), ('missing_ids', '21-100'), ('missing_ids', '>100'), ('any_gap', 'gap'), ('any_gap', 'no_gap')) t(grouping, bucket))",
          then="SELECT d.grouping, d.bucket, count(n.e) AS bars, avg(n.e) AS mean_error, max(n.e) AS max_error FROM dim d LEFT JOIN named n ON d.grouping = n.grouping AND d.bucket = n.bucket GROUP BY 1, 2"),
    "mean_error max_error",
)
def a15(spark, sf):
    bars = bars15(spark, sf)
    return B.bucketed_gaps(bars, F.col("number_of_trades") - 1, F.col("high") - F.col("low"))


@query(
    "a16_describe_bps",
    chain(*BASE15[:3], "x AS (SELECT (close / open - 1) * 10000 AS v FROM bars)", then="SELECT count(v) AS n, avg(abs(v)) AS mean, stddev_samp(abs(v)) AS std, min(abs(v)) AS minimum, max(abs(v)) AS maximum, quantile_cont(abs(v), 0.5) AS p50, quantile_cont(abs(v), 0.9) AS p90, quantile_cont(abs(v), 0.95) AS p95, quantile_cont(abs(v), 0.99) AS p99, avg(v) AS signed_mean, avg(CAST(v > 0 AS DOUBLE)) AS positive_ratio, avg(CAST(v < 0 AS DOUBLE)) AS negative_ratio FROM x"),
    "mean std minimum maximum p50 p90 p95 p99 signed_mean positive_ratio negative_ratio", 4,
)
def a16(spark, sf):
    return L.describe_abs_bps(bars15(spark, sf), X.bps(F.col("close"), F.col("open")))


@query("o02_largest_errors", chain(*BASE15[:3], SHIFTED, JOINED, then="SELECT open_time, base_volume_relative_error FROM j WHERE base_volume_relative_error IS NOT NULL ORDER BY round(base_volume_relative_error, 9) DESC, open_time LIMIT 100"), "base_volume_relative_error")
def o02(spark, sf):
    e = F.col("base_volume_relative_error")
    return overlap(spark, sf).where(e.isNotNull()).orderBy(F.desc(F.round(e, 9)), "open_time").limit(100).select("open_time", e)


@query("a15_j15_volume_reconciliation", chain(*BASE15[:3], SHIFTED, then="SELECT count_if(k.open_time IS NOT NULL) AS matched, count_if(k.open_time IS NULL) AS only_trades, CAST(0 AS BIGINT) AS only_bars, avg(abs(a.volume - k.volume) / k.volume) AS mean_error, max(abs(a.volume - k.volume) / k.volume) AS max_error FROM bars a LEFT JOIN shifted k USING (open_time)"), "mean_error max_error")
def j15(spark, sf):
    agg = A.trade_bars(spark, sf, QUARTER)
    other = B.as_bars(agg).where(F.col("open_time") % (13 * QUARTER) != 0)
    return P.volume_reconciliation(agg, other.withColumn("volume", F.col("volume") * (1 + F.expr(f"(open_time div {QUARTER}) % 5") / 1000.0)))


@query("j16_time_overlap", chain(TRADES, then="SELECT greatest(a0, b0) AS start, least(a1, b1) AS \"end\", greatest(a0, b0) <= least(a1, b1) AS overlaps FROM (SELECT min(trade_time) AS a0, max(trade_time) AS a1 FROM trades), (SELECT min(trade_time) + 86400000 AS b0, max(trade_time) + 86400000 AS b1 FROM trades)"))
def j16(spark, sf):
    t = A.trades(spark, sf)
    return P.time_overlap(t, t.withColumn("trade_time", F.col("trade_time") + 86_400_000), "trade_time")


# labels


LABEL_COLUMNS = "decision_time entry_price_proxy settlement_price_proxy is_valid_proxy_label future_simple_return_60m future_log_return_60m label_up_60m abs_future_return_bps_60m margin_bucket boundary_risk_1bps boundary_risk_2_5bps boundary_risk_5bps boundary_risk_10bps margin_sample_weight is_final_model_label_candidate"


@query("j02_j03_p23_p24_p25_n09_n11_g02_labels", chain(*LABELS15, then=f"SELECT {', '.join(LABEL_COLUMNS.split())} FROM labels60"), "entry_price_proxy settlement_price_proxy future_simple_return_60m future_log_return_60m abs_future_return_bps_60m margin_sample_weight")
def j02(spark, sf):
    return labels15(spark, sf).select(*LABEL_COLUMNS.split()).withColumn("label_up_60m", F.col("label_up_60m").cast("int"))


@query("p31_invalid_details", chain(*LABELS15, then="SELECT decision_time, continuity_segment_id, NOT entry_row_exists AS missing_entry_row, NOT settlement_row_exists AS missing_settlement_row, false AS bad_entry_price, false AS bad_settlement_price, entry_row_exists AND settlement_row_exists AND NOT same_segment AS crosses_segments, is_model_candidate FROM labels60 WHERE NOT is_valid_proxy_label"))
def p31(spark, sf):
    return L.invalid_details(labels15(spark, sf))


@query("a17_return_distribution", chain(*LABELS15, then="SELECT count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, min(r) AS minimum, max(r) AS maximum, quantile_cont(r, 0.01) AS p01, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.75) AS p75, quantile_cont(r, 0.95) AS p95, quantile_cont(r, 0.99) AS p99 FROM (SELECT future_simple_return_60m AS r FROM labels60)"), "mean std minimum maximum p01 p05 p25 p50 p75 p95 p99")
def a17(spark, sf):
    return L.describe(labels15(spark, sf), F.col("future_simple_return_60m"), L.QUANTILES)


KINDS = """kinds AS (
  SELECT 'date' AS kind, strftime(make_timestamp(decision_time * 1000), '%Y-%m-%d') AS value, * FROM labels60
  UNION ALL SELECT 'segment', CAST(continuity_segment_id AS VARCHAR), * FROM labels60 UNION ALL SELECT 'margin', margin_bucket, * FROM labels60)"""


@query("a23_label_distributions", chain(*LABELS15, KINDS, then="SELECT kind, value, count(*) AS n, count_if(label_up_60m = 1) AS up, count_if(label_up_60m = 0) AS down, avg(label_up_60m) AS up_ratio, avg(future_simple_return_60m) AS mean_return, median(future_simple_return_60m) AS median_return, coalesce(stddev_samp(future_simple_return_60m), 0) AS std_return FROM kinds WHERE is_valid_proxy_label GROUP BY kind, value"), "up_ratio mean_return median_return std_return")
def a23(spark, sf):
    return L.label_distributions(labels15(spark, sf))


@query("a24_stability", chain(*LABELS15, """by_day AS (
  SELECT strftime(make_timestamp(decision_time * 1000), '%Y-%m-%d') AS period, count(*) AS n, avg(label_up_60m) AS ratio, avg(CAST(abs_future_return_bps_60m < 2000 AS DOUBLE)) AS near FROM labels60 WHERE is_valid_proxy_label GROUP BY 1)""",
    "whole AS (SELECT avg(label_up_60m) AS overall FROM labels60 WHERE is_valid_proxy_label)", "lim AS (SELECT median(n) AS median_n, avg(near) AS mean_near, coalesce(stddev_samp(near), 0) AS std_near FROM by_day)",
    then="SELECT arg_max(period, {'d': round(abs(ratio - overall), 12), 'p': period}) AS farthest_period, max(abs(ratio - overall)) AS farthest_distance, count_if(n < 0.5 * median_n) AS thin_periods, count_if(near > mean_near + 2 * std_near) AS near_zero_periods FROM by_day, whole, lim"), "farthest_distance")
def a24(spark, sf):
    return L.stability(labels15(spark, sf), X.calendar(F.col("decision_time"))["date"], near_zero_bps=2000.0)


@query("o04_u01_extreme_returns", chain(*LABELS15, "v AS (SELECT decision_time, future_simple_return_60m FROM labels60 WHERE is_valid_proxy_label)", then="(SELECT *, 'largest' AS side FROM v ORDER BY 2 DESC, 1 LIMIT 20) UNION ALL (SELECT *, 'smallest' AS side FROM v ORDER BY 2, 1 LIMIT 20)"), "future_simple_return_60m")
def o04(spark, sf):
    return L.extreme_returns(labels15(spark, sf))


@query("a40_label_stats", chain(*LABELS15, then="SELECT count(*) AS rows, count_if(is_valid_proxy_label) AS valid, count_if(label_up_60m = 1) AS up, avg(abs_future_return_bps_60m) AS mean_bps, min(decision_time) AS first_time, max(decision_time) AS last_time FROM labels60"), "mean_bps")
def a40(spark, sf):
    return labels15(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_valid_proxy_label").alias("valid"), F.count_if(F.col("label_up_60m") == 1).alias("up"), F.avg("abs_future_return_bps_60m").alias("mean_bps"), F.min("decision_time").alias("first_time"), F.max("decision_time").alias("last_time"))


def proxy(spark, sf):
    agg = B.boundary_flags(stored(B.aggregate_trades(A.trades(spark, sf), QUARTER, first=(60, 120, 300, 600), last=(300,), quantiles=False), "trade_bars"))
    agg = agg.withColumnsRenamed({f"vwap_first_{a}s": f"vwap_first_{b}s" for a, b in ((60, 1), (120, 2), (300, 5), (600, 10))})
    minutes = agg.withColumnRenamed("first_trade_price", "kline_open").withColumnRenamed("base_volume", "agg_base_volume").withColumn("is_reliable_overlap_minute", ~F.col("is_boundary_partial_minute"))
    return L.label_proxy(L.prediction_rows(bars15(spark, sf)), minutes, HORIZON15)


PROXY = (
    *BASE15,
    f"""m AS (SELECT trade_time // {QUARTER} * {QUARTER} AS open_time, arg_min(price, {{'t': trade_time, 'i': agg_trade_id}}) AS kline_open, sum(quantity) AS base,
  sum(quote_quantity) FILTER (WHERE trade_time % {QUARTER} < 300000) / sum(quantity) FILTER (WHERE trade_time % {QUARTER} < 300000) AS v5,
  sum(quote_quantity) FILTER (WHERE trade_time % {QUARTER} < 600000) / sum(quantity) FILTER (WHERE trade_time % {QUARTER} < 600000) AS v10 FROM gapped GROUP BY 1)""",
    f"""p AS (SELECT d.decision_time, e.kline_open AS ek, s.kline_open AS sk, e.v5 AS e5, s.v5 AS s5, e.v10 AS e10, s.v10 AS s10, e.base AS agg_base_volume
  FROM positioned d LEFT JOIN m e ON e.open_time = d.decision_time LEFT JOIN m s ON s.open_time = d.decision_time + {HORIZON15} WHERE d.is_prediction_time_5m)""",
    "q AS (SELECT *, CASE WHEN ek IS NOT NULL AND sk IS NOT NULL THEN CAST(sk > ek AS INTEGER) END AS lk, CASE WHEN e5 IS NOT NULL AND s5 IS NOT NULL THEN CAST(s5 > e5 AS INTEGER) END AS l5, CASE WHEN e10 IS NOT NULL AND s10 IS NOT NULL THEN CAST(s10 > e10 AS INTEGER) END AS l10, sk / ek - 1 AS rk, s5 / e5 - 1 AS r5 FROM p)",
)


@query("n12_label_proxy", chain(*PROXY, then="SELECT decision_time, lk AS label_kline_open, l5 AS label_vwap_first_5s, l10 AS label_vwap_first_10s, CASE WHEN lk IS NOT NULL AND l5 IS NOT NULL THEN lk = l5 END AS agree_5s, CASE WHEN lk IS NOT NULL AND l5 IS NOT NULL THEN lk <> l5 END AS flip_5s, (ek - e5) / e5 * 10000 AS entry_difference_bps_5s FROM q"), "entry_difference_bps_5s", 4)
def n12(spark, sf):
    return proxy(spark, sf).select("decision_time", "label_kline_open", "label_vwap_first_5s", "label_vwap_first_10s", "agree_5s", "flip_5s", "entry_difference_bps_5s")


@query("p32_flip_samples", chain(*PROXY, then="SELECT decision_time, lk AS label_kline_open, l5 AS label_vwap_first_5s FROM q WHERE lk <> l5"))
def p32(spark, sf):
    return proxy(spark, sf).where(F.coalesce("flip_5s", F.lit(False))).select("decision_time", "label_kline_open", "label_vwap_first_5s")


AGREE = """count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n, count(*) FILTER (WHERE a = b) AS agree, count(*) FILTER (WHERE a <> b) AS flips, avg(CAST(a = b AS DOUBLE)) AS agreement,
  avg(CAST(a AS DOUBLE)) FILTER (WHERE b IS NOT NULL) AS up_rate_a, avg(CAST(b AS DOUBLE)) FILTER (WHERE a IS NOT NULL) AS up_rate_b, count(*) FILTER (WHERE a = 0 AND b = 1) AS up_to_down, count(*) FILTER (WHERE a = 1 AND b = 0) AS down_to_up,
  corr(a, b) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS mcc"""
AGREE_COLUMNS = ["n", "agree", "flips", "agreement", "up_rate_a", "up_rate_b", "up_to_down", "down_to_up", "mcc"]


@query("a18_a19_agreement_sets", chain(*PROXY, "sets AS (SELECT 'ALL' AS set_name, lk AS a, l5 AS b FROM q UNION ALL SELECT 'BIG_VOLUME', lk, l5 FROM q WHERE agg_base_volume >= 20 UNION ALL SELECT 'KLINE_UP', lk, l5 FROM q WHERE rk > 0)", then=f"SELECT set_name, {AGREE} FROM sets GROUP BY set_name"), "agreement up_rate_a up_rate_b mcc")
def a18(spark, sf):
    rows = L.exploded_sets(proxy(spark, sf), {"ALL": F.lit(True), "BIG_VOLUME": F.col("agg_base_volume") >= 20, "KLINE_UP": F.col("return_kline_open") > 0})
    return L.agreement_by(rows, "label_kline_open", "label_vwap_first_5s", [F.col("set_name")]).select("set_name", *AGREE_COLUMNS)


BUCKET = "CASE WHEN x >= 50 THEN '[50, +inf)' WHEN x >= 25 THEN '[25, 50)' WHEN x >= 10 THEN '[10, 25)' WHEN x >= 5 THEN '[5, 10)' WHEN x >= 2.5 THEN '[2.5, 5)' WHEN x >= 1 THEN '[1, 2.5)' WHEN x >= 0 THEN '[0, 1)' END"


@query("a20_agreement_by_margin", chain(*PROXY, "two AS (SELECT 'margin_bucket' AS source, round_even(abs(rk) * 10000, 9) AS x, lk AS a, l5 AS b FROM q UNION ALL SELECT 'reference_margin_bucket', round_even(abs(r5) * 10000, 9), lk, l5 FROM q)", f"named AS (SELECT *, {BUCKET} AS bucket FROM two)", then=f"SELECT source, bucket, {AGREE} FROM named GROUP BY 1, 2"), "agreement up_rate_a up_rate_b mcc")
def a20(spark, sf):
    rows = proxy(spark, sf).unpivot(["decision_time", "label_kline_open", "label_vwap_first_5s"], ["margin_bucket", "reference_margin_bucket"], "source", "bucket")
    return L.agreement_by(rows, "label_kline_open", "label_vwap_first_5s", [F.col("source"), F.col("bucket")]).select("source", "bucket", *AGREE_COLUMNS)


@query("a21_agreement_by_hour", chain(*PROXY, then=f"SELECT hour(make_timestamp(decision_time * 1000)) AS hour, {AGREE} FROM (SELECT *, lk AS a, l5 AS b FROM q) GROUP BY 1"), "agreement up_rate_a up_rate_b mcc")
def a21(spark, sf):
    return L.agreement_by(proxy(spark, sf), "label_kline_open", "label_vwap_first_5s", [X.calendar(F.col("decision_time"))["hour"].cast("long").alias("hour")]).select("hour", *AGREE_COLUMNS)


@query("a22_correlations", chain(*PROXY, "ok AS (SELECT rk, r5 FROM q WHERE rk IS NOT NULL AND r5 IS NOT NULL)", "rr AS (SELECT rk, r5, rank() OVER (ORDER BY rk) + (count(*) OVER (PARTITION BY rk) - 1) / 2.0 AS x, rank() OVER (ORDER BY r5) + (count(*) OVER (PARTITION BY r5) - 1) / 2.0 AS y FROM ok)", then="SELECT count(*) AS n, corr(rk, r5) AS pearson, corr(x, y) AS spearman FROM rr"), "pearson spearman")
def a22(spark, sf):
    return L.correlations(proxy(spark, sf), "return_kline_open", "return_vwap_first_5s")


@query("o03_largest_differences", chain(*PROXY, then="SELECT decision_time, abs(rk - r5) AS difference FROM q WHERE rk IS NOT NULL AND r5 IS NOT NULL ORDER BY round(abs(rk - r5), 9) DESC, decision_time LIMIT 100"), "difference")
def o03(spark, sf):
    d = F.abs(F.col("return_kline_open") - F.col("return_vwap_first_5s"))
    return proxy(spark, sf).select("decision_time", d.alias("difference")).where("difference IS NOT NULL").orderBy(F.desc(F.round("difference", 9)), "decision_time").limit(100)


@query("p26_volume_quartiles", chain(*PROXY, "e AS (SELECT quantile_cont(agg_base_volume, 0.25) AS a, quantile_cont(agg_base_volume, 0.5) AS b, quantile_cont(agg_base_volume, 0.75) AS c FROM q)", then="SELECT decision_time, CASE WHEN agg_base_volume <= a THEN 'q1' WHEN agg_base_volume <= b THEN 'q2' WHEN agg_base_volume <= c THEN 'q3' WHEN agg_base_volume IS NOT NULL THEN 'q4' END AS quartile FROM q, e"))
def p26(spark, sf):
    return L.quartile_bucket(proxy(spark, sf), "agg_base_volume", "quartile").select("decision_time", "quartile")


@query("g07_proxy_decision", chain(*PROXY, then=f"SELECT n, agreement, CASE WHEN NOT (agreement >= 0.9) AND n >= 100 THEN 'REJECT_PROXY' WHEN n < 100 THEN 'INCONCLUSIVE_NEED_MORE_AGG_DATA' ELSE 'ACCEPT_WITH_LIMITATIONS' END AS decision FROM (SELECT {AGREE} FROM (SELECT lk AS a, l5 AS b FROM q))"), "agreement")
def g07(spark, sf):
    stats = L.agreement_by(proxy(spark, sf), "label_kline_open", "label_vwap_first_5s", [])
    return L.accept_proxy(stats, {"min_samples": 100, "min_agreement": 0.9, "min_wilson_low": 0.0, "min_kappa": -1.0}).select("n", "agreement", "decision")


# checks


@query("p16_bar_constraints", chain(*BASE15[:4], then="""SELECT 'unsorted_or_repeated_time' AS "check", count_if(delta <= 0) AS violations FROM segmented UNION ALL SELECT 'wrong_spacing', CAST(0 AS BIGINT) UNION ALL SELECT 'time_off_grid', CAST(0 AS BIGINT)
  UNION ALL SELECT 'price_not_positive', count_if(low <= 0) FROM segmented UNION ALL SELECT 'high_below', count_if(high < greatest(open, close, low)) FROM segmented UNION ALL SELECT 'low_above', count_if(low > least(open, close, high)) FROM segmented
  UNION ALL SELECT 'negative_volume', count_if(volume < 0) FROM segmented UNION ALL SELECT 'taker_above_volume', count_if(taker_buy_base_volume > volume + 1e-9 + 1e-9 * volume) FROM segmented"""))
def p16(spark, sf):
    return K.violations(bars15(spark, sf), K.bar_suite(QUARTER))


@query("p16_trade_constraints", """SELECT * FROM (VALUES ('missing_time', CAST(0 AS BIGINT)), ('bad_price', CAST(0 AS BIGINT)), ('bad_quantity', CAST(0 AS BIGINT)), ('wrong_quote', CAST(0 AS BIGINT)), ('both_sides', CAST(0 AS BIGINT))) t("check", violations)""")
def p16_trades(spark, sf):
    return K.violations(A.trades(spark, sf), K.trade_suite())


@query("p06_aggregate_identities", """SELECT * FROM (VALUES ('sides_base', CAST(0 AS BIGINT)), ('sides_quote', CAST(0 AS BIGINT)), ('sides_count', CAST(0 AS BIGINT)), ('vwap_above_high', CAST(0 AS BIGINT)), ('vwap_below_low', CAST(0 AS BIGINT))) t("check", violations)""")
def p06(spark, sf):
    return K.violations(A.trade_bars(spark, sf, QUARTER), K.aggregate_suite())


@query("p17_label_constraints", """SELECT * FROM (VALUES ('label_without_validity', CAST(0 AS BIGINT)), ('valid_without_label', CAST(0 AS BIGINT)), ('label_not_binary', CAST(0 AS BIGINT)), ('sign_disagrees', CAST(0 AS BIGINT)), ('weight_out_of_range', CAST(0 AS BIGINT))) t("check", violations)""")
def p17(spark, sf):
    return K.violations(labels15(spark, sf), K.label_suite())


# features: 1-hour bars, so that windows of 120 bars are full at small scale


def hour_features(spark, sf):
    return FE.features(A.bars(spark, sf, HOUR))


def features_sql() -> str:
    """The 63 features in DuckDB SQL, written from their definitions, without the operators' code."""
    seg = "PARTITION BY continuity_segment_id ORDER BY open_time"

    def roll(f: str, x: str, k: int) -> str:
        w = f"OVER ({seg} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count({x}) {w} = {k} THEN {f}({x}) {w} END"

    def nd(a: str, b: str, mask: str, v: str) -> str:
        return f"CASE WHEN coalesce({mask}, false) THEN CAST({v} AS DOUBLE) WHEN {b} <> 0 THEN {a} / {b} END"

    lag = lambda k: f"lag(close, {k}) OVER ({seg})"
    t = "make_timestamp(decision_time * 1000)"
    minute, day = f"(hour({t}) * 60 + minute({t}))", f"(isodow({t}) - 1)"
    b1 = [f"ln(close / {lag(k)}) AS log_return_{k}m" for k in (1, 3, 5, 10, 15, 30, 60, 120)] + [f"abs(close - {lag(k)}) AS move_{k}" for k in (1, 15, 60)]
    b1 += [
        f"{lag(1)} AS prev", "CAST(close > open AS DOUBLE) AS up",
        nd("(close - open)", "(high - low)", "high = low", "0") + " AS signed_body_ratio", nd("abs(close - open)", "(high - low)", "high = low", "0") + " AS absolute_body_ratio",
        nd("(high - greatest(open, close))", "(high - low)", "high = low", "0") + " AS upper_wick_ratio", nd("(least(open, close) - low)", "(high - low)", "high = low", "0") + " AS lower_wick_ratio",
        nd("(close - low)", "(high - low)", "high = low", "0.5") + " AS close_location", "CAST(volume = 0 OR quote_volume = 0 AS INTEGER) AS is_zero_volume_1m", "ln(1 + quote_volume) AS lq",
        nd("taker_buy_quote_volume", "quote_volume", "quote_volume = 0", "0.5") + " AS taker_buy_quote_ratio_1m", "ln(1 + CAST(number_of_trades AS DOUBLE)) AS lc",
        "ln(1 + quote_volume / number_of_trades) AS ls", f"sin(2 * pi() * {minute} / 1440) AS time_sin", f"cos(2 * pi() * {minute} / 1440) AS time_cos",
        f"sin(2 * pi() * {day} / 7) AS weekday_sin", f"cos(2 * pi() * {day} / 7) AS weekday_cos", f"CAST({day} >= 5 AS INTEGER) AS is_weekend",
    ]
    b2 = [
        "CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr", "CASE WHEN log_return_1m > 0 THEN log_return_1m * log_return_1m WHEN log_return_1m IS NOT NULL THEN 0 END AS g2",
        "CASE WHEN log_return_1m < 0 THEN log_return_1m * log_return_1m WHEN log_return_1m IS NOT NULL THEN 0 END AS l2", "CAST(coalesce(taker_buy_quote_ratio_1m > 0.5, false) AS DOUBLE) AS buys", "close * segment_row_number AS rc",
    ]
    b3 = [roll("sum", "move_1", 15) + " AS path_15", roll("sum", "move_1", 60) + " AS path_60", roll("avg", "up", 15) + " AS up_candle_ratio_15m"]
    b3 += [roll("stddev_pop", "log_return_1m", k) + f" AS realized_volatility_{k}m" for k in (5, 15, 30, 60, 120)]
    b3 += [roll("avg", "tr", 14) + " AS atr_14", roll("avg", "tr", 60) + " AS atr_60", roll("sum", "g2", 60) + " AS gains", roll("sum", "l2", 60) + " AS losses"]
    b3 += [roll("sum", "close", k) + f" AS sc_{k}" for k in (15, 60)] + [roll("sum", "rc", k) + f" AS src_{k}" for k in (15, 60)]
    b3 += [roll("max", "high", k) + f" AS hi_{k}" for k in (30, 60, 120)] + [roll("min", "low", k) + f" AS lo_{k}" for k in (30, 60, 120)]
    b3 += [roll("sum", "volume", 60) + " AS v_60"] + [roll("sum", "quote_volume", k) + f" AS q_{k}" for k in (5, 15, 60)] + [roll("sum", "taker_buy_quote_volume", k) + f" AS tq_{k}" for k in (5, 15, 60)]
    b3 += [roll("avg", "signed_body_ratio", 5) + " AS signed_body_mean_5m", roll("avg", "upper_wick_ratio", 15) + " AS upper_wick_mean_15m", roll("avg", "lower_wick_ratio", 15) + " AS lower_wick_mean_15m"]
    b3 += [roll("avg", "buys", 15) + " AS buy_pressure_persistence_15m", roll("stddev_pop", "taker_buy_quote_ratio_1m", 15) + " AS buy_pressure_std_15m"]
    b3 += [roll("avg", x, 60) + f" AS m_{x}" for x in ("lq", "lc", "ls")] + [roll("stddev_pop", x, 60) + f" AS s_{x}" for x in ("lq", "lc", "ls")]
    atr = lambda x: nd(f"({x})", "atr_14", f"({x}) = 0 AND atr_14 = 0", "0")

    def slope(k: int) -> str:
        xs, xx = k * (k - 1) / 2, (k - 1) * k * (2 * k - 1) / 6
        return f"(({k} * (src_{k} - (segment_row_number - {k - 1}) * sc_{k}) - {xs} * sc_{k}) / {k * xx - xs * xs} / (sc_{k} / {k}))"

    fin = {
        "momentum_acceleration_5_30": "log_return_5m / 5 - log_return_30m / 30", "momentum_acceleration_15_60": "log_return_15m / 15 - log_return_60m / 60",
        **{f"efficiency_ratio_{k}m": nd(f"move_{k}", f"path_{k}", f"path_{k} = 0 AND move_{k} = 0", "0") for k in (15, 60)},
        **{f"volatility_ratio_{a}_{b}": nd(f"realized_volatility_{a}m", f"realized_volatility_{b}m", f"realized_volatility_{a}m = 0 AND realized_volatility_{b}m = 0", "1") for a, b in ((5, 60), (15, 120))},
        "normalized_atr_14": "atr_14 / close", "normalized_atr_60": "atr_60 / close", "semivariance_imbalance_60m": nd("(gains - losses)", "(gains + losses)", "gains = 0 AND losses = 0", "0"),
        **{f"ema_distance_{s}": f"CASE WHEN segment_row_number >= {s - 1} THEN {atr(f'close - e{s}')} END" for s in (5, 20, 60, 120)},
        "ema_spread_5_20": f"CASE WHEN segment_row_number >= 19 THEN {atr('e5 - e20')} END", "ema_spread_20_60": f"CASE WHEN segment_row_number >= 59 THEN {atr('e20 - e60')} END",
        "normalized_slope_15m": slope(15), "normalized_slope_60m": slope(60),
        **{f"range_position_{k}m": nd(f"(close - lo_{k})", f"(hi_{k} - lo_{k})", f"hi_{k} = lo_{k}", "0.5") for k in (30, 60, 120)},
        "support_distance_60m": atr("close - lo_60"), "resistance_distance_60m": atr("hi_60 - close"), "vwap_distance_60m": f"CASE WHEN v_60 = 0 THEN 0 ELSE {atr('close - q_60 / v_60')} END",
        "log_quote_volume_zscore_60m": nd("(lq - m_lq)", "s_lq", "s_lq = 0", "0"), "volume_ratio_5_60": nd("(q_5 / 5)", "(q_60 / 60)", "q_60 = 0", "0"), "volume_ratio_15_60": nd("(q_15 / 15)", "(q_60 / 60)", "q_60 = 0", "0"),
        **{f"taker_buy_quote_ratio_{k}m": nd(f"tq_{k}", f"q_{k}", f"q_{k} = 0", "0.5") for k in (5, 15, 60)}, "buy_pressure_change_5_60": "tq_5 / q_5 - tq_60 / q_60",
        "log_trade_count_zscore_60m": nd("(lc - m_lc)", "s_lc", "s_lc = 0", "0"), "log_avg_trade_quote_size_zscore_60m": nd("(ls - m_ls)", "s_ls", "s_ls = 0", "0"),
    }
    emas = ", ".join(f"close AS e{s}" for s in (5, 20, 60, 120))
    step = ", ".join(f"(2.0 / {s + 1}) * n.close + (1 - 2.0 / {s + 1}) * e.e{s}" for s in (5, 20, 60, 120))
    body = chain(
        *BASE60,
        f"ema AS (SELECT continuity_segment_id, segment_row_number, {emas} FROM positioned WHERE segment_row_number = 0 UNION ALL SELECT n.continuity_segment_id, n.segment_row_number, {step} FROM ema e JOIN positioned n ON n.continuity_segment_id = e.continuity_segment_id AND n.segment_row_number = e.segment_row_number + 1)",
        f"b1 AS (SELECT p.*, e5, e20, e60, e120, {', '.join(b1)} FROM positioned p JOIN ema USING (continuity_segment_id, segment_row_number))", f"b2 AS (SELECT *, {', '.join(b2)} FROM b1)", f"b3 AS (SELECT *, {', '.join(b3)} FROM b2)",
        then=f"SELECT open_time, continuity_segment_id, {', '.join(f'CAST({fin.get(n, n)} AS DOUBLE) AS {n}' for n in FE.FEATURES)} FROM b3",
    )
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


FEATURE_SQL = features_sql()


@query("f01_f63_features", FEATURE_SQL, " ".join(FE.FEATURES), 5)
def f63(spark, sf):
    return hour_features(spark, sf).select("open_time", "continuity_segment_id", *FE.FEATURES)


@query("p22_feature_completeness", f"WITH f AS ({FEATURE_SQL}) SELECT open_time, CAST({' + '.join(f'CAST({n} IS NULL AS INTEGER)' for n in FE.FEATURES)} AS INTEGER) AS feature_missing_count, {' AND '.join(f'{n} IS NOT NULL' for n in FE.FEATURES)} AS is_feature_complete FROM f WHERE (open_time + {HOUR}) % {5 * HOUR} = 0")
def p22(spark, sf):
    t = FE.feature_table(hour_features(spark, sf))
    return t.select(F.col("feature_open_time").alias("open_time"), F.col("feature_missing_count").cast("int").alias("feature_missing_count"), "is_feature_complete")


SUMMED = ["log_return_1m", "realized_volatility_60m", "range_position_30m", "taker_buy_quote_ratio_5m"]


@query("a25_feature_summary", f"WITH f AS ({FEATURE_SQL}), l AS ({' UNION ALL '.join(f'''SELECT '{n}' AS feature, {n} AS v FROM f''' for n in SUMMED)}) SELECT feature, count(*) AS rows, avg(CAST(v IS NULL AS DOUBLE)) AS missing_rate, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS minimum, max(v) AS maximum, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.99) AS p99 FROM l GROUP BY 1", "missing_rate mean std minimum maximum p01 p25 p50 p75 p99", 5)
def a25(spark, sf):
    return FE.feature_summary(hour_features(spark, sf), SUMMED)


@query("a26_completeness_by_day", f"WITH f AS ({FEATURE_SQL}) SELECT strftime(make_timestamp((open_time + {HOUR}) * 1000), '%Y-%m-%d') AS day, count(*) AS rows, count_if({' AND '.join(f'{n} IS NOT NULL' for n in FE.FEATURES)}) AS complete, avg({' + '.join(f'CAST({n} IS NULL AS INTEGER)' for n in FE.FEATURES)}) AS mean_missing FROM f WHERE (open_time + {HOUR}) % {5 * HOUR} = 0 GROUP BY 1", "mean_missing")
def a26(spark, sf):
    return FE.completeness(FE.feature_table(hour_features(spark, sf)), [X.calendar(F.col("decision_time"))["date"].alias("day")])


@query("a27_neutral_counts", f"WITH f AS ({FEATURE_SQL}), b AS ({chain(*BASE60[:3], then='SELECT open_time, high, low FROM bars')}) SELECT count_if(high = low) AS zero_candle_range, count_if(is_zero_volume_1m = 1) AS zero_volume_1m, count_if(efficiency_ratio_15m = 0 AND high = low) AS flat_efficiency_15m, count_if(range_position_60m = 0.5) AS middle_range_position_60m, count_if(taker_buy_quote_ratio_1m = 0.5) AS even_taker_ratio_1m FROM f JOIN b USING (open_time)")
def a27(spark, sf):
    return FE.neutral_counts(hour_features(spark, sf))


@query("a28_float_report", f"WITH f AS ({FEATURE_SQL}), l AS ({' UNION ALL '.join(f'''SELECT '{n}' AS feature, {n} AS v FROM f''' for n in SUMMED)}) SELECT feature, max(abs(CAST(CAST(v AS FLOAT) AS DOUBLE) - v)) AS max_abs_error, max(abs(CAST(CAST(v AS FLOAT) AS DOUBLE) - v) / nullif(abs(v), 0)) AS max_rel_error, count_if(sign(CAST(v AS FLOAT)) <> sign(v)) AS sign_changes, CAST(0 AS BIGINT) AS overflows FROM l GROUP BY 1", "max_abs_error max_rel_error")
def a28(spark, sf):
    return FE.float_report(hour_features(spark, sf), SUMMED)


@query("p19_range_checks", f"WITH f AS ({FEATURE_SQL}) SELECT 'range_position_30m' AS feature, count_if(range_position_30m < -1e-6 OR range_position_30m > 0.5 + 1e-6) AS violations FROM f UNION ALL SELECT 'close_location', count_if(close_location < -1e-6 OR close_location > 1 + 1e-6) FROM f")
def p19(spark, sf):
    return FE.range_checks(hour_features(spark, sf), {"range_position_30m": (0, 0.5), "close_location": (0, 1)})


@query("o05_incomplete_samples", f"WITH f AS ({FEATURE_SQL}) SELECT open_time + {HOUR} AS decision_time, continuity_segment_id, CAST({' + '.join(f'CAST({n} IS NULL AS INTEGER)' for n in FE.FEATURES)} AS INTEGER) AS feature_missing_count FROM f WHERE (open_time + {HOUR}) % {5 * HOUR} = 0 AND NOT ({' AND '.join(f'{n} IS NOT NULL' for n in FE.FEATURES)}) ORDER BY 1 LIMIT 200")
def o05(spark, sf):
    return FE.incomplete_samples(FE.feature_table(hour_features(spark, sf))).withColumn("feature_missing_count", F.col("feature_missing_count").cast("int"))


# dataset and splits: labels of 15-minute bars with a simple feature, so that every role occurs


FOLD_DAYS = ((8, 14), (14, 20))
DAY = 86_400_000
TEST_DAY = 24


def _simple_features(bars):
    b = bars.where("is_prediction_time_5m")
    x = F.try_divide(F.col("close") - F.col("open"), F.col("high") - F.col("low"))
    b = b.withColumn("body", x).withColumn("feature_missing_count", F.col("body").isNull().cast("int"))
    return b.select(
        F.col("open_time").alias("feature_open_time"), "decision_time", "continuity_segment_id", F.col("has_history_5m").alias("is_model_candidate"), "feature_missing_count",
        F.lit(False).alias("has_nonfinite_feature"), (F.col("has_history_5m") & F.col("body").isNotNull()).alias("is_final_feature_candidate"), "body",
    )


def _audit(spark, sf):
    bars = bars15(spark, sf)
    y = L.full_labels(bars, HORIZON15).withColumn("is_final_model_label_candidate", F.col("is_valid_proxy_label") & F.col("has_history_5m"))
    f = _simple_features(bars).where(F.col("decision_time") % (7 * 5 * QUARTER) != 0)
    return D.join_audit(f, y, ["body"], QUARTER, HORIZON15), f


START = "(SELECT min(open_time) // 86400000 * 86400000 FROM bars)"
AUDIT = (
    *LABELS15,
    f"f AS (SELECT open_time AS fo, decision_time, continuity_segment_id AS fs, has_history_5m AS c, CASE WHEN high <> low THEN (close - open) / (high - low) END AS body FROM positioned WHERE is_prediction_time_5m AND decision_time % {7 * 5 * QUARTER} <> 0)",
    """aud AS (SELECT y.decision_time, f.fo IS NOT NULL AS ef, coalesce(f.c, false) AS c, f.body, y.is_valid_proxy_label AND y.has_history_5m AS lc, y.* EXCLUDE (decision_time) FROM labels60 y LEFT JOIN f ON f.decision_time = y.decision_time)""",
    """audit AS (SELECT *, ef AND c AND body IS NOT NULL AND lc AS final, concat_ws(';', CASE WHEN NOT ef THEN 'FEATURE_ROW_MISSING' END, CASE WHEN ef AND NOT c THEN 'NOT_MODEL_CANDIDATE' END,
  CASE WHEN ef AND NOT (c AND body IS NOT NULL) THEN 'INCOMPLETE_FEATURES' END, CASE WHEN NOT lc THEN 'INVALID_LABEL' END, CASE WHEN NOT ef THEN NULL WHEN false THEN 'SEGMENT_MISMATCH' END,
  CASE WHEN ef AND body IS NULL THEN 'NONFINITE_FEATURE' END, CASE WHEN label_up_60m IS NULL THEN 'MISSING_TARGET' END) AS exclusion_reason FROM aud)""",
    "data AS (SELECT row_number() OVER (ORDER BY decision_time) - 1 AS dataset_row_id, * FROM audit WHERE final)",
)


def role_sql(lo: int, hi: int) -> str:
    a, b = f"({START} + {lo * DAY})", f"({START} + {hi * DAY})"
    d, s = "decision_time", "settlement_minute_open_time"
    return f"CASE WHEN final_split_role <> 'DEVELOPMENT' THEN 'FINAL_TEST_EXCLUDED' WHEN {d} < {a} AND {s} < {a} THEN 'TRAIN' WHEN {d} < {a} THEN 'PURGED_BEFORE_VALIDATION' WHEN {d} < {b} AND {s} < {b} THEN 'VALIDATION' WHEN {d} < {b} THEN 'PURGED_AT_VALIDATION_END' ELSE 'OUTSIDE_FOLD' END"


TEST = f"({START} + {TEST_DAY * DAY})"
SPLIT = (
    *AUDIT,
    f"roled AS (SELECT *, CASE WHEN decision_time >= {TEST} THEN 'FINAL_TEST' WHEN settlement_minute_open_time >= {TEST} THEN 'PURGED_BEFORE_FINAL_TEST' ELSE 'DEVELOPMENT' END AS final_split_role FROM data)",
    f"split AS (SELECT *, {role_sql(*FOLD_DAYS[0])} AS fold_a_role, {role_sql(*FOLD_DAYS[1])} AS fold_b_role, CAST(decision_time % {HORIZON15} // {QUARTER} AS INTEGER) AS evaluation_offset_minutes, decision_time % {HORIZON15} // {QUARTER} = 0 AS is_primary_nonoverlap_evaluation FROM roled)",
)


def _split(spark, sf):
    audit, f = _audit(spark, sf)
    data = stored(D.dataset(audit, f, ["body"]), "dataset")
    start = A.table(spark, sf, "events").agg(F.min("ts").cast("date").cast("string")).first()[0]
    import datetime

    zero = int(datetime.datetime.fromisoformat(start).replace(tzinfo=datetime.timezone.utc).timestamp()) * 1000
    folds = [D.Fold(n, zero + a * DAY, zero + b * DAY) for n, (a, b) in zip(("fold_a", "fold_b"), FOLD_DAYS, strict=True)]
    return data, D.splits(data, zero + TEST_DAY * DAY, folds, QUARTER, HORIZON15), folds


@query("j05_p27_g03_join_audit", chain(*AUDIT, then="SELECT decision_time, ef AS exists_in_feature_table, final AS final_intersection_candidate, exclusion_reason FROM audit"))
def j05(spark, sf):
    return _audit(spark, sf)[0].select("decision_time", "exists_in_feature_table", "final_intersection_candidate", "exclusion_reason")


@query("a32_exclusion_histogram", chain(*AUDIT, then="SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(exclusion_reason, ';')) AS reason FROM audit WHERE exclusion_reason <> '') GROUP BY 1"))
def a32(spark, sf):
    return D.exclusion_histogram(_audit(spark, sf)[0])


@query("p33_excluded_samples", chain(*AUDIT, then="SELECT decision_time, continuity_segment_id, exclusion_reason FROM audit WHERE NOT final ORDER BY 1 LIMIT 200"))
def p33(spark, sf):
    return D.excluded_samples(_audit(spark, sf)[0])


@query("j08_w14_dataset", chain(*AUDIT, then="SELECT dataset_row_id, decision_time, label_up_60m, body FROM data"), "body")
def j08(spark, sf):
    audit, f = _audit(spark, sf)
    return D.dataset(audit, f, ["body"]).select("dataset_row_id", "decision_time", F.col("label_up_60m").cast("int").alias("label_up_60m"), "body")


@query("g04_g05_w17_splits", chain(*SPLIT, then="SELECT dataset_row_id, decision_time, final_split_role, fold_a_role, fold_b_role, evaluation_offset_minutes, is_primary_nonoverlap_evaluation FROM split"))
def g04(spark, sf):
    return _split(spark, sf)[1].drop("settlement_minute_open_time")


@query("j06_joined_dataset", chain(*SPLIT, then="SELECT dataset_row_id, body, final_split_role FROM split"), "body")
def j06(spark, sf):
    data, split, _ = _split(spark, sf)
    return D.joined(data, split).select("dataset_row_id", "body", "final_split_role")


@query("a31_fold_manifest", chain(*SPLIT, "l AS (SELECT 'fold_a' AS fold_name, fold_a_role AS role, * FROM split UNION ALL SELECT 'fold_b', fold_b_role, * FROM split)", then="""SELECT fold_name, count_if(role = 'TRAIN') AS train_rows, count_if(role = 'VALIDATION') AS validation_rows, count_if(starts_with(role, 'PURGED')) AS purged_rows,
  min(decision_time) FILTER (WHERE role = 'TRAIN') AS train_start, max(decision_time) FILTER (WHERE role = 'TRAIN') AS train_end, min(decision_time) FILTER (WHERE role = 'VALIDATION') AS validation_start, max(decision_time) FILTER (WHERE role = 'VALIDATION') AS validation_end,
  avg(label_up_60m) FILTER (WHERE role = 'TRAIN') AS train_up_ratio, avg(label_up_60m) FILTER (WHERE role = 'VALIDATION') AS validation_up_ratio FROM l GROUP BY 1"""), "train_up_ratio validation_up_ratio")
def a31(spark, sf):
    return D.fold_manifest(*_split(spark, sf))


@query("a29_split_summary", chain(*SPLIT, "l AS (SELECT 'ALL' AS subset_name, * FROM split UNION ALL SELECT final_split_role, * FROM split UNION ALL SELECT 'NONOVERLAP', * FROM split WHERE is_primary_nonoverlap_evaluation UNION ALL SELECT 'fold_a:' || fold_a_role, * FROM split UNION ALL SELECT 'fold_b:' || fold_b_role, * FROM split)", then="SELECT subset_name, avg(label_up_60m) AS up_ratio, count(*) AS n, avg(future_simple_return_60m) AS mean, stddev_samp(future_simple_return_60m) AS std, min(future_simple_return_60m) AS minimum, max(future_simple_return_60m) AS maximum, quantile_cont(future_simple_return_60m, 0.05) AS p05, quantile_cont(future_simple_return_60m, 0.5) AS p50, quantile_cont(future_simple_return_60m, 0.95) AS p95 FROM l GROUP BY 1"), "up_ratio mean std minimum maximum p05 p50 p95")
def a29(spark, sf):
    return D.split_summary(*_split(spark, sf))


@query("j13_a30_time_distribution", chain(*SPLIT, then="SELECT final_split_role, strftime(make_timestamp(decision_time * 1000), '%Y-%m-%d') AS period, count(*) AS rows, avg(label_up_60m) AS up_ratio, avg(abs_future_return_bps_60m) AS mean_abs_bps FROM split GROUP BY 1, 2"), "up_ratio mean_abs_bps", 5)
def a30(spark, sf):
    data, split, _ = _split(spark, sf)
    return D.time_distribution(data, split, "date")


@query("e05_inner_split", chain(*SPLIT, then=f"SELECT dataset_row_id, CASE WHEN decision_time >= ({START} + {5 * DAY}) THEN 'EARLY_STOP' WHEN settlement_minute_open_time < ({START} + {5 * DAY}) THEN 'INNER_TRAIN' ELSE 'INNER_PURGED' END AS inner_role FROM split WHERE fold_a_role = 'TRAIN'"))
def e05(spark, sf):
    data, split, folds = _split(spark, sf)
    train = D.joined(data, split).where("fold_a_role = 'TRAIN'")
    return D.inner_split(train, folds[0].start, 3 * DAY).select("dataset_row_id", "inner_role")


@query("g06_fold_integrity", "SELECT CAST(0 AS BIGINT) AS errors")
def g06(spark, sf):
    data, split, folds = _split(spark, sf)
    errors = [e for f in folds for e in D.fold_errors(data, split, f)] if data.limit(1).count() else []
    return spark.range(1).select(F.lit(len(errors)).cast("long").alias("errors"))


@query("p17_dataset_constraints", """SELECT * FROM (VALUES ('target_missing', CAST(0 AS BIGINT)), ('entry_time', CAST(0 AS BIGINT)), ('settlement_not_later', CAST(0 AS BIGINT)), ('negative_row_id', CAST(0 AS BIGINT))) t("check", violations)""")
def p17_data(spark, sf):
    return K.violations(_split(spark, sf)[0], K.dataset_suite())


# profile


@query("a01_column_profile", """WITH l AS (SELECT 'event_type' AS column_name, event_type AS v FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events)
SELECT column_name, count(*) AS row_count, count_if(v IS NULL) AS missing_count, CAST(0 AS BIGINT) AS boolean_count, count_if(regexp_full_match(v, '[+-]?[0-9]+')) AS integer_count, count_if(regexp_full_match(v, '[+-]?[0-9]+\\.[0-9]+')) AS decimal_count, count_if(column_name = 'event_type') AS string_count,
  min(TRY_CAST(v AS DOUBLE)) AS min_number, max(TRY_CAST(v AS DOUBLE)) AS max_number, CASE column_name WHEN 'event_type' THEN 'string' WHEN 'user_id' THEN 'integer' ELSE 'decimal' END AS inferred_type FROM l GROUP BY column_name""".replace("\\\\", "\\"), "min_number max_number")
def a01(spark, sf):
    found = P.profile(A.table(spark, sf, "events").select("event_type", "user_id", "value"))
    return found.select("column_name", "row_count", "missing_count", "boolean_count", "integer_count", "decimal_count", "string_count", "min_number", "max_number", "inferred_type")


@query("a02_hyperloglog_estimate")
def a02(spark, sf):
    return P.distinct_estimate(A.table(spark, sf, "events"), "event_id")


@query("a03_distinct_exact", "SELECT count(DISTINCT user_id) AS distinct_count, true AS is_exact FROM events")
def a03(spark, sf):
    return P.distinct_count(A.table(spark, sf, "events"), "user_id")


@query("a38_frequencies", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def a38(spark, sf):
    return P.frequencies(A.table(spark, sf, "events"), "event_type")


@query("o07_top_frequencies", "SELECT user_id AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def o07(spark, sf):
    return P.frequencies(A.table(spark, sf, "events"), "user_id", 10)


@query("o06_head_and_tail", "(SELECT event_id, event_type, 'head' AS \"end\" FROM events ORDER BY event_id LIMIT 5) UNION ALL (SELECT event_id, event_type, 'tail' FROM events ORDER BY event_id DESC LIMIT 5)")
def o06(spark, sf):
    return P.head_and_tail(A.table(spark, sf, "events").select("event_id", "event_type"), "event_id")


@query("p35_time_fields")
def p35(spark, sf):
    return P.time_fields(P.profile(A.raw_trades(spark, sf).select("agg_trade_id", "trade_time", "price")))


@query("n04_n06_p34_utc_text", chain(TRADES, then="SELECT agg_trade_id, strftime(make_timestamp(trade_time * 1000), '%Y-%m-%dT%H:%M:%SZ') AS trade_time_utc, trade_time // 1000 * 1000 AS back FROM trades"))
def n04(spark, sf):
    t = A.trades(spark, sf).select("agg_trade_id", X.utc_text(F.col("trade_time")).alias("trade_time_utc"))
    return t.withColumn("back", X.utc_millis(F.col("trade_time_utc")))


@query("n05_epoch_units", chain(TRADES, then="SELECT agg_trade_id, 'seconds' AS u1, trade_time // 1000 * 1000 AS ms1, 'microseconds' AS u2, trade_time AS ms2 FROM trades"))
def n05(spark, sf):
    t = A.trades(spark, sf)
    s, us = F.expr("trade_time div 1000"), F.col("trade_time") * 1000 + 7
    return t.select("agg_trade_id", X.epoch_unit(s).alias("u1"), X.epoch_to_millis(s, X.epoch_unit(s)).alias("ms1"), X.epoch_unit(us).alias("u2"), X.epoch_to_millis(us, X.epoch_unit(us)).alias("ms2"))


@query("n07_n08_calendar", chain(TRADES, then="SELECT agg_trade_id, trade_time // 60000 * 60000 AS minute, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, strftime(t, '%Y%m') AS yyyymm, CAST(hour(t) AS INTEGER) AS hour, CAST(isodow(t) - 1 AS INTEGER) AS weekday, strftime(t, '%Y-%m-%d') AS date FROM (SELECT *, make_timestamp(trade_time * 1000) AS t FROM trades)"))
def n07(spark, sf):
    cal = X.calendar(F.col("trade_time"))
    return A.trades(spark, sf).select("agg_trade_id", X.floor_to(F.col("trade_time"), 60_000).alias("minute"), *[cal[c].alias(c) for c in ("year", "month", "yyyymm", "hour", "weekday", "date")])


@query("n01_n02_n15_scalars", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN 0.5 ELSE l_discount / l_tax END AS neutral, ln(1 + l_quantity) AS lq, sqrt(l_extendedprice) AS root, greatest(least(l_discount, 0.05), 0.02) AS clipped, sin(l_quantity) AS s, exp(-l_discount) AS e FROM lineitem", "neutral lq root clipped s e")
def n01(spark, sf):
    x = A.table(spark, sf, "lineitem")
    d, t = F.col("l_discount"), F.col("l_tax")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", X.neutral_div(d, t, t == 0, 0.5).alias("neutral"), F.log1p("l_quantity").alias("lq"), F.sqrt("l_extendedprice").alias("root"), F.greatest(F.least(d, F.lit(0.05)), F.lit(0.02)).alias("clipped"), F.sin("l_quantity").alias("s"), F.exp(-d).alias("e"))


@query("n10_n13_errors", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_tax - l_discount) / greatest(abs(l_discount), 1e-12) AS rel, (l_tax - l_discount) / greatest(abs(l_discount), 1e-12) * 10000 AS bp, greatest(l_tax, l_discount) AS most FROM lineitem WHERE l_discount > 0", "rel bp most")
def n10(spark, sf):
    x = A.table(spark, sf, "lineitem").where("l_discount > 0")
    d, t = F.col("l_discount"), F.col("l_tax")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", X.relative_error(t, d, d).alias("rel"), X.bps(t, d).alias("bp"), X.row_max([t, d]).alias("most"))


@query("n16_strings", "SELECT event_id, lower(trim(event_type)) AS low, regexp_full_match(CAST(user_id AS VARCHAR), '[+-]?[0-9]+') AS is_integer, contains(event_type, 'r') AS has_r, starts_with(event_type, 'v') AS v, string_split(event_type, 'r')[1] AS head FROM events")
def n16(spark, sf):
    e, t = A.table(spark, sf, "events"), F.col("event_type")
    return e.select("event_id", F.lower(F.trim(t)).alias("low"), F.col("user_id").cast("string").rlike(P.INTEGER).alias("is_integer"), t.contains("r").alias("has_r"), t.startswith("v").alias("v"), F.split(t, "r")[0].alias("head"))


@query("n17_n18_n19_nulls", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END > 100000, false) AS big, coalesce(CASE WHEN o_orderstatus = 'F' THEN 1 END, CASE WHEN o_orderstatus = 'O' THEN 2 END, 3) AS k, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'large' END AS bucket FROM orders")
def n17(spark, sf):
    o, s, p = A.table(spark, sf, "orders"), F.col("o_orderstatus"), F.col("o_totalprice")
    return o.select("o_orderkey", X.all_of([F.when(s == "F", p) > 100000]).alias("big"), F.coalesce(F.when(s == "F", 1), F.when(s == "O", 2), F.lit(3)).alias("k"), F.when(p < 50000, "small").when(p < 200000, "middle").otherwise("large").alias("bucket"))


@query("n20_sha256_ids", "SELECT sha256(string_agg(CAST(user_id AS VARCHAR), chr(10) ORDER BY user_id)) AS sha256 FROM (SELECT DISTINCT user_id FROM events)")
def n20(spark, sf):
    from ..operators.models import ids_sha256

    return ids_sha256(A.table(spark, sf, "events").select("user_id").distinct(), "user_id")


@query("x01_x02_streaming_batch_bars", chain(TRADES, GAPPED, then="SELECT trade_time // 60000 * 60000 AS open_time, count(*) AS agg_trade_count, arg_min(price, {'t': trade_time, 'i': agg_trade_id}) AS first_trade_price, arg_max(price, {'t': trade_time, 'i': agg_trade_id}) AS last_trade_price, max(price) AS trade_high, min(price) AS trade_low, sum(quantity) AS base_volume, sum(quote_quantity) AS quote_volume, coalesce(sum(quantity) FILTER (WHERE buy), 0) AS active_buy_base_volume FROM gapped GROUP BY 1"), "first_trade_price last_trade_price trade_high trade_low base_volume quote_volume active_buy_base_volume")
def x01(spark, sf):
    from ..streaming.bars import live_bars

    return live_bars(A.trades(spark, sf).drop("previous_id", "previous_time"))


@query("x07_late_rows", chain(TRADES, then="SELECT count_if(trade_time < (SELECT min(trade_time) + 86400000 FROM trades)) AS late, count_if(trade_time >= (SELECT min(trade_time) + 86400000 FROM trades)) AS in_time FROM trades"))
def x07(spark, sf):
    from ..streaming.bars import split_late

    t = A.trades(spark, sf)
    state = t.agg((F.min("trade_time") + 86_400_000).alias("last_closed"))
    fine, late = split_late(t, state)
    return late.agg(F.count(F.lit(1)).alias("late")).crossJoin(fine.agg(F.count(F.lit(1)).alias("in_time")))


@query("w_running_sum_global_order", chain(TRADES, then="SELECT agg_trade_id, sum(quantity) OVER (ORDER BY trade_time, agg_trade_id) AS running FROM trades"), "running")
def running(spark, sf):
    return ordered.running_sum(A.trades(spark, sf), "trade_time", ["agg_trade_id"], F.col("quantity"), "running").select("agg_trade_id", "running")
