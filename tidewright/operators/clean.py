"""Cleaning of raw trades and bars, segments of gap-free bars, and reports on both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .ordered import DAY_MS, HOUR_MS, global_lag, runs


@dataclass
class Cleaned:
    """Clean rows with side tables; all are lazy."""

    rows: DataFrame
    counts: DataFrame
    side: dict[str, DataFrame]


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in file order. One pass of pre-aggregated maxima, no sort of a key's rows."""
    others = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row"))
    return last.select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def clean_trades(raw: DataFrame, order: str = "_ord", width: int = HOUR_MS) -> Cleaned:
    """Last row of each id, then the rows with a time, a positive price and quantity and a readable maker flag.

    Adds quote_quantity, is_active_buy, is_active_sell, id_gap_before (missing ids since the row before in (time, id)
    order) and time_gap_before.
    """
    last = keep_last(raw, ["agg_trade_id"], order).withColumns(
        {"price": X.number("price"), "quantity": X.number("quantity"), "trade_time": F.col("trade_time").try_cast("long"), "is_buyer_maker": X.parse_bool("is_buyer_maker")}
    )
    bad = {
        "missing_time": F.col("trade_time").isNull(),
        "bad_price": ~X.finite_positive("price"),
        "bad_quantity": ~X.finite_positive("quantity"),
        "bad_maker_flag": F.col("is_buyer_maker").isNull(),
    }
    counts = last.agg(F.count(F.lit(1)).alias("distinct_ids"), *[F.count_if(c).alias(n) for n, c in bad.items()])
    good = last.where(~X.any_of(list(bad.values()))).drop(order)
    good = good.withColumns({"quote_quantity": F.col("price") * F.col("quantity"), "is_active_buy": ~F.col("is_buyer_maker"), "is_active_sell": F.col("is_buyer_maker")})
    good = with_id_gaps(good, width)
    return Cleaned(good, counts, {"same_time": same_time_groups(good)})


def with_id_gaps(trades: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """Trades with previous id and time in (time, id) order, the missing ids and the milliseconds between."""
    out = global_lag(trades, "trade_time", ["agg_trade_id"], {"previous_id": "agg_trade_id", "previous_time": "trade_time"}, width)
    step = F.col("agg_trade_id") - F.col("previous_id")
    return out.withColumns({
        "id_gap_before": F.when(step > 1, step - 1).otherwise(0).cast("long"),
        "time_gap_before": F.col("trade_time") - F.col("previous_time"),
    })


def same_time_groups(trades: DataFrame) -> DataFrame:
    """(groups, rows, largest) of trades that share a millisecond."""
    shared = trades.groupBy("trade_time").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def long_quiet(trades: DataFrame, threshold: int) -> DataFrame:
    """(intervals, longest) between neighbouring trades that last longer than the threshold."""
    return trades.agg(F.count_if(F.col("time_gap_before") > threshold).alias("intervals"), F.max("time_gap_before").alias("longest"))


def order_violations(df: DataFrame, time: str, order: str, width: int) -> DataFrame:
    """(violations): rows whose time is before that of the row before them in file order."""
    seen = global_lag(df, order, [], {"_previous": time}, width)
    return seen.agg(F.count_if(F.col(time) < F.col("_previous")).alias("violations"))


def bar_faults() -> dict[str, Column]:
    """Reasons to reject a bar; a bar may have several."""
    prices = ["open", "high", "low", "close"]
    return {
        "non_positive_price": X.any_of([~X.finite_positive(c) for c in prices]),
        "negative_volume": X.any_of([~X.finite_nonnegative(c) for c in ("volume", "quote_volume")]),
        "bad_price_order": X.any_of([
            F.col("high") < F.greatest("open", "close", "low"),
            F.col("low") > F.least("open", "close", "high"),
        ]),
    }


def clean_bars(raw: DataFrame, interval: int = 60_000, order: str = "_ord", width: int = DAY_MS) -> Cleaned:
    """Last row of each open time, then the sound bars, with repaired close times and segments."""
    last = keep_last(raw, ["open_time"], order)
    faults = bar_faults()
    counts = last.agg(F.count(F.lit(1)).alias("distinct_times"), *[F.count_if(c).alias(n) for n, c in faults.items()])
    good = last.where(~X.any_of(list(faults.values()))).drop(order)
    due = F.col("open_time") + (interval - 1)
    good = good.withColumns({"close_time_repaired": F.coalesce(F.col("close_time") != due, F.lit(True)), "expected_close_time": due})
    repairs = good.where("close_time_repaired").select("open_time", "close_time", "expected_close_time")
    good = segments(good.withColumn("close_time", due), interval, width)
    return Cleaned(good, counts, {"repairs": repairs, "gaps": gap_report(good, interval)})


def segments(bars: DataFrame, interval: int, width: int = DAY_MS) -> DataFrame:
    """Bars with delta, gap_before_bars, previous_open_time and continuity_segment_id.

    A bar whose distance to the one before is not the interval, longer or shorter, opens a segment; ids count from 0.
    """
    out = runs(bars, "open_time", interval, width).withColumnsRenamed({"previous": "previous_open_time", "run": "continuity_segment_id"})
    delta = F.col("open_time") - F.col("previous_open_time")
    gap = F.when(delta > interval, F.expr(f"(open_time - previous_open_time) div {interval} - 1")).otherwise(0).cast("long")
    return out.withColumns({"delta": delta, "gap_before_bars": gap})


def gap_report(bars: DataFrame, interval: int) -> DataFrame:
    """One row per segment start but the first."""
    found = bars.where(F.col("delta") != interval)
    return found.select(
        F.col("previous_open_time"), F.col("open_time"), "delta", F.col("gap_before_bars").alias("missing_bars"),
        (F.col("continuity_segment_id") - 1).alias("previous_segment_id"), F.col("continuity_segment_id").alias("segment_id"),
    )


def segment_sizes(bars: DataFrame) -> DataFrame:
    return bars.groupBy("continuity_segment_id").agg(
        F.min("open_time").alias("start_time"), F.max("open_time").alias("end_time"), F.count(F.lit(1)).alias("bars")
    )


def longest_segment(bars: DataFrame) -> DataFrame:
    """The segment with the most bars, the first of equals."""
    return segment_sizes(bars).orderBy(F.desc("bars"), "continuity_segment_id").limit(1)


def interval_histogram(bars: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent distances between neighbouring bars."""
    return bars.where("delta IS NOT NULL").groupBy("delta").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "delta").limit(top)


def with_positions(bars: DataFrame, interval: int, history: tuple[int, ...] = (5, 15, 30, 60, 120, 240), future: tuple[int, ...] = (1, 60, 61), sample: int = 5) -> DataFrame:
    """Bars with times, position in the segment, history and future flags, and the candidate flag.

    Bars of a segment stand at the interval, so that a bar's position is its distance to the segment's start and no
    window over the segment is needed: one grouped pass finds the ends.
    """
    ends = bars.groupBy("continuity_segment_id").agg(F.min("open_time").alias("_start"), F.max("open_time").alias("_end"))
    out = bars.join(ends, "continuity_segment_id")
    out = out.withColumns({
        "feature_time": F.col("open_time") + interval,
        "decision_time": F.col("open_time") + interval,
        "segment_row_number": F.expr(f"(open_time - _start) div {interval}"),
        "segment_length": F.expr(f"(_end - _start) div {interval} + 1"),
        "minutes_until_segment_end": F.expr(f"(_end - open_time) div {interval}"),
    }).drop("_start", "_end")
    flags = {f"has_history_{k}m": F.col("segment_row_number") >= k - 1 for k in history}
    flags |= {f"has_future_{k}m": F.col("minutes_until_segment_end") >= k for k in future}
    flags["is_prediction_time_5m"] = F.col("decision_time") % (sample * interval) == 0
    out = out.withColumns(flags | {"is_segment_start": F.col("segment_row_number") == 0, "is_segment_end": F.col("minutes_until_segment_end") == 0})
    return out.withColumn("is_model_candidate", F.col("is_prediction_time_5m") & F.col(f"has_history_{max(history)}m") & F.col(f"has_future_{max(future)}m"))


def bad_flag_values(raw: DataFrame, column: str, examples: int = 20) -> DataFrame:
    """The most frequent values that are no flag."""
    bad = raw.where(X.parse_bool(column).isNull())
    return bad.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(examples)


def with_file_order(df: DataFrame, name: str = "_ord") -> DataFrame:
    """df with the order in which its files hold the rows, for the keep-last rules."""
    return df.withColumn(name, F.monotonically_increasing_id())


def global_positions(bars: DataFrame) -> DataFrame:
    """Bars with their number in the whole table and the bars that follow them."""
    from .ordered import row_numbers

    out = row_numbers(bars, "open_time", [], "global_row")
    return out.join(bars.agg(F.count(F.lit(1)).alias("_n"))).withColumn("global_until_end", F.col("_n") - 1 - F.col("global_row")).drop("_n")


def segment_windows(by: str = "continuity_segment_id", order: str = "open_time"):
    return Window.partitionBy(by).orderBy(order)
