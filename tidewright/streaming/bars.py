"""Streaming forms: live bars, sessions, keep-first and keep-last deduplication, late rows and matured labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(trades: DataFrame) -> DataFrame:
    return trades.withColumn("ts", F.timestamp_millis("trade_time"))


def live_bars(trades: DataFrame, interval: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Tumbling bars of a trade stream; a bar is emitted once the watermark has passed it (append mode).

    The state per open bar is one partial aggregate. first and last go by (time, id), as in the batch form.
    """
    at = F.struct("trade_time", "agg_trade_id")
    out = timed(trades).withWatermark("ts", late).groupBy(F.window("ts", interval)).agg(
        F.count(F.lit(1)).alias("agg_trade_count"), F.min_by("price", at).alias("first_trade_price"), F.max_by("price", at).alias("last_trade_price"),
        F.max("price").alias("trade_high"), F.min("price").alias("trade_low"), F.sum("quantity").alias("base_volume"), F.sum("quote_quantity").alias("quote_volume"),
        F.sum(F.when(F.col("is_active_buy"), F.col("quantity")).otherwise(0.0)).alias("active_buy_base_volume"),
    )
    return out.select(F.unix_millis("window.start").alias("open_time"), *[c for c in out.columns if c != "window"])


def live_sessions(bars: DataFrame, gap: str, late: str = "2 minutes") -> DataFrame:
    """Gap-based sessions of a bar stream. A session ends when no bar starts within `gap` of the last; a shorter step does not end it."""
    return (
        bars.withColumn("ts", F.timestamp_millis("open_time")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("bars"), F.min("open_time").alias("start_time"), F.max("open_time").alias("end_time"))
        .drop("w")
    )


def first_of_each(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each id within the watermark."""
    return timed(trades).withWatermark("ts", late).dropDuplicatesWithinWatermark(["agg_trade_id"])


def last_of_each(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that keeps the last row of each key in a table of versions: path/version=<batch>.

    A batch is merged with the newest complete version and written as the next one, so a batch that runs again gives
    the same version.
    """

    def merge(batch: DataFrame, n: int) -> None:
        from ..operators.clean import keep_last
        from ..sources.io import path_exists

        spark = batch.sparkSession
        rows, old = batch, f"{path}/version={n - 1}"
        if n and path_exists(spark, old):
            rows = spark.read.parquet(old).unionByName(batch)
        keep_last(rows, [key], order).write.mode("overwrite").parquet(f"{path}/version={n}")

    return merge


def split_late(trades: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch against (last_closed), the end of the last closed bar."""
    j = trades.crossJoin(F.broadcast(state))
    is_late = F.coalesce(F.col("trade_time") < F.col("last_closed"), F.lit(False))
    return j.where(~is_late).drop("last_closed"), j.where(is_late).drop("last_closed")


def matured_labels(decisions: DataFrame, bars: DataFrame, horizon_minutes: int = 60, late: str = "5 minutes") -> DataFrame:
    """Decision rows joined to the bar a horizon later, within a segment, once it has arrived.

    A stream-stream join with a time bound: state older than the horizon and the watermark goes.
    """
    d = decisions.withColumn("d_ts", F.timestamp_millis("decision_time")).withWatermark("d_ts", late)
    b = bars.select(F.col("open_time").alias("settlement_time"), F.col("open").alias("settlement_price"), F.col("continuity_segment_id").alias("settlement_segment"))
    b = b.withColumn("s_ts", F.timestamp_millis("settlement_time")).withWatermark("s_ts", late)
    ms = horizon_minutes * 60_000
    same = (F.col("settlement_time") == F.col("decision_time") + ms) & (F.col("settlement_segment") == F.col("continuity_segment_id"))
    bound = (F.col("s_ts") >= F.col("d_ts")) & (F.col("s_ts") <= F.col("d_ts") + F.expr(f"INTERVAL {horizon_minutes} MINUTES"))
    out = d.join(b, same & bound)
    return out.withColumn("label_up_60m", (F.col("settlement_price") > F.col("entry_price")).cast("int"))


def running_profile(trades: DataFrame) -> DataFrame:
    """Incremental counts and a distinct estimate of a stream (complete or update mode): mergeable aggregates as state."""
    return trades.groupBy().agg(
        F.count(F.lit(1)).alias("rows"), F.min("trade_time").alias("first_time"), F.max("trade_time").alias("last_time"), F.approx_count_distinct("agg_trade_id").alias("ids")
    )
