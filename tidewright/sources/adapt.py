"""The supplied test tables in the shapes that the market and evaluation operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import clean as C
from .scratch import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as raw trades: ids, times in epoch milliseconds (floored), prices, quantities and maker flags."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.to_timestamp_ntz(F.col("ts")).cast("timestamp")) if e.schema["ts"].dataType.typeName() != "timestamp" else F.unix_micros("ts")
    return e.select(
        F.col("event_id").alias("agg_trade_id"), F.floor(micros / 1000).cast("long").alias("trade_time"), (F.lit(100.0) + F.col("value")).alias("price"),
        (F.lit(1.0) + F.pmod("user_id", F.lit(10))).alias("quantity"), F.col("event_type").isin("error", "view").cast("string").alias("is_buyer_maker"),
    )


def plain_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with their quote quantity and sides; the supplied ids are unique, so nothing is deduplicated."""
    t = raw_trades(spark, sf_dir).withColumn("is_buyer_maker", F.col("is_buyer_maker") == "true")
    return t.withColumns({"quote_quantity": F.col("price") * F.col("quantity"), "is_active_buy": ~F.col("is_buyer_maker"), "is_active_sell": F.col("is_buyer_maker")})


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean trades, with their gaps of id and time."""
    return C.with_id_gaps(plain_trades(spark, sf_dir))


def trade_bars(spark: SparkSession, sf_dir: str, interval: int, quantiles: bool = False) -> DataFrame:
    """Trade bars, written once, with the flags of the first and the last."""
    return B.boundary_flags(stored(B.aggregate_trades(trades(spark, sf_dir), interval, quantiles=quantiles), "trade_bars"))


def bars(spark: SparkSession, sf_dir: str, interval: int) -> DataFrame:
    """Bars with segments and positions, written once: one pass over the trades, however often the bars are read."""
    t = plain_trades(spark, sf_dir).withColumns({"previous_id": F.lit(None).cast("long"), "previous_time": F.lit(None).cast("long"), "id_gap_before": F.lit(0)})
    plain = stored(B.as_bars(B.aggregate_trades(t, interval, quantiles=False)), "plain_bars")
    return stored(C.with_positions(C.segments(plain, interval), interval), "bars")


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as prediction rows of three models with deterministic pseudo-probabilities and five folds."""
    y = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("dataset_row_id"), F.col("quality").cast("int").alias("y_true"))
    i = F.col("dataset_row_id")
    y = y.withColumns({
        "decision_time": i * 300_000,
        "fold_name": F.concat(F.lit("fold_"), F.pmod(i, F.lit(5)).cast("string")),
        "abs_future_return_bps_60m": F.pmod(i * 37, F.lit(300)) / 10,
        "evaluation_offset_minutes": (F.pmod(i, F.lit(12)) * 5).cast("int"),
        "is_primary_nonoverlap_evaluation": F.pmod(i, F.lit(12)) == 0,
    })
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(k).alias("k")) for n, k in (("logistic", 7919), ("momentum", 104729), ("trees", 15485863))]))
    y = y.withColumn("_m", models).select("*", "_m.model_name", "_m.k").drop("_m")
    p = F.pmod(i * F.col("k") + 300 * F.col("y_true"), F.lit(1000)) / 1000
    return y.withColumn("p_up", p).withColumn("y_pred", (F.col("p_up") >= 0.5).cast("int")).drop("k")
