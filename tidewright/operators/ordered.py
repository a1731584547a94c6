"""Operators over one total order, without a task that sees all rows.

Rows are cut into buckets of the order key. A window runs inside each bucket, and what crosses a bucket's start comes
from a table with one row per bucket, which alone is ordered as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def even_width(df: DataFrame, key: str) -> int:
    """A bucket width such that the key's range has about as many buckets as a bucket has rows, from one narrow pass."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    return max(1, math.ceil((high - low + 1) / math.sqrt(n))) if n else 1


def runs(df: DataFrame, key: str, step: int, width: int = DAY_MS) -> DataFrame:
    """df with previous (the key of the row before, NULL in the first) and run, which counts the distances other than step.

    Both come from one pass over the buckets of the key: a bucket tells its ends and the runs that begin inside it.
    """
    inside = Window.partitionBy("_bucket").orderBy(key)
    cut = df.withColumn("_bucket", F.floor(F.col(key) / width)).withColumn("_last", F.lag(key).over(inside))
    opens = F.coalesce(F.col(key) - F.col("_last") != step, F.lit(False)).cast("long")
    cut = cut.withColumn("_opens", F.sum(opens).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = cut.groupBy("_bucket").agg(F.min(key).alias("_low"), F.max(key).alias("_high"), F.max("_opens").alias("_sum"))
    order = Window.orderBy("_bucket")
    ends = ends.withColumn("_before", F.lag("_high").over(order))
    ends = ends.withColumn("_here", F.coalesce(F.col("_low") - F.col("_before") != step, F.lit(False)).cast("long"))
    ends = ends.withColumn("_base", F.sum(F.col("_here") + F.col("_sum")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum"))
    out = cut.join(ends.select("_bucket", "_before", "_base"), "_bucket", "left")
    out = out.withColumns({"previous": F.coalesce("_last", "_before"), "run": F.col("_base") + F.col("_opens")})
    return out.drop("_bucket", "_last", "_opens", "_before", "_base")


def global_lag(df: DataFrame, key: str, tie: list[str], values: dict[str, str], width: int = DAY_MS) -> DataFrame:
    """df with the previous row's values in the order (key, *tie); NULL in the first row.

    values maps new names to the columns whose previous value they get. width is the key range of a bucket.
    """
    at = F.floor(F.col(key) / width)
    order = [key, *tie]
    row = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    cut = df.withColumn("_bucket", at)
    inside = Window.partitionBy("_bucket").orderBy(*order)
    cut = cut.withColumns({"_last": F.lag(row).over(inside), "_first": F.row_number().over(inside) == 1})
    ends = df.groupBy(at.alias("_bucket")).agg(F.max_by(row, F.struct(*order)).alias("_end"))
    ends = ends.select("_bucket", F.lag("_end").over(Window.orderBy("_bucket")).alias("_before"))
    cut = cut.join(ends, "_bucket", "left")
    got = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_last"))
    return cut.withColumns({n: got[n] for n in values}).drop("_bucket", "_last", "_first", "_before")


def running_sum(df: DataFrame, key: str, tie: list[str], value: Column, name: str, width: int = DAY_MS) -> DataFrame:
    """df with the sum of value over all rows up to this one in the order (key, *tie)."""
    cut = df.withColumns({"_bucket": F.floor(F.col(key) / width), "_value": value})
    inside = Window.partitionBy("_bucket").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_inside", F.sum("_value").over(inside))
    whole = cut.groupBy("_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    out = cut.join(whole, "_bucket", "left").withColumn(name, F.col("_inside") + F.col("_before"))
    return out.drop("_bucket", "_value", "_inside", "_before")


def row_numbers(df: DataFrame, key: str, tie: list[str], name: str, width: int = DAY_MS) -> DataFrame:
    """df with a dense number from 0 in the order (key, *tie)."""
    return running_sum(df, key, tie, F.lit(1).cast("long"), name, width).withColumn(name, F.col(name) - 1)


def haloed(df: DataFrame, position: str, block: int, halo: int) -> DataFrame:
    """df cut into blocks of positions, each preceded by copies of the halo rows before it.

    Windows by (…, block) that look back at most `halo` rows give the same as windows over the whole run, and a run of
    any length is dealt to many tasks. Rows with _halo are to be dropped afterwards.
    """
    own = F.floor(F.col(position) / block).cast("long")
    copies = F.when(F.col(position) % block >= block - halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = df.withColumn("_step", F.explode(copies))
    return out.withColumns({"_block": own + F.col("_step"), "_halo": F.col("_step") == 1}).drop("_step")
