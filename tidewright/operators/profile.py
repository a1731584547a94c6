"""Profiling of raw text tables: types, missing values, distinct counts, time units and the meaning of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Trimmed, lower-case texts that count as missing.
MISSING = ("", "na", "n/a", "nan", "null", "none", "nat")
INTEGER, DECIMAL, STAMP = r"^[+-]?\d+$", r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$", r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"

#: Aliases of logical fields of any source, the exact names first.
ALIASES = {
    "time": ("open_time", "trade_time", "transact_time", "timestamp", "time", "ts"),
    "open": ("open", "open_price"), "high": ("high", "high_price"), "low": ("low", "low_price"), "close": ("close", "close_price"),
    "volume": ("volume", "base_volume", "vol"), "quote_volume": ("quote_volume", "quote_asset_volume", "turnover"),
    "trades": ("number_of_trades", "trade_count", "count"), "price": ("price", "p"), "quantity": ("quantity", "qty", "q"),
    "trade_id": ("agg_trade_id", "trade_id", "id", "event_id"), "maker": ("is_buyer_maker", "buyer_maker", "m"),
}


#: The fields that a source of each role has, by their names; a name of several words also matches any column with all of them.
ROLES = {
    "bars": {
        "symbol": ("symbol",), "interval": ("interval",), "open_time": ("open_time",), "open_time_utc": ("open_time_utc", "open_utc"), "close_time": ("close_time",),
        "open": ("open",), "high": ("high",), "low": ("low",), "close": ("close",), "volume": ("volume", "base_volume"), "quote_volume": ("quote_volume",),
        "number_of_trades": ("number_of_trades", "trade_count", "trades"), "taker_buy_base_volume": ("taker_buy_base_volume", "taker_buy_base"),
    },
    "trades": {
        "symbol": ("symbol",), "agg_trade_id": ("agg_trade_id", "aggregate_trade_id", "a"), "price": ("price", "p"), "quantity": ("quantity", "qty", "q"),
        "first_trade_id": ("first_trade_id", "f"), "last_trade_id": ("last_trade_id", "l"), "trade_time": ("trade_time", "transact_time", "t"),
        "trade_time_utc": ("trade_time_utc", "trade_utc"), "is_buyer_maker": ("is_buyer_maker", "buyer_maker", "m"), "is_best_match": ("is_best_match", "best_match"),
    },
}


def typed(c: Column) -> dict[str, Column]:
    """Disjoint type tests of a trimmed text; a text is counted under the first that fits."""
    x, low = F.trim(c), F.lower(F.trim(c))
    missing = c.isNull() | low.isin(*MISSING)
    boolean = ~missing & low.isin("true", "false")
    integer = ~missing & ~boolean & x.rlike(INTEGER)
    decimal = ~missing & ~boolean & ~integer & x.rlike(DECIMAL)
    stamp = ~missing & ~boolean & ~integer & ~decimal & x.rlike(STAMP)
    return {"missing": missing, "boolean": boolean, "integer": integer, "decimal": decimal, "datetime": stamp, "string": ~(missing | boolean | integer | decimal | stamp)}


def profile(df: DataFrame, exact_limit: int = 200_000) -> DataFrame:
    """One row per column: counts by type, the inferred type, extremes, and the number of distinct values.

    All columns are profiled in one pass over (column, value) rows, pre-aggregated to distinct values; the distinct number
    is exact up to exact_limit values and HyperLogLog's estimate above, which is_exact tells.
    """
    rows = df.select([F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "value")
    tests = typed(F.col("value"))
    numeric = F.when(tests["integer"] | tests["decimal"], F.col("value").try_cast("double"))
    known = F.when(~tests["missing"], F.col("value"))
    out = rows.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count_if(t).alias(f"{n}_count") for n, t in tests.items()], F.min(numeric).alias("min_number"), F.max(numeric).alias("max_number"),
        F.min(known).alias("min_text"), F.max(known).alias("max_text"), F.approx_count_distinct(known, 0.0163).alias("_about"),
    )
    small = out.where(F.col("_about") <= exact_limit).select("column_name")
    exact = rows.join(F.broadcast(small), "column_name").select("column_name", known.alias("v")).distinct().groupBy("column_name").agg(F.count("v").alias("_exact"))
    out = out.join(exact, "column_name", "left")
    types = ["missing", "boolean", "integer", "decimal", "datetime", "string"]
    kind = F.when(F.col("missing_count") == F.col("row_count"), "empty")
    for t in ("string", "datetime", "decimal", "integer", "boolean"):
        others = [F.col(f"{o}_count") == 0 for o in types if o not in (t, "missing") and not (t == "decimal" and o == "integer")]
        kind = kind.when(X.all_of([F.col(f"{t}_count") > 0, *others]), t)
    kind = kind.otherwise("string")
    return out.withColumns({"inferred_type": kind, "distinct_count": F.coalesce("_exact", "_about"), "is_exact": F.col("_exact").isNotNull(), "non_missing_count": F.col("row_count") - F.col("missing_count")}).drop("_about", "_exact")


def distinct_estimate(df: DataFrame, c: str, bits: int = 12) -> DataFrame:
    """(estimate) by a HyperLogLog sketch of 2 ** bits registers."""
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(c, bits)).alias("estimate"))


def distinct_count(df: DataFrame, c: str, limit: int = 200_000) -> DataFrame:
    """(distinct_count, is_exact): exact up to the limit."""
    counts = df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("_exact"))
    about = df.agg(F.approx_count_distinct(c, 0.0163).alias("_about"))
    small = F.col("_exact") <= limit
    return counts.crossJoin(about).select(F.when(small, F.col("_exact")).otherwise(F.col("_about")).alias("distinct_count"), small.alias("is_exact"))


def frequencies(df: DataFrame, c: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def find_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The column whose normalised name is one of the names, else the first that holds all words of one of them."""
    plain = {re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_"): c for c in columns}
    for n in names:
        if n in plain:
            return plain[n]
    for n in names:
        for p, c in plain.items():
            if len(n) > 1 and set(n.split("_")) <= set(p.split("_")):
                return c
    return None


def field_mapping(columns: list[str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> dict[str, str | None]:
    return {logical: find_column(columns, names) for logical, names in aliases.items()}


def role_mapping(role: str, columns: list[str]) -> dict[str, dict[str, str | None]]:
    """For every field of a role the column that holds it, with confidence: exact, by words, or missing. A column serves one field."""
    out: dict[str, dict[str, str | None]] = {}
    taken: set[str] = set()
    plain = {re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_"): c for c in reversed(columns)}
    for logical, names in ROLES[role].items():
        if found := next((plain[n] for n in names if n in plain), None):
            out[logical] = {"column": found, "confidence": "exact"}
            taken.add(found)
    for logical, names in ROLES[role].items():
        if logical not in out:
            several = tuple(n for n in names if "_" in n)
            found = find_column([c for c in columns if c not in taken], several) if several else None
            out[logical] = {"column": found, "confidence": "by words" if found else "missing"}
            taken.add(found or "")
    return {logical: out[logical] for logical in ROLES[role]}


def meaning(column: str) -> str:
    """A column's meaning by its name, for reports."""
    for logical, names in ALIASES.items():
        if find_column([column], names):
            return logical
    return "unknown"


def time_fields(profiled: DataFrame) -> DataFrame:
    """Columns that hold times, with the unit that their magnitude shows."""
    numeric = F.col("inferred_type") == "integer"
    unit = F.when(F.col("inferred_type") == "datetime", "text").when(numeric, X.epoch_unit(F.col("max_number")))
    found = profiled.select("column_name", unit.alias("unit"))
    return found.where("unit IS NOT NULL AND unit <> 'unknown'")


def head_and_tail(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    head = df.orderBy(order).limit(n).withColumn("end", F.lit("head"))
    return head.unionByName(df.orderBy(F.desc(order)).limit(n).withColumn("end", F.lit("tail")))


def volume_reconciliation(minutes: DataFrame, bars: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """(matched, only_trades, only_bars, mean and largest relative volume error) of two sources' bars by time."""
    j = minutes.select("open_time", F.col("base_volume").alias("a")).join(bars.select("open_time", F.col("volume").alias("b")), "open_time", "full_outer")
    error = X.relative_error(F.col("a"), F.col("b"), F.col("b"), epsilon)
    return j.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_trades"), F.count_if(F.col("a").isNull()).alias("only_bars"),
        F.avg(error).alias("mean_error"), F.max(error).alias("max_error"),
    )


def time_overlap(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """(start, end, overlaps) of the common time range of two sources."""
    x = a.agg(F.min(c).alias("a0"), F.max(c).alias("a1"))
    y = b.agg(F.min(c).alias("b0"), F.max(c).alias("b1"))
    start, end = F.greatest("a0", "b0"), F.least("a1", "b1")
    return x.crossJoin(y).select(start.alias("start"), end.alias("end"), (start <= end).alias("overlaps"))
