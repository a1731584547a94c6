"""Suites of constraint checks: one aggregate pass counts all violations, then all are reported at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import ValidationError

FORBIDDEN_EXACT = (
    "entry_price_proxy", "settlement_price_proxy", "future_simple_return_60m", "future_log_return_60m", "label_up_60m", "margin_bucket",
)
FORBIDDEN_PARTS = ("future_", "label_", "settlement_", "entry_price", "target", "y_true")
ALLOWED = ("has_future_61m",)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations): rows in which a check's condition holds; an unknown condition counts as no violation."""
    counted = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return counted.unpivot([], list(checks), "check", "violations")


def require(df: DataFrame, checks: dict[str, Column], what: str = "table") -> None:
    found = [r for r in violations(df, checks).collect() if r["violations"]]
    if found:
        raise ValidationError([f"{what}: {r['check']} ({r['violations']} rows)" for r in found])


def bar_suite(interval: int) -> dict[str, Column]:
    """Checks of segmented bars (see clean.segments); they need no window of their own."""
    same = F.col("gap_before_bars") == 0
    return {
        "unsorted_or_repeated_time": F.col("delta") <= 0,
        "wrong_spacing": same & (F.col("delta") != interval) & (F.col("delta") > 0),
        "time_off_grid": F.col("open_time") % interval != 0,
        "price_not_positive": X.any_of([~X.finite_positive(c) for c in ("open", "high", "low", "close")]),
        "high_below": F.col("high") < F.greatest("open", "close", "low"),
        "low_above": F.col("low") > F.least("open", "close", "high"),
        "negative_volume": X.any_of([~X.finite_nonnegative(c) for c in ("volume", "quote_volume")]),
        "taker_above_volume": ~X.within_upper_bound(F.col("taker_buy_base_volume"), F.col("volume"), 1e-9, 1e-9),
    }


def trade_suite() -> dict[str, Column]:
    return {
        "missing_time": F.col("trade_time").isNull(),
        "bad_price": ~X.finite_positive("price"),
        "bad_quantity": ~X.finite_positive("quantity"),
        "wrong_quote": ~X.close_to(F.col("quote_quantity"), F.col("price") * F.col("quantity")),
        "both_sides": F.col("is_active_buy") == F.col("is_active_sell"),
    }


def aggregate_suite() -> dict[str, Column]:
    """Identities of trade bars."""
    return {
        "sides_base": ~X.close_to(F.col("active_buy_base_volume") + F.col("active_sell_base_volume"), F.col("base_volume"), 1e-6),
        "sides_quote": ~X.close_to(F.col("active_buy_quote_volume") + F.col("active_sell_quote_volume"), F.col("quote_volume"), 1e-6),
        "sides_count": F.col("active_buy_trade_count") + F.col("active_sell_trade_count") != F.col("agg_trade_count"),
        "vwap_above_high": ~X.within_upper_bound(F.col("trade_vwap"), F.col("trade_high"), 1e-9, 1e-9),
        "vwap_below_low": ~X.within_upper_bound(F.col("trade_low"), F.col("trade_vwap"), 1e-9, 1e-9),
    }


def label_suite() -> dict[str, Column]:
    valid = F.col("is_valid_proxy_label")
    return {
        "label_without_validity": ~valid & F.col("label_up_60m").isNotNull(),
        "valid_without_label": valid & F.col("label_up_60m").isNull(),
        "label_not_binary": ~F.col("label_up_60m").isin(0, 1),
        "sign_disagrees": valid & ((F.col("future_simple_return_60m") > 0) != (F.col("label_up_60m") == 1)),
        "weight_out_of_range": (F.col("margin_sample_weight") < 0.25) | (F.col("margin_sample_weight") > 1),
    }


def dataset_suite() -> dict[str, Column]:
    return {
        "target_missing": F.col("label_up_60m").isNull(),
        "entry_time": F.col("entry_minute_open_time") != F.col("decision_time"),
        "settlement_not_later": F.col("settlement_minute_open_time") <= F.col("decision_time"),
        "negative_row_id": F.col("dataset_row_id") < 0,
    }


def forbidden_fields(columns: list[str], exact: tuple[str, ...] = FORBIDDEN_EXACT, parts: tuple[str, ...] = FORBIDDEN_PARTS, allowed: tuple[str, ...] = ALLOWED) -> list[str]:
    """Columns that would leak the future into features."""
    return [c for c in columns if c not in allowed and (c in exact or any(p in c.lower() for p in parts))]


def assert_no_leakage(columns: list[str]) -> None:
    if bad := forbidden_fields(columns):
        raise ValidationError([f"forbidden column {c}" for c in bad])


def validate_names(names: list[str], count: int) -> None:
    errors = []
    if len(names) != count:
        errors.append(f"{len(names)} features, not {count}")
    if len(set(names)) != len(names):
        errors.append("feature names repeat")
    errors += [f"bad feature name {n}" for n in names if not re.fullmatch(r"[a-z][a-z0-9_]*", n)]
    if errors:
        raise ValidationError(errors)


def same_ids(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """(only_first, only_second, both) of two tables' id sets: two anti joins and a semi join on pre-aggregated ids."""
    x, y = a.select(c).distinct(), b.select(c).distinct()
    j = x.withColumn("_x", F.lit(1)).join(y.withColumn("_y", F.lit(1)), c, "full_outer")
    return j.agg(F.count_if(F.col("_y").isNull()).alias("only_first"), F.count_if(F.col("_x").isNull()).alias("only_second"), F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("both"))
