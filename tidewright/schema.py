"""Table schemas and checks of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidationError(ValueError):
    """All failures of a suite of checks at once."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(text: str) -> T.StructType:
    """A schema from "name type, …"; it needs no session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


RAW_TRADE = struct(
    "symbol string, agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long,"
    " trade_time long, trade_time_utc string, is_buyer_maker string, is_best_match string"
)
RAW_BAR = struct(
    "symbol string, interval string, open_time long, open_time_utc string, open double, high double, low double, close double,"
    " volume double, close_time long, close_time_utc string, quote_volume double, number_of_trades long,"
    " taker_buy_base_volume double, taker_buy_quote_volume double"
)
CLEAN_TRADE = struct(
    "agg_trade_id long, price double, quantity double, trade_time long, is_buyer_maker boolean, quote_quantity double,"
    " is_active_buy boolean, is_active_sell boolean, id_gap_before long"
)
BAR = struct(
    "open_time long, open double, high double, low double, close double, volume double, quote_volume double,"
    " number_of_trades long, taker_buy_base_volume double, taker_buy_quote_volume double"
)
PREDICTION = struct(
    "model_name string, fold_name string, dataset_row_id long, decision_time long, y_true int, p_up double, y_pred int,"
    " abs_future_return_bps_60m double, evaluation_offset_minutes int, is_primary_nonoverlap_evaluation boolean"
)


def schema_errors(df: DataFrame, expected: T.StructType) -> list[str]:
    """What of the expected names and types df lacks; further columns are no error."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = [f"missing column {f.name}" for f in expected if f.name not in have]
    return out + [
        f"column {f.name} is {have[f.name]}, not {f.dataType.simpleString()}"
        for f in expected
        if f.name in have and have[f.name] != f.dataType.simpleString()
    ]


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    if errors := schema_errors(df, expected):
        raise ValidationError(errors)
    return df


def require_columns(columns: list[str], needed: list[str], what: str = "table") -> None:
    if missing := [c for c in needed if c not in columns]:
        raise ValidationError([f"{what} lacks {', '.join(missing)}"])


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """Raises when a key occurs twice. The counts are pre-aggregated and one bad key is fetched."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValidationError([f"{what}: key {bad[0].asDict()} is not unique"])
    return df
