"""Column expressions with the null and neutral-value rules of the market operators.

NULL stands for every missing or undefined number; NaN and infinities never leave these functions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS, FALSE_WORDS = ("true", "1"), ("false", "0")
MARGIN_EDGES = (0.0, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """The value as a double; text that is no finite number, NaN and infinities become NULL."""
    x = col(c).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def finite(c: str | Column) -> Column:
    x = col(c)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_positive(c: str | Column) -> Column:
    return finite(c) & F.coalesce(col(c) > 0, F.lit(False))


def finite_nonnegative(c: str | Column) -> Column:
    return finite(c) & F.coalesce(col(c) >= 0, F.lit(False))


def within_upper_bound(left: Column, right: Column, absolute: float, relative: float) -> Column:
    return F.coalesce(left <= right + absolute + relative * F.abs(right), F.lit(False))


def close_to(a: Column, b: Column, absolute: float = 1e-8, relative: float = 1e-10) -> Column:
    return F.coalesce(F.abs(a - b) <= absolute + relative * F.abs(b), F.lit(False))


def neutral_div(top: Column, bottom: Column, mask: Column, value: float | None) -> Column:
    """top / bottom where both are known and bottom is not 0; `value` where mask holds; else NULL."""
    return F.when(F.coalesce(mask, F.lit(False)), F.lit(value).cast("double")).otherwise(F.try_divide(top, bottom))


def safe_div(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def parse_bool(c: str | Column) -> Column:
    """true/1 and false/0, trimmed and in any case; anything else is NULL."""
    x = F.lower(F.trim(col(c).cast("string")))
    return F.when(x.isin(*TRUE_WORDS), True).when(x.isin(*FALSE_WORDS), False)


def floor_to(t: Column, step: int) -> Column:
    return t - F.pmod(t, F.lit(step))


def utc_text(ms: Column) -> Column:
    """ISO text of epoch milliseconds, in UTC sessions."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ssXXX")


def utc_millis(text: Column) -> Column:
    """Epoch milliseconds of ISO text; text without a zone is UTC; anything else is NULL."""
    return F.unix_millis(F.try_to_timestamp(text))


def epoch_unit(largest: Column) -> Column:
    """seconds, milliseconds or microseconds by magnitude, else unknown."""
    return (
        F.when(largest.between(10**8, 10**11 - 1), "seconds")
        .when(largest.between(10**11, 10**14 - 1), "milliseconds")
        .when(largest.between(10**14, 10**17 - 1), "microseconds")
        .otherwise("unknown")
    )


def epoch_to_millis(value: Column, unit: Column) -> Column:
    return F.when(unit == "seconds", value * 1000).when(unit == "milliseconds", value).when(unit == "microseconds", F.floor(value / 1000)).cast("long")


def simple_return(later: Column, earlier: Column) -> Column:
    return F.try_divide(later, earlier) - 1


def log_return(later: Column, earlier: Column) -> Column:
    return F.when((later > 0) & (earlier > 0), F.ln(F.try_divide(later, earlier)))


def abs_bps(ratio: Column) -> Column:
    """|ratio| in basis points, to nine digits, ties to even."""
    return F.bround(F.abs(ratio) * 1e4, 9)


def relative_error(a: Column, b: Column, scale: Column, epsilon: float = 1e-12, signed: bool = False) -> Column:
    top = a - b if signed else F.abs(a - b)
    return F.when(scale.isNotNull(), top / F.greatest(F.abs(scale), F.lit(epsilon)))


def bps(a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    return relative_error(a, b, b, epsilon, signed=True) * 10000


def margin_bucket(value: Column, edges: tuple[float, ...] = MARGIN_EDGES) -> Column:
    """[a, b) labels of the edges, the last open to infinity; NULL stays NULL."""
    name = lambda x: f"{x:g}"
    out = F.when(value >= edges[-1], f"[{name(edges[-1])}, +inf)")
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when((value >= low) & (value < high), f"[{name(low)}, {name(high)})")
    return out


def risk_suffix(threshold: float) -> str:
    return f"{threshold:g}".replace(".", "_")


def below(value: Column, threshold: float) -> Column:
    return F.coalesce(value < threshold, F.lit(False))


def margin_weight(value: Column, scale: float = 10.0, least: float = 0.25) -> Column:
    """value / scale held in [least, 1]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.least(value / scale, F.lit(1.0)), F.lit(least)))


def all_of(rules: list[Column]) -> Column:
    return F.coalesce(reduce(and_, rules, F.lit(True)), F.lit(False))


def any_of(rules: list[Column]) -> Column:
    return F.coalesce(reduce(or_, rules, F.lit(False)), F.lit(False))


def reasons(tests: list[tuple[Column, str]]) -> Column:
    """The codes of the tests that hold, each once, in order, joined by ';'."""
    return F.concat_ws(";", F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(code)) for t, code in tests]))))


def logit(p: Column, epsilon: float = 1e-6) -> Column:
    x = F.greatest(F.least(p, F.lit(1 - epsilon)), F.lit(epsilon))
    return F.ln(x / (1 - x))


def clip01(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))


def row_max(columns: list[Column]) -> Column:
    """The largest value of a row, NULLs skipped."""
    return F.greatest(*columns)


def calendar(ms: Column) -> dict[str, Column]:
    t = F.timestamp_millis(ms)
    return {
        "year": F.year(t), "month": F.month(t), "yyyymm": F.date_format(t, "yyyyMM"), "hour": F.hour(t),
        "minute": F.minute(t), "weekday": F.weekday(t), "date": F.date_format(t, "yyyy-MM-dd"),
    }
