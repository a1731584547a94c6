"""Forward-looking labels from entry and settlement bars, their checks and summaries, and label agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import ValidationError

RISK_BPS = (1.0, 2.5, 5.0, 10.0)
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def prediction_rows(bars: DataFrame) -> DataFrame:
    return bars.where("is_prediction_time_5m")


def with_prices(rows: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Prediction rows with the bar that opens at the decision and the one a horizon later, by exact time.

    Both are left joins on integer keys of the same table, so that a row without its bar stays, with NULL.
    """
    side = bars.select("open_time", "open", "continuity_segment_id")
    entry = side.toDF("entry_minute_open_time", "entry_price_proxy", "entry_segment_id")
    settlement = side.toDF("settlement_minute_open_time", "settlement_price_proxy", "settlement_segment_id")
    rows = rows.withColumns({"entry_minute_open_time": F.col("decision_time"), "settlement_minute_open_time": F.col("decision_time") + horizon})
    return rows.join(entry, "entry_minute_open_time", "left").join(settlement, "settlement_minute_open_time", "left")


def full_labels(bars: DataFrame, horizon: int = 3_600_000, future_flag: str = "has_future_61m", strict: bool = False) -> DataFrame:
    """One row per prediction row: prices, validity, returns, label, margin bucket, risk flags and weight.

    The label is 1 for a higher settlement price, 0 for an equal or lower one, NULL where invalid. strict raises when
    validity disagrees with the future flag of the rows.
    """
    j = with_prices(prediction_rows(bars), bars, horizon)
    j = j.withColumns({
        "entry_row_exists": F.col("entry_segment_id").isNotNull(),
        "settlement_row_exists": F.col("settlement_segment_id").isNotNull(),
        "entry_price_valid": X.finite_positive("entry_price_proxy"),
        "settlement_price_valid": X.finite_positive("settlement_price_proxy"),
        "same_segment": F.coalesce((F.col("entry_segment_id") == F.col("settlement_segment_id")) & (F.col("entry_segment_id") == F.col("continuity_segment_id")), F.lit(False)),
    })
    valid = X.all_of([F.col(c) for c in ("entry_row_exists", "settlement_row_exists", "entry_price_valid", "settlement_price_valid", "same_segment")])
    j = j.withColumn("is_valid_proxy_label", valid)
    e, s = F.col("entry_price_proxy"), F.col("settlement_price_proxy")
    when_valid = lambda c: F.when(F.col("is_valid_proxy_label"), c)
    j = j.withColumns({
        "future_simple_return_60m": when_valid(X.simple_return(s, e)),
        "future_log_return_60m": when_valid(X.log_return(s, e)),
        "label_up_60m": when_valid((s > e).cast("byte")),
    })
    j = j.withColumn("abs_future_return_bps_60m", X.abs_bps(F.col("future_simple_return_60m")))
    m = F.col("abs_future_return_bps_60m")
    j = j.withColumns({
        "margin_bucket": X.margin_bucket(m),
        **{f"boundary_risk_{X.risk_suffix(t)}bps": X.below(m, t) for t in RISK_BPS},
        "margin_sample_weight": X.margin_weight(m),
        "is_final_model_label_candidate": F.col("is_valid_proxy_label") & F.col("is_model_candidate"),
    })
    if strict:
        bad = j.where(F.col(future_flag) & ~F.col("is_valid_proxy_label")).select("decision_time").limit(5).collect()
        if bad:
            raise ValidationError([f"no valid label at {r[0]} although {future_flag}" for r in bad])
    return j


def invalid_details(labels: DataFrame) -> DataFrame:
    """What is wrong with each candidate without a valid label."""
    bad = labels.where(~F.col("is_valid_proxy_label"))
    return bad.select(
        "decision_time", "continuity_segment_id", (~F.col("entry_row_exists")).alias("missing_entry_row"), (~F.col("settlement_row_exists")).alias("missing_settlement_row"),
        (F.col("entry_row_exists") & ~F.col("entry_price_valid")).alias("bad_entry_price"), (F.col("settlement_row_exists") & ~F.col("settlement_price_valid")).alias("bad_settlement_price"),
        (F.col("entry_row_exists") & F.col("settlement_row_exists") & ~F.col("same_segment")).alias("crosses_segments"), "is_model_candidate",
    )


def distribution(value: Column, quantiles: tuple[float, ...] = QUANTILES) -> dict[str, Column]:
    """Mean, median, sample deviation, extremes and quantiles of a column, as aggregates."""
    q = F.percentile(value, F.array(*map(F.lit, quantiles)))
    out = {"n": F.count(value), "mean": F.avg(value), "std": F.stddev_samp(value), "minimum": F.min(value), "maximum": F.max(value)}
    return out | {f"p{round(p * 100):02d}": q[k] for k, p in enumerate(quantiles)}


def describe(df: DataFrame, value: Column, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in distribution(value, quantiles).items()])


def describe_abs_bps(df: DataFrame, value: Column) -> DataFrame:
    """A signed error in bps: distribution of its size, and the shares above and below zero."""
    parts = distribution(F.abs(value), (0.5, 0.9, 0.95, 0.99)) | {
        "signed_mean": F.avg(value),
        "positive_ratio": F.avg((value > 0).cast("double")),
        "negative_ratio": F.avg((value < 0).cast("double")),
    }
    return df.agg(*[c.alias(n) for n, c in parts.items()])


def label_distribution(labels: DataFrame, by: list[Column]) -> DataFrame:
    """Counts, ratios and return moments of the valid labels by a grouping; the deviation of one row is 0."""
    good = labels.where("is_valid_proxy_label")
    r, y = F.col("future_simple_return_60m"), F.col("label_up_60m")
    return good.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("up"), F.count_if(y == 0).alias("down"), F.avg(y.cast("double")).alias("up_ratio"),
        F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std_return"),
    )


def label_distributions(labels: DataFrame) -> DataFrame:
    """The distributions by date, segment and margin bucket in one grouped pass."""
    day = X.calendar(F.col("decision_time"))["date"]
    kinds = F.array(
        F.struct(F.lit("date").alias("kind"), day.alias("value")),
        F.struct(F.lit("segment").alias("kind"), F.col("continuity_segment_id").cast("string").alias("value")),
        F.struct(F.lit("margin").alias("kind"), F.col("margin_bucket").alias("value")),
    )
    rows = labels.withColumn("_k", F.explode(kinds)).withColumns({"kind": F.col("_k.kind"), "value": F.col("_k.value")})
    return label_distribution(rows, [F.col("kind"), F.col("value")])


def stability(labels: DataFrame, period: Column, near_zero_bps: float = 2.5) -> DataFrame:
    """One row: the period whose up ratio is farthest from the whole's, and counts of thin and of near-zero periods."""
    good = labels.where("is_valid_proxy_label").select(period.alias("period"), F.col("label_up_60m").cast("double").alias("y"), (F.col("abs_future_return_bps_60m") < near_zero_bps).cast("double").alias("z"))
    by = good.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("ratio"), F.avg("z").alias("near"))
    whole = good.agg(F.avg("y").alias("overall"))
    limits = by.agg(F.median("n").alias("median_n"), F.avg("near").alias("mean_near"), F.coalesce(F.stddev_samp("near"), F.lit(0.0)).alias("std_near"))
    j = by.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(limits))
    far = F.struct(F.round(F.abs(F.col("ratio") - F.col("overall")), 12), F.col("period"))
    return j.agg(
        F.max_by("period", far).alias("farthest_period"), F.max(F.abs(F.col("ratio") - F.col("overall"))).alias("farthest_distance"),
        F.count_if(F.col("n") < 0.5 * F.col("median_n")).alias("thin_periods"), F.count_if(F.col("near") > F.col("mean_near") + 2 * F.col("std_near")).alias("near_zero_periods"),
    )


def extreme_returns(labels: DataFrame, n: int = 20) -> DataFrame:
    """The n largest and n smallest returns with a tag; ties by time. Two top-k, no full sort."""
    good = labels.where("is_valid_proxy_label").select("decision_time", "future_simple_return_60m")
    top = good.orderBy(F.desc("future_simple_return_60m"), "decision_time").limit(n).withColumn("side", F.lit("largest"))
    low = good.orderBy("future_simple_return_60m", "decision_time").limit(n).withColumn("side", F.lit("smallest"))
    return top.unionByName(low)


def label_proxy(rows: DataFrame, minutes: DataFrame, horizon: int, seconds: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """Labels from bar opens beside labels from the VWAPs of the bars' first seconds, with agreement and flips.

    minutes: open_time, kline_open, vwap_first_{s}s and is_reliable_overlap_minute. Rows keep NULL where a price lacks.
    """
    prices = ["kline_open", *[f"vwap_first_{s}s" for s in seconds]]
    rel = F.coalesce("is_reliable_overlap_minute", F.lit(False))
    e = minutes.select(F.col("open_time").alias("decision_time"), *[F.col(p).alias(f"entry_{p}") for p in prices], rel.alias("entry_reliable"), "agg_base_volume")
    s = minutes.select((F.col("open_time") - horizon).alias("decision_time"), *[F.col(p).alias(f"settlement_{p}") for p in prices], rel.alias("settlement_reliable"))
    j = rows.select("decision_time").join(e, "decision_time", "left").join(s, "decision_time", "left")
    out = {}
    for p in prices:
        a, b = F.col(f"entry_{p}"), F.col(f"settlement_{p}")
        ok = X.finite_positive(a) & X.finite_positive(b)
        out |= {f"is_valid_{p}": ok, f"return_{p}": F.when(ok, X.simple_return(b, a)), f"label_{p}": F.when(ok, (b > a).cast("int"))}
    j = j.withColumns(out)
    more = {}
    for sec in seconds:
        mine, ref = F.col(f"label_vwap_first_{sec}s"), F.col("label_kline_open")
        more |= {
            f"agree_{sec}s": F.when(mine.isNotNull() & ref.isNotNull(), mine == ref),
            f"flip_{sec}s": F.when(mine.isNotNull() & ref.isNotNull(), mine != ref),
            f"entry_difference_bps_{sec}s": X.bps(F.col("entry_kline_open"), F.col(f"entry_vwap_first_{sec}s")),
        }
    more["is_reliable_pair"] = F.coalesce("entry_reliable", F.lit(False)) & F.coalesce("settlement_reliable", F.lit(False))
    more["margin_bucket"] = X.margin_bucket(X.abs_bps(F.col("return_kline_open")))
    more["reference_margin_bucket"] = X.margin_bucket(X.abs_bps(F.col("return_vwap_first_5s")))
    return j.withColumns(more)


def agreement(a: Column, b: Column) -> dict[str, Column]:
    """Binary agreement of two 0/1 columns as aggregates; rows with a NULL in either do not count.

    Wilson 95 % interval, Cohen's kappa and MCC are NULL where their denominator is 0.
    """
    both = a.isNotNull() & b.isNotNull()
    count = lambda x, y: F.count_if(both & (a == x) & (b == y)).cast("double")
    tp, tn, fp, fn = count(1, 1), count(0, 0), count(1, 0), count(0, 1)
    n = tp + tn + fp + fn
    p = F.try_divide(tp + tn, n)
    z = 1.959963984540054
    middle = F.try_divide(p + F.try_divide(F.lit(z * z / 2), n), 1 + F.try_divide(F.lit(z * z), n))
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)), 1 + F.try_divide(F.lit(z * z), n))
    chance = F.try_divide((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "n": n.cast("long"), "agree": (tp + tn).cast("long"), "flips": (fp + fn).cast("long"), "agreement": p, "wilson_low": middle - half, "wilson_high": middle + half,
        "kappa": F.try_divide(p - chance, 1 - chance), "mcc": F.try_divide(tp * tn - fp * fn, spread), "up_rate_a": F.try_divide(tp + fp, n), "up_rate_b": F.try_divide(tp + fn, n),
        "up_to_down": fn.cast("long"), "down_to_up": fp.cast("long"),
    }


def agreement_by(df: DataFrame, a: str, b: str, by: list[Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in agreement(F.col(a), F.col(b)).items()])


def exploded_sets(df: DataFrame, sets: dict[str, Column], name: str = "set_name") -> DataFrame:
    """A row of df for each of the named, overlapping sets it belongs to: one grouped pass then serves all sets."""
    return df.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sets.items()]))))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, pearson, spearman) of two columns over the rows that have both; Spearman is Pearson of average ranks.

    Ranks come from running counts over the distinct values of each column, a table that is ordered in buckets.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = rows
    for c in ("a", "b"):
        ranked = ranked.join(average_ranks(rows, c).withColumnRenamed("rank", f"rank_{c}"), c)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearson"), F.corr("rank_a", "rank_b").alias("spearman"))


def average_ranks(rows: DataFrame, c: str, buckets: int = 1024) -> DataFrame:
    """(c, rank) of the distinct values: the mean of the places that equal values take.

    Values are cut into equal ranges between the extremes; places are counted inside each range and across the ranges.
    """
    from pyspark.sql import Window

    ends = rows.agg(F.min(c).alias("_low"), F.max(c).alias("_high"))
    values = rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(ends))
    width = F.col("_high") - F.col("_low")
    at = F.when(width > 0, F.least(F.floor((F.col(c) - F.col("_low")) / width * buckets), F.lit(buckets - 1))).otherwise(0).cast("int")
    values = values.withColumn("_at", at)
    inside = Window.partitionBy("_at").orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    parts = values.groupBy("_at").agg(F.sum("_n").alias("_m"))
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_at", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    placed = values.withColumn("_through", F.sum("_n").over(inside)).join(parts, "_at")
    return placed.select(c, (F.col("_before") + F.col("_through") - (F.col("_n") - 1) / 2).alias("rank"))


def quartile_bucket(df: DataFrame, c: str, name: str) -> DataFrame:
    """df with q1..q4 by the quartiles of c, (a, b] with the least value in q1; equal edges merge; NULL stays NULL."""
    q = df.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    x = F.col(c)
    bucket = F.when(x <= F.col("_q")[0], "q1").when(x <= F.col("_q")[1], "q2").when(x <= F.col("_q")[2], "q3").when(x.isNotNull(), "q4")
    return df.crossJoin(F.broadcast(q)).withColumn(name, bucket).drop("_q")


def accept_proxy(stats: DataFrame, limits: dict[str, float]) -> DataFrame:
    """stats (n, agreement, wilson_low, kappa, flips_ratio, reliable_n) with the decision on the bar-open proxy."""
    enough = F.col("n") >= limits["min_samples"]
    good = X.all_of([
        F.col("agreement") >= limits["min_agreement"], F.col("wilson_low") >= limits["min_wilson_low"], F.col("kappa") >= limits["min_kappa"],
    ])
    return stats.withColumn("decision", F.when(~good & enough, "REJECT_PROXY").when(~enough, "INCONCLUSIVE_NEED_MORE_AGG_DATA").otherwise("ACCEPT_WITH_LIMITATIONS"))
