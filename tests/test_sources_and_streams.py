import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tidewright.operators import profile as P
from tidewright.schema import RAW_TRADE, ValidationError
from tidewright.sources import io as IO
from tidewright.sources import rest as R
from tidewright.streaming import bars as S

M0 = 1_662_076_800_000


def recorded_bars(n, skip=()):
    return [[M0 + k * 60000, "1", "2", "0.5", "1.5", "3", M0 + k * 60000 + 59999, "4.5", 7, "1", "1.5", "0"] for k in range(n) if k not in skip]


def fetcher(rows, at):
    return lambda p: [x for x in rows if p["startTime"] <= at(x) <= p["endTime"]][: p["limit"]]


def test_pages_follow_the_cursor_and_skip_gaps():
    rows = recorded_bars(4000, range(900, 3000))
    got = list(R.pages(fetcher(rows, lambda x: x[0]), "bars", M0, M0 + 4000 * 60000, 60000))
    assert [r[0] for r in got] == [x[0] for x in rows]
    trades = [{"a": k, "p": "1", "q": "2", "f": k, "l": k, "T": M0 + k, "m": k % 2 == 0, "M": True} for k in range(2500)]
    assert len(list(R.pages(fetcher(trades, lambda x: x["T"]), "trades", M0, M0 + 10_000, 1))) == 2500
    assert list(R.pages(lambda p: [], "funding", 0, 10, 1)) == []


def test_retries():
    calls = []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429, "slow down", {}, None)
        return io.BytesIO(b'{"ok": 1}')

    assert R.request_json("http://x", {"a": 1}, opener=opener, sleep=lambda s: None) == {"ok": 1} and len(calls) == 3
    with pytest.raises(urllib.error.HTTPError):
        R.request_json("http://x", {}, opener=lambda url, timeout: (_ for _ in ()).throw(urllib.error.HTTPError(url, 404, "", {}, None)), sleep=lambda s: None)


def test_rows_books_and_discovered_schema():
    assert R.discovered_schema([{"x": 1, "timestamp": 2}, {"y": 3, "symbol": "s"}]) == ["symbol", "timestamp", "x", "y"]
    assert list(R.metric_rows([{"x": 1}], ["symbol", "x"])) == [(None, "1")]
    row = R.book_row({"lastUpdateId": 5, "bids": [["1", "2"]], "asks": [["3", "4"], ["5", "6"]]}, 9, 2)
    assert row == (9, 5, 1.0, 2.0, None, None, 3.0, 4.0, 5.0, 6.0) and len(R.book_schema(2).split(",")) == 10


def test_paged_source_in_spark(spark, tmp_path):
    R.register(spark)
    path = tmp_path / "bars.json"
    path.write_text(json.dumps(recorded_bars(50, range(20, 30))))
    df = spark.read.format("paged_rest").options(kind="bars", start=M0, end=M0 + 50 * 60000, step=60000, partitions=4, recorded=str(path)).load()
    assert df.rdd.getNumPartitions() == 4 and df.count() == 40 and df.agg(F.countDistinct("open_time")).first()[0] == 40


def test_files(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("symbol,agg_trade_id,price\nX,1,2.5\nNA,,bad\n")
    assert [tuple(r) for r in IO.text_csv(spark, str(csv)).collect()][1][0] == "NA"
    typed = IO.typed_csv(spark, str(csv), type(RAW_TRADE)(RAW_TRADE.fields[:3])).collect()
    assert typed[0]["price"] == 2.5 and typed[1]["price"] is None
    IO.write_parquet(spark.range(5), str(tmp_path / "p"))
    assert IO.parquet(spark, str(tmp_path / "p"), ["id"], "id > 2").count() == 2 and IO.parquet_schema(spark, str(tmp_path / "p")) == {"id": "bigint"}
    IO.append_csv(spark.range(2), str(tmp_path / "a"))
    IO.append_csv(spark.range(2), str(tmp_path / "a"))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 4
    IO.write_json(str(tmp_path / "m.json"), {"x": float("nan"), "y": [1, float("inf")], "z": "é"})
    assert IO.read_json(str(tmp_path / "m.json")) == {"x": None, "y": [1, None], "z": "é"}
    IO.write_markdown(str(tmp_path / "r.md"), "T", {"rows": spark.range(2), "text": "t"})
    assert "| id |" in (tmp_path / "r.md").read_text() and len(IO.file_sha256(str(csv))) == 64
    IO.write_failures(str(tmp_path / "f.md"), ["one", "two"])
    assert "- two" in (tmp_path / "f.md").read_text()
    assert IO.first_existing(spark, [str(tmp_path / "none"), str(csv)]) == str(csv)
    with pytest.raises(ValidationError):
        IO.first_existing(spark, [str(tmp_path / "none")])


def test_profile(spark):
    rows = [("1", "a", "2022-01-01", "true", ""), ("2.5", "b", "2022-01-02T00:00:00Z", "false", "NA"), ("", "3", None, "TRUE", "null")]
    got = {r["column_name"]: r for r in P.profile(spark.createDataFrame(rows, "n string, s string, d string, b string, e string")).collect()}
    assert {k: r["inferred_type"] for k, r in got.items()} == {"n": "decimal", "s": "string", "d": "datetime", "b": "boolean", "e": "empty"}
    assert (got["n"]["missing_count"], got["n"]["max_number"], got["s"]["distinct_count"], got["s"]["is_exact"]) == (1, 2.5, 3, True)
    assert P.find_column(["Open Time", "Qty"], ("open_time",)) == "Open Time" and P.field_mapping(["qty", "trade_price"])["quantity"] == "qty"
    assert P.meaning("close_price") == "close" and P.meaning("zzz") == "unknown"


def trade_rows(spark, path, n=400):
    df = spark.range(n).select(
        F.col("id").alias("agg_trade_id"), (F.lit(M0) + F.col("id") * 1700).alias("trade_time"), (100 + F.col("id") % 7).cast("double").alias("price"),
        (1 + F.col("id") % 3).cast("double").alias("quantity"), (F.col("id") % 2 == 0).alias("is_active_buy"),
    ).withColumn("quote_quantity", F.col("price") * F.col("quantity"))
    df.coalesce(1).write.parquet(path)
    return df


def run_available(query):
    query.awaitTermination(120)


def test_streamed_bars_equal_batch(spark, tmp_path):
    df = trade_rows(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = S.live_bars(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run_available(out)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("live")) == key(S.live_bars(df)) and spark.table("live").count() > 5


def test_sessions_first_and_last(spark, tmp_path):
    bars = spark.createDataFrame([(M0 + k * 60000,) for k in (0, 1, 2, 6, 7)], "open_time long")
    got = sorted((r["bars"], r["start_time"]) for r in S.live_sessions(bars, "90 seconds").collect())
    assert got == [(2, M0 + 6 * 60000), (3, M0)]
    merge = S.last_of_each(str(tmp_path / "v"), "k", "n")
    merge(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, n int, x string"), 0)
    merge(spark.createDataFrame([(1, 2, "c")], "k int, n int, x string"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "v/version=1")).collect())) == [(1, 2, "c"), (2, 1, "b")]
    labels = S.matured_labels(
        spark.createDataFrame([(M0, 100.0, 0), (M0 + 60000, 5.0, 0)], "decision_time long, entry_price double, continuity_segment_id long"),
        spark.createDataFrame([(M0 + 3_600_000, 101.0, 0), (M0 + 3_660_000, 1.0, 1)], "open_time long, open double, continuity_segment_id long"),
    ).collect()
    assert [(r["decision_time"], r["label_up_60m"]) for r in labels] == [(M0, 1)]


def test_a_stream_passes_a_gap_in_trading_and_sends_its_parameters():
    step, asked = 60_000, []
    rows = [[M0 + k * step, *["1"] * 5, M0 + k * step + 59_999, "1", 1, "1", "1"] for k in (0, 1, 5000)]

    def fetch(params):
        asked.append(params)
        span = [r for r in rows if params["startTime"] <= r[0] < params["startTime"] + 1000 * step]
        return span[: params["limit"]]

    options = {"kind": "bars", "start": str(M0), "end": str(M0 + 6000 * step), "step": str(step), "symbol": "S", "interval": "1m"}
    stream = R.PagedStream(options, fetch, now=lambda: (M0 + 5500 * step) / 1000)
    at, got = stream.initialOffset(), []
    for _ in range(8):
        part, at = stream.read(at)
        got += [r[0] for r in part]
    assert got == [r[0] for r in rows] and at["cursor"] == M0 + 5001 * step  # the span beyond now is waited for
    assert all(a["symbol"] == "S" and a["interval"] == "1m" for a in asked)
    assert [r[0] for r in stream.readBetweenOffsets({"cursor": M0}, at)] == got
    ended = R.PagedStream(options | {"end": str(M0 + 10)}, fetch, now=lambda: 1e12)
    assert list(ended.read({"cursor": M0 + 10})[0]) == []


@pytest.mark.parametrize("kind", sorted(R.METRICS))
def test_metrics_endpoints_are_read_with_the_schema_of_their_first_page(spark, tmp_path, kind):
    rows = [{"timestamp": str(M0 + k * 300_000), "zeta": k, "alpha": f"{k}.5"} for k in range(700)]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    R.register(spark)
    df = spark.read.format("paged_rest").options(kind=kind, recorded=str(tmp_path / "m.json"), symbol="S", period="5m", start=M0, end=M0 + 700 * 300_000).load()
    assert df.columns == ["symbol", "timestamp", "timestamp_utc", "alpha", "zeta"] and df.schema["timestamp"].dataType.simpleString() == "bigint"
    got = df.orderBy("timestamp").collect()
    assert len(got) == 700 and got[3]["alpha"] == "3.5" and got[0]["symbol"] == "S" and got[0]["timestamp_utc"].startswith("2022-09-02T00:00:00")


def test_fields_by_the_role_of_their_source():
    got = P.role_mapping("trades", ["Symbol", "Aggregate Trade ID", "p", "Qty", "The First Trade Id", "T", "buyer_is_maker"])
    assert {k: (v["column"], v["confidence"]) for k, v in got.items()} == {
        "symbol": ("Symbol", "exact"), "agg_trade_id": ("Aggregate Trade ID", "exact"), "price": ("p", "exact"), "quantity": ("Qty", "exact"), "first_trade_id": ("The First Trade Id", "by words"),
        "last_trade_id": (None, "missing"), "trade_time": ("T", "exact"), "trade_time_utc": (None, "missing"), "is_buyer_maker": ("buyer_is_maker", "by words"), "is_best_match": (None, "missing"),
    }
    bars = P.role_mapping("bars", ["open_time", "open", "close", "base_volume", "taker_buy_base_asset_volume", "n_trades"])
    assert bars["volume"]["column"] == "base_volume" and bars["taker_buy_base_volume"]["confidence"] == "by words" and bars["interval"]["confidence"] == "missing"
