"""Paged REST endpoints as Python data sources: bars, trades, funding rates, futures metrics and order books.

A page source is a callable (params) -> decoded JSON. The default asks over HTTP with retries; tests pass recorded
pages. Batch reads split the time range into partitions, each of which follows its own cursor; streaming reads use the
cursor as offset, so that a query resumes where its last batch ended.
"""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

RETRIED = {418, 429, 500, 502, 503, 504}


def request_json(url: str, params: dict, retries: int = 6, pause: float = 1.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep):
    """The decoded body; waits pause * 2 ** attempt after an error that may pass."""
    full = f"{url}?{urllib.parse.urlencode(params)}"
    for attempt in range(retries + 1):
        try:
            with opener(full, timeout=30) as response:
                return json.loads(response.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt == retries:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == retries:
                raise
        sleep(pause * 2**attempt)
    raise AssertionError


def bar_row(x: list) -> tuple:
    """An array-shaped bar: (open_time, open, high, low, close, volume, close_time, quote_volume, trades, taker base, taker quote)."""
    return (int(x[0]), *map(float, x[1:6]), int(x[6]), float(x[7]), int(x[8]), float(x[9]), float(x[10]))


def trade_row(x: dict) -> tuple:
    return int(x["a"]), float(x["p"]), float(x["q"]), int(x["f"]), int(x["l"]), int(x["T"]), bool(x["m"]), x.get("M")


def funding_row(x: dict) -> tuple:
    return x["symbol"], int(x["fundingTime"]), float(x["fundingRate"]), float(x["markPrice"]) if x.get("markPrice") not in (None, "") else None


#: kind -> (row maker, time of a row, schema, page size)
KINDS = {
    "bars": (
        bar_row, lambda r: r[0],
        "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double,"
        " number_of_trades long, taker_buy_base_volume double, taker_buy_quote_volume double", 1000,
    ),
    "trades": (
        trade_row, lambda r: r[5],
        "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, trade_time long, is_buyer_maker boolean, is_best_match boolean", 1000,
    ),
    "funding": (funding_row, lambda r: r[1], "symbol string, funding_time long, funding_rate double, mark_price double", 1000),
}


#: Metrics of the futures market by period: kind -> path. Their columns are those of the first page, all text but the timestamp.
METRICS = {
    "open_interest": "/futures/data/openInterestHist",
    "taker_volume": "/futures/data/takerlongshortRatio",
    "account_ratio": "/futures/data/globalLongShortAccountRatio",
    "top_account_ratio": "/futures/data/topLongShortAccountRatio",
    "top_position_ratio": "/futures/data/topLongShortPositionRatio",
}
METRIC_PAGE = 500


def pages(fetch: Callable[[dict], list], kind: str, start: int, end: int, step: int, params: dict | None = None, shape: tuple | None = None) -> Iterator[tuple]:
    """Rows with start <= time < end, page by page; after a page the cursor stands behind its last row.

    An empty page of bars skips its span, as a gap in trading leaves none; for other kinds it ends the read.
    """
    make, at, _, size = shape or KINDS[kind]
    cursor = start
    while cursor < end:
        page = fetch({**(params or {}), "startTime": cursor, "endTime": end - 1, "limit": size})
        rows = [r for r in map(make, page) if cursor <= at(r) < end]
        if not rows:
            if kind != "bars":
                return
            cursor += step * size
            continue
        yield from rows
        cursor = max(map(at, rows)) + step


def discovered_schema(page: list[dict], preferred: tuple[str, ...] = ("symbol", "timestamp")) -> list[str]:
    """Column names of a metrics endpoint from its first page: the preferred ones first, the rest as they come."""
    seen = list(dict.fromkeys(k for row in page for k in row))
    return [c for c in preferred if c in seen] + [c for c in seen if c not in preferred]


def metric_rows(page: list[dict], columns: list[str]) -> Iterator[tuple]:
    for row in page:
        yield tuple(None if row.get(c) is None else str(row[c]) for c in columns)


def metric_shape(columns: list[str], symbol: str | None) -> tuple:
    """The entry of KINDS for metric rows of these columns: symbol, timestamp, timestamp_utc, then the others by name."""
    place = columns.index("timestamp")

    def make(row: dict) -> tuple:
        at = int(row["timestamp"])
        utc = datetime.datetime.fromtimestamp(at / 1000, datetime.timezone.utc).isoformat(timespec="milliseconds")
        whole = {**row, "symbol": row.get("symbol", symbol), "timestamp_utc": utc}
        return tuple(at if c == "timestamp" else None if whole.get(c) is None else str(whole[c]) for c in columns)

    return make, lambda r: r[place], ", ".join(f"`{c}` {'long' if c == 'timestamp' else 'string'}" for c in columns), METRIC_PAGE


def metric_columns(page: list[dict]) -> list[str]:
    first = ["symbol", "timestamp", "timestamp_utc"]
    return first + sorted({k for row in page for k in row} - set(first))


def book_row(snapshot: dict, at: int, levels: int) -> tuple:
    """A snapshot as (time, last_update_id, bid prices and sizes, ask prices and sizes) of the best levels."""
    out: list = [at, int(snapshot["lastUpdateId"])]
    for side in ("bids", "asks"):
        for k in range(levels):
            price, size = snapshot[side][k] if k < len(snapshot[side]) else (None, None)
            out += [float(price) if price is not None else None, float(size) if size is not None else None]
    return tuple(out)


def book_schema(levels: int) -> str:
    sides = [f"{s}_price_{k} double, {s}_qty_{k} double" for s in ("bid", "ask") for k in range(levels)]
    return ", ".join(["event_time long", "last_update_id long", *sides])


class Span(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__(start)
        self.start, self.end = start, end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable | None = None, columns: list[str] | None = None):
        self.options = options
        self.kind, self.url = options["kind"], options.get("url", "")
        self.start, self.end = int(options["start"]), int(options["end"])
        self.step, self.parts = int(options.get("step", 1)), int(options.get("partitions", 1))
        self.columns = columns
        self._fetch = fetch

    def asked(self) -> dict:
        """The parameters of every request beside the cursor."""
        return {k: self.options[k] for k in ("symbol", "interval", "period") if k in self.options}

    def shape(self) -> tuple:
        return metric_shape(self.columns or metric_columns([]), self.options.get("symbol")) if self.kind in METRICS else KINDS[self.kind]

    def partitions(self) -> list[Span]:
        width = -(-(self.end - self.start) // self.parts)
        width = max(self.step, -(-width // self.step) * self.step)
        return [Span(a, min(self.end, a + width)) for a in range(self.start, self.end, width)]

    def fetch(self, params: dict) -> list:
        if self._fetch:
            return self._fetch(params)
        if recorded := self.options.get("recorded"):
            with open(recorded, encoding="utf-8") as f:
                rows = json.load(f)
            name = {"trades": "T", "funding": "fundingTime"}.get(self.kind, "timestamp")
            at = (lambda x: x[0]) if self.kind == "bars" else (lambda x: int(x[name]))
            return [x for x in rows if params["startTime"] <= at(x) <= params["endTime"]][: params["limit"]]
        return request_json(self.url + METRICS.get(self.kind, ""), params)

    def read(self, partition: Span) -> Iterator[tuple]:
        return pages(self.fetch, self.kind, partition.start, partition.end, self.step, self.asked(), self.shape())


class PagedStream(SimpleDataSourceStreamReader):
    """The cursor is the offset; a batch is a page.

    An empty page of bars whose whole span has passed is a gap in trading, and the cursor goes behind it; otherwise the
    cursor waits.
    """

    def __init__(self, options: dict, fetch: Callable | None = None, now: Callable[[], float] = time.time, columns: list[str] | None = None):
        self.reader = PagedReader(options, fetch, columns)
        self.now = now

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.reader.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        r, cursor = self.reader, start["cursor"]
        make, at, _, size = r.shape()
        if cursor >= r.end:
            return iter([]), start
        page = r.fetch({**r.asked(), "startTime": cursor, "endTime": r.end - 1, "limit": size})
        rows = [x for x in map(make, page) if cursor <= at(x) < r.end]
        if rows:
            return iter(rows), {"cursor": max(map(at, rows)) + r.step}
        behind = cursor + r.step * size
        passed = r.kind == "bars" and behind <= self.now() * 1000
        return iter([]), {"cursor": min(behind, r.end) if passed else cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        r = self.reader
        return pages(r.fetch, r.kind, start["cursor"], end["cursor"], r.step, r.asked(), r.shape())


class PagedSource(DataSource):
    """spark.read.format("paged_rest").option("kind", "bars" | "trades" | "funding" | a kind of METRICS).option("start", ms)…"""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        kind = self.options["kind"]
        if kind not in METRICS:
            return KINDS[kind][2]
        asking = PagedReader(dict(self.options))
        page = asking.fetch({**asking.asked(), "startTime": asking.start, "endTime": asking.end - 1, "limit": METRIC_PAGE})
        return metric_shape(metric_columns(page), None)[2]

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options), columns=schema.fieldNames())

    def simpleStreamReader(self, schema) -> PagedStream:  # noqa: N802
        return PagedStream(dict(self.options), columns=schema.fieldNames())


class BookStream(SimpleDataSourceStreamReader):
    """Polls order-book snapshots; the offset counts them."""

    def __init__(self, options: dict):
        self.options, self.levels = options, int(options.get("levels", 5))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def snapshot(self, n: int) -> list[tuple[dict, int]]:
        if recorded := self.options.get("recorded"):
            with open(recorded, encoding="utf-8") as f:
                found = json.load(f)
            return [(x, x["E"]) for x in found[n : n + 1]]
        return [(request_json(self.options["url"], {"symbol": self.options["symbol"], "limit": self.options.get("depth", 100)}), int(time.time() * 1000))]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [book_row(x, at, self.levels) for x, at in self.snapshot(start["n"])]
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for n in range(start["n"], end["n"]):
            yield from (book_row(x, at, self.levels) for x, at in self.snapshot(n))


class BookSource(DataSource):
    """spark.readStream.format("order_book").option("levels", 5)…"""

    @classmethod
    def name(cls) -> str:
        return "order_book"

    def schema(self) -> str:
        return book_schema(int(self.options.get("levels", 5)))

    def simpleStreamReader(self, schema) -> BookStream:  # noqa: N802
        return BookStream(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(PagedSource)
    spark.dataSource.register(BookSource)
