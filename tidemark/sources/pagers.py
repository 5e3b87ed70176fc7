"""Paged web sources as Spark data sources: every page, or every day's file, is a partition with its own task.

``register(spark)`` makes the formats ``kline_pages``, ``ohlc_pages`` and ``trade_days`` known.  A page that
fails is asked for again after 1, 2, 4, ... seconds (or what the server says), and a lost task asks for its
own page alone.  Pages have fixed ends, so that none is read twice and a gap in the data needs no paging state.
"""

from __future__ import annotations

import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Statuses that ask for patience, and the longest wait in seconds.
BUSY, LONGEST = (418, 429), 60
#: Seconds between two requests of a lane: a little more than one, so that no second sees two.
GAP = 1.02
STEP_MS = {"1m": 60_000, "1h": 3_600_000, "1d": 86_400_000}
#: Raw trade times above this are microseconds, else milliseconds.
MICROS_FROM = 10**14


def fetch(url: str, retries: int = 5, timeout: float = 20, unit: float = 1.0, before: Callable[[], None] = lambda: None) -> bytes | None:
    """The body; None where there is none (404).  ``unit``: seconds of the first wait; ``before`` is called before each attempt."""
    for attempt in range(retries):
        before()
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code not in BUSY and e.code < 500:
                raise
            wait = float(e.headers.get("Retry-After") or 2**attempt)
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            wait = 2**attempt
        time.sleep(min(wait, LONGEST) * unit)
    raise RuntimeError(f"no answer from {url} after {retries} attempts")


@dataclass
class Page(InputPartition):
    """[start, end) in the source's unit, or one day."""

    start: int
    end: int = 0


def stamp(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, tz=UTC)


@dataclass
class Lane(InputPartition):
    """Pages that one task asks for, one after the other."""

    pages: list[Page]


class Pace:
    """Keeps the attempts of a lane apart by so many seconds."""

    def __init__(self, gap: float):
        self.gap, self.last = gap, -float("inf")

    def wait(self) -> None:
        time.sleep(max(0.0, self.last + self.gap - time.monotonic()))
        self.last = time.monotonic()


class Pages(DataSourceReader):
    """Reads [start, end) in pages of ``limit`` steps; the options are those of the source.

    With ``per_second`` the pages are dealt to that many lanes at most, each of which asks, retries included, less
    than once a second: all tasks together stay within the rate, however many run at once and without a word between
    them.  Without it every page is a task.
    """

    def __init__(self, options: dict, step: int):
        self.options, self.step = dict(options), step
        self.start, self.end, self.limit = int(options["start"]), int(options["end"]), int(options.get("limit", 1000))

    def partitions(self) -> list[Lane]:
        width, rate = self.step * self.limit, int(self.options.get("per_second", 0))
        pages = [Page(k, min(k + width, self.end)) for k in range(self.start, self.end, width)]
        lanes = min(rate, len(pages)) if rate else len(pages)
        return [Lane(pages[k::lanes]) for k in range(lanes)]

    def read(self, lane: Lane) -> Iterator[tuple]:
        self.pace = Pace(GAP if "per_second" in self.options else float(self.options.get("pause", 0)))
        for page in lane.pages:
            yield from self.page(page)

    def ask(self, **query) -> object:
        body = fetch(self.options["url"] + "?" + urllib.parse.urlencode(query), int(self.options.get("retries", 5)), unit=float(self.options.get("unit", 1)), before=self.pace.wait)
        return json.loads(body or b"null")


class KlineReader(Pages):
    def page(self, page: Page) -> Iterator[tuple]:
        found = self.ask(symbol=self.options["symbol"], interval=self.options.get("interval", "1m"), startTime=page.start, endTime=page.end - 1, limit=self.limit)
        for k in found or ():
            if page.start <= k[0] < page.end and k[6] < self.end:  # candles that are still open are left out
                yield stamp(k[0]), *map(float, k[1:6]), stamp(k[6]), float(k[7]), int(k[8]), float(k[9]), float(k[10])


class KlinePages(DataSource):
    """Options: url, symbol, interval, start and end (ms), limit, pause, per_second, retries."""

    @classmethod
    def name(cls) -> str:
        return "kline_pages"

    def schema(self) -> str:
        return "time timestamp, open double, high double, low double, close double, volume double, close_time timestamp, quote_asset_volume double, num_trades long, taker_buy_base_volume double, taker_buy_quote_volume double"

    def reader(self, schema) -> DataSourceReader:
        return KlineReader(self.options, STEP_MS[self.options.get("interval", "1m")])


class OhlcReader(Pages):
    def page(self, page: Page) -> Iterator[tuple]:
        found = self.ask(step=self.step, limit=self.limit, start=page.start)
        rows = {int(k["timestamp"]): k for k in found["data"]["ohlc"]} if found else {}
        for at in sorted(rows):
            if page.start <= at < page.end:
                yield stamp(1000 * at), *(float(rows[at][c]) for c in ("open", "high", "low", "close", "volume"))


class OhlcPages(DataSource):
    """Options: url, start and end (seconds), step, limit, pause, per_second, retries."""

    @classmethod
    def name(cls) -> str:
        return "ohlc_pages"

    def schema(self) -> str:
        return "time timestamp, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return OhlcReader(self.options, int(self.options.get("step", 60)))


class TradeDayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Page]:
        first, last = (date.fromisoformat(self.options[k]).toordinal() for k in ("start", "end"))
        return [Page(k) for k in range(first, last + 1)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        day = date.fromordinal(page.start).isoformat()
        body = fetch(self.options["url"].format(day=day), int(self.options.get("retries", 4)), 120, float(self.options.get("unit", 1)))
        if body is None:  # no file for that day
            return
        names = ["agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "timestamp", "is_buyer_maker", "is_best_match"]
        kinds = {"price": pa.float64(), "quantity": pa.float64(), "is_buyer_maker": pa.string(), "is_best_match": pa.string()}
        options = pa.csv.ConvertOptions(column_types={n: kinds.get(n, pa.int64()) for n in names})
        with zipfile.ZipFile(io.BytesIO(body)) as z, z.open(z.namelist()[0]) as f:
            for batch in pa.csv.open_csv(f, pa.csv.ReadOptions(column_names=names), convert_options=options):
                at = batch.column("timestamp")
                micros = pc.if_else(pc.greater(at, MICROS_FROM), at, pc.multiply(at, 1000)).cast(pa.timestamp("us", tz="UTC"))
                told = {n: pc.equal(pc.utf8_lower(batch.column(n)), "true") if n.startswith("is_") else batch.column(n) for n in names if n != "timestamp"}
                yield pa.RecordBatch.from_pydict(told | {"trade_time": micros})


class TradeDays(DataSource):
    """Options: url (with ``{day}``), start and end (days, both included), retries."""

    @classmethod
    def name(cls) -> str:
        return "trade_days"

    def schema(self) -> str:
        return "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, is_buyer_maker boolean, is_best_match boolean, trade_time timestamp"

    def reader(self, schema) -> DataSourceReader:
        return TradeDayReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (KlinePages, OhlcPages, TradeDays):
        spark.dataSource.register(source)


def resume_from(stored, close_time: str = "close_time") -> int | None:
    """The first millisecond after the last stored candle; None for an empty table."""
    last = stored.selectExpr(f"max(unix_millis(cast({close_time} as timestamp))) AS m").first()["m"]
    return None if last is None else last + 1


def day_range(start: date, end: date) -> list[date]:
    """Every day from start to end, both included."""
    return [start + timedelta(days=k) for k in range((end - start).days + 1)]
