import io
import json
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tidemark.sources import pagers

MINUTES = [k for k in range(2500) if not 700 <= k < 760]  # an hour is missing


class Venue(BaseHTTPRequestHandler):
    failed: set = set()
    times: list = []

    def do_GET(self):
        Venue.times.append(time.monotonic())
        at = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        if self.path not in Venue.failed:  # every first request fails
            Venue.failed.add(self.path)
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        if at.path == "/klines":
            low, high, limit = int(q["startTime"]), int(q["endTime"]), int(q["limit"])
            body = json.dumps([[60000 * k, "1.5", "2", "1", str(k), "3", 60000 * k + 59999, "9", 4, "1", "2", "0"] for k in MINUTES if low <= 60000 * k <= high][:limit]).encode()
        elif at.path == "/ohlc":
            low, limit = int(q["start"]), int(q["limit"])
            body = json.dumps({"data": {"ohlc": [{"timestamp": str(60 * k), "open": "1", "high": "2", "low": "1", "close": str(k), "volume": "3"} for k in MINUTES if 60 * k >= low][:limit]}}).encode()
        elif at.path.endswith("2024-01-02.zip"):
            self.send_response(404)
            self.end_headers()
            return
        else:
            raw, out = "7,100.5,0.25,1,2,{},True,False\n", io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("day.csv", raw.format(1704067200123 if "01-01" in at.path else 1704240000123456))
            body = out.getvalue()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def venue():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Venue)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_and_days(spark, venue):
    pagers.register(spark)
    end = 2400 * 60000 + 30000  # the last candle is still open
    df = spark.read.format("kline_pages").options(url=f"{venue}/klines", symbol="X", start=0, end=end, limit=500, unit=0.01).load()
    assert df.rdd.getNumPartitions() == 5
    want = [k for k in MINUTES if k < 2400]
    assert sorted(r["close"] for r in df.collect()) == want
    assert pagers.resume_from(df) == want[-1] * 60000 + 60000 and pagers.resume_from(df.limit(0)) is None
    df = spark.read.format("ohlc_pages").options(url=f"{venue}/ohlc", start=60, end=60 * 1000, limit=300, unit=0.01).load()
    assert sorted(r["close"] for r in df.collect()) == [k for k in MINUTES if 1 <= k < 1000]
    days = spark.read.format("trade_days").options(url=venue + "/{day}.zip", start="2024-01-01", end="2024-01-03", unit=0.01).load()
    got = days.selectExpr("cast(trade_time as string)", "price", "is_buyer_maker", "is_best_match").collect()
    assert sorted(map(tuple, got)) == [("2024-01-01 00:00:00.123", 100.5, True, False), ("2024-01-03 00:00:00.123456", 100.5, True, False)]


def test_shared_rate(spark, venue):
    """Eight tasks at once, retries included: no second sees more requests than agreed."""
    pagers.register(spark)
    Venue.times.clear()
    df = spark.read.format("ohlc_pages").options(url=f"{venue}/ohlc", start=0, end=60 * 2500, limit=250, per_second=4, unit=0.01).load()
    assert df.rdd.getNumPartitions() == 4
    assert sorted(r["close"] for r in df.collect()) == MINUTES
    times = sorted(Venue.times)
    assert len(times) >= 10  # each page once, and the first time of some in vain
    assert all(sum(t <= x < t + 1 for x in times) <= 4 for t in times)


def test_no_answer(venue):
    with pytest.raises(RuntimeError):
        pagers.fetch("http://127.0.0.1:9/none", retries=2, unit=0.001)
