"""The prevailing quote of each trade on streams, as ``operators.book.asof_mid`` has it on tables.

Trades and quotes wait in state, keyed by symbol and laid in buckets of ``WIDTH`` seconds, until the watermark has
passed a bucket: then no quote that it needs can still come, its looks are answered, and of the quotes behind it only
the last one stays.  State is so bounded by what arrives within the lateness, the longest horizon and a bucket.

The clock is the receive time of trades and the event time of quotes, not the time that a look asks for: a look one
minute ahead does not make the quotes of that minute late.  Sessions need the RocksDB state store.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators.book import LAG_MS

WIDTH = 10
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Prevailing(StatefulProcessor):
    """One symbol: looks wait until their bucket is safe, then take the last mid strictly before."""

    def __init__(self, width: int, lag_ms: int):
        self.width, self.lag = width * 1000, lag_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quotes = handle.getMapState("quotes", "bucket long", "at array<long>, seq array<long>, mid array<double>")
        self.looks = handle.getMapState("looks", "bucket long", "at array<long>, id array<long>, horizon array<int>")
        self.last = handle.getValueState("last", "at long, seq long, mid double")

    def _add(self, state, bucket: int, rows: tuple[list, list, list]) -> None:
        if state.containsKey((bucket,)):
            rows = tuple([*old, *new] for old, new in zip(state.getValue((bucket,)), rows, strict=True))
        else:
            self.handle.registerTimer((bucket + 1) * self.width + self.lag)
        state.updateValue((bucket,), rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            bucket = pdf["at"] // (self.width * 1000)
            for (b, quote), part in pdf.groupby([bucket, pdf["k"] == 1]):
                columns = ("at", "seq", "mid") if quote else ("at", "id", "horizon")
                kinds = {"at": int, "seq": int, "id": int, "horizon": int, "mid": float}
                self._add(self.quotes if quote else self.looks, int(b), tuple([kinds[c](v) for v in part[c]] for c in columns))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Answers every bucket that the watermark has made safe, in order, and lets go of the quotes behind it."""
        until = expiredTimerInfo.getExpiryTimeInMs() - self.lag
        safe = lambda state: sorted(b for (b,) in state.keys() if (b + 1) * self.width <= until)  # noqa: E731, SIM118
        known = [tuple(self.last.get())] if self.last.exists() else []
        old = safe(self.quotes)
        for b in old:
            known += zip(*self.quotes.getValue((b,)), strict=True)
        known.sort()
        times, out = [q[0] for q in known], []
        for b in safe(self.looks):
            for at, id_, horizon in zip(*self.looks.getValue((b,)), strict=True):
                k = bisect_left(times, at) - 1
                out.append((key[0], id_, horizon, known[k][2] if k >= 0 else None))
            self.looks.removeKey((b,))
        for b in old:
            self.quotes.removeKey((b,))
        if known:
            self.last.update(known[-1])
        if out:
            yield pd.DataFrame(out, columns=["symbol", "id", "horizon", "mid"]).astype({"horizon": "int32", "mid": "float64"})


def asof_mid(trades: DataFrame, quotes: DataFrame, horizons: tuple[int, ...] = (0,), late: str = "2 minutes", lag_ms: int = LAG_MS, key: str = "agg_trade_id", width: int = WIDTH) -> DataFrame:
    """(symbol, key, horizon, mid) of the streams ``trades(symbol, key, recv_time)`` and ``quotes(symbol, event_time, update_id, mid)``.

    A row that comes more than ``late`` behind the newest is dropped.  A trade without a quote before it has no mid.
    """
    if trades.sparkSession.conf.get(STORE) != ROCKS:
        raise ValueError(f"set {STORE} to {ROCKS}")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    looks = trades.select("symbol", F.col("recv_time").cast("timestamp").alias("seen"), F.col(key).cast("long").alias("id"), F.explode(F.array(*(F.lit(h) for h in horizons))).alias("horizon"))
    looks = looks.select("symbol", "seen", (F.unix_micros("seen") + F.col("horizon") * 1_000_000 - lag_ms * 1000).alias("at"), F.lit(0).alias("k"), "id", "horizon", F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("mid"))
    marks = quotes.where("mid IS NOT NULL").select(
        "symbol", F.col("event_time").cast("timestamp").alias("seen"), micros("event_time").alias("at"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("horizon"), F.col("update_id").cast("long").alias("seq"), "mid"
    )
    both = looks.unionByName(marks).withWatermark("seen", late)
    found = both.groupBy("symbol").transformWithStateInPandas(Prevailing(width, lag_ms), "symbol string, id long, horizon int, mid double", "Append", "EventTime")
    return found.withColumnRenamed("id", key)
