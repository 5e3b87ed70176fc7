"""Live capture on Structured Streaming: partitioned sink, windowed bars, stateful order flow, liveness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.io import demultiplex


def sink(df: DataFrame, path: str, checkpoint: str, recv: str = "recv_time", every: str = "20 seconds", once: bool = False) -> StreamingQuery:
    """Append to ``path/host=/date=/hour=`` by receive time; exactly once through the checkpoint."""
    told = df.withColumns({"host": F.col("source_host"), "date": F.to_date(recv), "hour": F.date_format(recv, "HH")})
    out = told.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd").partitionBy("host", "date", "hour")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def sink_raw(raw: DataFrame, path: str, checkpoint: str, host: str, every: str = "20 seconds") -> StreamingQuery:
    """Append a feed's parsed envelopes to ``path/kind=/host=/date=/hour=`` by receive time; ``io.book_rows`` and the like read them."""
    told = demultiplex(raw).withColumns({"host": F.lit(host), "date": F.to_date("recv_time"), "hour": F.date_format("recv_time", "HH")})
    out = told.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd")
    return out.partitionBy("kind", "host", "date", "hour").trigger(processingTime=every).start()


def minute_bars(trades: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Streaming minute bars; a bar is final when the watermark has passed it."""
    maker, q = F.col("is_buyer_maker"), F.col("quantity")
    bars = trades.withWatermark("trade_time", late).groupBy(F.window("trade_time", "1 minute")).agg(
        F.max_by("price", F.struct("trade_time", "agg_trade_id")).alias("close"), F.sum(F.when(maker, 0.0).otherwise(q)).alias("buy_qty"), F.sum(F.when(maker, q).otherwise(0.0)).alias("sell_qty"), F.count(F.lit(1)).alias("n_trades"), F.sum(F.col("price") * q).alias("usd_volume")
    )
    return bars.select(F.col("window.start").alias("minute"), "close", "buy_qty", "sell_qty", "n_trades", "usd_volume")


def order_flow(quotes: DataFrame) -> DataFrame:
    """Order-flow imbalance of each quote, with a symbol's last quote as state; rows of a batch in update order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("update_id")
        out = []
        for r in rows.itertuples(index=False):
            ofi = None
            if last is not None:
                b, qb, a, qa = last
                ofi = (r.bid >= b) * r.bid_qty - (r.bid <= b) * qb - (r.ask <= a) * r.ask_qty + (r.ask >= a) * qa
            out.append((key[0], r.update_id, ofi))
            last = (r.bid, r.bid_qty, r.ask, r.ask_qty)
        state.update(tuple(float(x) for x in last))
        yield pd.DataFrame(out, columns=["symbol", "update_id", "ofi"]).astype({"ofi": "float64"})

    return quotes.groupBy("symbol").applyInPandasWithState(step, "symbol string, update_id long, ofi double", "bid double, bid_qty double, ask double, ask_qty double", "append", GroupStateTimeout.NoTimeout)


def stale(seconds_since: float, counts: dict[str, int], flush_seconds: float = 20) -> bool:
    """No sign of life for max(90, 4 flushes) seconds, or an interval without any message."""
    return seconds_since > max(90, 4 * flush_seconds) or (bool(counts) and not any(counts.values()))


class Liveness(StreamingQueryListener):
    """Calls back when a query's batches stay empty ``patience`` times in a row, or when it ends."""

    def __init__(self, alarm: Callable[[str], None], patience: int = 5):
        self.alarm, self.patience, self.empty = alarm, patience, {}

    def onQueryStarted(self, event) -> None:
        self.empty[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.empty[str(p.id)] = self.empty.get(str(p.id), 0) + 1 if p.numInputRows == 0 else 0
        if self.empty[str(p.id)] >= self.patience:
            self.alarm(f"{p.name or p.id}: no rows in {self.patience} batches")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.alarm(f"{event.id}: {event.exception}")
