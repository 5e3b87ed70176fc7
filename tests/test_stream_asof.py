"""The streaming as-of join on rows out of order, restarted half-way, against the join of the whole tables."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import book
from tidemark.streaming import asof

TRADES, QUOTES = "symbol string, agg_trade_id long, recv_time timestamp", "symbol string, event_time timestamp, update_id long, mid double"
FAR = pd.Timestamp("2024-01-02", tz="UTC")


@pytest.fixture
def rocks(spark):
    spark.conf.set(asof.STORE, asof.ROCKS)
    yield
    spark.conf.unset(asof.STORE)


def dealt(pdf, time, folder, rng, parts):
    """Files in the order of arrival: up to 80 seconds late."""
    os.makedirs(folder)
    arrival = pdf[time] + pd.to_timedelta(rng.uniform(0, 80, len(pdf)), unit="s")
    edges = pd.date_range("2024-01-01", periods=parts + 1, freq="10min", tz="UTC")
    for k in range(parts):
        part = pdf[(arrival >= edges[k]) & ((arrival < edges[k + 1]) | (k == parts - 1))]
        part.to_parquet(f"{folder}/{k}.parquet", coerce_timestamps="us")
        os.utime(f"{folder}/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def test_stream_equals_table(spark, rocks, tmp_path):
    rng = np.random.default_rng(6)
    at = lambda n: pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(np.round(rng.uniform(0, 3600, n), 2), unit="s")
    trades = pd.DataFrame({"symbol": rng.choice(["btc", "eth"], 400, p=[0.9, 0.1]), "agg_trade_id": np.arange(400), "recv_time": at(400)})
    quotes = pd.DataFrame({"symbol": rng.choice(["btc", "eth", "none"], 900), "event_time": at(900), "update_id": np.arange(900), "mid": np.where(rng.random(900) < 0.05, np.nan, rng.normal(100, 1, 900))})
    quotes = pd.concat([quotes, quotes.assign(update_id=quotes.update_id + 900, mid=quotes.mid + 1).head(50)])  # two quotes at one time
    dealt(trades, "recv_time", tmp_path / "trades", rng, 6)
    dealt(quotes, "event_time", tmp_path / "quotes", rng, 6)
    clean = lambda q: q.withColumn("mid", F.when(~F.isnan("mid"), F.col("mid")))
    horizons = (0, 1, 60)

    def run():
        read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        found = asof.asof_mid(read(TRADES, "trades"), clean(read(QUOTES, "quotes")), horizons, "3 minutes")
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return q

    later = [(tmp_path / "quotes" / f"{k}.parquet", tmp_path / f"q{k}.parquet") for k in (4, 5)] + [(tmp_path / "trades" / f"{k}.parquet", tmp_path / f"t{k}.parquet") for k in (4, 5)]
    for there, away in later:
        there.rename(away)
    run()
    for there, away in later:
        away.rename(there)
    pd.DataFrame({"symbol": ["none"], "event_time": [FAR], "update_id": [10**6], "mid": [1.0]}).to_parquet(tmp_path / "quotes" / "9.parquet", coerce_timestamps="us")
    run()  # from the checkpoint
    run()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(got) == len(trades) * 3 and not got.duplicated(["agg_trade_id", "horizon"]).any()
    whole = book.asof_mid(spark.read.schema(TRADES).parquet(str(tmp_path / "trades")), clean(spark.read.schema(QUOTES).parquet(str(tmp_path / "quotes"))).where("mid IS NOT NULL"), horizons, by=("symbol",)).toPandas()
    order = ["agg_trade_id", "horizon"]
    got, whole = (x.sort_values(order).reset_index(drop=True)[["symbol", *order, "mid"]] for x in (got, whole))
    pd.testing.assert_frame_equal(got, whole, check_dtype=False)


def test_the_state_store_is_asked_for(spark):
    empty = spark.createDataFrame([], TRADES)
    with pytest.raises(ValueError):
        asof.asof_mid(empty, spark.createDataFrame([], QUOTES))
