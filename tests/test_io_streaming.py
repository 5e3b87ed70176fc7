import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import book, feeds
from tidemark.sources import io as tio
from tidemark.sources import roles
from tidemark.streaming import capture


def envelopes(spark):
    rows = [
        ("2024-01-01T00:00:01.5+00:00", json.dumps({"stream": "btcusdt@bookTicker", "data": {"b": "1.5", "B": "2", "a": "1.6", "A": "3", "u": 7}})),
        ("2024-01-01T00:00:02+00:00", json.dumps({"stream": "btcusdt@aggTrade", "data": {"E": 1704067202000, "T": 1704067201900, "p": "1.55", "q": "2", "m": True, "a": 9}})),
        ("2024-01-01T00:00:03+00:00", json.dumps({"stream": "btcusdt@depth20", "data": {"bids": [["1.5", "1"], ["1.4", "2"]], "asks": [["1.6", "3"]]}})),
        ("2024-01-01T00:00:04+00:00", "not json"),
    ]
    return spark.createDataFrame(rows, "recv string, value string")


def test_demultiplex(spark):
    events = tio.demultiplex(envelopes(spark))
    assert events.count() == 3 and {r["symbol"] for r in events.collect()} == {"BTCUSDT"}
    b = tio.book_rows(events, "recv", "h").first()
    assert (b["best_bid_price"], b["best_ask_qty"], b["update_id"]) == (1.5, 3.0, 7)
    t = tio.trade_rows(events, "recv", "h").first()
    assert t["price"] == 1.55 and t["is_buyer_maker"] and t["agg_trade_id"] == 9
    wide = tio.depth_rows(events, "recv", "h")
    d = wide.first()
    assert d["bid_px_2"] == 1.4 and d["ask_px_2"] is None
    ladder = tio.ladders(wide, "event_time").first()
    assert len(ladder["bids"]) == 2 and len(ladder["asks"]) == 1


def test_partitions_and_cache(spark, tmp_path):
    base = str(tmp_path / "book")
    rows = tio.book_rows(tio.demultiplex(envelopes(spark)), "recv", "host1")
    tio.write_partitions(rows, f"{base}/quotes", "event_time")
    assert tio.load_stream(spark, base, "quotes", "host1").count() == 1
    with pytest.raises(ValueError):
        tio.load_stream(spark, base, "quotes", "other")
    path, calls = str(tmp_path / "cache"), []
    build = lambda: calls.append(1) or spark.range(3)
    assert tio.cached(spark, path, build).count() == 3 and tio.cached(spark, path, build).count() == 3 and len(calls) == 1


def test_zip_and_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "1,10.5,2,1,1,1704067200000,True,True\n2,11,1,2,3,1704067200000000,False,True\n")
    got = tio.read_trade_zips(spark, str(tmp_path / "a.zip")).orderBy("agg_trade_id").collect()
    assert [r["is_buyer_maker"] for r in got] == [True, False] and got[0]["trade_time"] == got[1]["trade_time"]
    (tmp_path / "d.csv").write_text("date,close\n2024-01-01,5\n")
    assert tuple(tio.read_daily_csv(spark, str(tmp_path / "d.csv")).first())[1:] == (5.0, None, 0.0)
    (tmp_path / "e.csv").write_text("date,open\n2024-01-01,5\n")
    with pytest.raises(ValueError):
        tio.read_daily_csv(spark, str(tmp_path / "e.csv"))


def test_small_helpers(spark):
    assert [tio.format_number(x) for x in (1234567, 1234.5, 0.123456, None, float("nan"))] == ["1,234,567", "1,234", "0.1235", "", ""]
    assert tio.read_heartbeat('{"pid": 1}') == {"pid": 1} and tio.read_heartbeat("x") is None and tio.read_heartbeat(None) is None
    assert tio.markdown(spark.range(1)).splitlines() == ["| id |", "|---|", "| 0 |"]
    assert tio.keep_last(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), ["k"], "v").first()["v"] == 2
    assert tio.synthetic_regimes(spark, 50).count() == 50
    assert capture.stale(91, {"a": 1}) and capture.stale(1, {"a": 0}) and not capture.stale(1, {"a": 2})


def test_streaming_bars_and_sink(spark, tmp_path):
    source = str(tmp_path / "in")
    trades = roles.trades(spark, "/root/testdata/sf0.001").drop("event_type").withColumn("source_host", F.lit("h"))
    trades.write.parquet(source)
    stream = spark.readStream.schema(trades.schema).parquet(source)
    capture.sink(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == trades.count()
    q = capture.minute_bars(stream.withColumn("trade_time", F.col("trade_time").cast("timestamp"))).writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert 0 < spark.table("bars").count() <= trades.count()


def test_streaming_order_flow(spark, tmp_path):
    quotes = roles.quotes(spark, "/root/testdata/sf0.001").withColumn("symbol", F.lit("S"))
    source = str(tmp_path / "quotes")
    quotes.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(quotes.schema).parquet(source)
    q = capture.order_flow(stream).writeStream.format("memory").queryName("flow").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    w = {r["update_id"]: r["ofi"] for r in book.order_flow(quotes.withColumn("event_time", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, update_id)"))).collect()}
    got = {r["update_id"]: r["ofi"] for r in spark.table("flow").collect()}
    assert got.keys() == w.keys()
    assert all((a is None or a != a) if w[k] is None else a == pytest.approx(w[k]) for k, a in got.items())


def test_a_stopped_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tio.read_replaced(spark, path)
    df = spark.range(10)
    tio.replace_parquet(df, path)
    reader = tio.read_replaced(spark, path)
    df.limit(3).write.parquet(f"{path}/v-{1:020d}")
    (tmp_path / "t" / f"v-{1:020d}" / "_SUCCESS").unlink()  # stopped before its commit
    assert tio.read_replaced(spark, path).count() == 10
    tio.replace_parquet(df.limit(4), path)
    assert tio.read_replaced(spark, path).count() == 4 and reader.count() == 10
    assert tio.versions(spark, path) == [(0, True), (2, True)]
    tio.replace_parquet(df.limit(5), path)
    assert tio.versions(spark, path) == [(2, True), (3, True)]


def test_settings_are_merged_in_groups():
    from tidemark.plans.regime_run import DEFAULTS, settings

    got = settings("router: {hidden: 8}", label={"k": 0.5})
    assert got["router"] == DEFAULTS["router"] | {"hidden": 8} and got["label"] == DEFAULTS["label"] | {"k": 0.5}
    assert settings('{"n": 5}')["n"] == 5 and settings() == DEFAULTS


def test_tables_and_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        tio.append_csv(df, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 4
    for k in (1, 2):
        tio.replace_parquet(df.where(f"k >= {k}"), str(tmp_path / "t"))
    assert tio.read_replaced(spark, str(tmp_path / "t")).count() == 1
    tio.write_small(df, str(tmp_path / "m"), "json")
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    rows = df.selectExpr("k", "'h' AS host", "DATE'2024-01-01' AS date", "lpad(k, 2, '0') AS hour")
    for _ in range(2):
        rows.write.mode("append").partitionBy("host", "date", "hour").parquet(str(tmp_path / "cap" / "depth20"))
    got = tio.partition_rows(spark, str(tmp_path / "cap"), host="h").collect()
    assert sorted((r["stream"], int(r["hour"]), r["n"], r["files"]) for r in got) == [("depth20", 1, 2, 2), ("depth20", 2, 2, 2)]
    spark.createDataFrame([("2017-08-17 05:00:00",), ("2017-08-18 00:00:00",)], "t string").selectExpr("cast(t as timestamp_ntz) AS time").write.parquet(str(tmp_path / "klines_2017"))
    assert tio.read_year_klines(spark, str(tmp_path / "klines_*"), "2017-08-18").count() == 1
    present = spark.createDataFrame([("depth20", 1, 17999), ("depth20", 2, 18000)], "stream string, hour int, n int")
    assert [r["hour"] for r in feeds.low_cadence(present, 36_000).collect()] == [1]
