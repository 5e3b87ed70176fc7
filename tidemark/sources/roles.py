"""Market roles of the generic tables: each is a fixed projection, as documented in FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("trade_time"), F.col("ts").alias("recv_time"), F.col("value").alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("quantity"),
        (F.col("event_id") % 2 == 1).alias("is_buyer_maker"), F.col("event_id").alias("agg_trade_id"), "event_type",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best quotes with mid and spread in three units; a tick is 0.01, ticks are rounded half to even."""
    ask = F.col("value") + 0.01 * (1 + F.col("event_id") % 5)
    best = table(spark, sf_dir, "events").where("event_type = 'view'").select(
        F.col("ts").alias("event_time"), F.col("value").alias("bid"), ask.alias("ask"), (1 + F.col("user_id") % 7).cast("double").alias("bid_qty"),
        (1 + F.col("event_id") % 9).cast("double").alias("ask_qty"), F.col("event_id").alias("update_id"),
    )
    return with_spreads(best)


def with_spreads(best: DataFrame) -> DataFrame:
    mid, spread = (F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid")
    return best.withColumns({"mid": mid, "spread_usdt": spread, "spread_ticks": F.rint(spread / 0.01), "spread_bps": F.try_divide(spread, mid) * 1e4})


def depth(spark: SparkSession, sf_dir: str, levels: int = 10) -> DataFrame:
    """(snapshot, bids, asks): ladders of (px, qty), best level first, at most ``levels``."""
    px = F.try_divide("l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", px.alias("px"), F.col("l_quantity").cast("double").alias("qty"), *LINE_ORDER[2:])
    one = F.col("l_linenumber") % 2 == 1
    side = lambda cond, up: F.slice(F.sort_array(F.collect_list(F.when(cond & F.col("px").isNotNull(), F.struct((F.col("px") if up else -F.col("px")).alias("key"), "qty"))), True), 1, levels)
    return lines.groupBy(F.col("l_orderkey").alias("snapshot")).agg(side(one, False).alias("b"), side(~one, True).alias("a")).select("snapshot", F.transform("b", lambda x: F.struct((-x["key"]).alias("px"), x["qty"].alias("qty"))).alias("bids"), F.transform("a", lambda x: F.struct(x["key"].alias("px"), x["qty"].alias("qty"))).alias("asks"))


def minute_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute bars of the trade tape with the kline columns."""
    t = trades(spark, sf_dir)
    at = F.struct("trade_time", "agg_trade_id")
    return t.groupBy(F.date_trunc("minute", "trade_time").alias("time")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("quote_asset_volume"), F.count(F.lit(1)).alias("num_trades"), F.sum(F.when(~F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0)).alias("taker_buy_base_volume"),
    )


def daily_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of one day each: side from the return flag."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_returnflag") == "R").alias("is_buyer_maker"))


def daily_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 6).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


