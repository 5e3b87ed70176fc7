"""Order-book measures: as-of quotes, spread decomposition, order-flow imbalance, slippage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.exprs import bucketed_last, micros, safe_div
from tidemark.functions.quantiles import exact_quantiles, exact_quantiles_of
from tidemark.operators.liquidity import ols_hc0

LAG_MS = 50
HORIZONS = (1, 5, 30, 60)


def asof_mid(trades: DataFrame, quotes: DataFrame, horizons: tuple[int, ...] = (0,), lag_ms: int = LAG_MS, key: str = "agg_trade_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, horizon, mid): the last mid strictly before ``recv_time - lag + horizon`` seconds, of the same ``by`` (a symbol).

    All horizons share one pass: trades stand once for each, and trades and quotes run through one
    ordered union, dealt by hour.  Of quotes at one time the highest update_id wins.
    """
    return looked_up(trades.select(*by, F.col(key).alias("id"), "recv_time"), quotes, horizons, lag_ms, by, ()).select(*by, F.col("id").alias(key), "horizon", "mid")


def looked_up(trades: DataFrame, quotes: DataFrame, horizons: tuple[int, ...], lag_ms: int, by: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """(by, id, carry, horizon, mid) of ``trades(by, id, recv_time, carry)``."""
    at = F.col("recv_time") - F.expr(f"INTERVAL {lag_ms} MILLISECONDS") + F.make_dt_interval(secs=F.col("horizon").cast("decimal(18,6)"))
    looks = trades.select("*", F.explode(F.array(*(F.lit(h) for h in horizons))).alias("horizon")).select(*by, "id", *carry, "horizon", at.alias("at"), F.lit(0).alias("k"))
    marks = quotes.select(*by, F.col("event_time").alias("at"), F.lit(1).alias("k"), F.col("update_id").cast("long").alias("seq"), F.col("mid").alias("quoted"))
    both = looks.unionByName(marks, allowMissingColumns=True).withColumn("hour", F.date_trunc("hour", "at"))
    return bucketed_last(both, {"mid": F.col("quoted")}, ["at", "k", "seq"], "hour", by).where("k = 0").select(*by, "id", *carry, "horizon", "mid")


def effective_spreads(trades: DataFrame, quotes: DataFrame, horizons: tuple[int, ...] = HORIZONS, by: tuple[str, ...] = ()) -> DataFrame:
    """Per trade and horizon: effective spread, price impact and realised spread in bp.

    Price, quantity and side ride along with the looks; the mids of a trade are gathered by its id once.
    """
    d = F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0)
    told = trades.select(*by, F.col("agg_trade_id").alias("id"), "recv_time", "price", "quantity", d.alias("d"))
    mids = looked_up(told, quotes, (0, *horizons), LAG_MS, by, ("price", "quantity", "d"))
    after = F.filter(F.collect_list(F.when(F.col("horizon") > 0, F.struct("horizon", F.col("mid").alias("m_after")))), lambda x: x["m_after"].isNotNull())
    gathered = mids.groupBy(*by, "id").agg(F.max(F.when(F.col("horizon") == 0, F.col("mid"))).alias("m"), *(F.max(c).alias(c) for c in ("price", "quantity", "d")), after.alias("after"))
    each = gathered.where("m <> 0").select("*", F.explode("after").alias("x")).select(*by, F.col("id").alias("agg_trade_id"), "m", "price", "quantity", "d", "x.*")
    es, pi = (safe_div(2 * F.col("d") * (x - F.col("m")), F.col("m")) * 1e4 for x in (F.col("price"), F.col("m_after")))
    return each.select(*by, "agg_trade_id", "horizon", "quantity", es.alias("es"), pi.alias("pi"), (es - pi).alias("rs"))


def spread_summary(spreads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Volume-weighted means and exact medians by horizon."""
    keys = (*by, "horizon")
    weighted = lambda c: safe_div(F.sum(F.col(c) * F.col("quantity")), F.sum("quantity")).alias(f"{c}_vw")
    means = spreads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"), weighted("es"), weighted("pi"), weighted("rs"))
    return means.join(exact_quantiles_of(spreads, ["es", "pi", "rs"], {"median": 0.5}, keys), list(keys), "left")


def next_times(quotes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the seconds to the next quote; 0 for the last.  Hours are joined by their first quote."""
    hour = F.date_trunc("hour", "event_time")
    told = quotes.withColumns({"hour": hour, "us": micros(F.col("event_time"))})
    within = Window.partitionBy(*by, "hour").orderBy("us", "update_id")
    heads = told.groupBy(*by, "hour").agg(F.min("us").alias("first"))
    ahead = F.lead("first").over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("hour"))
    timed = told.withColumn("_next", F.lead("us").over(within)).join(heads.select(*by, "hour", ahead.alias("_after")), [*by, "hour"])
    return timed.withColumn("seconds", (F.coalesce("_next", "_after", "us") - F.col("us")) / 1e6).drop("hour", "us", "_next", "_after")


def quoted_spreads(quotes: DataFrame) -> DataFrame:
    """Time-weighted quoted spread; the weights have an epsilon, the one-tick share has none."""
    w = F.col("seconds") + 1e-9
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    return next_times(quotes).agg(
        F.count(F.lit(1)).alias("n_quotes"), mean("spread_bps").alias("spread_bps_tw"), mean("spread_usdt").alias("spread_usdt_tw"), mean("spread_ticks").alias("spread_ticks_tw"),
        safe_div(F.sum(F.when(F.col("spread_ticks") == 1, F.col("seconds")).otherwise(0.0)), F.sum("seconds")).alias("one_tick_share"), F.max("spread_bps").alias("spread_bps_max"), F.avg("bid_qty").alias("bid_qty_mean"), F.avg("ask_qty").alias("ask_qty_mean"),
    )


def order_flow(quotes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Order-flow imbalance of each quote update; NULL for the first of its ``by`` (a symbol)."""
    best = F.struct("bid", "bid_qty", "ask", "ask_qty")
    told = bucketed_last(quotes.withColumn("hour", F.date_trunc("hour", "event_time")), {"p": best}, ["event_time", "update_id"], "hour", by)
    b, a, pb, pa = F.col("bid"), F.col("ask"), F.col("p.bid"), F.col("p.ask")
    one = lambda c: c.cast("double")
    ofi = one(b >= pb) * F.col("bid_qty") - one(b <= pb) * F.col("p.bid_qty") - one(a <= pa) * F.col("ask_qty") + one(a >= pa) * F.col("p.ask_qty")
    return told.withColumn("ofi", ofi).drop("p", "hour")


def impact_bins(quotes: DataFrame, trades: DataFrame, seconds: int = 10) -> DataFrame:
    """Bins of quotes and trades: mid change in bp within the bin, summed flow, signed volume.

    Trades keep their raw receive clock.  A bin without trades inside the trades' range counts 0.
    """
    width = f"{seconds} seconds"
    at = F.struct("event_time", "update_id")
    q = order_flow(quotes).groupBy(F.window("event_time", width).start.alias("bin")).agg(F.min_by("mid", at).alias("first"), F.max_by("mid", at).alias("last"), F.coalesce(F.sum("ofi"), F.lit(0.0)).alias("ofi"))
    signed = F.when(F.col("is_buyer_maker"), -F.col("quantity")).otherwise(F.col("quantity"))
    t = trades.groupBy(F.window("recv_time", width).start.alias("bin")).agg(F.sum(signed).alias("signed_volume"))
    ends = t.agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    joined = q.join(t, "bin", "left").crossJoin(F.broadcast(ends)).where("bin BETWEEN _a AND _b")
    return joined.select("bin", ((safe_div(F.col("last"), F.col("first")) - 1) * 1e4).alias("y"), "ofi", F.coalesce("signed_volume", F.lit(0.0)).alias("signed_volume"))


def impact_regressions(bins: DataFrame) -> DataFrame:
    x = F.explode(F.array(F.struct(F.lit("ofi").alias("x_name"), F.col("ofi").alias("x")), F.struct(F.lit("signed_volume").alias("x_name"), F.col("signed_volume").alias("x"))))
    return ols_hc0(bins.select("y", x.alias("p")).select("y", "p.*"), ["x_name"], "y", "x")


def slippage(depth: DataFrame, sizes: tuple[float, ...]) -> DataFrame:
    """(snapshot, side, size, bps, thin): cost against the mid of eating the book; NULL when it is too thin.

    A ladder is walked once, with the costs of all sizes side by side.
    """
    zero, wanted = F.lit(0.0), F.array(*(F.lit(float(s)) for s in sizes))

    def walk(ladder: Column) -> Column:
        def eat(acc: Column, x: Column) -> Column:
            q = F.coalesce(x["qty"], zero)
            cost = F.zip_with(acc["n"], wanted, lambda n, s: n + F.coalesce(F.greatest(F.least(s - acc["c"], q), zero) * x["px"], zero))
            return F.struct((acc["c"] + q).alias("c"), cost.alias("n"))

        return F.aggregate(ladder, F.struct(zero.alias("c"), F.transform(wanted, lambda _: F.lit(0.0)).alias("n")), eat)

    mid = (F.try_element_at("bids", F.lit(1))["px"] + F.try_element_at("asks", F.lit(1))["px"]) / 2
    sides = F.array(F.struct(F.lit("buy").alias("side"), F.lit(1.0).alias("sign"), walk(F.col("asks")).alias("w")), F.struct(F.lit("sell").alias("side"), F.lit(-1.0).alias("sign"), walk(F.col("bids")).alias("w")))
    both = depth.withColumn("mid", mid).where("mid IS NOT NULL").select("snapshot", "mid", F.explode(sides).alias("p")).select("snapshot", "mid", "p.side", "p.sign", "p.w.c", F.explode(F.arrays_zip(wanted.alias("size"), F.col("p.w.n").alias("n"))).alias("s"))
    size, n = F.col("s.size"), F.col("s.n")
    cost = safe_div(F.col("sign") * (n / size - F.col("mid")), F.col("mid")) * 1e4
    return both.select("snapshot", "side", size.alias("size"), F.when(F.col("c") >= size, cost).alias("bps"), (F.col("c") < size).alias("thin"))


def slippage_curve(depth: DataFrame, sizes: tuple[float, ...] = (0.1, 0.5, 1, 2, 5, 10)) -> DataFrame:
    costs = slippage(depth, sizes)
    means = costs.groupBy("side", "size").agg(F.avg("bps").alias("mean_bps"), F.avg(F.col("thin").cast("double")).alias("book_too_thin_share"), F.count(F.lit(1)).alias("n"))
    return means.join(exact_quantiles(costs, "bps", {"median_bps": 0.5, "p95_bps": 0.95}, ("side", "size")), ["side", "size"], "left")
