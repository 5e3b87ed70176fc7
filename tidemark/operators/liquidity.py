"""Liquidity measures of minute bars, by day, hour or year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.exprs import bucketed_last, log_ratio, order_by, pos_log, rolling, safe_div


def prepare_minutes(klines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Side volumes, and the return in bp where the minute before is there.

    Days are worked on in parallel; the last minute of the day before comes from one row for each day.
    A minute whose price, or the price before, is 0 or missing has no return.
    """
    dated = klines.withColumn("date", F.to_date("time"))
    held = bucketed_last(dated, {"_before": F.struct("time", "close")}, ["time"], "date", by)
    near = F.col("_before.time") == F.col("time") - F.expr("INTERVAL 1 MINUTE")
    return held.withColumns({
        "buy_volume": F.col("taker_buy_base_volume"),
        "sell_volume": F.col("volume") - F.col("taker_buy_base_volume"),
        "signed_volume": 2 * F.col("taker_buy_base_volume") - F.col("volume"),
        "return_bps": F.when(near, log_ratio(F.col("close"), F.col("_before.close")) * 1e4),
    }).drop("_before")


def regression_by(df: DataFrame, by: list, y: str = "return_bps", x: str = "signed_volume") -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def kyle_daily(minutes: DataFrame) -> DataFrame:
    return regression_by(minutes, ["date"]).select("date", (F.col("slope") * 100).alias("kyle_lambda"), "r2", "n")


def ols_hc0(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Slope, intercept, HC0 t-statistic, R2 and n by group; two passes, as raw moments would cancel."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    first = both.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(x).alias("_mx"), F.regr_sxx(y, x).alias("_sxx"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))
    joined = both.join(first, by)
    dx, e = F.col(x) - F.col("_mx"), F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)
    second = joined.groupBy(*by).agg(F.sum(dx * dx * e * e).alias("_meat"))
    out = first.join(second, by, "left").withColumn("_var", safe_div(F.col("_meat"), F.col("_sxx") * F.col("_sxx")))
    fit = (F.col("n") >= 3) & (F.col("_sxx") > 0) & (F.col("_var") > 0)
    return out.select(*by, "slope", "intercept", F.when(fit, F.col("slope") / F.sqrt("_var")).alias("t"), "r2", "n")


def amihud_daily(minutes: DataFrame) -> DataFrame:
    days = minutes.groupBy("date").agg(F.max_by("close", "time").alias("close"), F.sum("quote_asset_volume").alias("usd"))
    return days.select("date", safe_div(F.abs(log_ratio(F.col("close"), F.lag("close").over(order_by("date")))) * 1e4, F.col("usd") / 1e6).alias("amihud"))


def roll_daily(minutes: DataFrame) -> DataFrame:
    before = F.lag("return_bps").over(Window.partitionBy("date").orderBy("time"))
    cov = minutes.select("date", (F.col("return_bps") / 1e4).alias("r"), (before / 1e4).alias("p")).groupBy("date").agg(F.covar_samp("r", "p").alias("cov"))
    return cov.select("date", "cov", F.when(F.col("cov") < 0, 2 * F.sqrt(-F.col("cov")) * 1e4).alias("roll_spread_bps"))


def abdi_ranaldo_daily(minutes: DataFrame) -> DataFrame:
    eta = (pos_log(F.col("high")) + pos_log(F.col("low"))) / 2
    told = minutes.select("date", "time", pos_log(F.col("close")).alias("c"), eta.alias("eta")).withColumn("next", F.lead("eta").over(Window.partitionBy("date").orderBy("time")))
    mean = F.avg((F.col("c") - F.col("eta")) * (F.col("c") - F.col("next")))
    return told.groupBy("date").agg(mean.alias("m")).select("date", F.when(F.col("m").isNotNull(), F.sqrt(F.greatest(4 * F.col("m"), F.lit(0.0))) * 1e4).alias("abdi_ranaldo_bps"))


def daily_basics(minutes: DataFrame) -> DataFrame:
    r = F.col("return_bps") / 1e4
    return minutes.groupBy("date").agg(
        F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"), F.sum("quote_asset_volume").alias("usd_volume"), F.sum("num_trades").alias("n_trades"),
        safe_div(F.sum("buy_volume"), F.sum("volume")).alias("buy_share"), F.sqrt(365 * F.coalesce(F.sum(r * r), F.lit(0.0))).alias("realized_vol"), F.count(F.lit(1)).alias("minutes"),
    )


def vpin_daily(minutes: DataFrame, per_day: int = 50, window: int = 50) -> DataFrame:
    """Mean VPIN of the buckets that end on each day.

    The volume clock is a two-level prefix sum: days are summed first, and each day's minutes start
    from the total before it.  Only daily totals pass through one task.
    """
    days = minutes.groupBy("date").agg(F.sum("volume").alias("v"))
    size = F.avg("v").over(Window.partitionBy(F.trunc("date", "month"))) / per_day
    sized = days.withColumn("size", size).withColumn("clock", safe_div(F.col("v"), F.col("size")))
    start = F.coalesce(F.sum("clock").over(order_by("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    clocked = minutes.join(sized.select("date", "size", start.alias("start")), "date")
    run = F.sum(safe_div(F.col("volume"), F.col("size"))).over(Window.partitionBy("date").orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    buckets = clocked.withColumn("bucket", F.floor(F.round(F.col("start") + run, 9))).groupBy("bucket").agg(F.sum("buy_volume").alias("b"), F.sum("sell_volume").alias("s"), F.max("time").alias("end"))
    told = buckets.withColumn("imbalance", safe_div(F.abs(F.col("b") - F.col("s")), F.col("b") + F.col("s")))
    told = told.withColumn("vpin", rolling(F.avg("imbalance"), F.col("imbalance"), order_by("bucket"), window))
    return told.groupBy(F.to_date("end").alias("date")).agg(F.avg("vpin").alias("vpin"), F.count(F.lit(1)).alias("buckets"))


def trade_counts(minutes: DataFrame) -> DataFrame:
    """Estimated buyer- and seller-initiated trades by day, rounded half to even."""
    share = F.coalesce(safe_div(F.col("buy_volume"), F.col("volume")), F.lit(0.5))
    return minutes.groupBy("date").agg(F.rint(F.sum(F.col("num_trades") * share)).alias("buys"), F.rint(F.sum(F.col("num_trades") * (1 - share))).alias("sells"))


def daily_table(minutes: DataFrame, full_day: int = 1200) -> DataFrame:
    """All daily measures; those of days with fewer minutes than ``full_day`` are NULL."""
    parts = [amihud_daily(minutes), kyle_daily(minutes).select("date", "kyle_lambda"), roll_daily(minutes).select("date", "roll_spread_bps"), abdi_ranaldo_daily(minutes), vpin_daily(minutes).select("date", "vpin")]
    out = daily_basics(minutes)
    for part in parts:
        out = out.join(part, "date", "left")
    whole = F.col("minutes") >= full_day
    return out.select(*(F.when(whole, F.col(c)).alias(c) if c in ("amihud", "kyle_lambda", "roll_spread_bps", "abdi_ranaldo_bps", "vpin", "realized_vol", "buy_share") else c for c in out.columns))


def yearly_medians(daily: DataFrame, columns: list[str]) -> DataFrame:
    return daily.groupBy(F.year("date").alias("year")).agg(*(F.median(c).alias(c) for c in columns))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho, n): pairs without NULLs, ranks with ties averaged within each pair."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :])))
    long = df.select(pairs.alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    rank = lambda c: F.rank().over(Window.partitionBy("a", "b").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("a", "b", c)) - 1) / 2
    ranked = long.withColumns({"rx": rank("x"), "ry": rank("y")})
    return ranked.groupBy("a", "b").agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
