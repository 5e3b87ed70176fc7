"""Bar builders: trades to minute bars, and the two panels with their different gap semantics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.exprs import clip, log_ratio, pos_log, rolling, safe_div
from tidemark.functions.quantiles import exact_quantiles
from tidemark.functions.ranges import ROWS, in_ranges
from tidemark.operators.liquidity import prepare_minutes

DAY = 1440


def step_number(time: str, n: int) -> Column:
    """Which bar of ``n`` minutes since 1970 a time begins; bars on a full grid have consecutive numbers."""
    return F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / (60 * n))


def minute_bars(trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, minute, close, buy_qty, sell_qty, n_trades, usd_volume); the close is the last trade by time and id."""
    maker, q = F.col("is_buyer_maker"), F.col("quantity")
    return trades.groupBy(*by, F.date_trunc("minute", "trade_time").alias("minute")).agg(
        F.max_by("price", F.struct("trade_time", "agg_trade_id")).alias("close"), F.sum(F.when(maker, 0.0).otherwise(q)).alias("buy_qty"), F.sum(F.when(maker, q).otherwise(0.0)).alias("sell_qty"),
        F.count(F.lit(1)).alias("n_trades"), F.sum(F.col("price") * q).alias("usd_volume"),
    )


def bar_panel(minutes: DataFrame, n: int, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """N-minute bars without the empty ones: return in bp only between consecutive bars, imbalance, activity."""
    bars = minutes.groupBy(*by, F.window("minute", f"{n} minutes").start.alias("bar")).agg(
        F.max_by("close", "minute").alias("close"), F.sum("buy_qty").alias("buy_qty"), F.sum("sell_qty").alias("sell_qty"), F.sum("n_trades").alias("n_trades"), F.sum("usd_volume").alias("usd_volume")
    ).where("n_trades > 0")
    day = max(DAY // n, 2)

    def measures(told: DataFrame, w: WindowSpec) -> DataFrame:
        consecutive = F.lag("bar").over(w) == F.col("bar") - F.expr(f"INTERVAL {n} MINUTES")
        told = told.withColumns({
            "ret_bp": F.when(consecutive, log_ratio(F.col("close"), F.lag("close").over(w)) * 1e4),
            "imbalance": safe_div(F.col("buy_qty") - F.col("sell_qty"), F.col("buy_qty") + F.col("sell_qty")),
            "log_activity": pos_log(F.col("usd_volume")),
        })
        told = told.withColumn("activity_dev", F.col("log_activity") - rolling(F.avg("log_activity"), F.col("log_activity"), w, day, day // 2, skip=1))
        return told.withColumn("next_ret", F.lead("ret_bp").over(w))

    return in_ranges(bars, ["bar"], measures, day, 1, by, rows)


def backtest_factors(panel: DataFrame, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Lags over existing rows: returns and imbalances of three bars, the smoothed imbalance, the activity."""

    def lags(told: DataFrame, w: WindowSpec) -> DataFrame:
        shifted = {f"{k}_lag{i}": F.lag(c, i).over(w) if i else F.col(c) for k, c in (("ret", "ret_bp"), ("imb", "imbalance")) for i in range(3)}
        return told.withColumns(shifted | {"imb_smooth": rolling(F.avg("imbalance"), F.col("imbalance"), w, 12), "log_activity_dev": F.col("activity_dev")})

    named = [f"{k}_lag{i}" for k in ("ret", "imb") for i in range(3)]
    return in_ranges(panel, ["bar"], lags, 11, 0, by, rows).select(*by, "bar", *named, "imb_smooth", "log_activity_dev", "next_ret")


def full_grid(bars: DataFrame, time: str, step: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Every bar between the first and the last of its key, missing ones with NULLs."""
    ends = bars.groupBy(*by).agg(F.min(time).alias("a"), F.max(time).alias("b")).where("a IS NOT NULL")
    grid = ends.select(*by, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(time))
    return grid.join(bars, [*by, time], "left")


def factor_panel(klines: DataFrame, n: int, share: float = 50 / 60, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Bars of ``n`` minutes on the full grid, with the measures of the minutes inside them.

    ``path_bp`` is the summed absolute minute return and ``amihud`` that path over a million of volume in
    quote currency; ``kyle`` is the slope of minute returns on signed volume, for 100 units; ``rv_bp`` the
    root of the summed squared minute returns.  All but the count of minutes are NULL in bars with less
    than ``share`` of their minutes (50 of 60).
    """
    bars = prepare_minutes(klines, by).groupBy(*by, F.window("time", f"{n} minutes").start.alias("bar")).agg(
        F.min_by("open", "time").alias("open"),
        F.max_by("close", "time").alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
        F.sum("buy_volume").alias("buy_volume"),
        (F.sum("quote_asset_volume") / 1e6).alias("usd_volume_m"),
        F.sum("num_trades").alias("n_trades"),
        F.coalesce(F.sum(F.abs("return_bps")), F.lit(0.0)).alias("path_bp"),
        F.sqrt(F.coalesce(F.sum(F.col("return_bps") * F.col("return_bps")), F.lit(0.0))).alias("rv_bp"),
        (F.regr_slope("return_bps", "signed_volume") * 100).alias("kyle"),
        F.count(F.lit(1)).alias("minutes_available"),
    )
    returns = lambda told, w: told.withColumn("ret_bp", log_ratio(F.col("close"), F.lag("close").over(w)) * 1e4)
    grid = in_ranges(full_grid(bars, "bar", f"{n} MINUTES", by), ["bar"], returns, 1, 0, by, rows, step_number("bar", n)).withColumns({
        "minutes_available": F.coalesce("minutes_available", F.lit(0)),
        "range_bp": log_ratio(F.col("high"), F.col("low")) * 1e4,
        "oib": safe_div(2 * F.col("buy_volume") - F.col("volume"), F.col("volume")),
        "avg_trade": safe_div(F.col("volume"), F.col("n_trades")),
        "amihud": safe_div(F.col("path_bp"), F.col("usd_volume_m")),
    })
    whole = F.col("minutes_available") >= round(n * share)
    kept = (*by, "bar", "minutes_available")
    return grid.select(*kept, *(F.when(whole, F.col(c)).alias(c) for c in grid.columns if c not in kept))


def hourly_panel(klines: DataFrame) -> DataFrame:
    return factor_panel(klines, 60)


def har_windows(n: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """((day, least), (week, least)) in bars of ``n`` minutes."""
    day, week = max(DAY // n, 5), max(7 * DAY // n, 30)
    return (day, round(day * 18 / 24)), (week, round(week * 120 / 168))


def har_components(column: str, n: int, w: WindowSpec) -> dict[str, Column]:
    (day, day_least), (week, week_least) = har_windows(n)
    x = F.col(column)
    return {f"{column}_last": x, f"{column}_day": rolling(F.avg(x), x, w, day, day_least), f"{column}_week": rolling(F.avg(x), x, w, week, week_least)}


def winsorized(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, by: tuple[str, ...] = ()) -> DataFrame:
    """The column clipped to its own whole-sample quantiles, of each key."""
    ends = exact_quantiles(df, column, {"_low": low, "_high": high}, by)
    own = ends.select(*(F.col(k).alias(f"_k{k}") for k in by), "_low", "_high")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in by), F.lit(True))
    joined = df.join(own if by else F.broadcast(own), same, "left")  # without a key it is one row, or none
    return joined.withColumn(column, clip(F.col(column), F.col("_low"), F.col("_high"))).select(*df.columns)


def har_factors(panel: DataFrame, n: int, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Factor table of the full-grid panel: last, day and week of each measure, seasonals, next-bar targets.

    Seasonals belong to the bar that is forecast.  Bars of a day or more have no hour terms.
    """
    logs = {"log_amihud": "amihud", "log_rv": "rv_bp", "log_volume": "usd_volume_m", "log_size": "avg_trade", "log_range": "range_bp"}
    base = winsorized(panel.withColumns({k: pos_log(F.col(c)) for k, c in logs.items()}), "kyle", by=by)
    (day, day_least), (week, week_least) = har_windows(n)
    made = []

    def factors(told: DataFrame, w: WindowSpec) -> DataFrame:
        recent = lambda agg, c: rolling(agg(c), F.col(c), w, day, day_least)
        long_run = lambda agg, c: rolling(agg(c), F.col(c), w, week, week_least)
        out = {k: v for c in ("log_amihud", "log_rv", "kyle") for k, v in har_components(c, n, w).items()}
        out |= {f"{c}_dev": F.col(c) - long_run(F.avg, c) for c in ("log_amihud", "log_rv", "kyle")}
        out |= {"ret_last": F.col("ret_bp"), "ret_day": recent(F.sum, "ret_bp"), "ret_week": long_run(F.sum, "ret_bp")}
        out |= {"oib_last": F.col("oib"), "oib_day": recent(F.avg, "oib"), "log_range": F.col("log_range")}
        out |= {f"abn_{c}": F.col(c) - long_run(F.avg, c) for c in ("log_volume", "log_size", "log_range")}
        ahead = F.col("bar") + F.expr(f"INTERVAL {n} MINUTES")
        out |= {"weekend": (F.weekday(ahead) >= 5).cast("int")}
        if n < DAY:
            angle = F.hour(ahead) * (2 * math.pi / 24)
            out |= {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "hour_sin2": F.sin(2 * angle), "hour_cos2": F.cos(2 * angle), "hour_of_day": F.hour(ahead)}
        out |= {f"target_{k}": F.lead(c).over(w) for k, c in (("amihud", "log_amihud"), ("kyle", "kyle"), ("rv", "log_rv"), ("return", "ret_bp"))}
        made.extend(out)
        return told.select("*", *(v.alias(f"_o_{k}") for k, v in out.items()))

    told = in_ranges(base, ["bar"], factors, week - 1, 1, by, rows, step_number("bar", n))
    return told.select(*by, "bar", *(F.col(f"_o_{k}").alias(k) for k in made))
