"""Daily regime features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.exprs import log_ratio, rolling, safe_div
from tidemark.functions.ranges import ROWS, in_ranges


def features(days: DataFrame, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Thirteen causal features of ``days(by, date, close[, sentiment])``."""
    if "sentiment" not in days.columns:
        days = days.withColumn("sentiment", F.lit(0.0))

    def made(told: DataFrame, w: WindowSpec) -> DataFrame:
        c, s = F.col("close"), F.col("sentiment")
        base = told.withColumns({"r": log_ratio(c, F.lag(c).over(w)), "step": c - F.lag(c).over(w)})
        base = base.withColumns({"up": F.when(F.col("step").isNotNull(), F.greatest("step", F.lit(0.0))), "down": F.when(F.col("step").isNotNull(), -F.least("step", F.lit(0.0)))})
        mean = lambda x, n: rolling(F.avg(x), F.col(x), w, n)
        dev = lambda x, n: rolling(F.stddev_samp(x), F.col(x), w, n)
        rs = mean("up", 14) / (mean("down", 14) + 1e-12)
        return base.withColumns(
            {f"ret_{k}": log_ratio(c, F.lag(c, k).over(w)) for k in (5, 20, 60)}
            | {f"vol_{n}": dev("r", n) for n in (10, 30)}
            | {f"ma_ratio_{n}": safe_div(c, mean("close", n)) - 1 for n in (20, 60)}
            | {"drawdown_60": safe_div(c, rolling(F.max("close"), c, w, 60)) - 1, "rsi_14": (1 - 1 / (1 + rs)) - 0.5, "sent": s}
            | {"sent_ma_10": mean("sentiment", 10), "sent_chg_5": s - F.lag(s, 5).over(w), "sent_z_60": (s - mean("sentiment", 60)) / (dev("sentiment", 60) + 1e-9)}
        )

    names = ["ret_5", "ret_20", "ret_60", "vol_10", "vol_30", "ma_ratio_20", "ma_ratio_60", "drawdown_60", "rsi_14", "sent", "sent_ma_10", "sent_chg_5", "sent_z_60"]
    return in_ranges(days, ["date"], made, 61, 0, by, rows).select(*by, "date", "close", *names)


def next_return(days: DataFrame, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    ahead = lambda told, w: told.withColumn("next_ret", log_ratio(F.lead("close").over(w), F.col("close")))
    return in_ranges(days, ["date"], ahead, 0, 1, by, rows)


def labels(days: DataFrame, horizon: int = 20, k: float = 0.5, vol_window: int = 30, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """(by, date, z, regime): 2 above ``k``, 0 below ``-k``, else 1; NULL where z is."""

    def scored(told: DataFrame, w: WindowSpec) -> DataFrame:
        base = told.withColumn("r", log_ratio(F.col("close"), F.lag("close").over(w)))
        sd = rolling(F.stddev_samp("r"), F.col("r"), w, vol_window)
        return base.withColumn("z", safe_div(log_ratio(F.lead("close", horizon).over(w), F.col("close")), sd * horizon**0.5))

    told = in_ranges(days, ["date"], scored, vol_window, horizon, by, rows)
    return told.select(*by, "date", "z", F.when(F.col("z") > k, 2).when(F.col("z") < -k, 0).when(F.col("z").isNotNull(), 1).alias("regime"))
