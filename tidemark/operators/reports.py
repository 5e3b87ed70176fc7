"""What reports are made of: descriptions, thinned curves, top rows, findings; small results only leave Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import order_by
from tidemark.functions.ranges import numbered


def describe_bars(minutes: DataFrame) -> DataFrame:
    """First and last minute, bars, share of empty minutes, trades, first and last close."""
    span = F.timestamp_diff("MINUTE", F.min("minute"), F.max("minute")) + 1
    return minutes.agg(
        F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"), F.count(F.lit(1)).alias("bars"), (1 - F.try_divide(F.count(F.lit(1)), span)).alias("empty_share"), F.sum("n_trades").alias("trades"),
        F.min_by("close", "minute").alias("first_close"), F.max_by("close", "minute").alias("last_close"),
    )


def thinned(df: DataFrame, time: str, points: int = 2000) -> DataFrame:
    """Every k-th row of a curve, so that about ``points`` stay (for a chart)."""
    told = numbered(df, [time], name="_r").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    return told.where(F.col("_r") % F.greatest(F.floor(F.col("_n") / points), F.lit(1)) == 0).drop("_r", "_n")


def last_rows(df: DataFrame, time: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(time)).limit(n)


def top_terms(table: DataFrame, k: int = 6) -> DataFrame:
    """The terms with the largest absolute t, without the constant."""
    return table.where("term <> 'const'").orderBy(F.abs("t").desc(), "term").limit(k)


def extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    """Where a value is largest and smallest."""
    return df.agg(F.max_by(key, value).alias(f"max_{key}"), F.min_by(key, value).alias(f"min_{key}"))


def rolling_median(x: Column, days: int, time: str, least: int = 10) -> Column:
    """Exact median over the last ``days`` rows (a bounded frame), NULL below ``least`` values."""
    frame = order_by(time).rowsBetween(-(days - 1), 0)
    held = F.array_sort(F.collect_list(x).over(frame))
    n = F.size(held)
    middle = (F.try_element_at(held, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(held, (F.floor(n / 2) + 1).cast("int"))) / 2
    return F.when(n >= least, middle)


def findings(evaluation: DataFrame, strategies: DataFrame, level: float = 0.05) -> list[str]:
    """Sentences for a summary: significant forecasts, the best gross strategy, what is left after costs."""
    out = [f"{r['model']}: out-of-sample R2 {100 * r['r2']:.3g} %, p {r['p_value']:.3g}" for r in evaluation.where(F.col("p_value") < level).orderBy("model").collect()]
    best = strategies.where("cost_bp = 0 AND sharpe IS NOT NULL").orderBy(F.desc("sharpe"), "strategy").limit(1).collect()
    out += [f"best gross Sharpe ratio: {r['strategy']}, {r['sharpe']:.3g}" for r in best]
    left = [r["strategy"] for r in strategies.where("cost_bp > 0 AND mean_bp > 0 AND strategy <> 'buy_hold'").select("strategy").distinct().orderBy("strategy").collect()]
    return [*out, "positive after costs: " + (", ".join(left) or "none")]
