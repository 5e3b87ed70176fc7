"""Forecast tests and strategy accounting.  Statistics are SQL; p-values come from ``functions.special``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import safe_div
from tidemark.functions.ranges import ROWS, in_ranges, running
from tidemark.functions.special import normal_two_sided, normal_upper_tail


def newey_west(df: DataFrame, x: str, time: str, lags: int, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """(by, n, mean, var_mean): variance of the mean with Bartlett weights."""
    some = df.where(F.col(x).isNotNull()).select(*by, time, F.col(x).alias("_x"))
    means = some.groupBy(*by).agg(F.avg("_x").alias("_m"))
    centred = (some.join(means, list(by)) if by else some.crossJoin(F.broadcast(means))).withColumn("_e", F.col("_x") - F.col("_m"))
    lagged = in_ranges(centred, [time], lambda told, w: told.withColumns({f"_l{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)}), lags, 0, by, rows)
    total = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0))
    n = F.count(F.lit(1))
    return lagged.groupBy(*by).agg(n.alias("n"), F.avg("_x").alias("mean"), safe_div(total, n * n).alias("var_mean"))


def newey_west_lags(bars_per_day: float) -> int:
    return int(min(max(round(bars_per_day), 5), 48))


def _statistic(df: DataFrame) -> DataFrame:
    return df.withColumn("se", F.sqrt("var_mean")).withColumn("stat", F.when(F.col("var_mean") > 0, safe_div(F.col("mean"), F.col("se")))).drop("var_mean")


def diebold_mariano(f: DataFrame, time: str, lags: int) -> DataFrame:
    """One-sided: does the model beat the benchmark?  ``f(actual, model, benchmark)``."""
    d = F.pow(F.col("actual") - F.col("benchmark"), 2) - F.pow(F.col("actual") - F.col("model"), 2)
    return _statistic(newey_west(f.withColumn("d", d), "d", time, lags))


def clark_west(f: DataFrame, time: str, lags: int | None) -> DataFrame:
    """With ``lags`` autocorrelation-consistent; without, the plain version with the sample deviation."""
    e0, e1, gap = F.pow(F.col("actual") - F.col("benchmark"), 2), F.pow(F.col("actual") - F.col("model"), 2), F.pow(F.col("benchmark") - F.col("model"), 2)
    told = f.withColumn("d", e0 - (e1 - gap))
    if lags is not None:
        return _statistic(newey_west(told, "d", time, lags))
    return _statistic(told.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), safe_div(F.var_samp("d"), F.count("d")).alias("var_mean")))


def with_p_value(stats: DataFrame, two_sided: bool = False) -> DataFrame:
    return stats.withColumn("p_value", (normal_two_sided if two_sided else normal_upper_tail)(F.col("stat")))


def pesaran_timmermann(f: DataFrame, zeros: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """Direction test; with ``zeros`` returns of 0 stay and the variance has a floor."""
    rows = f.where(F.col("actual").isNotNull() & F.col("model").isNotNull())
    rows = rows if zeros else rows.where(F.col("actual") != 0)
    up, said = (F.col("actual") > 0).cast("double"), (F.col("model") > 0).cast("double")
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((up == said).cast("double")).alias("hit_rate"), F.avg(up).alias("py"), F.avg(said).alias("forecast_up_share"))
    py, px, n = F.col("py"), F.col("forecast_up_share"), F.col("n")
    expected = py * px + (1 - py) * (1 - px)
    v1 = safe_div(expected * (1 - expected), n)
    v2 = safe_div(F.pow(2 * py - 1, 2) * px * (1 - px) + F.pow(2 * px - 1, 2) * py * (1 - py), n) + safe_div(4 * py * px * (1 - py) * (1 - px), n * n)
    var = F.greatest(v1 - v2, F.lit(1e-18)) if zeros else v1 - v2
    told = s.withColumns({"hit_rate_if_independent": expected, "stat": safe_div(F.col("hit_rate") - expected, F.sqrt(F.when(var > 0, var)))})
    return told.select(*by, "n", "hit_rate", *(["hit_rate_if_independent"] if by else []), "forecast_up_share", "stat")


def oos_r2(f: DataFrame, by: list, benchmark: bool = True) -> DataFrame:
    against = F.col("actual") - F.col("benchmark") if benchmark else F.col("actual")
    return f.groupBy(*by).agg((1 - safe_div(F.sum(F.pow(F.col("actual") - F.col("model"), 2)), F.sum(against * against))).alias("r2"), F.count(F.lit(1)).alias("n"))


def positions(f: DataFrame) -> DataFrame:
    """Long format (bar, strategy, pos, ret): forecast sign, follow and fade the imbalance, buy and hold, momentum.

    A bar without a signal or without a next return is no bar of that strategy.
    """
    rules: list[tuple[str, Column]] = [
        ("forecast", F.signum("model")), ("follow_imbalance", F.signum("imbalance")), ("fade_imbalance", -F.signum("imbalance")), ("buy_hold", F.lit(1.0)), ("momentum", F.signum("last_ret")),
    ]
    p = F.explode(F.array(*(F.struct(F.lit(k).alias("strategy"), v.alias("pos")) for k, v in rules)))
    return f.where("actual IS NOT NULL").select("bar", F.col("actual").alias("ret"), p.alias("p")).select("bar", "p.*", "ret").where("pos IS NOT NULL")


def pnl(held: DataFrame, costs: tuple[float, ...] = (0.0, 1.0, 10.0)) -> DataFrame:
    """Adds cost scenario and net bp: the first trade costs its whole position."""
    changed = lambda told, w: told.withColumn("traded", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0))))
    traded = in_ranges(held, ["bar"], changed, 1, 0, ("strategy",))
    return traded.select("*", F.explode(F.array(*(F.lit(c) for c in costs))).alias("cost_bp")).withColumn("pnl", F.col("pos") * F.col("ret") - F.col("cost_bp") * F.col("traded"))


def strategy_summary(net: DataFrame, bar_minutes: int) -> DataFrame:
    run = running(net, "pnl", ["bar"], ("strategy", "cost_bp"))
    sd = F.stddev_samp("pnl")
    return run.groupBy("strategy", "cost_bp").agg(
        F.avg("pnl").alias("mean_bp"), F.when(sd > 0, safe_div(F.avg("pnl"), sd) * (525600 / bar_minutes) ** 0.5).alias("sharpe"), (F.sum("pnl") / 100).alias("total_pct"),
        (F.min(F.col("cum") - F.col("peak")) / 100).alias("max_drawdown_pct"), (F.sum("traded") / F.count(F.lit(1)) * (1440 / bar_minutes)).alias("trades_per_day"), F.count(F.lit(1)).alias("n"),
    )


def breakeven_fee(net: DataFrame) -> DataFrame:
    gross = net.where("cost_bp = 0").groupBy("strategy").agg(F.sum("pnl").alias("gross"), F.sum("traded").alias("traded"))
    return gross.select("strategy", "gross", "traded", F.when(F.col("strategy") != "buy_hold", safe_div(F.col("gross"), F.col("traded"))).alias("breakeven_bp"))


def yearly_pivot(net: DataFrame, years: list[int], unit: str = "year") -> DataFrame:
    part = F.month("bar") if unit == "month" else F.year("bar")
    return net.withColumn("_p", part).groupBy("strategy", "cost_bp").pivot("_p", years).agg(F.avg("pnl"))


def confusion(df: DataFrame, y: str, p: str, classes: int = 3) -> DataFrame:
    """(label, pred, n) on the whole grid."""
    one = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    grid = one.crossJoin(one.withColumnRenamed("label", "pred"))
    counts = df.groupBy(F.col(y).cast("int").alias("label"), F.col(p).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def macro_f1(counts: DataFrame) -> DataFrame:
    t = counts.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("row"), F.lit(0).cast("long").alias("col")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("row"), F.col("n").alias("col")))).alias("e"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("d"))
    per = t.groupBy("e.c").agg(F.sum("e.row").alias("row"), F.sum("e.col").alias("col"), (F.sum("d") / 2).alias("hit"))
    precision, recall = F.col("hit") / F.greatest("col", F.lit(1)), F.col("hit") / F.greatest("row", F.lit(1))
    f1 = F.coalesce(safe_div(2 * precision * recall, precision + recall), F.lit(0.0))
    return per.agg(F.avg(f1).alias("macro_f1"), safe_div(F.sum("hit"), F.sum("row")).alias("accuracy"))


def trading_stats(df: DataFrame, forecast: str, ret: str) -> DataFrame:
    p = F.signum(forecast) * F.col(ret)
    return df.agg(F.avg((F.signum(forecast) == F.signum(ret)).cast("double")).alias("dir_acc"), F.corr(forecast, ret).alias("ic"), (F.avg(p) / (F.stddev_pop(p) + 1e-12) * 365**0.5).alias("sharpe"), (F.exp(F.sum(p)) - 1).alias("total_return"))


def max_drawdown(df: DataFrame, x: str, time: str) -> DataFrame:
    """Of the running sum in bp, from a peak that starts at the first value; in per cent."""
    run = running(df, x, [time])
    return run.agg((F.min(F.col("cum") - F.col("peak")) / 100).alias("max_drawdown_pct"), F.count(F.lit(1)).alias("n"))


def long_forecasts(wide: DataFrame, time: str, models: list[str], benchmark: str) -> DataFrame:
    """(time, actual, benchmark, name, model): a row for each model."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).alias("model")) for m in models)))
    return wide.select(time, "actual", F.col(benchmark).alias("benchmark"), each.alias("p")).select(time, "actual", "benchmark", "p.*")


def _scores(f: DataFrame) -> tuple[DataFrame, Column, Column]:
    e0, e1 = F.pow(F.col("actual") - F.col("benchmark"), 2), F.pow(F.col("actual") - F.col("model"), 2)
    scores = f.groupBy("name").agg((1 - safe_div(F.sum(e1), F.sum(e0))).alias("r2"), F.sqrt(F.avg(e1)).alias("rmse"), F.corr("actual", "model").alias("corr"), F.count(F.lit(1)).alias("n"))
    return scores, e0, e1


def evaluate(wide: DataFrame, time: str, models: list[str], benchmark: str, lags: int, returns: bool) -> DataFrame:
    """Out-of-sample R2, RMSE, correlation and the test against the benchmark, by model.

    Liquidity is tested by Diebold-Mariano, returns by Clark-West; both with Newey-West errors.
    """
    f = long_forecasts(wide, time, models, benchmark)
    scores, e0, e1 = _scores(f)
    d = e0 - (e1 - F.pow(F.col("benchmark") - F.col("model"), 2)) if returns else e0 - e1
    tests = _statistic(newey_west(f.withColumn("d", d), "d", time, lags, ("name",))).select("name", "stat")
    return scores.join(tests, "name")


def sign_strategies(f: DataFrame, time: str, cost_bp: float, bar_minutes: int, rows: int = ROWS) -> DataFrame:
    """(name, gross and net mean in bp, gross and net Sharpe, trades_per_day) of holding the forecast's sign; deviations over all bars."""
    held = f.withColumn("pos", F.signum("model"))
    changed = lambda x, w: x.withColumn("traded", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0))))
    told = in_ranges(held, [time], changed, 1, 0, ("name",), rows)
    gross = F.col("pos") * F.col("actual")
    net = gross - F.col("traded") * cost_bp
    year = (525_600 / bar_minutes) ** 0.5
    sharpe = lambda x: F.when(F.stddev_pop(x) > 0, safe_div(F.avg(x), F.stddev_pop(x)) * year)
    return told.groupBy("name").agg(
        F.avg(gross).alias("gross_mean_bp"), F.avg(net).alias("net_mean_bp"), sharpe(gross).alias("gross_sharpe"), sharpe(net).alias("net_sharpe"),
        (F.sum("traded") / F.count(F.lit(1)) * (1440 / bar_minutes)).alias("trades_per_day"),
    )


def evaluate_returns(wide: DataFrame, time: str, models: list[str], benchmark: str, lags: int, cost_bp: float, bar_minutes: int) -> DataFrame:
    """A row for each model of the next return: fit, Clark-West with its p-value, direction test with its p-value, and what its sign earns."""
    f = long_forecasts(wide, time, models, benchmark)
    scores, e0, e1 = _scores(f)
    cw = _statistic(newey_west(f.withColumn("d", e0 - (e1 - F.pow(F.col("benchmark") - F.col("model"), 2))), "d", time, lags, ("name",)))
    cw = cw.select("name", F.col("stat").alias("clark_west"), normal_upper_tail(F.col("stat")).alias("clark_west_p"))
    pt = pesaran_timmermann(f, False, ("name",)).drop("n")
    pt = pt.withColumn("pesaran_timmermann_p", normal_upper_tail(F.col("stat"))).withColumnRenamed("stat", "pesaran_timmermann")
    return scores.join(cw, "name").join(pt, "name", "left").join(sign_strategies(f, time, cost_bp, bar_minutes), "name")


def evaluate_liquidity(wide: DataFrame, time: str, models: list[str], benchmark: str, lags: int) -> DataFrame:
    """As ``evaluate``, with the p-value of the one-sided Diebold-Mariano test."""
    return with_p_value(evaluate(wide, time, models, benchmark, lags, False))
