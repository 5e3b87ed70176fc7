"""Registered queries over the generic tables, and the DuckDB SQL that repeats each of them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ranges
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import bars, book, evaluation, feeds, liquidity, mixture, models, regimes, reports
from tidemark.plans import oracles
from tidemark.sources import io, roles

BAR = 15
THREE = ["ret_lag0", "imb_lag0", "log_activity_dev"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and times shown as text, so that engines can be compared."""
    def shown(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "double":
            return F.round(F.when(~F.isnan(c), c), digits) + 0.0
        return c.cast("string") if kind in ("date", "timestamp", "timestamp_ntz") else c.cast("long") if kind in ("int", "smallint", "tinyint") else c

    return df.select(*(shown(c, k).alias(c) for c, k in df.dtypes))


def _minutes(spark: SparkSession, sf: str) -> DataFrame:
    return liquidity.prepare_minutes(roles.minute_klines(spark, sf))


def _daily_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """The daily tape as bars of one day: for measures by month or quarter."""
    t = roles.daily_tape(spark, sf)
    buy = F.when(F.col("is_buyer_maker"), 0.0).otherwise(F.col("quantity"))
    return t.groupBy("date").agg(F.sum("quantity").alias("volume"), F.sum(buy).alias("buy_volume"), F.sum(F.col("quantity") - buy).alias("sell_volume"), F.count(F.lit(1)).alias("num_trades")).withColumn("time", F.col("date").cast("timestamp_ntz"))


def _panel(spark: SparkSession, sf: str, n: int = BAR) -> DataFrame:
    return bars.bar_panel(bars.minute_bars(roles.trades(spark, sf)), n)


def _forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed forecast of the next return: minus a tenth of the last one; the benchmark is 0."""
    p = _panel(spark, sf)
    return p.where("next_ret IS NOT NULL AND ret_bp IS NOT NULL").select("bar", F.col("next_ret").alias("actual"), (-0.1 * F.col("ret_bp")).alias("model"), F.lit(0.0).alias("benchmark"), "imbalance", F.col("ret_bp").alias("last_ret"))


def _held(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.positions(_forecasts(spark, sf))


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    return bars.factor_panel(roles.minute_klines(spark, sf), 60, 8 / 60)


def _fold_table(spark: SparkSession, sf: str) -> DataFrame:
    f = bars.backtest_factors(_panel(spark, sf))
    return f.select("bar", "ret_lag0", "imb_lag0", "log_activity_dev", "next_ret")


def _folds(df: DataFrame, time: str = "bar", skip: int = 10, width: int = 5) -> list[tuple[str, str]]:
    """Folds of ``width`` days, from ``skip`` days after the first row's day to the last row."""
    ends = df.agg(F.date_trunc("day", F.min(time)).alias("a"), F.max(time).alias("b")).first()
    day = lambda k: (ends["a"] + timedelta(days=k)).strftime("%Y-%m-%d %H:%M:%S")
    return [(day(k), day(k + width)) for k in range(skip, (ends["b"] - ends["a"]).days + 1, width)]


def _walk(spark: SparkSession, sf: str, alpha: float) -> DataFrame:
    t = _fold_table(spark, sf)
    return models.walk_forward(t, "bar", "next_ret", lambda: {"model": models.Linear(["ret_lag0"], alpha), "benchmark": models.Zero()}, _folds(t), ["ret_lag0", "imb_lag0"])


def _regime_rows(spark: SparkSession, sf: str) -> DataFrame:
    days = roles.daily_close(spark, sf)
    joined = regimes.features(days).join(regimes.labels(days, 30, 0.4).select("date", "regime"), "date").join(regimes.next_return(days).select("date", "next_ret"), "date")
    return joined


def _two_models(spark: SparkSession, sf: str) -> DataFrame:
    return _forecasts(spark, sf).select("bar", "actual", "benchmark", F.col("model").alias("reversal"), (0.1 * F.col("last_ret")).alias("momentum"))


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.evaluate(_two_models(spark, sf), "bar", ["reversal", "momentum"], "benchmark", 5, False)


def _liquidity_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward M0 to M3 for the next four hours' volatility, with the abnormal part under M2."""
    t = bars.har_factors(bars.factor_panel(roles.minute_klines(spark, sf), 240, 0.05), 240)
    out = models.walk_forward(t, "bar", "target_rv", lambda: models.make_models("rv"), _folds(t), models.columns_used(models.make_models("rv")), 40)
    return models.abnormal(out, "m2")


FEATURES = ["ret_5", "ret_20", "ret_60", "vol_10", "vol_30", "ma_ratio_20", "ma_ratio_60", "drawdown_60", "rsi_14"]
MEDIANS = ["close", "usd_volume", "n_trades", "buy_share", "realized_vol", "kyle_lambda", "roll_spread_bps", "abdi_ranaldo_bps"]


def _boost(spark: SparkSession, sf: str) -> DataFrame:
    t = bars.backtest_factors(_panel(spark, sf))
    columns = ["ret_lag0", "ret_lag1", "imb_lag0", "imb_lag1"]
    return models.walk_forward(t, "bar", "next_ret", lambda: {"forecast": models.Boosting(columns)}, _folds(t), columns)


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.routed(_regime_rows(spark, sf), FEATURES, 0.7, 30)


def _panel_query(fn: Callable[[SparkSession, str], DataFrame], digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: rounded(fn(spark, sf), digits)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "minute_bars_from_trades": lambda s, d: bars.minute_bars(roles.trades(s, d)),
    "bars_nmin_drop_empty": lambda s, d: _panel(s, d).select("bar", "close", "buy_qty", "sell_qty", "n_trades", "usd_volume", "ret_bp", "imbalance", "activity_dev", "next_ret"),
    "bars_nmin_full_grid": lambda s, d: bars.factor_panel(roles.minute_klines(s, d), 5, 2 / 5).select("bar", "minutes_available", "open", "close", "high", "low", "volume", "usd_volume_m", "n_trades", "ret_bp", "path_bp", "rv_bp", "range_bp", "oib", "avg_trade", "amihud", "kyle"),
    "kyle_lambda_daily": lambda s, d: liquidity.kyle_daily(_minutes(s, d)),
    "kyle_lambda_by_hour_hc0": lambda s, d: liquidity.ols_hc0(_minutes(s, d).select(F.hour("time").alias("hour"), "return_bps", "signed_volume"), ["hour"], "return_bps", "signed_volume"),
    "amihud_daily": lambda s, d: liquidity.amihud_daily(_minutes(s, d)),
    "roll_daily": lambda s, d: liquidity.roll_daily(_minutes(s, d)),
    "abdi_ranaldo_daily": lambda s, d: liquidity.abdi_ranaldo_daily(_minutes(s, d)),
    "realized_vol_daily": lambda s, d: liquidity.daily_basics(_minutes(s, d)),
    "yearly_medians": lambda s, d: liquidity.yearly_medians(liquidity.daily_table(_minutes(s, d), 100), MEDIANS),
    "spearman_matrix": lambda s, d: liquidity.spearman(liquidity.daily_table(_minutes(s, d), 100), ["usd_volume", "realized_vol", "kyle_lambda", "amihud", "roll_spread_bps"]),
    "vpin_daily": lambda s, d: liquidity.vpin_daily(_minutes(s, d), 50, 50),
    "trade_count_split": lambda s, d: liquidity.trade_counts(_minutes(s, d)),
    "asof_prevailing_mid": lambda s, d: book.asof_mid(roles.trades(s, d).where("event_type = 'purchase'"), roles.quotes(s, d), (0, 1, 60)),
    "effective_spread_decomposition": lambda s, d: book.spread_summary(book.effective_spreads(roles.trades(s, d).where("event_type = 'purchase'"), roles.quotes(s, d))),
    "quoted_spread_time_weighted": lambda s, d: book.quoted_spreads(roles.quotes(s, d)),
    "ofi_per_update": lambda s, d: book.order_flow(roles.quotes(s, d)).select("update_id", "event_time", "ofi"),
    "ofi_impact_regression": lambda s, d: book.impact_regressions(book.impact_bins(roles.quotes(s, d), roles.trades(s, d).where("event_type = 'purchase'"), 1800)),
    "slippage_curve": lambda s, d: book.slippage_curve(roles.depth(s, d)),
    "har_factors": lambda s, d: bars.har_factors(_hourly(s, d), 60),
    "har_factors_daily": lambda s, d: bars.har_factors(bars.factor_panel(roles.minute_klines(s, d), 1440, 100 / 1440), 1440),
    "backtest_factors": lambda s, d: bars.backtest_factors(_panel(s, d)),
    "regime_features": lambda s, d: regimes.features(roles.daily_close(s, d)),
    "ewm_close": lambda s, d: ranges.ewm_mean(roles.daily_close(s, d), "close", ["date"], 5, "mean").select("date", "mean"),
    "regime_labels": lambda s, d: regimes.labels(roles.daily_close(s, d), 30, 0.4),
    "winsorize": lambda s, d: bars.winsorized(_panel(s, d).select("bar", F.col("ret_bp").alias("x")), "x"),
    "strategy_pnl_cost_grid": lambda s, d: evaluation.strategy_summary(evaluation.pnl(_held(s, d)), BAR),
    "max_drawdown": lambda s, d: evaluation.max_drawdown(_forecasts(s, d), "actual", "bar"),
    "breakeven_fee": lambda s, d: evaluation.breakeven_fee(evaluation.pnl(_held(s, d))),
    "yearly_pivot": lambda s, d: evaluation.yearly_pivot(evaluation.pnl(_held(s, d)), list(range(1, 13)), "month").withColumnsRenamed({str(k): f"p{k}" for k in range(1, 13)}),
    "oos_r2_against_zero": lambda s, d: evaluation.oos_r2(_forecasts(s, d), [F.month("bar").alias("month")], False),
    "trading_stats": lambda s, d: evaluation.trading_stats(_forecasts(s, d).withColumn("actual", F.col("actual") / 1e5), "model", "actual"),
    "top_terms": lambda s, d: reports.top_terms(models.hac_regression(_fold_table(s, d), ["ret_lag0"], "next_ret", "bar", 5).select("term", "coef", "se", "t")),
    "extreme_hours": lambda s, d: reports.extremes(liquidity.ols_hc0(_minutes(s, d).select(F.hour("time").alias("hour"), "return_bps", "signed_volume"), ["hour"], "return_bps", "signed_volume"), "hour", "slope"),
    "last_forecasts": lambda s, d: reports.last_rows(_forecasts(s, d), "bar", 14 * 96).select("bar", "actual", "model"),
    "thinned_curve": lambda s, d: reports.thinned(_forecasts(s, d).select("bar", "actual"), "bar", 100),
    "bars_in_range": lambda s, d: io.clean_range(_panel(s, d), "bar", "2024-01-10", "2024-01-12").select("bar", "close", "n_trades"),
    "common_bars": lambda s, d: feeds.common(_panel(s, d).where("activity_dev > 0"), _forecasts(s, d).where("actual > 0"), "bar"),
    "first_filled_field": lambda s, d: roles.table(s, d, "documents").groupBy(feeds.first_filled(F.col("source"), F.col("lang"), F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n")),
    "confusion_grid": lambda s, d: evaluation.confusion(regimes.labels(roles.daily_close(s, d), 30, 0.4).where("regime IS NOT NULL").withColumn("guess", F.dayofmonth("date") % 3), "regime", "guess"),
    "clark_west": lambda s, d: evaluation.clark_west(_forecasts(s, d), "bar", None),
    "clark_west_hac": lambda s, d: evaluation.clark_west(_forecasts(s, d), "bar", 5),
    "diebold_mariano": lambda s, d: evaluation.diebold_mariano(_forecasts(s, d), "bar", 5),
    "pesaran_timmermann_a": lambda s, d: evaluation.pesaran_timmermann(_forecasts(s, d), False),
    "pesaran_timmermann_b": lambda s, d: evaluation.pesaran_timmermann(_forecasts(s, d), True),
    "newey_west_mean": lambda s, d: evaluation.newey_west(_forecasts(s, d), "actual", "bar", 5).select("n", "mean", F.sqrt("var_mean").alias("se")),
    "oos_r2_yearly": lambda s, d: evaluation.oos_r2(_forecasts(s, d), [F.year("bar").alias("year")]),
    "walk_forward_ols": lambda s, d: _walk(s, d, 0.0),
    "walk_forward_ridge": lambda s, d: _walk(s, d, 10.0),
    "hac_regression": lambda s, d: models.hac_regression(_fold_table(s, d), ["ret_lag0"], "next_ret", "bar", 5).select("term", "coef", "se", "t"),
    "hac_table": lambda s, d: models.hac_regression(_fold_table(s, d), THREE, "next_ret", "bar", 5),
    "evaluate_returns": lambda s, d: evaluation.evaluate_returns(_two_models(s, d), "bar", ["reversal", "momentum"], "benchmark", 5, 1.0, BAR),
    "evaluate_liquidity": lambda s, d: evaluation.evaluate_liquidity(_two_models(s, d), "bar", ["reversal", "momentum"], "benchmark", 5),
    "exact_quantiles_daily": lambda s, d: exact_quantiles(roles.daily_tape(s, d).select(F.year("date").alias("year"), "price"), "price", {"low": 0.01, "median": 0.5, "high": 0.99}, ("year",)),
    "keyword_filter_clean_text": lambda s, d: feeds.news_rows(roles.table(s, d, "documents"), "feed", "doc_id", "text", ("the ", "une")),
    "incremental_antijoin": lambda s, d: feeds.unseen(roles.table(s, d, "documents").select("doc_id", "lang"), roles.table(s, d, "labels"), "doc_id", True),
    "coverage_hard_gaps": lambda s, d: feeds.hard_gaps(feeds.hourly_rows(roles.table(s, d, "events"), "ts", "event_type")),
    "coverage_soft_gaps": lambda s, d: feeds.soft_gaps(feeds.hourly_rows(roles.table(s, d, "events"), "ts", "event_type"), 0.5),
    "coverage_low_cadence": lambda s, d: feeds.low_cadence(feeds.hourly_rows(roles.table(s, d, "events"), "ts", "event_type"), 6.0, 0.5),
    "coverage_report": lambda s, d: feeds.coverage(feeds.hourly_rows(roles.table(s, d, "events"), "ts", "event_type"), 0.5),
    "data_description": lambda s, d: reports.describe_bars(bars.minute_bars(roles.trades(s, d))),
    "rolling_median_30d": lambda s, d: roles.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close")).select("date", reports.rolling_median(F.col("close"), 30, "date").alias("median_close")),
    "evaluate_forecasts": _evaluated,
    "liquidity_forecasts": _liquidity_forecasts,
    "confusion_macro_f1": lambda s, d: evaluation.macro_f1(evaluation.confusion(regimes.labels(roles.daily_close(s, d), 30, 0.4).where("regime IS NOT NULL").withColumn("guess", F.dayofmonth("date") % 3), "regime", "guess")),
    "pin_quarterly": lambda s, d: models.pin_quarterly(_daily_minutes(s, d).select("date", F.rint(F.col("buy_volume") / 25).alias("buys"), F.rint(F.col("sell_volume") / 25).alias("sells"))),
    "placebo_sharpe": lambda s, d: models.placebo(_held(s, d), BAR, 1.0),
    "moe_routing": _routed,
    "moe_metrics": lambda s, d: mixture.routing_metrics(_routed(s, d)),
    "boosting_walk_forward": _boost,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _panel_query(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
