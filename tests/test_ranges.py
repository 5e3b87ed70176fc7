"""Ranges with a halo, running sums and exact quantiles against plain pandas; several symbols against each one alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantiles, ranges
from tidemark.functions.exprs import rolling
from tidemark.operators import bars, book, evaluation, models, regimes
from tidemark.sources import roles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(8)
    frames = []
    for key, n in (("a", 300), ("b", 41), (None, 7)):
        day = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 2000, n)), unit="m")
        frames.append(pd.DataFrame({"key": key, "t": day, "x": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n))}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=2)).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("t", F.col("t").cast("timestamp_ntz"))
    return pdf, df.cache()


@pytest.mark.parametrize("rows", [1, 3, 16, 10_000])
def test_rolling_in_ranges(series, rows):
    pdf, df = series

    def compute(told, w):
        return told.withColumns({"mean": rolling(F.avg("x"), F.col("x"), w, 12, 4), "late": F.lag("x", 2).over(w), "early": F.lead("x", 3).over(w)})

    got = ranges.in_ranges(df, ["t"], compute, 11, 3, ("key",), rows)
    assert got.columns == [*df.columns, "mean", "late", "early"]
    got = got.toPandas().sort_values(["key", "t"], na_position="last").reset_index(drop=True)
    by = pdf.groupby("key", dropna=False, sort=False).x
    pdf = pdf.assign(mean=by.transform(lambda x: x.rolling(12, min_periods=4).mean()), late=by.shift(2), early=by.shift(-3))
    for c in ("x", "mean", "late", "early"):
        assert np.allclose(got[c].astype(float), pdf[c], equal_nan=True)


def test_numbers_and_running_sums(series):
    pdf, df = series
    got = ranges.running(ranges.numbered(df, ["t"], ("key",)), "x", ["t"], ("key",)).toPandas().sort_values(["key", "t"], na_position="last")
    by = pdf.fillna({"x": 0}).groupby("key", dropna=False, sort=False).x
    assert got._row.tolist() == by.cumcount().tolist()
    assert np.allclose(got["cum"], by.cumsum())
    assert np.allclose(got["peak"], by.cumsum().groupby(pdf.key, dropna=False, sort=False).cummax())
    with pytest.raises(ValueError):
        ranges.cell_of(df, "key")


def test_exponentially_weighted_mean(series):
    pdf, df = series
    got = ranges.ewm_mean(df, "x", ["t"], 5, "mean", ("key",), 40).toPandas().sort_values(["key", "t"], na_position="last")
    want = pdf.groupby("key", dropna=False, sort=False).x.transform(lambda x: x.ewm(span=5).mean())
    # the definition with absolute places
    assert np.allclose(got["mean"].astype(float), want, equal_nan=True)
    assert got.columns.tolist() == [*df.columns, "mean"]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    wanted = {"q0": 0.0, "q1": 0.01, "q25": 0.25, "q50": 0.5, "q60": 0.6, "q61": 0.601, "q99": 0.99, "q100": 1.0}
    groups = {
        "normal": rng.normal(size=5000), "heavy": rng.standard_cauchy(3000) ** 3, "ties": np.repeat([1.0, 2.0, 3.0], [1000, 1500, 10]), "half": np.concatenate([np.zeros(3000), rng.random(2000)]),
        "one": np.array([4.0]), "two": np.array([4.0, 8.0]), "equal": np.ones(900), "negative": -rng.exponential(size=1201),
    }
    pdf = pd.concat(pd.DataFrame({"g": g, "x": x}) for g, x in groups.items())
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).union(spark.createDataFrame([("one", float("nan")), ("none", None)], "g string, x double")).repartition(5).cache()
    for limit in (100_000, 50, 5):
        got = {r["g"]: r for r in quantiles.exact_quantiles(df, "x", wanted, ("g",), limit).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            assert [got[g][k] for k in wanted] == pytest.approx([np.quantile(x, q) for q in wanted.values()], rel=1e-12)
    whole = quantiles.exact_quantiles(df, "x", wanted, (), 20).first()
    assert [whole[k] for k in wanted] == pytest.approx([np.quantile(pdf.x, q) for q in wanted.values()], rel=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), "x", wanted).count() == 0
    two = quantiles.exact_quantiles_of(df.withColumn("y", 2 * F.col("x")), ["x", "y"], {"m": 0.5}, ("g",)).where("g = 'normal'").first()
    assert two["y_m"] == pytest.approx(2 * two["x_m"])


@pytest.fixture(scope="module")
def tape(spark):
    """Two symbols: the trades and quotes of the small table dealt by user."""
    symbol = F.when(F.col("user_id") % 3 == 0, "eth").otherwise("btc").alias("symbol")
    events = roles.table(spark, SF, "events").select("event_id", "event_type", symbol)
    told = lambda df, key: df.join(events.select(F.col("event_id").alias(key), "symbol"), key).cache()
    return told(roles.trades(spark, SF), "agg_trade_id"), told(roles.quotes(spark, SF), "update_id")


def same(got, alone, symbol):
    got = got.where(F.col("symbol") == symbol).drop("symbol").toPandas()
    alone = alone.toPandas()[list(got.columns)]
    order = [c for c in ("minute", "bar", "agg_trade_id", "update_id", "horizon", "date", "term") if c in got.columns]
    got, alone = (x.sort_values(order).reset_index(drop=True) if order else x for x in (got, alone))
    pd.testing.assert_frame_equal(got, alone, check_dtype=False, rtol=1e-9, atol=1e-9)
    assert len(got)


def test_symbols_keep_apart(spark, tape):
    trades, quotes = tape
    by = ("symbol",)
    minutes = bars.minute_bars(trades, by).cache()
    panel = bars.bar_panel(minutes, 60, by, 50).cache()
    factors = bars.backtest_factors(panel, by, 50).cache()
    klines = trades.groupBy("symbol", F.date_trunc("minute", "trade_time").alias("time")).agg(
        F.first("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.last("price").alias("close"), F.sum("quantity").alias("volume"),
        F.sum("price").alias("quote_asset_volume"), F.count(F.lit(1)).alias("num_trades"), F.lit(1.0).alias("taker_buy_base_volume"),
    ).cache()
    grid = bars.factor_panel(klines, 240, 0.001, by, 20).cache()
    har = bars.har_factors(grid, 240, by, 20)
    hac = models.hac_regression(factors, ["ret_lag0", "imb_lag0"], "next_ret", "bar", 3, by, 17)
    nw = evaluation.newey_west(factors, "next_ret", "bar", 3, by, 17)
    mids = book.asof_mid(trades.withColumn("recv_time", F.col("trade_time")), quotes, (0, 60), by=by)
    flow, gaps = book.order_flow(quotes, by), book.next_times(quotes, by)
    days = minutes.groupBy("symbol", F.to_date("minute").alias("date")).agg(F.avg("close").alias("close")).cache()
    marks, feats = regimes.labels(days, 3, 0.4, 5, by, 7), regimes.features(days, by, 64)
    for s in ("eth", "btc"):
        own = lambda df, s=s: df.where(F.col("symbol") == s).drop("symbol")
        same(minutes, bars.minute_bars(own(trades)), s)
        same(panel, bars.bar_panel(own(minutes), 60), s)
        same(factors, bars.backtest_factors(own(panel)), s)
        same(grid, bars.factor_panel(own(klines), 240, 0.001), s)
        same(har, bars.har_factors(own(grid), 240), s)
        same(hac, models.hac_regression(own(factors), ["ret_lag0", "imb_lag0"], "next_ret", "bar", 3), s)
        same(nw, evaluation.newey_west(own(factors), "next_ret", "bar", 3), s)
        same(mids, book.asof_mid(own(trades), own(quotes), (0, 60)), s)
        same(flow, book.order_flow(own(quotes)), s)
        same(gaps, book.next_times(own(quotes)), s)
        same(marks, regimes.labels(own(days), 3, 0.4, 5), s)
        same(feats, regimes.features(own(days)), s)


def test_no_stage_of_a_single_task(spark, tape):
    trades, quotes = tape
    by = ("symbol",)
    panel = bars.bar_panel(bars.minute_bars(trades, by), 60, by)
    for df in (panel, bars.backtest_factors(panel, by), book.order_flow(quotes, by)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_hac_table_against_numpy(spark):
    rng = np.random.default_rng(3)
    n, lags = 400, 4
    x = rng.normal(size=(n, 3))
    y = 1 + x @ [0.5, -0.2, 0.0] + np.convolve(rng.normal(size=n + 3), [1, 0.5, 0.3, 0.1])[3 : n + 3]
    df = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], "t long, a double, b double, c double, y double")
    z = np.column_stack([np.ones(n), (x - x.mean(0)) / x.std(0, ddof=1)])
    inverse = np.linalg.inv(z.T @ z)
    beta = inverse @ z.T @ y
    u = z * (y - z @ beta)[:, None]
    meat = u.T @ u
    for h in range(1, lags + 1):
        meat += (1 - h / (lags + 1)) * (u[h:].T @ u[:-h] + u[:-h].T @ u[h:])
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    for rows in (ranges.ROWS, 9):
        got = models.hac_regression(df, ["a", "b", "c"], "y", "t", lags, rows=rows).toPandas()
        assert got.term.tolist() == ["const", "a", "b", "c"]
        assert np.allclose(got.coef, beta) and np.allclose(got.se, se) and np.allclose(got.t, beta / se)
        assert np.allclose(got.r2, 1 - np.var(y - z @ beta) / np.var(y)) and (got.n == n).all()
        assert ((got.p_value < 0.05) == (got.t.abs() > 1.96)).all()


def test_return_evaluation(spark):
    rng = np.random.default_rng(5)
    actual = rng.normal(size=300)
    good, bad = actual * 0.3 + rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([(k, float(a), 0.0, float(g), float(b)) for k, (a, g, b) in enumerate(zip(actual, good, bad, strict=True))], "t long, actual double, m0 double, good double, bad double")
    got = {r["name"]: r for r in evaluation.evaluate_returns(df, "t", ["good", "bad"], "m0", 5, 1.0, 60).collect()}
    assert got["good"]["clark_west_p"] < 0.01 < got["bad"]["clark_west_p"]
    assert got["good"]["pesaran_timmermann_p"] < 0.05
    pos = np.sign(good)
    net = pos * actual - np.abs(np.diff(pos, prepend=0))
    assert got["good"]["net_mean_bp"] == pytest.approx(net.mean())
    assert got["good"]["net_sharpe"] == pytest.approx(net.mean() / net.std() * 8760**0.5)
    assert got["good"]["trades_per_day"] == pytest.approx(np.abs(np.diff(pos, prepend=0)).mean() * 24)
