"""Hand-checked micro fixtures, computed from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import order_by, rolling
from tidemark.operators import bars, book, evaluation, feeds, liquidity, models


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_order_flow(spark):
    rows = [(f"2024-01-01 00:{m:02d}:00", i, b, qb, a, qa) for i, (m, b, qb, a, qa) in enumerate([(0, 100.0, 2.0, 101.0, 3.0), (59, 100.0, 5.0, 101.0, 1.0), (59, 101.0, 1.0, 102.0, 4.0), (59, 99.0, 2.0, 100.0, 2.0)])]
    df = spark.createDataFrame(rows, "t string, update_id long, bid double, bid_qty double, ask double, ask_qty double").withColumn("event_time", F.col("t").cast("timestamp_ntz"))
    assert values(book.order_flow(df).orderBy("update_id"), "ofi") == [(None,), (5.0,), (2.0,), (-3.0,)]
    # the state crosses hours
    later = df.withColumn("event_time", F.col("event_time") + F.expr("make_dt_interval(0, 0, 0, update_id * 7200)"))
    assert values(book.order_flow(later).orderBy("update_id"), "ofi") == [(None,), (5.0,), (2.0,), (-3.0,)]


def test_asof_is_strict_after_the_lag(spark):
    q = spark.createDataFrame([(0.0, 100.0, 1), (0.95, 101.0, 2), (1.0, 102.0, 3)], "s double, mid double, update_id long").withColumn("event_time", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)"))
    t = spark.createDataFrame([(7,)], "agg_trade_id long").withColumn("recv_time", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:01'"))
    assert sorted(values(book.asof_mid(t, q, (0, 1)), "horizon", "mid")) == [(0, 100.0), (1, 102.0)]


def test_slippage(spark):
    rows = [(1, [(99.0, 1.0), (98.0, 1.0)], [(100.0, 1.0), (101.0, 2.0)])]
    df = spark.createDataFrame(rows, "snapshot long, bids array<struct<px:double,qty:double>>, asks array<struct<px:double,qty:double>>")
    got = {(r["side"], r["size"]): (r["bps"], r["thin"]) for r in book.slippage(df, (2.0, 2.5)).collect()}
    assert got[("buy", 2.0)][0] == pytest.approx(100.50251256) and got[("sell", 2.0)][0] == pytest.approx(100.50251256)
    assert got[("sell", 2.5)] == (None, True) and got[("sell", 2.0)][1] is False


def test_robust_regression(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 3.0), (1, 3.0, 2.0), (1, 4.0, 6.0), (2, 1.0, 1.0), (2, 1.0, 2.0)], "g int, x double, y double")
    got = {r["g"]: r for r in liquidity.ols_hc0(df, ["g"], "y", "x").collect()}
    assert [got[1][k] for k in ("slope", "intercept", "t", "r2")] == pytest.approx([1.4, -0.5, 4.26797533, 0.7])
    assert got[2]["t"] is None


def test_roll(spark):
    df = spark.createDataFrame([("d", i, x * 1e4) for i, x in enumerate((0.01, -0.01, 0.01, -0.01))], "date string, time int, return_bps double")
    r = liquidity.roll_daily(df).first()
    assert r["cov"] == pytest.approx(-1.33333e-4, rel=1e-4) and r["roll_spread_bps"] == pytest.approx(230.94, rel=1e-4)


def test_vpin(spark):
    df = spark.createDataFrame([(f"2024-01-01 00:0{i}:00", 4.0, b, 4.0 - b) for i, b in enumerate((4.0, 0.0, 2.0, 4.0))], "t string, volume double, buy_volume double, sell_volume double").selectExpr("cast(t as timestamp_ntz) as time", "to_date(t) as date", "volume", "buy_volume", "sell_volume")
    r = liquidity.vpin_daily(df, 2, 2).first()
    assert r["buckets"] == 3 and r["vpin"] == pytest.approx(0.75)


def test_pnl_and_drawdown(spark):
    df = spark.createDataFrame([(i, "s", float(p), float(r)) for i, (p, r) in enumerate(zip((1, 1, -1, 0, 1), (10, -5, -20, 3, 4), strict=True))], "bar int, strategy string, pos double, ret double")
    net = evaluation.pnl(df, (1.0,))
    assert [r[0] for r in values(net.orderBy("bar"), "pnl")] == [9, -5, 18, -1, 3]
    assert evaluation.max_drawdown(net, "pnl", "bar").first()["max_drawdown_pct"] == pytest.approx(-0.05)
    assert evaluation.strategy_summary(net, 60).first()["max_drawdown_pct"] == pytest.approx(-0.05)


def test_newey_west(spark):
    df = spark.createDataFrame(list(enumerate((1.0, 2.0, 0.5, 1.5))), "t int, x double")
    assert evaluation.newey_west(df, "x", "t", 1).first()["var_mean"] == pytest.approx(0.01953125)
    assert [evaluation.newey_west_lags(b) for b in (24, 1440, 1)] == [24, 48, 5]


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (2, 1)], "y int, p int")
    assert evaluation.macro_f1(evaluation.confusion(df, "y", "p")).first()["macro_f1"] == pytest.approx(0.5)


def test_upper_median_and_gaps(spark):
    df = spark.createDataFrame([("s", f"2024-01-01 0{h}:00:00", n) for h, n in ((0, 1), (1, 2), (3, 3), (5, 10))], "stream string, h string, n long").withColumn("hour", F.col("h").cast("timestamp_ntz")).drop("h")
    soft = feeds.soft_gaps(df, 0.5).collect()
    assert {r["median_n"] for r in soft} == {3} and [r["n"] for r in soft] == [1]
    assert sorted(str(r[0])[11:13] for r in values(feeds.hard_gaps(df), "hour")) == ["02", "04"]


def test_rolling_guards(spark):
    df = spark.createDataFrame(list(enumerate((1.0, None, 3.0, 4.0, 5.0))), "t int, x double")
    w = order_by("t")
    full, two = rolling(F.avg("x"), F.col("x"), w, 3), rolling(F.avg("x"), F.col("x"), w, 3, 2)
    assert [r[1] for r in df.select("t", full).orderBy("t").collect()] == [None, None, None, None, 4.0]
    assert [r[1] for r in df.select("t", two).orderBy("t").collect()] == [None, None, 2.0, 3.5, 4.0]


def test_spearman_ranks_after_dropping(spark):
    df = spark.createDataFrame(list(zip((1.0, 2.0, 3.0, 4.0, 5.0), (5.0, None, 1.0, 2.0, 9.0), strict=True)), "a double, b double")
    assert liquidity.spearman(df, ["a", "b"]).first()["rho"] == pytest.approx(0.4)


def test_har_windows():
    assert bars.har_windows(60) == ((24, 18), (168, 120))
    assert bars.har_windows(1440) == ((5, 4), (30, 21))
    assert bars.har_windows(5) == ((288, 216), (2016, 1440))


def test_linear_models(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = 2 + x @ np.array([1.5, -0.7]) + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    clipped = np.column_stack([np.clip(c, *np.quantile(c, models.CLIP)) for c in x.T])
    z = (clipped - clipped.mean(0)) / clipped.std(0, ddof=1)
    for alpha in (0.0, 10.0):
        want = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
        assert models.Linear(["a", "b"], alpha).fit(df, "y").coef == pytest.approx(want)
    got = models.hac_regression(df.withColumn("t", F.monotonically_increasing_id()), ["a", "b"], "y", "t", 3).collect()
    assert [r["term"] for r in got] == ["const", "a", "b"] and all(r["se"] > 0 for r in got)


def test_pin_recovers_parameters():
    import numpy as np

    rng = np.random.default_rng(7)
    news = rng.random(250) < 0.4
    bad = rng.random(250) < 0.5
    buys, sells = rng.poisson(100 + 80 * (news & ~bad)), rng.poisson(100 + 80 * (news & bad))
    got = models.estimate_pin(buys.astype(float), sells.astype(float))
    assert got["alpha"] == pytest.approx(0.4, abs=0.1) and got["pin"] == pytest.approx(0.4 * 80 / (0.4 * 80 + 200), abs=0.03)


def test_placebo_floor(spark):
    df = spark.createDataFrame([("s", i, float(1 if i % 2 else -1), float(1 if i % 2 else -1) + i / 1e4) for i in range(60)], "strategy string, bar int, pos double, ret double")
    assert models.placebo(df, 15).first()["p_value"] == pytest.approx(1 / 2001)
    flat = spark.createDataFrame([("f", i, 0.0, 1.0) for i in range(5)], df.schema)
    assert tuple(models.placebo(flat, 15).first()) == ("f", None, None, 5)


def test_placebo_against_every_order(spark):
    """The p-value comes near the share of all orders of the positions, costs paid."""
    from itertools import permutations

    import numpy as np

    pos, ret, cost = [1.0, -1.0, 0.0, 1.0, -1.0, 1.0], [3.0, -2.0, 1.0, -1.0, 2.0, 0.5], 0.4

    def ratio(p):
        net = np.array(p) * ret - cost * np.abs(np.diff(p, prepend=0.0))
        return net.mean() / net.std(ddof=1) * (525600 / 15) ** 0.5

    every = [ratio(p) for p in permutations(pos)]
    df = spark.createDataFrame([("s", i, p, r) for i, (p, r) in enumerate(zip(pos, ret, strict=True))], "strategy string, bar int, pos double, ret double")
    got = models.placebo(df, 15, cost, draws=4000).first()
    assert got["sharpe"] == pytest.approx(ratio(pos)) and got["n"] == 6
    assert got["p_value"] == pytest.approx(np.mean(np.array(every) >= ratio(pos) - 1e-12), abs=0.03)


def test_mixture_beats_chance(spark):
    """Mean accuracy of the router over four invented series: above 0.42, where chance is a third."""
    from tidemark.plans import regime_run

    shares = []
    for seed in range(4):
        routing, metrics = regime_run.run(spark, regime_run.settings(seed=seed))
        m = metrics.first()
        shares.append(m["accuracy"])
        assert m["n_test"] > 800 and m["share_bear"] + m["share_sideways"] + m["share_bull"] == pytest.approx(1)
        assert -1 <= m["moe_ic"] <= 1 and -1 <= m["single_ic"] <= 1
    assert sum(shares) / 4 > 0.42


@pytest.mark.parametrize("hidden,top_k", [(0, 0), (4, 2)])
def test_gates(spark, hidden, top_k):
    import numpy as np

    from tidemark.operators import mixture

    rng = np.random.default_rng(0)
    y = rng.choice(3, 600, p=[0.7, 0.2, 0.1])
    x = rng.normal(size=(600, 2)) + 2.5 * np.array([[0, 0], [1, 0], [0, 1]])[y]
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y, strict=True)], "a double, b double, regime int")
    got = mixture.Gate(hidden=hidden, top_k=top_k, seed=3).fit(df, ["a", "b"], "regime").attach(df).collect()
    g = np.array([r["gate"] for r in got])
    assert np.allclose(g.sum(axis=1), 1) and ((g > 0).sum(axis=1) <= (top_k or 3)).all()
    hits = [(g.argmax(axis=1) == [r["regime"] for r in got])[[r["regime"] == k for r in got]].mean() for k in range(3)]
    assert min(hits) > 0.6  # the rarest class is found as well


def test_experts_against_the_normal_equations(spark):
    import numpy as np

    from tidemark.operators import mixture

    rng = np.random.default_rng(2)
    k = rng.choice(3, 200, p=[0.5, 0.45, 0.05])
    x = rng.normal(size=(200, 2))
    y = (x * np.array([[1, 0], [0, 1], [2, 2]])[k]).sum(axis=1)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(r)) for (a, b), c, r in zip(x, y, k, strict=True)], "a double, b double, y double, regime int")
    own, single = mixture.experts(df, ["a", "b"], "regime", "y", alpha=10.0, least=30)
    got = np.array([list(r) for r in df.select(*own, single).collect()])
    z = np.column_stack([np.ones(200), (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)])

    def ridge(w):
        return z @ np.linalg.solve((z.T * w) @ z + np.diag([0, 10.0, 10.0]), (z.T * w) @ y)

    want = [ridge(np.where(k == c, 1, 0.05)) for c in (0, 1)] + [ridge(np.ones(200))] * 2  # the third regime has too few rows
    assert np.allclose(got, np.array(want).T)


def test_robust_errors_against_the_sum_over_lags(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    n, lags = 80, 5
    x = rng.normal(size=(n, 2)).cumsum(axis=0) * 0.3
    y = 1 + x @ np.array([0.5, -1.0]) + rng.normal(size=n).cumsum() * 0.2
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "t int, a double, b double, y double")
    z = np.column_stack([np.ones(n), (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)])
    inverse = np.linalg.inv(z.T @ z)
    coef = inverse @ z.T @ y
    u = z * (y - z @ coef)[:, None]
    meat = u.T @ u
    for h in range(1, lags + 1):
        part = u[h:].T @ u[:-h]
        meat += (1 - h / (lags + 1)) * (part + part.T)
    got = models.hac_regression(df, ["a", "b"], "y", "t", lags).collect()
    assert [r["coef"] for r in got] == pytest.approx(coef)
    assert [r["se"] for r in got] == pytest.approx(np.sqrt(np.diag(inverse @ meat @ inverse)))


def test_boosting_stops_early_and_learns(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 2))
    y = np.where(x[:, 0] > 0, 3.0, -1.0) + 0.1 * rng.normal(size=1500)
    df = spark.createDataFrame([(float(a), float(b), float(c), 10.0) for (a, b), c in zip(x, y + 10, strict=True)], "a double, b double, y double, base double")
    model = models.Boosting(["a", "b"], "base", rounds=60, step=0.3, least=20).fit(df, "y")
    assert len(model.model.trees) < 60
    got = np.array([(r["y"], r["f"]) for r in model.attach(df, "f").collect()])
    assert np.corrcoef(got.T)[0, 1] > 0.98 and abs((got[:, 0] - got[:, 1]).mean()) < 0.1


def test_no_signal_is_no_position(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0, None, 2.0), (2, None, 1.0, 1.0, 2.0), (3, 1.0, 0.0, 0.0, None)], "bar int, actual double, model double, imbalance double, last_ret double")
    got = {(r["strategy"], r["bar"]): r["pos"] for r in evaluation.positions(df).collect()}
    assert got == {("forecast", 1): 1, ("forecast", 3): 0, ("follow_imbalance", 3): 0, ("fade_imbalance", 3): 0, ("buy_hold", 1): 1, ("buy_hold", 3): 1, ("momentum", 1): 1}


def klines(spark, rows):
    """(minute, open, high, low, close, volume, buys, trades) as kline columns."""
    df = spark.createDataFrame(rows, "k int, open double, high double, low double, close double, volume double, taker_buy_base_volume double, num_trades long")
    return df.withColumns({"time": F.expr("TIMESTAMP_NTZ'2024-01-01 23:58:00' + make_dt_interval(0, 0, k, 0)"), "quote_asset_volume": F.col("close") * F.col("volume")})


def test_panel_measures(spark):
    """Path length over volume, slope for 100 units, root of the squared returns, across midnight."""
    closes = [100.0, 101.0, 100.0, 102.0, 101.0, 103.0]
    rows = [(i, c, c + 1, c - 1, c, 2.0 + i, 1.0 + i % 3, 2) for i, c in enumerate(closes)]
    got = bars.factor_panel(klines(spark, rows), 2, 0.5).orderBy("bar").collect()
    r = [math.log(b / a) * 1e4 for a, b in zip(closes, closes[1:], strict=False)]
    usd = 100 * 4 + 102 * 5
    assert got[1]["path_bp"] == pytest.approx(abs(r[1]) + abs(r[2])) and got[1]["rv_bp"] == pytest.approx(math.hypot(r[1], r[2]))
    assert got[1]["amihud"] == pytest.approx((abs(r[1]) + abs(r[2])) / (usd / 1e6))
    signed = [2 * (1 + i % 3) - (2 + i) for i in range(6)]
    assert got[1]["kyle"] == pytest.approx(100 * (r[2] - r[1]) / (signed[3] - signed[2]))
    assert got[1]["range_bp"] == pytest.approx(math.log(103 / 99) * 1e4) and got[1]["avg_trade"] == pytest.approx(9 / 4)
    assert got[0]["path_bp"] == pytest.approx(abs(r[0])) and got[0]["ret_bp"] is None


def test_prices_of_zero(spark):
    """A price of 0 has no return before or after it and breaks no measure."""
    rows = [(i, c, c, c, c, v, v / 2, 1) for i, (c, v) in enumerate([(100.0, 1.0), (0.0, 1.0), (101.0, 0.0), (102.0, 2.0)])]
    minutes = liquidity.prepare_minutes(klines(spark, rows))
    assert [r["return_bps"] is None for r in minutes.orderBy("time").collect()] == [True, True, True, False]
    for fn in (liquidity.kyle_daily, liquidity.amihud_daily, liquidity.roll_daily, liquidity.abdi_ranaldo_daily, liquidity.daily_basics, liquidity.vpin_daily, liquidity.trade_counts):
        assert fn(minutes).count() >= 1
    assert bars.har_factors(bars.factor_panel(klines(spark, rows), 1, 1.0), 1).count() == 4
    zero = spark.createDataFrame([(1, [(0.0, 1.0)], [(0.0, 1.0)])], "snapshot long, bids array<struct<px:double,qty:double>>, asks array<struct<px:double,qty:double>>")
    assert all(r["bps"] is None for r in book.slippage(zero, (1.0,)).collect())


def test_tails(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "stat double")
    got = [r["p_value"] for r in evaluation.with_p_value(df).collect()]
    assert got[0] == pytest.approx(0.158655, abs=1e-6) and (got[1] is None or math.isnan(got[1]))


def test_text_rules(spark):
    df = spark.createDataFrame([(1, " a\nb BTC "), (2, None), (2, "xbitcoiny")], "id int, t string")
    assert values(df.select(feeds.clean_text(F.col("t"))), "*")[0] == ("a b BTC",)
    assert [r[0] for r in df.select(feeds.mentions(F.lit(None), F.col("t"))).collect()] == [True, False, True]
    seen = spark.createDataFrame([(1,)], "id int")
    assert feeds.unseen(df, seen, "id", False).count() == 2 and feeds.unseen(df, seen, "id", True).count() == 1


@pytest.mark.parametrize("table", ["backtest", "regime"])
def test_factors_are_causal(spark, table):
    """Prices after a row do not change what stands before it."""
    from tidemark.operators import regimes

    n = 140
    df = spark.range(n).select(F.col("id").alias("k"), (100 + 3 * F.sin(F.col("id") * 1.7) + F.col("id") / 10).alias("close"))
    bent = df.withColumn("close", F.when(F.col("k") > 100, F.col("close") * 5).otherwise(F.col("close")))

    def build(x):
        if table == "regime":
            days = x.withColumn("date", F.expr("date_add(DATE'2020-01-01', cast(k as int))"))
            return [tuple(r) for r in regimes.features(days).orderBy("date").limit(101).collect()]
        minutes = x.select((F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(k as int) * 15, 0)")).alias("minute"), "close", F.lit(2.0).alias("buy_qty"), (1 + F.col("k") % 3).cast("double").alias("sell_qty"), F.lit(3).alias("n_trades"), F.lit(500.0).alias("usd_volume"))
        return [tuple(r)[:-1] for r in bars.backtest_factors(bars.bar_panel(minutes, 15)).orderBy("bar").limit(101).collect()]

    assert build(df) == build(bent)
