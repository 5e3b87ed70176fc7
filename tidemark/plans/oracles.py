"""DuckDB SQL for the registered queries, written from the formulas."""


def lnr(a: str, b: str) -> str:
    """ln(a / b), NULL where one is not above 0."""
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln(({a}) / nullif({b}, 0)) END"


def lnp(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln(nullif(greatest({x}, 0), 0)) END"



TRADES = """trades AS (SELECT ts AS trade_time, value AS price, 1.0 + user_id % 10 AS quantity, event_id % 2 = 1 AS maker, event_id, event_type FROM events)"""
KLINES = f"""{TRADES}, klines AS (SELECT date_trunc('minute', trade_time) AS time, arg_min(price, (trade_time, event_id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, (trade_time, event_id)) AS close, sum(quantity) AS volume, sum(price * quantity) AS usd, count(*) AS num_trades, sum(CASE WHEN maker THEN 0.0 ELSE quantity END) AS buy FROM trades GROUP BY 1),
 minutes AS (SELECT *, volume - buy AS sell, 2 * buy - volume AS signed, CAST(time AS DATE) AS date, CASE WHEN lag(time) OVER w = time - INTERVAL 1 MINUTE THEN {lnr("close", "lag(close) OVER w")} * 1e4 END AS ret FROM klines WINDOW w AS (ORDER BY time))"""


def panel(n: int = 15) -> str:
    day = max(1440 // n, 2)
    return f"""{TRADES}, mb AS (SELECT date_trunc('minute', trade_time) AS minute, arg_max(price, (trade_time, event_id)) AS close, sum(CASE WHEN maker THEN 0.0 ELSE quantity END) AS buy_qty,
 sum(CASE WHEN maker THEN quantity ELSE 0.0 END) AS sell_qty, count(*) AS n_trades, sum(price * quantity) AS usd_volume FROM trades GROUP BY 1),
 pb AS (SELECT time_bucket(INTERVAL {n} MINUTE, minute, TIMESTAMP '1970-01-01') AS bar, arg_max(close, minute) AS close, sum(buy_qty) AS buy_qty, sum(sell_qty) AS sell_qty, CAST(sum(n_trades) AS BIGINT) AS n_trades, sum(usd_volume) AS usd_volume FROM mb GROUP BY 1),
 p1 AS (SELECT *, CASE WHEN lag(bar) OVER w = bar - INTERVAL {n} MINUTE THEN {lnr("close", "lag(close) OVER w")} * 1e4 END AS ret_bp, (buy_qty - sell_qty) / nullif(buy_qty + sell_qty, 0) AS imbalance, {lnp("usd_volume")} AS la FROM pb WINDOW w AS (ORDER BY bar)),
 panel AS (SELECT *, la - CASE WHEN count(la) OVER f >= {day // 2} THEN avg(la) OVER f END AS activity_dev, lead(ret_bp) OVER w AS next_ret FROM p1 WINDOW w AS (ORDER BY bar), f AS (ORDER BY bar ROWS BETWEEN {day} PRECEDING AND 1 PRECEDING))"""


QUOTES = """quotes AS (SELECT ts AS event_time, value AS bid, value + 0.01 * (1 + event_id % 5) AS ask, 1.0 + user_id % 7 AS bid_qty, 1.0 + event_id % 9 AS ask_qty, event_id AS update_id FROM events WHERE event_type = 'view'),
 q AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread FROM quotes)"""
BUYS = "buys AS (SELECT * FROM trades WHERE event_type = 'purchase')"
FORECASTS = f"""{panel()}, fc AS (SELECT bar, next_ret AS actual, -0.1 * ret_bp AS model, 0.0 AS benchmark, imbalance, ret_bp AS last_ret FROM panel WHERE next_ret IS NOT NULL AND ret_bp IS NOT NULL)"""
HELD = f"""{FORECASTS}, held AS (SELECT bar, 'forecast' AS strategy, CAST(sign(model) AS DOUBLE) AS pos, actual AS ret FROM fc UNION ALL SELECT bar, 'follow_imbalance', sign(imbalance), actual FROM fc WHERE imbalance IS NOT NULL UNION ALL SELECT bar, 'fade_imbalance', -sign(imbalance), actual FROM fc WHERE imbalance IS NOT NULL
 UNION ALL SELECT bar, 'buy_hold', 1, actual FROM fc UNION ALL SELECT bar, 'momentum', sign(last_ret), actual FROM fc),
 tr AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY strategy ORDER BY bar), 0)) AS traded FROM held), net AS (SELECT *, pos * ret - cost_bp * traded AS pnl FROM tr, (VALUES (0.0::DOUBLE), (1.0), (10.0)) c(cost_bp))"""
DAYS = "days AS (SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS close FROM orders GROUP BY 1)"
BASICS = f"""{KLINES}, basics AS (SELECT date, arg_max(close, time) AS close, sum(volume) AS volume, sum(usd) AS usd_volume, CAST(sum(num_trades) AS BIGINT) AS n_trades, sum(buy) / nullif(sum(volume), 0) AS buy_share, sqrt(365 * coalesce(sum((ret / 1e4) * (ret / 1e4)), 0)) AS realized_vol, count(*) AS minutes FROM minutes GROUP BY 1),
 kyle AS (SELECT date, regr_slope(ret, signed) * 100 AS kyle_lambda, regr_r2(ret, signed) AS r2, CAST(regr_count(ret, signed) AS BIGINT) AS n FROM minutes GROUP BY 1),
 ami AS (SELECT date, abs({lnr("close", "lag(close) OVER (ORDER BY date)")}) * 1e4 / nullif(usd_volume / 1e6, 0) AS amihud FROM basics),
 rollr AS (SELECT date, ret / 1e4 AS r, lag(ret) OVER (PARTITION BY date ORDER BY time) / 1e4 AS p FROM minutes), roll AS (SELECT date, covar_samp(r, p) AS cov FROM rollr GROUP BY 1),
 are AS (SELECT date, {lnp("close")} AS c, ({lnp("high")} + {lnp("low")}) / 2 AS eta, lead(({lnp("high")} + {lnp("low")}) / 2) OVER (PARTITION BY date ORDER BY time) AS nxt FROM minutes), ar AS (SELECT date, sqrt(greatest(4 * avg((c - eta) * (c - nxt)), 0)) * 1e4 AS abdi_ranaldo_bps FROM are GROUP BY 1),
 daily AS (SELECT basics.date AS date, close, usd_volume, n_trades, CASE WHEN minutes >= 100 THEN buy_share END AS buy_share, CASE WHEN minutes >= 100 THEN realized_vol END AS realized_vol, CASE WHEN minutes >= 100 THEN kyle_lambda END AS kyle_lambda,
  CASE WHEN minutes >= 100 AND cov < 0 THEN 2 * sqrt(greatest(-cov, 0)) * 1e4 END AS roll_spread_bps, CASE WHEN minutes >= 100 THEN abdi_ranaldo_bps END AS abdi_ranaldo_bps, CASE WHEN minutes >= 100 THEN amihud END AS amihud FROM basics LEFT JOIN kyle USING (date) LEFT JOIN ami USING (date) LEFT JOIN roll USING (date) LEFT JOIN ar USING (date))"""


def rolled(agg: str, n: int, least: int | None = None, order: str = "date") -> str:
    x = agg[agg.index("(") + 1 : -1]
    w = f"OVER (ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {agg} {w} END"


R = lambda *names: ", ".join(f"round({x}, 6) AS {x}" for x in names)


def newey(d: str, lags: int = 5) -> str:
    lag = ", ".join(f"lag(e, {k}) OVER (ORDER BY bar) AS l{k}" for k in range(1, lags + 1))
    total = "sum(e * e)" + "".join(f" + 2 * {1 - k / (lags + 1)!r} * coalesce(sum(e * l{k}), 0)" for k in range(1, lags + 1))
    return f"{FORECASTS}, d0 AS (SELECT bar, {d} AS d FROM fc), d1 AS (SELECT *, d - avg(d) OVER () AS e FROM d0), d2 AS (SELECT *, {lag} FROM d1), nw AS (SELECT count(*) AS n, avg(d) AS mean, ({total}) / count(*) / count(*) AS var_mean FROM d2)"


CW = "(actual - benchmark) ** 2 - ((actual - model) ** 2 - (benchmark - model) ** 2)"
STAT = f"SELECT n, {R('mean')}, round(sqrt(var_mean), 6) AS se, round(mean / sqrt(var_mean), 6) AS stat FROM"


def pesaran(zeros: bool) -> str:
    v2 = "((2 * py - 1) ** 2 * px * (1 - px) + (2 * px - 1) ** 2 * py * (1 - py)) / n + 4 * py * px * (1 - py) * (1 - px) / n / n"
    var = f"ex * (1 - ex) / n - ({v2})"
    var = f"greatest({var}, 1e-18)" if zeros else var
    keep = "" if zeros else "WHERE actual <> 0"
    return f"""WITH {FORECASTS}, s AS (SELECT count(*) AS n, avg(CAST((actual > 0) = (model > 0) AS INT)) AS hit_rate, avg(CAST(actual > 0 AS INT)) AS py, avg(CAST(model > 0 AS INT)) AS px FROM fc {keep}), e AS (SELECT *, py * px + (1 - py) * (1 - px) AS ex FROM s)
 SELECT n, round(hit_rate, 6) AS hit_rate, round(px, 6) AS forecast_up_share, round((hit_rate - ex) / sqrt({var}), 6) AS stat FROM e"""


def walk(alpha: float) -> str:
    return f"""WITH {panel()}, t AS (SELECT bar, ret_bp AS x, next_ret AS y FROM panel WHERE ret_bp IS NOT NULL AND imbalance IS NOT NULL AND next_ret IS NOT NULL), o AS (SELECT date_trunc('day', min(bar)) AS a, max(bar) AS b FROM panel),
 folds AS (SELECT a + INTERVAL 1 DAY * k AS s, a + INTERVAL 1 DAY * (k + 5) AS e FROM (SELECT a, unnest(range(10, datediff('day', a, b) + 1, 5)) AS k FROM o)),
 q AS (SELECT s, e, quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM folds JOIN t ON bar < s GROUP BY s, e),
 c AS (SELECT s, e, lo, hi, least(greatest(x, lo), hi) AS x, y FROM q JOIN t ON bar < s),
 m AS (SELECT s, e, lo, hi, avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, count(*) AS n FROM c GROUP BY s, e, lo, hi)
 SELECT CAST(bar AS VARCHAR) AS bar, round(y, 6) AS actual, round(my + (sxy / sx) / (n - 1 + {alpha}) * (least(greatest(x, lo), hi) - mx) / sx, 6) AS model, 0.0::DOUBLE AS benchmark FROM m JOIN t ON bar >= s AND bar < e WHERE n >= 30"""


def grid(n: int, least: int) -> str:
    """The full-grid panel of ``n``-minute bars, NULL below ``least`` minutes: path length over volume, slope for 100 units, root of the squared returns."""
    measures = ("open", "close", "high", "low", "volume", "usd_volume_m", "n_trades", "ret_bp", "path_bp", "rv_bp", "range_bp", "oib", "avg_trade", "amihud", "kyle")
    return f"""{KLINES}, gb AS (SELECT time_bucket(INTERVAL {n} MINUTE, time, TIMESTAMP '1970-01-01') AS bar, arg_min(open, time) AS open, arg_max(close, time) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume, sum(buy) AS buy,
 sum(usd) / 1e6 AS usd_volume_m, CAST(sum(num_trades) AS BIGINT) AS n_trades, coalesce(sum(abs(ret)), 0) AS path_bp, sqrt(coalesce(sum(ret * ret), 0)) AS rv_bp, CASE WHEN regr_sxx(ret, signed) > 0 THEN regr_slope(ret, signed) * 100 END AS kyle, count(*) AS k FROM minutes GROUP BY 1),
 gg AS (SELECT unnest(generate_series(min(bar), max(bar), INTERVAL {n} MINUTE)) AS bar FROM gb), gj AS (SELECT gg.bar AS bar, coalesce(k, 0) AS minutes_available, open, close, high, low, volume, usd_volume_m, n_trades, path_bp, rv_bp, kyle, {lnr("close", "lag(close) OVER (ORDER BY gg.bar)")} * 1e4 AS ret_bp, {lnr("high", "low")} * 1e4 AS range_bp,
 (2 * buy - volume) / nullif(volume, 0) AS oib, volume / nullif(n_trades, 0) AS avg_trade, path_bp / nullif(usd_volume_m, 0) AS amihud FROM gg LEFT JOIN gb USING (bar)),
 grid AS (SELECT bar, minutes_available, {", ".join(f"CASE WHEN minutes_available >= {least} THEN {x} END AS {x}" for x in measures)} FROM gj)"""


def har(n: int, least: int) -> str:
    """Factors of the panel of ``n``-minute bars; a day is 5 bars and a week 30 at least."""
    d, k = max(1440 // n, 5), max(10080 // n, 30)
    day, week = (lambda x: rolled(x, d, round(d * 18 / 24), "bar")), (lambda x: rolled(x, k, round(k * 120 / 168), "bar"))
    cols = {f"{c}_{k}": e for c in ("log_amihud", "log_rv", "kyle") for k, e in (("last", c), ("day", day(f"avg({c})")), ("week", week(f"avg({c})")), ("dev", f"{c} - ({week(f'avg({c})')})"))}
    cols |= {"ret_last": "ret_bp", "ret_day": day("sum(ret_bp)"), "ret_week": week("sum(ret_bp)"), "oib_last": "oib", "oib_day": day("avg(oib)"), "log_range": "log_range"}
    cols |= {f"abn_{c}": f"{c} - ({week(f'avg({c})')})" for c in ("log_volume", "log_size", "log_range")}
    ahead = f"(bar + INTERVAL {n} MINUTE)"
    if n < 1440:
        hour = f"(hour({ahead}) * 2 * pi() / 24)"
        cols |= {"hour_sin": f"sin({hour})", "hour_cos": f"cos({hour})", "hour_sin2": f"sin(2 * {hour})", "hour_cos2": f"cos(2 * {hour})"}
    cols |= {f"target_{k}": f"lead({c}) OVER (ORDER BY bar)" for k, c in (("amihud", "log_amihud"), ("kyle", "kyle"), ("rv", "log_rv"), ("return", "ret_bp"))}
    logs = ", ".join(f"{lnp(c)} AS {k}" for k, c in (("log_amihud", "amihud"), ("log_rv", "rv_bp"), ("log_volume", "usd_volume_m"), ("log_size", "avg_trade"), ("log_range", "range_bp")))
    extra = f", hour({ahead}) AS hour_of_day" if n < 1440 else ""
    return f"""WITH {grid(n, least)}, q AS (SELECT quantile_cont(kyle, 0.01) AS lo, quantile_cont(kyle, 0.99) AS hi FROM grid), t AS (SELECT bar, ret_bp, oib, {logs}, CASE WHEN kyle IS NOT NULL THEN least(greatest(kyle, lo), hi) END AS kyle FROM grid, q)
 SELECT CAST(bar AS VARCHAR) AS bar, CAST(isodow{ahead} >= 6 AS BIGINT) AS weekend{extra}, {", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in cols.items())} FROM t"""


PRESENT = "present AS (SELECT event_type AS stream, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)"
EXPECTED = "expected AS (SELECT stream, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM present GROUP BY stream)"
SOFT = "r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY n, hour) AS k, count(*) OVER (PARTITION BY stream) AS c FROM present), m AS (SELECT stream, n AS median_n FROM r WHERE k = c // 2 + 1), soft AS (SELECT stream, hour, n, median_n FROM present JOIN m USING (stream) WHERE n < greatest(1.0, 0.5 * median_n))"
ASOF = f"WITH {TRADES}, {BUYS}, {QUOTES}, looks AS (SELECT event_id, h AS horizon, trade_time - INTERVAL 50 MILLISECOND + INTERVAL 1 SECOND * h AS at, price, quantity, maker FROM buys, (VALUES (0), (1), (5), (30), (60)) v(h)), found AS (SELECT looks.*, q.mid FROM looks ASOF LEFT JOIN q ON looks.at > q.event_time)"
OFI = f"{QUOTES}, o AS (SELECT update_id, event_time, mid, CAST(bid >= lag(bid) OVER w AS INT) * bid_qty - CAST(bid <= lag(bid) OVER w AS INT) * lag(bid_qty) OVER w - CAST(ask <= lag(ask) OVER w AS INT) * ask_qty + CAST(ask >= lag(ask) OVER w AS INT) * lag(ask_qty) OVER w AS ofi FROM q WINDOW w AS (ORDER BY event_time, update_id))"
SPEARMAN = ["usd_volume", "realized_vol", "kyle_lambda", "amihud", "roll_spread_bps"]

def evaluated() -> str:
    lag = ", ".join(f"lag(e, {k}) OVER (PARTITION BY name ORDER BY bar) AS l{k}" for k in range(1, 6))
    total = "sum(e * e)" + "".join(f" + 2 * {1 - k / 6!r} * coalesce(sum(e * l{k}), 0)" for k in range(1, 6))
    return f"""WITH {FORECASTS}, f AS (SELECT bar, actual, benchmark, 'reversal' AS name, model FROM fc UNION ALL SELECT bar, actual, benchmark, 'momentum', 0.1 * last_ret FROM fc), d0 AS (SELECT *, (actual - benchmark) ** 2 - (actual - model) ** 2 AS d FROM f), d1 AS (SELECT *, d - avg(d) OVER (PARTITION BY name) AS e FROM d0), d2 AS (SELECT *, {lag} FROM d1)
 SELECT name, round(1 - sum((actual - model) ** 2) / sum((actual - benchmark) ** 2), 6) AS r2, round(sqrt(avg((actual - model) ** 2)), 6) AS rmse, round(corr(actual, model), 6) AS corr, count(*) AS n, round(avg(d) / sqrt(({total}) / count(*) / count(*)), 6) AS stat FROM d2 GROUP BY 1"""


HAC = f"""WITH {panel()}, t AS (SELECT bar, ret_bp AS x0, next_ret AS y FROM panel WHERE ret_bp IS NOT NULL AND next_ret IS NOT NULL), z AS (SELECT bar, y, (x0 - avg(x0) OVER ()) / stddev_samp(x0) OVER () AS x FROM t), m AS (SELECT avg(y) AS a, sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n FROM z), u AS (SELECT bar, y - a - b * x AS u0, x * (y - a - b * x) AS u1 FROM z, m),
 l AS (SELECT *, {', '.join(f'lag(u{i}, {k}) OVER (ORDER BY bar) AS l{i}_{k}' for i in (0, 1) for k in range(1, 6))} FROM u), g AS (SELECT {', '.join(f"sum(u{i} * u{i})" + ''.join(f' + 2 * {1 - k / 6!r} * sum(u{i} * l{i}_{k})' for k in range(1, 6)) + f' AS g{i}' for i in (0, 1))} FROM l)
 SELECT 'const' AS term, round(a, 6) AS coef, round(sqrt(g0) / n, 6) AS se, round(a / (sqrt(g0) / n), 6) AS t FROM m, g UNION ALL SELECT 'ret_lag0', round(b, 6), round(sqrt(g1) / sxx, 6), round(b / (sqrt(g1) / sxx), 6) FROM m, g"""


def upper_tail(z: str) -> str:
    """P(Z > z) by the series of the error function."""
    x = f"({z} / sqrt(2.0))"
    series = f"list_sum(list_transform(range(0, 90), lambda i: (CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END) * exp((2 * i + 1) * ln(abs({x})) - lgamma(i + 1.0)) / (2 * i + 1)))"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 6 THEN 0.0 WHEN {z} < -6 THEN 1.0 WHEN {z} = 0 THEN 0.5 ELSE 0.5 - sign({z}) * {series} / sqrt(pi()) END"


def hac_table(lags: int = 5) -> str:
    """Three z-scored factors: the constant stands apart, the rest by the adjugate of a 3 x 3 matrix."""
    x = ["ret_bp", "imbalance", "activity_dev"]
    names = ["ret_lag0", "imb_lag0", "log_activity_dev"]
    pairs = [(i, j) for i in range(1, 4) for j in range(1, 4)]
    g = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    rest = lambda i: [k for k in (1, 2, 3) if k != i]
    minor = lambda i, j: "({} * {} - {} * {})".format(*(g(a, b) for a, b in ((rest(i)[0], rest(j)[0]), (rest(i)[1], rest(j)[1]), (rest(i)[0], rest(j)[1]), (rest(i)[1], rest(j)[0]))))
    det = " + ".join(f"{(-1) ** (1 + j)} * {g(1, j)} * {minor(1, j)}" for j in (1, 2, 3))
    inverse = ", ".join(f"{(-1) ** (i + j)} * {minor(j, i)} / ({det}) AS v{i}{j}" for i, j in pairs)
    beta = ", ".join(f"{' + '.join(f'v{i}{j} * y{j}' for j in (1, 2, 3))} AS b{i}" for i in (1, 2, 3))
    e = "(y - b0 - b1 * z1 - b2 * z2 - b3 * z3)"
    lag = ", ".join(f"lag(u{i}, {k}) OVER (ORDER BY bar) AS l{i}_{k}" for i in range(4) for k in range(1, lags + 1))
    meat = lambda i, j: f"sum(u{i} * u{j})" + "".join(f" + {1 - k / (lags + 1)!r} * sum(u{i} * l{j}_{k} + u{j} * l{i}_{k})" for k in range(1, lags + 1))
    meats = ", ".join(f"{meat(i, j)} AS m{i}{j}" for i in range(4) for j in range(4) if i == j == 0 or i and j)
    var = lambda i: " + ".join(f"v{i}{a} * m{a}{b} * v{b}{i}" for a in (1, 2, 3) for b in (1, 2, 3))
    rows = "SELECT 'const' AS term, b0 AS coef, sqrt(m00) / n AS se, r2, n FROM f, h" + "".join(f" UNION ALL SELECT '{name}', b{i}, sqrt({var(i)}), r2, n FROM f, h" for i, name in enumerate(names, 1))
    return f"""WITH {panel()}, t AS (SELECT bar, next_ret AS y, {', '.join(f'{c} AS x{i}' for i, c in enumerate(x, 1))} FROM panel WHERE next_ret IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in x)}),
 z AS (SELECT bar, y, {', '.join(f'(x{i} - avg(x{i}) OVER ()) / stddev_samp(x{i}) OVER () AS z{i}' for i in (1, 2, 3))} FROM t),
 s AS (SELECT count(*) AS n, avg(y) AS b0, var_pop(y) AS vy, {', '.join(f'sum(z{i} * z{j}) AS s{i}{j}' for i, j in pairs if i <= j)}, {', '.join(f'sum(z{i} * y) AS y{i}' for i in (1, 2, 3))} FROM z),
 v AS (SELECT *, {inverse} FROM s), c AS (SELECT *, {beta} FROM v), f AS (SELECT c.*, (SELECT 1 - sum({e} ** 2) / n / vy FROM z, c d WHERE true GROUP BY n, vy) AS r2 FROM c),
 u AS (SELECT bar, {e} AS u0, {', '.join(f'z{i} * {e} AS u{i}' for i in (1, 2, 3))} FROM z, c), l AS (SELECT *, {lag} FROM u), h AS (SELECT {meats} FROM l), o AS ({rows})
 SELECT term, {R('coef', 'se')}, round(coef / se, 6) AS t, round(2 * ({upper_tail('abs(coef / se)')}), 6) AS p_value, {R('r2')}, n FROM o"""


def evaluated_returns(cost: float = 1.0, n: int = 15) -> str:
    lag = ", ".join(f"lag(e, {k}) OVER (PARTITION BY name ORDER BY bar) AS l{k}" for k in range(1, 6))
    total = "sum(e * e)" + "".join(f" + 2 * {1 - k / 6!r} * coalesce(sum(e * l{k}), 0)" for k in range(1, 6))
    v = "ex * (1 - ex) / m - (((2 * py - 1) ** 2 * px * (1 - px) + (2 * px - 1) ** 2 * py * (1 - py)) / m + 4 * py * px * (1 - py) * (1 - px) / m / m)"
    sharpe = lambda c: f"CASE WHEN stddev_pop({c}) > 0 THEN avg({c}) / stddev_pop({c}) * sqrt({525600 / n!r}) END"
    return f"""WITH {FORECASTS}, f AS (SELECT bar, actual, benchmark, 'reversal' AS name, model FROM fc UNION ALL SELECT bar, actual, benchmark, 'momentum', 0.1 * last_ret FROM fc),
 d0 AS (SELECT *, (actual - benchmark) ** 2 - ((actual - model) ** 2 - (benchmark - model) ** 2) AS d FROM f), d1 AS (SELECT *, d - avg(d) OVER (PARTITION BY name) AS e FROM d0), d2 AS (SELECT *, {lag} FROM d1),
 a AS (SELECT name, 1 - sum((actual - model) ** 2) / sum((actual - benchmark) ** 2) AS r2, sqrt(avg((actual - model) ** 2)) AS rmse, corr(actual, model) AS corr, count(*) AS n, avg(d) / sqrt(({total}) / count(*) / count(*)) AS clark_west FROM d2 GROUP BY 1),
 p AS (SELECT name, count(*) AS m, avg(CAST((actual > 0) = (model > 0) AS INT)) AS hit_rate, avg(CAST(actual > 0 AS INT)) AS py, avg(CAST(model > 0 AS INT)) AS px FROM f WHERE actual <> 0 GROUP BY 1),
 q AS (SELECT *, py * px + (1 - py) * (1 - px) AS ex FROM p), r AS (SELECT *, (hit_rate - ex) / sqrt({v}) AS pt FROM q),
 h AS (SELECT *, abs(sign(model) - coalesce(lag(sign(model)) OVER (PARTITION BY name ORDER BY bar), 0)) AS traded, sign(model) * actual AS gross FROM f), g AS (SELECT *, gross - traded * {cost!r} AS net FROM h),
 w AS (SELECT name, avg(gross) AS gross_mean_bp, avg(net) AS net_mean_bp, {sharpe('gross')} AS gross_sharpe, {sharpe('net')} AS net_sharpe, sum(traded) / count(*) * {1440 / n!r} AS trades_per_day FROM g GROUP BY 1)
 SELECT a.name AS name, {R('r2', 'rmse', 'corr')}, n, {R('clark_west')}, round({upper_tail('clark_west')}, 6) AS clark_west_p, {R('hit_rate')}, round(ex, 6) AS hit_rate_if_independent, round(px, 6) AS forecast_up_share, round(pt, 6) AS pesaran_timmermann, round({upper_tail('pt')}, 6) AS pesaran_timmermann_p,
 {R('gross_mean_bp', 'net_mean_bp', 'gross_sharpe', 'net_sharpe', 'trades_per_day')} FROM a JOIN r ON r.name = a.name JOIN w ON w.name = a.name"""


GUESSED = f"{DAYS}, b AS (SELECT *, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS r FROM days), z AS (SELECT date, (ln(lead(close, 30) OVER (ORDER BY date)) - ln(close)) / (({rolled('stddev_samp(r)', 30)}) * sqrt(30)) AS z FROM b), l AS (SELECT CASE WHEN z > 0.4 THEN 2 WHEN z < -0.4 THEN 0 ELSE 1 END AS y, day(date) % 3 AS p FROM z WHERE z IS NOT NULL)"

SQL: dict[str, str] = {
    "data_description": f"WITH {panel()} SELECT CAST(min(minute) AS VARCHAR) AS first_minute, CAST(max(minute) AS VARCHAR) AS last_minute, count(*) AS bars, round(1 - count(*) / (datediff('minute', min(minute), max(minute)) + 1), 6) AS empty_share, CAST(sum(n_trades) AS BIGINT) AS trades, round(arg_min(close, minute), 6) AS first_close, round(arg_max(close, minute), 6) AS last_close FROM mb",
    "rolling_median_30d": "WITH days AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1) SELECT CAST(date AS VARCHAR) AS date, CASE WHEN count(close) OVER w >= 10 THEN round(median(close) OVER w, 6) END AS median_close FROM days WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)",
    "evaluate_forecasts": evaluated(),
    "hac_table": hac_table(),
    "ewm_close": f"WITH {DAYS}, k AS (SELECT *, row_number() OVER (ORDER BY date) AS k FROM days) SELECT CAST(b.date AS VARCHAR) AS date, round(sum(a.close * power(2.0 / 3, b.k - a.k)) / sum(power(2.0 / 3, b.k - a.k)), 6) AS mean FROM k a JOIN k b ON a.k <= b.k GROUP BY 1",
    "evaluate_returns": evaluated_returns(),
    "evaluate_liquidity": f"SELECT *, round({upper_tail('stat')}, 6) AS p_value FROM ({evaluated()})",
    "exact_quantiles_daily": f"SELECT year(l_shipdate) AS year, {', '.join(f'round(quantile_cont(l_extendedprice / l_quantity, {q}), 6) AS {k}' for k, q in (('low', 0.01), ('median', 0.5), ('high', 0.99)))} FROM lineitem WHERE l_quantity <> 0 GROUP BY 1",
    "minute_bars_from_trades": f"WITH {panel()} SELECT CAST(minute AS VARCHAR) AS minute, n_trades, {R('close', 'buy_qty', 'sell_qty', 'usd_volume')} FROM mb",
    "bars_nmin_drop_empty": f"WITH {panel()} SELECT CAST(bar AS VARCHAR) AS bar, n_trades, {R('close', 'buy_qty', 'sell_qty', 'usd_volume', 'ret_bp', 'imbalance', 'activity_dev', 'next_ret')} FROM panel",
    "bars_nmin_full_grid": f"WITH {grid(5, 2)} SELECT CAST(bar AS VARCHAR) AS bar, minutes_available, n_trades, {R('open', 'close', 'high', 'low', 'volume', 'usd_volume_m', 'ret_bp', 'path_bp', 'rv_bp', 'range_bp', 'oib', 'avg_trade', 'amihud', 'kyle')} FROM grid",
    "kyle_lambda_daily": f"WITH {BASICS} SELECT CAST(date AS VARCHAR) AS date, {R('kyle_lambda', 'r2')}, n FROM kyle",
    "kyle_lambda_by_hour_hc0": f"""WITH {KLINES}, d AS (SELECT hour(time) AS hour, ret AS y, signed AS x FROM minutes WHERE ret IS NOT NULL), m AS (SELECT hour, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2, count(*) AS n FROM d GROUP BY 1),
 v AS (SELECT hour, sum((x - mx) ** 2 * (y - intercept - slope * x) ** 2) AS meat FROM d JOIN m USING (hour) GROUP BY 1) SELECT hour, {R('slope', 'intercept')}, CASE WHEN n >= 3 AND sxx > 0 AND meat > 0 THEN round(slope / sqrt(meat / nullif(sxx * sxx, 0)), 6) END AS t, round(r2, 6) AS r2, n FROM m JOIN v USING (hour)""",
    "amihud_daily": f"WITH {BASICS} SELECT CAST(date AS VARCHAR) AS date, {R('amihud')} FROM ami",
    "roll_daily": f"WITH {BASICS} SELECT CAST(date AS VARCHAR) AS date, {R('cov')}, CASE WHEN cov < 0 THEN round(2 * sqrt(greatest(-cov, 0)) * 1e4, 6) END AS roll_spread_bps FROM roll",
    "abdi_ranaldo_daily": f"WITH {BASICS} SELECT CAST(date AS VARCHAR) AS date, {R('abdi_ranaldo_bps')} FROM ar",
    "realized_vol_daily": f"WITH {BASICS} SELECT CAST(date AS VARCHAR) AS date, {R('close', 'volume', 'usd_volume', 'buy_share', 'realized_vol')}, n_trades, minutes FROM basics",
    "yearly_medians": f"WITH {BASICS} SELECT year(date) AS year, {', '.join(f'round(CAST(median({x}) AS DOUBLE), 6) AS {x}' for x in ('close', 'usd_volume', 'n_trades', 'buy_share', 'realized_vol', 'kyle_lambda', 'roll_spread_bps', 'abdi_ranaldo_bps'))} FROM daily GROUP BY 1",
    "spearman_matrix": f"WITH {BASICS}, l AS ({' UNION ALL '.join(f'''SELECT '{a}' AS a, '{b}' AS b, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM daily WHERE {a} IS NOT NULL AND {b} IS NOT NULL''' for i, a in enumerate(SPEARMAN) for b in SPEARMAN[i + 1 :])}), k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM l) SELECT a, b, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM k GROUP BY 1, 2",
    "vpin_daily": f"""WITH {KLINES}, dv AS (SELECT date, sum(volume) AS v FROM minutes GROUP BY 1), sz AS (SELECT date, v, avg(v) OVER (PARTITION BY date_trunc('month', date)) / 50 AS size FROM dv), st AS (SELECT date, size, coalesce(sum(v / size) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sz),
 b AS (SELECT CAST(floor(round(start + sum(volume / size) OVER (PARTITION BY date ORDER BY time), 9)) AS BIGINT) AS bucket, buy, sell, time FROM minutes JOIN st USING (date)), k AS (SELECT bucket, sum(buy) AS b, sum(sell) AS s, max(time) AS e FROM b GROUP BY 1), i AS (SELECT bucket, e, abs(b - s) / nullif(b + s, 0) AS imbalance FROM k),
 v AS (SELECT e, {rolled('avg(imbalance)', 50, None, 'bucket')} AS vpin FROM i) SELECT CAST(CAST(e AS DATE) AS VARCHAR) AS date, round(avg(vpin), 6) AS vpin, count(*) AS buckets FROM v GROUP BY 1""",
    "trade_count_split": f"WITH {KLINES} SELECT CAST(date AS VARCHAR) AS date, round_even(sum(num_trades * coalesce(buy / nullif(volume, 0), 0.5)), 0) AS buys, round_even(sum(num_trades * (1 - coalesce(buy / nullif(volume, 0), 0.5))), 0) AS sells FROM minutes GROUP BY 1",
    "asof_prevailing_mid": f"{ASOF} SELECT event_id AS agg_trade_id, CAST(horizon AS BIGINT) AS horizon, {R('mid')} FROM found WHERE horizon IN (0, 1, 60)",
    "effective_spread_decomposition": f"""{ASOF}, n AS (SELECT event_id, mid AS m FROM found WHERE horizon = 0), s AS (SELECT horizon, quantity, 2 * d * (price - m) / m * 1e4 AS es, 2 * d * (mid - m) / m * 1e4 AS pi FROM (SELECT *, CASE WHEN maker THEN -1 ELSE 1 END AS d FROM found WHERE horizon > 0) JOIN n USING (event_id) WHERE m IS NOT NULL AND mid IS NOT NULL), t AS (SELECT *, es - pi AS rs FROM s)
 SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS n_trades, {', '.join(f'round(sum({x} * quantity) / sum(quantity), 6) AS {x}_vw, round(median({x}), 6) + 0.0 AS {x}_median' for x in ('es', 'pi', 'rs'))} FROM t GROUP BY 1""",
    "quoted_spread_time_weighted": f"""WITH {QUOTES}, s AS (SELECT *, spread / mid * 1e4 AS bps, round_even(spread / 0.01, 0) AS ticks, coalesce(epoch_us(lead(event_time) OVER (ORDER BY event_time, update_id)) - epoch_us(event_time), 0) / 1e6 AS sec FROM q)
 SELECT count(*) AS n_quotes, round(sum(bps * (sec + 1e-9)) / sum(sec + 1e-9), 6) AS spread_bps_tw, round(sum(spread * (sec + 1e-9)) / sum(sec + 1e-9), 6) AS spread_usdt_tw, round(sum(ticks * (sec + 1e-9)) / sum(sec + 1e-9), 6) AS spread_ticks_tw,
 round(sum(CASE WHEN ticks = 1 THEN sec ELSE 0 END) / sum(sec), 6) AS one_tick_share, round(max(bps), 6) AS spread_bps_max, round(avg(bid_qty), 6) AS bid_qty_mean, round(avg(ask_qty), 6) AS ask_qty_mean FROM s""",
    "ofi_per_update": f"WITH {OFI} SELECT update_id, CAST(event_time AS VARCHAR) AS event_time, round(ofi, 6) AS ofi FROM o",
    "ofi_impact_regression": f"""WITH {TRADES}, {BUYS}, {OFI}, qb AS (SELECT time_bucket(INTERVAL 1800 SECOND, event_time, TIMESTAMP '1970-01-01') AS bin, arg_min(mid, (event_time, update_id)) AS f, arg_max(mid, (event_time, update_id)) AS l, coalesce(sum(ofi), 0) AS ofi FROM o GROUP BY 1),
 tb AS (SELECT time_bucket(INTERVAL 1800 SECOND, trade_time, TIMESTAMP '1970-01-01') AS bin, sum(CASE WHEN maker THEN -quantity ELSE quantity END) AS sv FROM buys GROUP BY 1), j AS (SELECT (l / f - 1) * 1e4 AS y, ofi, coalesce(sv, 0) AS signed_volume FROM qb LEFT JOIN tb USING (bin) WHERE bin BETWEEN (SELECT min(bin) FROM tb) AND (SELECT max(bin) FROM tb)),
 d AS (SELECT 'ofi' AS x_name, y, ofi AS x FROM j UNION ALL SELECT 'signed_volume', y, signed_volume FROM j), m AS (SELECT x_name, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2, count(*) AS n FROM d GROUP BY 1), v AS (SELECT x_name, sum((x - mx) ** 2 * (y - intercept - slope * x) ** 2) AS meat FROM d JOIN m USING (x_name) GROUP BY 1)
 SELECT x_name, {R('slope', 'intercept')}, CASE WHEN n >= 3 AND sxx > 0 AND meat > 0 THEN round(slope / sqrt(meat / nullif(sxx * sxx, 0)), 6) END AS t, round(r2, 6) AS r2, n FROM m JOIN v USING (x_name)""",
    "slippage_curve": """WITH l AS (SELECT l_orderkey AS snapshot, l_linenumber % 2 = 1 AS bid, l_extendedprice / l_quantity AS px, CAST(l_quantity AS DOUBLE) AS qty FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY snapshot, bid ORDER BY CASE WHEN bid THEN -px ELSE px END, qty) AS lv FROM l), d AS (SELECT *, sum(qty) OVER (PARTITION BY snapshot, bid ORDER BY lv) - qty AS before FROM k WHERE lv <= 10),
 m AS (SELECT snapshot, (max(CASE WHEN bid AND lv = 1 THEN px END) + max(CASE WHEN NOT bid AND lv = 1 THEN px END)) / 2 AS mid FROM d GROUP BY 1), s AS (SELECT d.snapshot AS snapshot, bid, size, sum(qty) AS c, sum(greatest(least(size - before, qty), 0) * px) AS n FROM d, (VALUES (0.1::DOUBLE), (0.5), (1), (2), (5), (10)) v(size) GROUP BY 1, 2, 3),
 b AS (SELECT CASE WHEN bid THEN 'sell' ELSE 'buy' END AS side, size, CASE WHEN c >= size THEN (CASE WHEN bid THEN -1 ELSE 1 END) * (n / size - mid) / mid * 1e4 END AS bps, c < size AS thin FROM s JOIN m USING (snapshot) WHERE mid IS NOT NULL)
 SELECT side, size, round(avg(bps), 6) AS mean_bps, round(median(bps), 6) AS median_bps, round(quantile_cont(bps, 0.95), 6) AS p95_bps, round(avg(CAST(thin AS INT)), 6) AS book_too_thin_share, count(*) AS n FROM b GROUP BY 1, 2""",
    "har_factors": har(60, 8),
    "har_factors_daily": har(1440, 100),
    "backtest_factors": f"WITH {panel()} SELECT CAST(bar AS VARCHAR) AS bar, round(ret_bp, 6) AS ret_lag0, round(lag(ret_bp, 1) OVER w, 6) AS ret_lag1, round(lag(ret_bp, 2) OVER w, 6) AS ret_lag2, round(imbalance, 6) AS imb_lag0, round(lag(imbalance, 1) OVER w, 6) AS imb_lag1, round(lag(imbalance, 2) OVER w, 6) AS imb_lag2, round({rolled('avg(imbalance)', 12, None, 'bar')}, 6) AS imb_smooth, round(activity_dev, 6) AS log_activity_dev, round(next_ret, 6) AS next_ret FROM panel WINDOW w AS (ORDER BY bar)",
    "regime_features": f"""WITH {DAYS}, b AS (SELECT *, 0.0::DOUBLE AS s, ln(close) - ln(lag(close) OVER w) AS r, greatest(close - lag(close) OVER w, 0) AS up0, -least(close - lag(close) OVER w, 0) AS dn0, lag(close) OVER w AS p FROM days WINDOW w AS (ORDER BY date)), c AS (SELECT *, CASE WHEN p IS NOT NULL THEN up0 END AS up, CASE WHEN p IS NOT NULL THEN dn0 END AS down FROM b),
 f AS (SELECT date, close, ln(close) - ln(lag(close, 5) OVER w) AS ret_5, ln(close) - ln(lag(close, 20) OVER w) AS ret_20, ln(close) - ln(lag(close, 60) OVER w) AS ret_60, {rolled('stddev_samp(r)', 10)} AS vol_10, {rolled('stddev_samp(r)', 30)} AS vol_30, close / ({rolled('avg(close)', 20)}) - 1 AS ma_ratio_20, close / ({rolled('avg(close)', 60)}) - 1 AS ma_ratio_60, close / ({rolled('max(close)', 60)}) - 1 AS drawdown_60,
 1 - 1 / (1 + ({rolled('avg(up)', 14)}) / (({rolled('avg(down)', 14)}) + 1e-12)) - 0.5 AS rsi_14, s AS sent, {rolled('avg(s)', 10)} AS sent_ma_10, s - lag(s, 5) OVER w AS sent_chg_5, (s - ({rolled('avg(s)', 60)})) / (({rolled('stddev_samp(s)', 60)}) + 1e-9) AS sent_z_60 FROM c WINDOW w AS (ORDER BY date))
 SELECT CAST(date AS VARCHAR) AS date, {R('close', 'ret_5', 'ret_20', 'ret_60', 'vol_10', 'vol_30', 'ma_ratio_20', 'ma_ratio_60', 'drawdown_60', 'rsi_14', 'sent', 'sent_ma_10', 'sent_chg_5', 'sent_z_60')} FROM f""",
    "regime_labels": f"WITH {DAYS}, b AS (SELECT *, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS r FROM days), z AS (SELECT date, (ln(lead(close, 30) OVER (ORDER BY date)) - ln(close)) / (({rolled('stddev_samp(r)', 30)}) * sqrt(30)) AS z FROM b) SELECT CAST(date AS VARCHAR) AS date, {R('z')}, CAST(CASE WHEN z > 0.4 THEN 2 WHEN z < -0.4 THEN 0 WHEN z IS NOT NULL THEN 1 END AS BIGINT) AS regime FROM z",
    "winsorize": f"WITH {panel()}, q AS (SELECT quantile_cont(ret_bp, 0.01) AS lo, quantile_cont(ret_bp, 0.99) AS hi FROM panel) SELECT CAST(bar AS VARCHAR) AS bar, CASE WHEN ret_bp IS NOT NULL THEN round(least(greatest(ret_bp, lo), hi), 6) END AS x FROM panel, q",
    "strategy_pnl_cost_grid": f"""WITH {HELD}, a AS (SELECT *, sum(pnl) OVER w AS cum FROM net WINDOW w AS (PARTITION BY strategy, cost_bp ORDER BY bar ROWS UNBOUNDED PRECEDING)), b AS (SELECT *, max(cum) OVER (PARTITION BY strategy, cost_bp ORDER BY bar ROWS UNBOUNDED PRECEDING) AS peak FROM a)
 SELECT strategy, cost_bp, round(avg(pnl), 6) AS mean_bp, CASE WHEN stddev_samp(pnl) > 0 THEN round(avg(pnl) / stddev_samp(pnl) * sqrt(525600 / 15.0), 6) END AS sharpe, round(sum(pnl) / 100, 6) AS total_pct, round(min(cum - peak) / 100, 6) AS max_drawdown_pct, round(sum(traded) / count(*) * 96.0, 6) AS trades_per_day, count(*) AS n FROM b GROUP BY 1, 2""",
    "max_drawdown": f"WITH {FORECASTS}, a AS (SELECT bar, sum(actual) OVER (ORDER BY bar ROWS UNBOUNDED PRECEDING) AS cum FROM fc), b AS (SELECT cum, max(cum) OVER (ORDER BY bar ROWS UNBOUNDED PRECEDING) AS peak FROM a) SELECT round(min(cum - peak) / 100, 6) AS max_drawdown_pct, count(*) AS n FROM b",
    "breakeven_fee": f"WITH {HELD} SELECT strategy, round(sum(pnl), 6) AS gross, round(sum(traded), 6) AS traded, CASE WHEN strategy <> 'buy_hold' AND sum(traded) > 0 THEN round(sum(pnl) / nullif(sum(traded), 0), 6) END AS breakeven_bp FROM net WHERE cost_bp = 0 GROUP BY 1",
    "yearly_pivot": f"WITH {HELD} SELECT strategy, cost_bp, {', '.join(f'round(avg(pnl) FILTER (month(bar) = {k}), 6) AS p{k}' for k in range(1, 13))} FROM net GROUP BY 1, 2",
    "clark_west": f"WITH {FORECASTS}, d AS (SELECT {CW} AS d FROM fc), s AS (SELECT count(d) AS n, avg(d) AS mean, var_samp(d) / count(d) AS var_mean FROM d) {STAT} s",
    "clark_west_hac": f"WITH {newey(CW)} {STAT} nw",
    "diebold_mariano": f"WITH {newey('(actual - benchmark) ** 2 - (actual - model) ** 2')} {STAT} nw",
    "pesaran_timmermann_a": pesaran(False),
    "pesaran_timmermann_b": pesaran(True),
    "newey_west_mean": f"WITH {newey('actual')} SELECT n, {R('mean')}, round(sqrt(var_mean), 6) AS se FROM nw",
    "oos_r2_yearly": f"WITH {FORECASTS} SELECT year(bar) AS year, round(1 - sum((actual - model) ** 2) / nullif(sum((actual - benchmark) ** 2), 0), 6) AS r2, count(*) AS n FROM fc GROUP BY 1",
    "walk_forward_ols": walk(0.0),
    "walk_forward_ridge": walk(10.0),
    "hac_regression": HAC,
    "keyword_filter_clean_text": r"WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^\s+', ''), '\s+$', '') AS body FROM documents) SELECT id, 'rss:feed' AS source, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS body_md5 FROM c WHERE contains(lower(' ' || body), 'the ') OR contains(lower(' ' || body), 'une')",
    "incremental_antijoin": "SELECT doc_id, min(lang) AS lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1",
    "coverage_hard_gaps": f"WITH {PRESENT}, {EXPECTED} SELECT stream, CAST(hour AS VARCHAR) AS hour FROM expected ANTI JOIN present USING (stream, hour)",
    "coverage_soft_gaps": f"WITH {PRESENT}, {SOFT} SELECT stream, CAST(hour AS VARCHAR) AS hour, n, median_n FROM soft",
    "coverage_low_cadence": f"WITH {PRESENT} SELECT stream, CAST(hour AS VARCHAR) AS hour, n, 6.0::DOUBLE AS expected_n FROM present WHERE n < 3.0",
    "oos_r2_against_zero": f"WITH {FORECASTS} SELECT month(bar) AS month, round(1 - sum((actual - model) ** 2) / nullif(sum(actual ** 2), 0), 6) AS r2, count(*) AS n FROM fc GROUP BY 1",
    "trading_stats": f"WITH {FORECASTS}, t AS (SELECT model, actual / 1e5 AS r FROM fc) SELECT round(avg(CAST(sign(model) = sign(r) AS INT)), 6) AS dir_acc, round(corr(model, r), 6) AS ic, round(avg(sign(model) * r) / (stddev_pop(sign(model) * r) + 1e-12) * sqrt(365), 6) AS sharpe, round(exp(sum(sign(model) * r)) - 1, 6) AS total_return FROM t",
    "top_terms": f"SELECT * FROM ({HAC}) WHERE term <> 'const' ORDER BY abs(t) DESC, term LIMIT 6",
    "extreme_hours": f"WITH {KLINES}, d AS (SELECT hour(time) AS hour, CASE WHEN regr_sxx(ret, signed) > 0 THEN regr_slope(ret, signed) END AS slope FROM minutes WHERE ret IS NOT NULL GROUP BY 1) SELECT arg_max(hour, slope) AS max_hour, arg_min(hour, slope) AS min_hour FROM d",
    "last_forecasts": f"WITH {FORECASTS} SELECT CAST(bar AS VARCHAR) AS bar, {R('actual', 'model')} FROM fc ORDER BY bar DESC LIMIT 1344",
    "thinned_curve": f"WITH {FORECASTS}, r AS (SELECT bar, actual, row_number() OVER (ORDER BY bar) - 1 AS k, count(*) OVER () AS c FROM fc) SELECT CAST(bar AS VARCHAR) AS bar, {R('actual')} FROM r WHERE k % greatest(c // 100, 1) = 0",
    "bars_in_range": f"WITH {panel()} SELECT CAST(bar AS VARCHAR) AS bar, {R('close')}, n_trades FROM panel WHERE bar >= TIMESTAMP '2024-01-10' AND bar < TIMESTAMP '2024-01-12'",
    "common_bars": f"WITH {FORECASTS} SELECT CAST(bar AS VARCHAR) AS bar FROM (SELECT bar FROM panel WHERE activity_dev > 0 INTERSECT SELECT bar FROM fc WHERE actual > 0)",
    "first_filled_field": "SELECT coalesce(nullif(source, ''), nullif(lang, ''), 'none') AS label, count(*) AS n FROM documents GROUP BY 1",
    "confusion_grid": f"WITH {GUESSED} SELECT a.v AS label, b.v AS pred, (SELECT count(*) FROM l WHERE y = a.v AND p = b.v) AS n FROM (VALUES (0::BIGINT), (1), (2)) a(v), (VALUES (0::BIGINT), (1), (2)) b(v)",
    "coverage_report": f"WITH {PRESENT}, {EXPECTED}, {SOFT}, hg AS (SELECT stream, hour FROM expected ANTI JOIN present USING (stream, hour)) SELECT stream, count(*) AS hours, CAST(sum(n) AS BIGINT) AS rows, (SELECT count(*) FROM expected e WHERE e.stream = present.stream) AS expected, (SELECT count(*) FROM hg WHERE hg.stream = present.stream) AS hard_gaps, (SELECT count(*) FROM soft WHERE soft.stream = present.stream) AS soft_gaps FROM present GROUP BY 1",
    "confusion_macro_f1": f"""WITH {GUESSED},
 f AS (SELECT c, sum(CAST(y = c AND p = c AS INT)) / greatest(sum(CAST(p = c AS INT)), 1) AS pr, sum(CAST(y = c AND p = c AS INT)) / greatest(sum(CAST(y = c AS INT)), 1) AS re FROM l, (VALUES (0), (1), (2)) v(c) GROUP BY 1) SELECT round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 6) AS macro_f1, (SELECT round(avg(CAST(y = p AS INT)), 6) FROM l) AS accuracy FROM f""",
}
