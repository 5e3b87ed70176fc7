"""A mixture of regime experts: a gate gives each day's regime probabilities, a ridge for each regime its forecast.

Everything is fitted by Spark: the gate by summed gradients, the experts from one pass of summed moments for each
regime.  Gates and forecasts are column expressions, so that no row leaves the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import safe_div
from tidemark.functions.ranges import numbered
from tidemark.operators.evaluation import confusion, macro_f1, trading_stats
from tidemark.operators.network import Network

REGIMES = ("bear", "sideways", "bull")
#: What a row of another regime weighs in an expert's fit.
OTHERS = 0.05


class Gate:
    """Regime probabilities in which each class weighs alike, however often it occurs.

    ``hidden`` units make a one-layer network, 0 a multinomial logistic regression; ``decay`` is the penalty on
    the weights of either.  ``temperature`` flattens the probabilities; ``top_k`` keeps the largest (ties stay)
    and lets them sum to 1; 0 keeps all.
    """

    def __init__(self, hidden: int = 4, rounds: int = 150, decay: float = 0.03, temperature: float = 1.0, top_k: int = 0, seed: int = 0):
        self.hidden, self.rounds, self.decay, self.temperature, self.top_k, self.seed = hidden, rounds, decay, temperature, top_k, seed

    def fit(self, train: DataFrame, columns: list[str], y: str, classes: int = 3) -> Gate:
        self.classes = classes
        self.model = Network(columns, classes, self.hidden, self.decay, self.rounds, self.seed).fit(train, F.col(y))
        return self

    def attach(self, df: DataFrame, name: str = "gate") -> DataFrame:
        """Adds the array of gates."""
        told = df.withColumn(name, F.transform(self.model.probabilities(), lambda x: F.pow(x, F.lit(1 / self.temperature))))
        if 0 < self.top_k < self.classes:
            least = F.element_at(F.sort_array(name, asc=False), self.top_k)
            told = told.withColumn(name, F.transform(name, lambda x: F.when(x >= least, x).otherwise(0.0)))
        sum_of = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
        return told.withColumn(name, F.transform(name, lambda x: safe_div(x, sum_of)))


def experts(train: DataFrame, columns: list[str], regime: str, y: str, alpha: float = 10.0, least: int = 30, classes: int = 3) -> tuple[list[Column], Column]:
    """(a forecast for each regime, the forecast of one ridge over all rows).

    Factors are z-scored, the constant is not penalised.  A regime with fewer rows than ``least`` takes the
    ridge over all rows.
    """
    stats = train.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    z = [F.lit(1.0), *((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] + 1e-9) for c in columns)]
    k = len(z)
    sums = [F.sum(z[i] * z[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(z[i] * F.col(y)).alias(f"y{i}") for i in range(k)]
    gram, pull, rows = np.zeros((classes, k, k)), np.zeros((classes, k)), np.zeros(classes)
    for r in train.groupBy(F.col(regime).cast("int").alias("_k")).agg(F.count(F.lit(1)).alias("_n"), *sums).collect():
        gram[r["_k"]] = [[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
        pull[r["_k"]], rows[r["_k"]] = [r[f"y{i}"] for i in range(k)], r["_n"]
    penalty = alpha * np.diag([0.0, *[1.0] * (k - 1)])

    def forecast(weights: np.ndarray) -> Column:
        coef = np.linalg.solve(np.tensordot(weights, gram, 1) + penalty, weights @ pull)
        return sum((F.lit(float(b)) * x for b, x in zip(coef[1:], z[1:], strict=True)), F.lit(float(coef[0])))

    every = np.ones(classes)
    own = [np.where(np.arange(classes) == c, 1.0, OTHERS) if rows[c] >= least else every for c in range(classes)]
    return [forecast(w) for w in own], forecast(every)


def routed(rows: DataFrame, columns: list[str], train_share: float = 0.7, purge: int = 20, alpha: float = 10.0, **gate) -> DataFrame:
    """(date, regime, next_ret, gate_<regime>..., pred_regime, forecast, baseline) of the later rows.

    The first ``train_share`` of the rows is learned from, without its last ``purge`` ones, whose labels
    look into the rest.  ``baseline`` is one ridge without regimes.
    """
    told = numbered(rows.na.drop(subset=[*columns, "regime", "next_ret"]), ["date"], name="_row").withColumn("_row", F.col("_row") + 1)
    cut = int(told.count() * train_share)
    train = told.where(F.col("_row") <= max(cut - purge, 0))
    own, single = experts(train, columns, "regime", "next_ret", alpha)
    gated = Gate(**gate).fit(train, columns, "regime").attach(told.where(F.col("_row") > cut))
    mixed = sum((F.col("gate")[k] * e for k, e in enumerate(own)), F.lit(0.0))
    shown = [F.col("gate")[k].alias(f"gate_{name}") for k, name in enumerate(REGIMES)]
    hard = (F.array_position("gate", F.array_max("gate")) - 1).cast("int")
    return gated.select("date", "regime", "next_ret", *shown, hard.alias("pred_regime"), mixed.alias("forecast"), single.alias("baseline"))


def routing_metrics(routing: DataFrame) -> DataFrame:
    """One row: accuracy and macro-F1 of the router, class shares, trading statistics of the mixture and the single ridge, buy and hold."""
    shares = routing.agg(F.count(F.lit(1)).alias("n_test"), *(F.avg((F.col("regime") == k).cast("double")).alias(f"share_{name}") for k, name in enumerate(REGIMES)), (F.exp(F.sum("next_ret")) - 1).alias("buy_hold_return"))
    out = shares.crossJoin(macro_f1(confusion(routing, "regime", "pred_regime")))
    for name, forecast in (("moe", "forecast"), ("single", "baseline")):
        stats = trading_stats(routing, forecast, "next_ret")
        out = out.crossJoin(stats.select(*(F.col(c).alias(f"{name}_{c}") for c in stats.columns)))
    return out
