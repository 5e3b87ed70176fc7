"""The gate network: its gradient against differences, blocks against one task, class weights and penalty at work."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import network
from tidemark.operators.mixture import Gate


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 2))
    y = np.where(x[:, 0] ** 2 + x[:, 1] ** 2 > 4.5, 2, np.where(x[:, 0] > 0.5, 1, 0))  # class 2 is rare and no line parts it
    return x, y, spark.createDataFrame(pd.DataFrame({"a": 5 + 3 * x[:, 0], "b": x[:, 1], "y": y})).cache()


@pytest.mark.parametrize("hidden", [0, 5])
def test_gradient_against_differences(hidden):
    rng = np.random.default_rng(1)
    net = network.Network(["a", "b", "c"], 4, hidden, 0.3, 10, 0)
    net.n, net.weights = 50, np.array([1.0, 2.0, 0.5, 3.0])
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 4, 50)
    flat = rng.normal(size=sum(a * b for a, b in net.shapes()))
    loss = lambda at: net.penalised(at, *net.summed(at, [(x[:20], y[:20]), (x[20:], y[20:])]))
    _, slope = loss(flat)
    for k in range(len(flat)):
        step = np.eye(len(flat))[k] * 1e-6
        assert slope[k] == pytest.approx((loss(flat + step)[0] - loss(flat - step)[0]) / 2e-6, abs=1e-6)


def test_minimum_of_a_known_function():
    target = np.array([1.0, -2.0, 3.0])
    found = network.minimised(lambda x: (float((np.array([1, 10, 100]) * (x - target) ** 2).sum()), 2 * np.array([1, 10, 100]) * (x - target)), np.zeros(3), 100)
    assert np.allclose(found, target, atol=1e-5)


@pytest.mark.parametrize("hidden", [0, 6])
def test_blocks_give_what_one_task_gives(rows, monkeypatch, hidden):
    _, _, df = rows
    alone = network.Network(["a", "b"], 3, hidden, 0.01, 25, 3).fit(df, F.col("y"))
    monkeypatch.setattr(network, "ROWS", 250)
    dealt = network.Network(["a", "b"], 3, hidden, 0.01, 25, 3).fit(df, F.col("y"))
    assert np.allclose(alone.flat, dealt.flat, atol=1e-3)
    p = np.array([r[0] for r in df.select(alone.probabilities()).collect()])
    x = np.array([(r["a"], r["b"]) for r in df.collect()])
    z = (x - alone.mean) / alone.unit
    layers = alone.layers(alone.flat)
    inner = np.tanh(z @ layers[0][:-1] + layers[0][-1]) if hidden else z
    e = np.exp(inner @ layers[-1][:-1] + layers[-1][-1])
    assert np.allclose(p, e / e.sum(axis=1, keepdims=True))


def test_weights_penalty_and_accuracy(rows):
    _, y, df = rows
    shares = np.bincount(y) / len(y)
    assert shares[2] < 0.2
    right, norms = [], []
    for seed in range(4):
        gate = Gate(8, 150, 0.001, seed=seed).fit(df, ["a", "b"], "y")
        got = np.array([(r["y"], int(np.argmax(r["gate"]))) for r in gate.attach(df).collect()])
        right.append((got[:, 0] == got[:, 1]).mean())
        assert (got[got[:, 0] == 2, 1] == 2).mean() > 0.8  # the rare class is not passed over
    assert min(right) > 0.85
    for decay in (0.0, 0.01, 0.3):
        gate = Gate(8, 150, decay).fit(df, ["a", "b"], "y")
        norms.append(sum((part[:-1] ** 2).sum() for part in gate.model.layers(gate.model.flat)))
    assert norms[0] > norms[1] > norms[2]
    assert Gate(0).fit(df.limit(0), ["a", "b"], "y").attach(df).count() == len(y)
