"""A classifier with one tanh layer (or none), class weights and an L2 penalty, fitted on all rows at once.

With p the softmax of the scores, the loss is the mean of w[y] * -ln p[y] plus decay / 2 times the squared weights
(not the biases).  Its gradient is summed over blocks of rows by Spark; the driver keeps nothing but the parameters and
takes quasi-Newton steps (limited-memory BFGS).  Up to ``ROWS`` rows lie in one task, which then needs no job for each
gradient.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a task's share, about; pairs of steps that the second-order model remembers.
ROWS, MEMORY = 1 << 17, 10
BLOCK, SUMS = "x binary, y binary", "loss double, gradient binary"


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, near: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with halved steps; ``loss`` gives value and gradient."""
    x, steps = start, []
    value, slope = loss(x)
    for _ in range(rounds):
        if np.abs(slope).max() < near:
            break
        way, kept = slope.copy(), []
        for s, y in reversed(steps):
            a = (s @ way) / (s @ y)
            way -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            way += (a - (y @ way) / (s @ y)) * s
        size = 1.0 if steps else min(1.0, 1.0 / np.abs(slope).max())
        while True:
            told, turned = loss(x - size * way)
            if told <= value - 1e-4 * size * (slope @ way):
                break
            size /= 2
            if size < 1e-10:
                return x
        s, y = -size * way, turned - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        better, x, value, slope = value - told, x + s, told, turned
        if better < 1e-10 * max(1.0, abs(told)):
            break
    return x


class Network:
    """``fit`` learns; ``probabilities`` is an array column, computed in the JVM."""

    def __init__(self, columns: list[str], classes: int, hidden: int, decay: float, rounds: int, seed: int):
        self.columns, self.classes, self.hidden, self.decay, self.rounds, self.seed = columns, classes, hidden, decay, rounds, seed

    def shapes(self) -> list[tuple[int, int]]:
        """Each layer's weights, with a last row for the biases."""
        d, h = len(self.columns), self.hidden
        return [(d + 1, h), (h + 1, self.classes)] if h else [(d + 1, self.classes)]

    def layers(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([a * b for a, b in self.shapes()])
        return [part.reshape(shape) for part, shape in zip(np.split(flat, ends[:-1]), self.shapes(), strict=True)]

    def summed(self, flat: np.ndarray, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
        """Loss and gradient summed over blocks of (scaled factors, classes), without the penalty."""
        layers, loss, out = self.layers(flat), 0.0, np.zeros(len(flat))
        for x, y in blocks:
            inner = np.tanh(x @ layers[0][:-1] + layers[0][-1]) if self.hidden else x
            score = inner @ layers[-1][:-1] + layers[-1][-1]
            score -= score.max(axis=1, keepdims=True)
            total = np.log(np.exp(score).sum(axis=1))
            weight, row = self.weights[y], np.arange(len(y))
            loss += float((weight * (total - score[row, y])).sum())
            pull = np.exp(score - total[:, None])
            pull[row, y] -= 1
            pull *= weight[:, None]
            parts = [np.vstack([inner.T @ pull, pull.sum(axis=0)])]
            if self.hidden:
                back = (pull @ layers[-1][:-1].T) * (1 - inner**2)
                parts.insert(0, np.vstack([x.T @ back, back.sum(axis=0)]))
            out += np.concatenate([p.ravel() for p in parts])
        return loss, out

    def penalised(self, flat: np.ndarray, loss: float, gradient: np.ndarray) -> tuple[float, np.ndarray]:
        kept = np.concatenate([np.vstack([part[:-1], np.zeros((1, part.shape[1]))]).ravel() for part in self.layers(flat)])
        return loss / self.n + self.decay / 2 * float(kept @ kept), gradient / self.n + self.decay * kept

    def fit(self, train: DataFrame, label: Column) -> Network:
        told = train.select(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(self.columns)), label.cast("int").alias("_y"))
        ends = told.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"x{j}").alias(f"m{j}") for j in range(len(self.columns))), *(F.stddev_pop(f"x{j}").alias(f"s{j}") for j in range(len(self.columns)))).first()
        counts = {r["_y"]: r["count"] for r in told.groupBy("_y").count().collect()}
        self.n = max(ends["n"], 1)
        self.mean, self.unit = (np.array([ends[f"{k}{j}"] or 0.0 for j in range(len(self.columns))]) for k in "ms")
        self.unit = np.where(self.unit > 0, self.unit, 1.0)
        self.weights = np.array([self.n / (self.classes * max(counts.get(k, 0), 1)) for k in range(self.classes)])
        rng = np.random.default_rng(self.seed)
        start = np.concatenate([np.vstack([rng.normal(0, 1 / np.sqrt(max(a - 1, 1)), (a - 1, b)), np.zeros((1, b))]).ravel() for a, b in self.shapes()])
        parts = max(1, -(-ends["n"] // ROWS))
        blocks = told.repartition(parts).mapInArrow(self._lay, BLOCK)
        if parts == 1:
            found = blocks.mapInArrow(lambda batches: self._alone(batches, start), SUMS).collect()
            self.flat = np.frombuffer(found[0]["gradient"]) if found else start
            return self
        blocks = blocks.persist()
        try:
            self.flat = minimised(lambda flat: self.penalised(flat, *self._over(blocks, flat)), start, self.rounds)
        finally:
            blocks.unpersist()
        return self

    def _lay(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(len(self.columns))])
            y = b.column("_y").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"x": [((x - self.mean) / self.unit).tobytes()], "y": [y.tobytes()]})

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for r in b.to_pylist():
                y = np.frombuffer(r["y"], np.int64)
                yield np.frombuffer(r["x"]).reshape(len(y), -1), y

    def _alone(self, batches: Iterator[pa.RecordBatch], start: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = list(self._rows(batches))
        if rows:
            flat = minimised(lambda at: self.penalised(at, *self.summed(at, rows)), start, self.rounds)
            yield pa.RecordBatch.from_pydict({"loss": [0.0], "gradient": [flat.tobytes()]})

    def _over(self, blocks: DataFrame, flat: np.ndarray) -> tuple[float, np.ndarray]:
        """The sums over all blocks: each task adds up its own, a few tasks those of all, the driver the rest."""

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient = self.summed(flat, self._rows(batches))
            yield pa.RecordBatch.from_pydict({"loss": [loss], "gradient": [gradient.tobytes()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in b.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pydict({"loss": [sum(r["loss"] for r in rows)], "gradient": [sum(np.frombuffer(r["gradient"]) for r in rows).tobytes()]})

        rows = blocks.mapInArrow(one, SUMS).repartition(8).mapInArrow(add, SUMS).collect()
        return sum(r["loss"] for r in rows), sum(np.frombuffer(r["gradient"]) for r in rows)

    def probabilities(self) -> Column:
        layers = self.layers(self.flat)
        x = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.columns, self.mean, self.unit, strict=True)]
        line = lambda values, part, k: sum((v * F.lit(float(w)) for v, w in zip(values, part[:-1, k], strict=True)), F.lit(float(part[-1, k])))
        if self.hidden:
            # a list of one binds the layer, which is computed once for all classes
            inner = F.array(*(F.tanh(line(x, layers[0], k)) for k in range(self.hidden)))
            scores = F.transform(F.array(inner), lambda h: F.array(*(line([h[k] for k in range(self.hidden)], layers[1], c) for c in range(self.classes))))[0]
        else:
            scores = F.array(*(line(x, layers[0], c) for c in range(self.classes)))
        raised = F.transform(F.array(scores), lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s))))[0]
        return F.transform(F.array(raised), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]
