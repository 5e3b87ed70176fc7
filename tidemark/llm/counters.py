"""A table of hash counters over a whole corpus: which hashes are frequent, in memory that does not grow with it.

Counters are shared by many hashes, so that a count is an upper bound.  The table only orders and deals
work; no result depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shingling import chunks

#: The table has 2 ** COUNTERS counters, which travel in SLICES parts.
COUNTERS, SLICES = 20, 64
#: A counter with so many hits, and 16 times the mean, marks its hashes as frequent.
FREQUENT = 1024


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)


def frequent(hits: np.ndarray) -> np.ndarray:
    return hits >= max(FREQUENT, 16 * hits.mean())


def hit_table(docs: DataFrame, hashes: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """Hits of each counter over the ``hashes`` of all texts."""
    width = (1 << COUNTERS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for _, texts in chunks(batches):
            total += np.bincount(counter_of(hashes(texts)), minlength=1 << COUNTERS)
        if total.any():
            parts = [total[k * width : (k + 1) * width].astype(np.uint32).tobytes() for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array(parts, pa.binary())], ["slice", "hits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "hits"])

    shape = "slice bigint, hits binary"
    out = np.zeros(1 << COUNTERS, np.int64)
    for r in docs.select("text").mapInArrow(count, shape).repartition("slice").mapInArrow(add, shape).collect():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["hits"], np.int64)
    return out
