"""Periodic runs of words in whole texts: where they stand, and the text with each run cut to its first period.

A run is a stretch of consecutive words with smallest period q, at least ``max(LEAST, 2 q)`` long, that no
neighbouring word extends.  Runs are found by the linear tandem-repeat method of ``tandem_repeats``: Lempel-Ziv
blocks give squares that cover the leftmost ones, suffix-link walks complete the vocabulary, and the located
occurrences are merged.

A task takes some megabytes of texts at a time, each text whole.  Every word of a run stands in a group of
``LEAST / 2`` consecutive words that recurs in the run, so that only stretches of recurring groups are searched;
those of all texts at hand share one suffix tree.  Nothing is shuffled.  Memory is bounded by the words at hand,
or those of the longest text.

Cases: a null or empty text has no words and no run; words are parted by blank and \\t \\n \\v \\f \\r and compared
byte for byte; every row is a document, whatever its doc_id (null and repeated ids too); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.shingling import chunks, powers, splitmix
from tidemark.llm.tandem_repeats import find_runs

LEAST = 12
RUNS = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def recurring(words: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """A number from 1 for each maximal stretch of words in groups of ``size`` that recur within ``group``; 0 elsewhere.

    Groups are compared by 64-bit hashes; equal hashes of different groups only make a stretch longer.
    """
    n = len(words)
    if n < size:
        return np.zeros(n, np.int64)
    hashed, factor = splitmix(words.astype(np.uint64)), powers(size + 1)[1:]
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += hashed[k : n - size + 1 + k] * factor[k]
    at = np.flatnonzero((group[: n - size + 1] == group[size - 1 :]) & (group[: n - size + 1] > 0))
    key = splitmix(total[at] ^ splitmix(group[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    at = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)
    inside = np.cumsum(edge)[:n] > 0
    begins = inside & ~(np.concatenate([[False], inside[:-1] & (group[1:] == group[:-1])]))
    return np.where(inside, np.cumsum(begins), 0)


def runs_of(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs of at least ``least`` words, which no run crosses ``doc`` in."""
    stretch = doc + 1
    for _ in range(3):  # what recurs in a text, then in a stretch of it alone
        stretch = recurring(words, stretch, -(-least // 2))
    at = np.flatnonzero(stretch)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    last = np.flatnonzero(np.append(stretch[at][1:] != stretch[at][:-1], True))
    _, dense = np.unique(words[at], return_inverse=True)
    text = np.insert(dense, last + 1, int(dense.max()) + 1 + np.arange(len(last)))  # a word of its own ends each stretch
    place = np.insert(at, last + 1, -1)
    start, length, period = find_runs(text)
    keep = length >= least
    return place[start[keep]], length[keep], period[keep]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: runs by start and period, word numbers from 0.

    ``collapsed`` has the words joined by one blank, without those that stand in any run after its first period.
    """
    kinds = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(RUNS).fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            index: dict[bytes, int] = {}
            split = [t.split() for t in texts]
            size = np.array([len(ws) for ws in split], np.int64)
            words = np.array([index.setdefault(w, len(index)) for ws in split for w in ws], np.int64)
            first = np.cumsum(size) - size
            start, length, period = runs_of(words, np.repeat(np.arange(len(texts)), size), least)
            doc = np.searchsorted(first, start, side="right") - 1 if len(start) else start
            dropped = np.bincount(start + period, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1)
            dropped = np.cumsum(dropped) > 0
            kept = []
            has = np.bincount(doc, minlength=len(texts))
            for k, ws in enumerate(split):
                if has[k]:
                    gone = dropped[first[k] : first[k] + size[k]].tolist()
                    ws = [w for w, g in zip(ws, gone, strict=True) if not g]
                kept.append(b" ".join(ws))
            fields = [pa.array(x, pa.int64()) for x in (start - first[doc] if len(doc) else start, length, period)]
            told = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]), pa.int32()), told)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), runs, pa.array(kept, pa.binary()).cast(pa.string())], kinds.names)

    return docs.select("doc_id", "text").mapInArrow(search, kinds)
