"""Vectorised word and shingle hashing of whole batches of texts (numpy).

A batch's UTF-8 texts are laid end to end with a blank between them, so that words never cross
texts.  Hashes have 64 bits and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes that are worked on at once; one longer text is taken whole.
CHUNK = 2 << 20
#: Odd multipliers (SplitMix64's and its successors by squaring).
MIX1, MIX2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SPACE = 0x20


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


BYTE_CODES = splitmix(np.arange(256, dtype=np.uint64))


def powers(n: int, base: int = 0x9E3779B97F4A7C15 | 1) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts have about CHUNK bytes, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
        part = np.cumsum(pc.binary_length(texts).to_numpy()) // CHUNK
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(low, high - low), texts.slice(low, high - low).to_pylist()


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first[k], first[k] + 1, ... (count[k] of them) of all k, end to end."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def byte_set(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Bytes that part words: white space alone, or all of ASCII but digits and letters.
WHITE = byte_set([0x20, 9, 10, 11, 12, 13])
NOT_ALNUM = byte_set(b for b in range(128) if not chr(b).isalnum())


class Words:
    """Words of a batch: ``hash`` of each, ``doc`` (index of its text), and ``first`` (index of a text's first word)."""

    def __init__(self, texts: list[bytes], parts: np.ndarray = WHITE):
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths + 1)])
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        inside = ~parts[data]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = ends - starts
        at = np.flatnonzero(inside)
        place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        value = BYTE_CODES[lower[data[at]]] * powers(int(size.max(initial=0)))[place]
        self.hash = splitmix(np.add.reduceat(value, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64))
        self.doc = np.searchsorted(self.offset, starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.size, self.at = size, np.cumsum(size) - size
        self.value = value

    def prefixes(self, length: int) -> np.ndarray:
        """Hashes of the words' first ``length`` bytes; 0 for shorter words."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value)])
        long = self.size >= length
        out = np.zeros(len(self.size), np.uint64)
        out[long] = splitmix(total[self.at[long] + length] - total[self.at[long]] + np.uint64(length))
        return out


def shingle_hashes(texts: list[bytes], n: int) -> tuple[np.ndarray, Words]:
    """The hashes of all runs of ``n`` words in the batch, those across texts included, and its words."""
    words = Words(texts)
    factor = powers(n + 1, int(MIX1))[1:]
    whole = len(words.hash) - n + 1
    grams = np.zeros(max(whole, 0), dtype=np.uint64)
    for k in range(n if whole > 0 else 0):
        grams += words.hash[k : k + whole] * factor[k]
    return splitmix(grams), words


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct ``n``-word shingles as sorted 64-bit hashes; fewer words make one shingle."""
    grams, words = shingle_hashes(texts, n)
    factor = powers(n + 1, int(MIX1))[1:]
    out = []
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            few = (words.hash[a:b] * factor[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(splitmix(np.array([few], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
