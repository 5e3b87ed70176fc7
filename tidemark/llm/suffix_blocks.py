"""Blockwise suffix sorting with a difference cover, to find repeated windows of a text (numpy).

A difference cover D modulo V has, for any two positions, an offset below V that takes both into the
sample {i : i mod V in D}.  The sample's suffixes are ranked first, by prefix doubling in steps of V.
The other suffixes are then sorted one bucket at a time (buckets are ranges of the first word), by
their first V bytes; longer ties are resolved by the ranks at the offset the cover gives, so no
comparison reads more than V bytes and memory stays bounded by the sample and one bucket.

Ties are resolved for all groups at once by three-way partitioning around a random member of each.
"""

from __future__ import annotations

import numpy as np

V = 32
BUCKET = 1 << 18


def difference_cover(v: int) -> list[int]:
    """A small difference cover modulo ``v``: the member that covers most missing differences is added next."""
    cover = [0]
    missing = set(range(1, v))
    while missing:
        gain = lambda c: len({d for x in cover for d in ((c - x) % v, (x - c) % v)} & missing)
        best = max(range(v), key=lambda c: (gain(c), -c))
        missing -= {d for x in cover for d in ((best - x) % v, (x - best) % v)}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(V)
IN_COVER = np.isin(np.arange(V), COVER)
#: OFFSET[r, s]: the least d with (r + d) mod V and (s + d) mod V both in the cover.
OFFSET = np.array([[next(d for d in range(V) if IN_COVER[(r + d) % V] and IN_COVER[(s + d) % V]) for s in range(V)] for r in range(V)], dtype=np.int64)


def big_endian_words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number that orders as they do; zeros beyond the end."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = wide[: len(text)] << np.uint64(56)
    for k in range(1, 8):
        out |= wide[k : k + len(text)] << np.uint64(56 - 8 * k)
    return out


def dense(changed: np.ndarray) -> np.ndarray:
    return np.cumsum(changed) - 1


def sample_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """At each sample position its suffix's rank by at least ``depth`` bytes (from 1; 0 elsewhere)."""
    at = np.flatnonzero(IN_COVER[np.arange(len(words)) % V])
    padded = np.concatenate([words, np.zeros(V, np.uint64)])
    keys = [padded[at + k] for k in range(0, V, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(at), np.int64)
    rank[order] = dense(new) + 1
    out, done = np.zeros(len(words) + 2 * depth + V, np.int64), V
    while True:
        out[at] = rank
        if done >= depth or rank.max(initial=0) == len(at):
            return out
        key = (rank << 32) | out[at + done]
        order = np.argsort(key, kind="stable")
        rank[order] = dense(np.concatenate([[True], key[order][1:] != key[order][:-1]])) + 1
        done *= 2


def groups_of(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, size) of each run of equal labels."""
    first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(label) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(label)))


def with_company(at: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the members that are alone in their group; labels made dense."""
    first, size = groups_of(label)
    keep = np.repeat(size > 1, size)
    kept = label[keep]
    return at[keep], dense(np.concatenate([[True], kept[1:] != kept[:-1]])) if len(kept) else kept


def resolve_ties(at: np.ndarray, label: np.ndarray, rank: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The positions in order; ``label`` groups those with equal first V bytes and ascends."""
    at, label = at.copy(), label.copy()
    open_ = np.arange(len(at))
    while len(open_):
        first, size = groups_of(label[open_])
        size_of = np.repeat(size, size)
        open_, one = open_[size_of > 1], label[open_][size_of > 1]
        if not len(open_):
            break
        first, size = groups_of(one)
        pivot = np.repeat(at[open_[first + (rng.random(len(first)) * size).astype(np.int64)]], size)
        here = at[open_]
        shift = OFFSET[here % V, pivot % V]
        side = np.sign(rank[here + shift] - rank[pivot + shift])
        order = np.lexsort((side, one))
        at[open_], side, one = here[order], side[order], one[order]
        unequal = side != 0
        # labels keep ascending: three for each old one
        label = label * 3 + 1
        label[open_] += side
        open_ = open_[unequal]
        if len(label) and label.max() > 1 << 60:
            label = dense(np.concatenate([[True], label[1:] != label[:-1]]))
    return at


def repeated_windows(text: np.ndarray, starts: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """For each start, whether the ``length`` bytes from it also stand at another of the starts."""
    words = big_endian_words(text)
    rank = sample_ranks(words, length)
    rng = np.random.default_rng(seed)
    repeated = np.zeros(len(text) + 1, bool)
    words = np.concatenate([words, np.zeros(length + 8, np.uint64)])
    lead = words[starts]
    splits = np.unique(np.sort(lead[rng.integers(0, len(lead), min(len(lead), 4096))])[:: max(1, 4096 * BUCKET // max(len(lead), 1))]) if len(lead) > BUCKET else np.zeros(0, np.uint64)
    bucket = np.searchsorted(splits, lead, side="right") if len(splits) else np.zeros(len(lead), np.int64)
    for b in range(len(splits) + 1):
        at = starts[bucket == b] if len(splits) else starts
        label = np.zeros(len(at), np.int64)
        for k in range(0, V, 8):
            key = words[at + k]
            order = np.argsort(key, kind="stable") if k == 0 else np.lexsort((key, label))
            at, key, label = at[order], key[order], label[order]
            if len(at):
                label = dense(np.concatenate([[True], (key[1:] != key[:-1]) | (label[1:] != label[:-1])]))
            at, label = with_company(at, label)
        at = resolve_ties(at, label, rank, rng)
        # neighbours in the sorted order have the longest common prefixes
        a, c = at[:-1], at[1:]
        for k in range(0, length - 7, 8):
            same = words[a + k] == words[c + k]
            a, c = a[same], c[same]
        if length % 8:
            same = words[a + length - 8] == words[c + length - 8]
            a, c = a[same], c[same]
        repeated[a] = repeated[c] = True
    return repeated[starts]
