"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def minimax(sizes: list[int], k: int) -> int:
    """The smallest largest piece of any cut into k contiguous pieces, by dynamic programming."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = ends[:]
    for _ in range(k - 1):
        best = [min((max(best[j], ends[i] - ends[j]) for j in range(i + 1)), default=0) for i in range(len(ends))]
    return best[-1]


def mix_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full, target = 1.5 * sum(sizes.values()), {}, {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        left = total - sum(full.values())
        target = full | {s: left * w / sum(rest.values()) for s, w in rest.items()}
        above = {s: 2.0 * sizes[s] for s in rest if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def contamination(docs: list[tuple], items: list[tuple]) -> dict:
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(ASCII_LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = ITEM_WORD.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WS_WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WS_WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def shingles(text: str | None, n: int = 4) -> frozenset:
    w = WS_WORD.findall((text or "").translate(ASCII_LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def components(ids: list, pairs: list[tuple]) -> dict:
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_components(docs: list[tuple], n: int = 4, percent: int = 85) -> dict:
    sets = [(d, shingles(t, n)) for d, t in docs]
    pairs = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    part = components([d for d, _ in sets], pairs)
    return {d: (len(s), part[d]) for d, s in sets}


def repeats(docs: list[tuple], length: int = 200) -> dict:
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = {}
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
