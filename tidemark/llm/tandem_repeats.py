"""All runs of a string of numbers by Gusfield and Stoye's way over its tandem repeats (numpy, walks in Python).

1. The string is cut into Lempel-Ziv blocks.  Extensions to both sides of the block borders report squares
   that cover, rotated to the right, the leftmost occurrence of every square.  Only squares of a primitive word
   are kept: every other square lies in the same run as one of these.
2. Each reported square is located in the suffix tree.
3. From each located square, suffix links lead to the next rotation as long as the tree has it: these walks
   complete the vocabulary of squares.
4. The leaves below a located square are all its occurrences.  Squares of one period at consecutive starts
   make a run.

The suffix tree is that of the suffix array and its longest common prefixes; extensions are read off the ranks
of all substrings of 1, 2, 4, ... numbers.  Time and memory grow with the string's length times its logarithm.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.shingling import ragged


class Ranks:
    """Ranks of the substrings of each length 2 ** k; the string's last number must stand nowhere else."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        order = np.argsort(text, kind="stable")
        rank, wide = np.zeros(n, np.int64), np.ones(n, bool)
        self._place(rank, order, text[order], np.zeros(n, np.int64), np.arange(n))
        self.levels = [rank.astype(np.int32)]
        open_, width = np.arange(n), 1
        while True:
            wide = np.bincount(rank[open_], minlength=n)
            open_ = open_[wide[rank[open_]] > 1]
            if not len(open_):
                break
            key = rank[open_] * (n + 1) + rank[np.minimum(open_ + width, n - 1)]
            order = np.argsort(key, kind="stable")
            at, key = open_[order], key[order]
            base = rank[at]
            first = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
            inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            self._place(rank, at, key, base, inside)
            width *= 2
            self.levels.append(rank.astype(np.int32))
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.rank = rank

    @staticmethod
    def _place(rank: np.ndarray, at: np.ndarray, key: np.ndarray, base: np.ndarray, inside: np.ndarray) -> None:
        """Equal keys share the least place of theirs in the order."""
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = base + inside[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i and from j (different places) agree."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            out += (self.levels[k][i + out] == self.levels[k][j + out]).astype(np.int64) << k
        return out

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers up to i and up to j, these included, agree; places below 0 agree with none."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            same = (a >= 0) & (b >= 0)
            same[same] = self.levels[k][a[same]] == self.levels[k][b[same]]
            out += same.astype(np.int64) << k
        return out


class SuffixTree:
    """Leaves are numbered by rank, then the root, then the other inner nodes."""

    def __init__(self, text: np.ndarray, ranks: Ranks):
        n, order = ranks.n, ranks.order
        self.root = n
        shared = np.zeros(n + 1, np.int64)
        shared[1:n] = ranks.after(order[:-1], order[1:]) if n > 1 else 0
        shared[n] = -1
        parent, depth = [n] * (n + 1), (n - order).tolist() + [0]
        low, high = [*range(n), 0], [*range(n), n - 1]
        stack = [n]
        for r, common in enumerate(shared.tolist()[1:], 1):
            last = r - 1  # the leaf or the node just closed
            while stack and depth[stack[-1]] > common:
                top = stack.pop()
                parent[last], high[top] = top, r - 1
                last = top
            if not stack:
                break
            if depth[stack[-1]] < common:
                parent.append(n)
                depth.append(common)
                low.append(low[last])
                high.append(r - 1)
                stack.append(len(depth) - 1)
            parent[last] = stack[-1]
        parent[n] = n
        self.parent, self.depth, self.low, self.high = (np.array(x, np.int64) for x in (parent, depth, low, high))
        self.ups = [self.parent]
        while (self.ups[-1] != n).any():
            self.ups.append(self.ups[-1][self.ups[-1]])
        inner = np.arange(n + 1, len(depth))
        self.link = np.full(len(depth), n, np.int64)
        self.link[inner] = self.locus(ranks.rank[order[self.low[inner]] + 1], self.depth[inner] - 1)
        below = np.concatenate([np.arange(n), inner])
        above = self.parent[below]
        self.span = int(text.max(initial=0)) + 1
        keys = above * self.span + text[order[self.low[below]] + self.depth[above]]
        self.child = dict(zip(keys.tolist(), below.tolist(), strict=True))

    def locus(self, leaf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The highest node above each leaf (or itself) that is at least ``length`` deep."""
        node = leaf.copy()
        for up in reversed(self.ups):
            higher = up[node]
            node = np.where(self.depth[higher] >= length, higher, node)
        return node


def blocks(ranks: Ranks) -> np.ndarray:
    """The starts of the Lempel-Ziv blocks, and the string's end: a block is the longest prefix that also starts earlier."""
    order = ranks.order.tolist()
    n = ranks.n
    smaller_before, smaller_after, stack = [-1] * n, [-1] * n, []
    for i in order:
        while stack and stack[-1] > i:
            smaller_after[stack.pop()] = i
        smaller_before[i] = stack[-1] if stack else -1
        stack.append(i)
    longest = np.zeros(n, np.int64)
    for other in (np.array(smaller_before, np.int64), np.array(smaller_after, np.int64)):
        has = np.flatnonzero(other >= 0)
        longest[has] = np.maximum(longest[has], ranks.after(has, other[has]))
    step, out, at = np.maximum(longest, 1).tolist(), [], 0
    while at < n:
        out.append(at)
        at += step[at]
    return np.array([*out, n], np.int64)


def primitive(ranks: Ranks, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the first half of each square is no power of a shorter word."""
    top = int(half.max(initial=1)) + 1
    least = np.arange(top)
    for p in range(2, int(top**0.5) + 1):
        if least[p] == p:
            part = least[p * p :: p]
            part[part == np.arange(p * p, top, p)] = p
    out, rest = np.ones(len(half), bool), half.copy()
    while (left := np.flatnonzero(out & (rest > 1))).size:
        factor = least[rest[left]]
        period = half[left] // factor
        out[left] = ranks.after(start[left], start[left] + period) < 2 * half[left] - period
        rest[left] //= factor
    return out


def covering_squares(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of primitive squares that cover the leftmost occurrence of every one."""
    cuts = blocks(ranks)
    begin, end = cuts[:-1], cuts[1:]
    size = end - begin
    after_next = np.append(size[1:], 0)
    found = []
    # centre in the block, the end beyond it
    half = ragged(np.ones(len(size), np.int64), size)
    border = np.repeat(end, size)
    half, border = half[border < ranks.n], border[border < ranks.n]
    found.append((border, border - half, half))
    # begun before the block
    count = np.minimum(size + after_next, ranks.n - 1 - begin)
    half, border = ragged(np.ones(len(count), np.int64), count), np.repeat(begin, count)
    found.append((border + half, border, half))
    starts, halves = [], []
    for right, left, half in found:
        forward = ranks.after(right, left)
        keep = forward > 0
        right, left, half, forward = right[keep], left[keep], half[keep], forward[keep]
        backward = ranks.before(right - 1, left - 1)
        keep = forward + backward >= half
        starts.append(np.maximum(left - backward, left - half + 1)[keep])
        halves.append(half[keep])
    start, half = np.concatenate(starts), np.concatenate(halves)
    keys = np.unique(start * (ranks.n + 1) + half)
    start, half = keys // (ranks.n + 1), keys % (ranks.n + 1)
    keep = primitive(ranks, start, half)
    return start[keep], half[keep]


def vocabulary(text: np.ndarray, ranks: Ranks, tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(node, half length) of every primitive square that stands in the string."""
    start, half = covering_squares(ranks)
    node = tree.locus(ranks.rank[start], 2 * half)
    limit = 2 * ranks.n + 1
    marks = set((node * limit + 2 * half).tolist())
    symbols, parent, depth, link, child, span = text.tolist(), tree.parent.tolist(), tree.depth.tolist(), tree.link.tolist(), tree.child, tree.span
    first = ranks.order[tree.low].tolist()  # an occurrence of each node
    for mark in list(marks):
        v, length = divmod(mark, limit)
        i = first[v]
        while True:
            symbol, x = symbols[i], link[parent[v]]
            while depth[x] < length - 1:
                x = child[x * span + symbols[i + 1 + depth[x]]]
            if depth[x] == length - 1:
                v = child.get(x * span + symbol)
                if v is None:
                    break
                i = first[v]
            elif symbols[i + length] == symbol:
                v, i = x, i + 1
            else:
                break
            mark = v * limit + length
            if mark in marks:
                break
            marks.add(mark)
    told = np.fromiter(marks, np.int64, len(marks))
    return told // limit, told % limit // 2


def find_runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of every run of at least two periods, by start and period.

    ``text`` has numbers from 0; its last one must stand nowhere else.
    """
    if len(text) < 2:
        return (np.zeros(0, np.int64),) * 3
    ranks = Ranks(text)
    tree = SuffixTree(text, ranks)
    node, half = vocabulary(text, ranks, tree)
    count = tree.high[node] - tree.low[node] + 1
    start, period = ranks.order[ragged(tree.low[node], count)], np.repeat(half, count)
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    new = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(start)) - 1
    begin, period = start[new], period[new]
    length = start[last[: len(new)]] - begin + 2 * period
    order = np.lexsort((period, begin))
    return begin[order], length[order], period[order]
