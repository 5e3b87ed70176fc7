"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks.  A block's features are its ancestors' elements and name tokens
and a few measures of its text (length, links, punctuation, place); the chain has a weight for each
pair of neighbouring labels.  The weights maximise the penalised likelihood of labelled sample pages
(forward-backward over all pages at once, Adam); Viterbi decodes a page.

The training pages are invented by ``dom_blocks.sample_page`` with known labels, so that the model
depends on no table; ``fit`` takes any other labelled pages.

Cases: a null page, or one without kept blocks, has the empty text; unclosed or cut markup ends with
the page; scripts, styles and comments never reach a block; repeated rows are extracted alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.dom_blocks import Block, blocks, sample_page

#: Elements that make a part of a page; a block's innermost one is a feature.
PARTS = frozenset(("article", "aside", "section", "nav", "header", "footer", "main", "form", "div", "blockquote", "ol", "table"))
PAGES, SEED = 900, 3
STEPS, RATE, DECAY = 150, 0.2, 3e-5


def path_features(path: tuple) -> list[str]:
    """Elements and name tokens of a block's ancestors; a label wrapper without name leaves no trace."""
    seen = {f"in:{element}" for element, _ in path} | {f"name:{t}" for _, names in path for t in names}
    if path:
        seen.add(f"own:{path[-1][0]}")
        seen.update(f"own-name:{t}" for t in path[-1][1])
    seen.update(f"near:{t}" for t in next((names for _, names in reversed(path) if names), ()))
    seen.add(f"part:{next((e for e, _ in reversed(path) if e in PARTS), '')}")
    seen -= {"in:div", "in:html", "in:body"}
    return sorted(seen)


def text_features(block: Block, place: int, count: int) -> list[str]:
    n, share = len(block.text), block.linked / len(block.text)
    out = [f"len:{min(9, n.bit_length())}", f"link:{0 if share == 0 else 1 if share < 0.35 else 2 if share < 0.8 else 3}", f"third:{3 * place // count}"]
    if block.text[-1] in ".!?":
        out.append("sentence")
    if "©" in block.text:
        out.append("copyright")
    if place == count - 1:
        out.append("last")
    return out


@dataclass
class Crf:
    weight: dict[str, float]
    move: np.ndarray
    begin: float
    cache: dict = field(default_factory=dict)

    def emission(self, block: Block, place: int, count: int) -> float:
        """How much the block's features favour main text."""
        known = self.cache.get(block.path)
        if known is None:
            known = sum(self.weight.get(f, 0.0) for f in path_features(block.path))
            if len(self.cache) < 100_000:
                self.cache[block.path] = known
        return known + sum(self.weight.get(f, 0.0) for f in text_features(block, place, count))

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the likeliest labels."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        zero, one = 0.0, self.begin + self.emission(page[0], 0, len(page))
        back: list[tuple[int, int]] = []
        for k in range(1, len(page)):
            e = self.emission(page[k], k, len(page))
            a, b, c, d = zero + m00, one + m10, zero + m01, one + m11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + e
        out = [int(one > zero)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def fit(pages: Iterable[list[Block]]) -> Crf:
    """Maximum penalised likelihood from pages whose blocks have labels "0" or "1"."""
    pages = [p for p in pages if p]
    names: dict[str, int] = {"bias": 0}
    page_of, place_of, feature, row = [], [], [], []
    longest = max(map(len, pages), default=1)
    gold = np.zeros((len(pages), longest), np.int64)
    real = np.zeros((len(pages), longest), bool)
    n = 0
    for i, page in enumerate(pages):
        for k, block in enumerate(page):
            gold[i, k], real[i, k] = block.label == "1", True
            for f in ("bias", *path_features(block.path), *text_features(block, k, len(page))):
                feature.append(names.setdefault(f, len(names)))
                row.append(n)
            page_of.append(i)
            place_of.append(k)
            n += 1
    feature, row, page_of, place_of = map(np.array, (feature, row, page_of, place_of))
    last = real.sum(axis=1) - 1
    theta = np.zeros(len(names) + 5)  # features, four moves, begin
    first_m, second_m = np.zeros_like(theta), np.zeros_like(theta)
    every = np.arange(len(pages))
    wanted = np.zeros_like(theta)
    np.add.at(wanted, feature[gold[page_of, place_of][row] == 1], 1.0)
    pair = real[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            wanted[len(names) + 2 * a + b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & pair).sum()
    wanted[-1] = gold[:, 0].sum()
    for step in range(1, STEPS + 1):
        emit = np.zeros((len(pages), longest, 2))
        emit[page_of, place_of, 1] = np.bincount(row, weights=theta[feature], minlength=n)
        move = theta[len(names) : -1].reshape(2, 2)
        emit[:, 0, 1] += theta[-1]
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for k in range(1, longest):
            forward[:, k] = np.where(real[:, k, None], emit[:, k] + np.logaddexp(forward[:, k - 1, :1] + move[0], forward[:, k - 1, 1:] + move[1]), forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            ahead = backward[:, k + 1] + emit[:, k + 1]
            backward[:, k] = np.where((k < last)[:, None], np.stack([np.logaddexp(ahead[:, 0] + move[s, 0], ahead[:, 1] + move[s, 1]) for s in (0, 1)], axis=1), 0.0)
        z = np.logaddexp(forward[every, last, 0], forward[every, last, 1])
        on = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]) * real
        expected = np.zeros_like(theta)
        expected[: len(names)] = np.bincount(feature, weights=on[page_of, place_of][row], minlength=len(names))
        for a in (0, 1):
            for b in (0, 1):
                p = forward[:, :-1, a] + move[a, b] + (emit + backward)[:, 1:, b] - z[:, None]
                expected[len(names) + 2 * a + b] = np.exp(np.where(pair, p, -np.inf)).sum()
        expected[-1] = on[:, 0].sum()
        grad = (expected - wanted) / n + DECAY * theta
        first_m, second_m = 0.9 * first_m + 0.1 * grad, 0.999 * second_m + 0.001 * grad * grad
        theta = theta - RATE * (first_m / (1 - 0.9**step)) / (np.sqrt(second_m / (1 - 0.999**step)) + 1e-8)
    weight = {f: float(theta[k]) for f, k in names.items() if f != "bias"}
    bias = float(theta[0])
    move = theta[len(names) : -1].reshape(2, 2).copy()
    move[:, 1] += bias
    return Crf(weight, move, float(theta[-1]) + bias)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    rng = random.Random(SEED)
    return fit(blocks(sample_page(rng)) for _ in range(PAGES))


def main_text(page: str | None, model: Crf) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, shared.value) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
