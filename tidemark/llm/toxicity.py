"""A counterfactual-regularised toxicity classifier.

Logistic regression over words and word beginnings, by their density in the text.  Each labelled text
of the fit gives a counterfactual pair: a text that names an identity group, and the same with every term
swapped for another of its list; or, of a text that names none, one of its sentences and the same sentence
with a term put in.  The squared change of the score's logit between the two is a penalty of the fit, so
that a group's mention alone moves no score.

Fit: document frequencies of all labelled rows choose the ``KEPT`` features; the weights are learned
from at most ``SAMPLE`` labelled rows (those with the smallest hash of doc_id and seed).

Cases: a null or empty text has no features and gets the score of the intercept; labels without
document, null labels and documents without label take no part in the fit; a doc_id with several
labels counts as toxic if one says so; without training rows every score is 0; an empty table gives
an empty result; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import materialise
from tidemark.llm.shingling import NOT_ALNUM, Words, chunks

#: Names of groups that are swapped for one another, by language.
IDENTITY_TERMS = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "gays", "lesbians", "immigrants", "africans", "asians", "arabs"),
    ("woman", "man", "muslim", "christian", "jewish", "hindu", "gay", "lesbian", "immigrant", "african", "asian", "arab"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "africains", "arabes"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer", "afrikaner", "araber"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "africanos", "árabes"),
)
PREFIXES = (4, 5, 6, 7)
FEATURE_BITS = 20
KEPT, SAMPLE = 6000, 20_000
PENALTY, DECAY, STEPS, RATE = 1.0, 2e-4, 300, 0.3
#: Labels (12 bytes each) that are sent to every executor; more are joined by a shuffle of the texts.
BROADCAST_LABELS = 2_000_000


def lower(texts: list[bytes]) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode() for t in texts]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text index) of every occurrence, and each text's number of words."""
    words = Words(lower(texts), NOT_ALNUM)
    own, found = [words.doc], [words.hash]
    for k in PREFIXES:
        first = words.prefixes(k)
        own.append(words.doc[first != 0])
        found.append(first[first != 0])
    return (np.concatenate(found) & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64), np.concatenate(own), np.diff(words.first)


def weighted(texts: list[bytes], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature, value) of the wanted features: log(1 + 100 x share of the words)."""
    feature, doc, n = features(texts)
    keep = wanted[feature]
    key, count = np.unique((doc[keep] << FEATURE_BITS) | feature[keep], return_counts=True)
    doc, feature = key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1)
    return doc, feature, np.log1p(100.0 * count / np.maximum(n[doc], 1))


def term_features(term: str) -> np.ndarray:
    return np.unique(features([term.encode()])[0])


NAMED = re.compile(r"[^\W\d_]+")
#: Where a sentence ends, and the words of one that are kept.
SENTENCE, LONGEST = re.compile(r"(?<=[.!?])\s+|\n+"), 30


def swapped(text: str, k: int) -> str | None:
    """The text with each identity term replaced by another of its list, the ``k``-th after it; None if it has none."""
    hit = False

    def other(m: re.Match) -> str:
        nonlocal hit
        for terms in IDENTITY_TERMS:
            if m[0].lower() in terms:
                hit = True
                return terms[(terms.index(m[0].lower()) + 1 + k % (len(terms) - 1)) % len(terms)]
        return m[0]

    out = NAMED.sub(other, text)
    return out if hit else None


def counterfactual(text: str, k: int) -> tuple[str, str]:
    """(one, other): two texts that should score alike; ``k`` chooses sentence, term and place."""
    other = swapped(text, k)
    if other is not None:
        return text, other
    sentences = [x.split()[:LONGEST] for x in SENTENCE.split(text) if x.strip()] or [[]]
    words = sentences[k % len(sentences)]
    terms = IDENTITY_TERMS[k // 7 % len(IDENTITY_TERMS)]
    at = k // 3 % (len(words) + 1)
    return " ".join(words), " ".join([*words[:at], terms[k % len(terms)], *words[at:]])


@dataclass
class Classifier:
    wanted: np.ndarray
    weight: np.ndarray
    bias: float
    #: Counterfactual pairs that the fit has seen.
    pairs: int = 0

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, feature, value = weighted(texts, self.wanted)
        z = self.bias + np.bincount(doc, weights=value * self.weight[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def learn(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], wanted: np.ndarray) -> Classifier:
    """``rows``: (label, features, values, and features and values of both sides of the counterfactual pair)."""
    if not rows:
        return Classifier(wanted, np.zeros(1 << FEATURE_BITS), -40.0)
    number = np.cumsum(wanted) - 1
    y = np.array([r[0] for r in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    feature, value = number[np.concatenate([r[1] for r in rows])], np.concatenate([r[2] for r in rows])
    sides = [(k, part, sign) for k, r in enumerate(rows) for part, sign in ((3, 1.0), (5, -1.0)) if len(r[part])]
    pair = np.concatenate([np.zeros(0, np.int64), *(np.full(len(rows[k][part]), k) for k, part, _ in sides)])
    delta_f = number[np.concatenate([np.zeros(0, np.int64), *(rows[k][part] for k, part, _ in sides)])]
    delta_v = np.concatenate([np.zeros(0), *(sign * rows[k][part + 1] for k, part, sign in sides)])
    d = int(wanted.sum())
    w, b = np.zeros(d), float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, STEPS + 1):  # Adam over all rows
        z = b + np.bincount(doc, weights=value * w[feature], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        grad = np.append(np.bincount(feature, weights=value * error[doc], minlength=d) + DECAY * w, error.sum())
        change = np.bincount(pair, weights=delta_v * w[delta_f], minlength=len(rows))
        grad[:-1] += 2 * PENALTY / len(rows) * np.bincount(delta_f, weights=delta_v * change[pair], minlength=d)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    full = np.zeros(1 << FEATURE_BITS)
    full[wanted] = w
    return Classifier(wanted, full, float(b), len(rows))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Classifier:
    """A classifier from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    told = F.broadcast(told) if labels.count() <= BROADCAST_LABELS else told
    labelled = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(told, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << FEATURE_BITS), np.int64)
        size = np.zeros(2, np.int64)
        for batch, texts in chunks(batches):
            label = batch.column("toxic").to_numpy()
            feature, doc, _ = features(texts)
            once = np.unique((doc << FEATURE_BITS) | feature)
            doc, feature = once >> FEATURE_BITS, once & ((1 << FEATURE_BITS) - 1)
            for k in (0, 1):
                seen[k] += np.bincount(feature[label[doc] == k], minlength=1 << FEATURE_BITS)
                size[k] += int((label == k).sum())
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([size[0], *seen[0][at]], pa.int64()), pa.array([size[1], *seen[1][at]], pa.int64())], ["feature", "clean", "toxic"])

    counts = labelled.select("text", "toxic").mapInArrow(spread, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialise(counts, "feature-counts")
    whole = counts.where("feature = -1").first()
    wanted = np.zeros(1 << FEATURE_BITS, bool)
    if whole is None or not whole["toxic"] or not whole["clean"]:
        return learn([], wanted)
    odds = F.log((F.col("toxic") + 0.5) / (whole["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (whole["clean"] + 1.0))
    best = counts.where("feature >= 0 AND toxic >= 3").select("feature", (odds * F.sqrt("toxic")).alias("gain")).where(odds > 0.5).orderBy(F.desc("gain"), "feature").limit(KEPT)
    wanted[[r["feature"] for r in best.collect()]] = True
    for terms in IDENTITY_TERMS:
        for term in terms:
            wanted[term_features(term)] = True

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            both = [counterfactual(t.decode("utf-8", "replace"), k) for t, k in zip(texts, batch.column("k").to_pylist(), strict=True)]
            columns = [batch.column("toxic").cast(pa.int64())]
            for some in (texts, [one.encode() for one, _ in both], [other.encode() for _, other in both]):
                doc, feature, value = weighted(some, wanted)
                ends = np.searchsorted(doc, np.arange(len(some) + 1)).astype(np.int32)
                columns += [pa.ListArray.from_arrays(ends, pa.array(feature)), pa.ListArray.from_arrays(ends, pa.array(value))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "f", "v", "of", "ov", "sf", "sv"])

    picked = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("_id"))
    sample = labelled.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "toxic", F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)).alias("k"))
    rows = sample.mapInArrow(describe, "toxic bigint, f array<bigint>, v array<double>, of array<bigint>, ov array<double>, sf array<bigint>, sv array<double>").toPandas()
    pack = [(int(r[0]), *(np.asarray(x, np.int64 if k % 2 == 0 else float) for k, x in enumerate(r[1:]))) for r in rows.itertuples(index=False)]
    return learn(sorted(pack, key=lambda r: (r[0], len(r[1]), r[1].tolist(), r[2].tolist())), wanted)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = shared.value.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, score double, predicted int")
