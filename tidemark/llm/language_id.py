"""Language identification by bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of its most frequent letter n-grams.  The filters are stored bit by
bit: a slot holds one bit for each language (a 64-bit word for each 64 of them), so ``HASHES`` look-ups
and a bitwise AND give the mask of all languages that contain an n-gram.  A text's n-grams are counted for each language; a count is
corrected for the filter's false positives (known from its fill), and the largest decides.  The score
is its share of the two largest.

Fit: at most ``PER_LANGUAGE`` documents of each language (those with the smallest hash of doc_id and
seed), whole texts, and the ``CAPACITY`` most frequent n-grams of each.  Scoring reads the text alone.

The table has 2 ** SLOT_BITS slots, 16 MB for each 64 languages; every lang value that occurs is learned.

Cases: a null text or one without letter is ``und`` with score 0; a text with letters but without a
known n-gram gets the most frequent learned language with score 0; ties go to the more frequent
language; without training rows all is ``und``; an empty table gives an empty result; repeated rows
score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shingling import powers, splitmix

GRAM = 4
PER_LANGUAGE = 1200
CAPACITY = 10_000
SLOT_BITS, HASHES = 21, 2
#: Languages of a word.
WORD = 64
#: Characters that are worked on at once.
CHUNK = 1 << 20
FACTOR = powers(GRAM + 1, 0xBF58476D1CE4E5B9)[1:]
LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index) of the n-grams of all texts, and whether each text has a letter.

    Texts are lower-cased; what stands between letters becomes one blank.
    """
    lowered = [(t or "").lower() for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    code = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTER[code]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[:-1] |= letter[1:] & ~letter[:-1] & ~kept[:-1]
    at = np.flatnonzero(kept)
    # one blank between words: of two kept gaps in a row the second goes
    gap = ~letter[at]
    double = np.zeros(len(at), bool)
    double[1:] = gap[1:] & gap[:-1]
    at = at[~double]
    value = np.where(letter[at], code[at], 32).astype(np.uint64)
    ends = np.cumsum(size + 1)
    doc = np.minimum(np.searchsorted(ends, at - 1, side="right"), max(len(texts) - 1, 0))
    has = np.zeros(len(texts), bool)
    has[doc[letter[at]]] = True
    n = max(0, len(at) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out += value[k : k + n] * FACTOR[k]
    solid = letter[at]
    low, high = np.arange(n), np.arange(n) + GRAM - 1
    own, other = doc[low + ~solid[low]], doc[high - ~solid[high]]
    inner = own == other
    return splitmix(out[inner]), own[inner], has


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, doc, has = grams(texts)
        masks = [np.full(len(found), ~np.uint64(0)) for _ in self.table]
        for at in slots(found):
            for mask, words in zip(masks, self.table, strict=True):
                mask &= words[at]
        total = np.bincount(doc, minlength=len(texts)).astype(float)
        counts = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            hits = np.bincount(doc, weights=((masks[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).astype(float), minlength=len(texts))
            counts[:, k] = np.maximum(0.0, (hits - total * self.false_rate[k]) / (1 - self.false_rate[k]))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        ordered = np.sort(np.concatenate([np.zeros((len(texts), 1)), counts], axis=1), axis=1)[:, -2:]
        best = (counts + 1e-6 * self.prior).argmax(axis=1)
        score = np.where(ordered[:, 1] > 0, ordered[:, 1] / np.maximum(ordered.sum(axis=1), 1e-12), 0.0)
        return [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, np.minimum(score, 1.0), 0.0)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def fit(labelled: DataFrame, seed: int = 11) -> Filters:
    """Filters from ``labelled(doc_id, text, lang)``; rows with a null take no part."""
    rows = labelled.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != "und"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    drawn = rows.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(seed)).alias("draw"))
    # the hashes are even: twice the share that is wanted holds the smallest ones, so that no language's rows all meet in the window
    shares = [(lang, min((1 << 63) - 1, -(1 << 63) + (2 * PER_LANGUAGE << 64) // n)) for lang, n in sizes.items()]
    upto = labelled.sparkSession.createDataFrame(shares, "_l string, upto bigint")
    drawn = drawn.join(F.broadcast(upto), F.col("lang") == F.col("_l")).where("draw <= upto")
    picked = drawn.withColumn("row", F.row_number().over(order)).where(F.col("row") <= PER_LANGUAGE).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    sample = rows.join(F.broadcast(picked), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                seen, n = np.unique(grams([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("row", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where((F.col("row") <= CAPACITY) & (F.col("n") > 1))
    learned = top.select("lang", "gram").toPandas()
    languages = sorted(sizes)
    table = np.zeros((-(-len(languages) // WORD), 1 << SLOT_BITS), np.uint64)
    for k, lang in enumerate(languages):
        for at in slots(learned.gram[learned.lang == lang].to_numpy(np.int64).view(np.uint64)):
            table[k // WORD, at] |= np.uint64(1 << k % WORD)
    fill = np.array([float(((table[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean()) for k in range(len(languages))])
    rows_of = np.array([float(sizes[x]) for x in languages])
    return Filters(languages, table, fill**HASHES, rows_of / max(rows_of.sum(initial=0.0), 1.0))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, scores = batch.column("text").to_pylist(), [], []
            low, size = 0, 0
            for high, text in enumerate([*texts, None], 1):
                size += len(text or "")
                if size > CHUNK or high > len(texts):
                    found, score = shared.value.score(texts[low:high])
                    names += found
                    scores.append(score)
                    low, size = high, 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
