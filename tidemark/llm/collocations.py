"""Mining of phrase collocations by level-wise (Apriori) passes, apart for each language.

Level k has every phrase of k words that stands at least ``least`` times within the pieces of the texts.  Each
pass sends the frequent (k-1)-grams to all tasks as a bit table of their hashes, and only k-grams whose two
overlapping (k-1)-grams are in it are counted.  What a pass leaves, stretches in which every window can still be
part of a longer frequent phrase, is written and is all that the next pass reads.  The bit table's size is
bounded (``MOST_BITS``); a bit that two phrases share, or more of them as the table fills, only lets more
k-grams be counted, whose counts are exact: they are told apart by their bytes everywhere.

A candidate of 2 words or more is cut at each place; with l and r, the counts of the two parts from the tables
of the levels, the cut scores floor(1000 a n / (l r)).  The lowest score counts.  Candidates inside a longer one
that stands as often are dropped, and the first ``top`` of each language are kept, picked in parts before they
meet.

Cases: a null text counts as empty; a null language is ``und``; repeated rows count each time; a language
without words or candidates has no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import materialise
from tidemark.llm.shingling import chunks, ragged

LEAST, LONGEST, TOP = 100, 5, 2000
#: Of a longer phrase's count, in hundredths of the shorter one's, from which the shorter one is dropped.
SHARE = 100
#: Bits for each frequent phrase, and at most (16 MB).
BITS, MOST_BITS = 32, 1 << 27
#: Parts in which the first phrases of a language are picked before they meet.
PARTS = 64
#: Languages that are sent to every executor.
BROADCAST_LANGUAGES = 10_000
#: Bytes of a written row, about.
ROW = 4096
BLANK, BREAK = 0x20, 0x0A
#: A-Z are lower-cased, [.,;:!?] and \n \v \f \r part pieces, blank and \t part words.
TRANSLATED = bytes(BREAK if chr(b) in ".,;:!?\n\v\f\r" else BLANK if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Laid:
    """The words of texts end to end, each followed by a blank, or by a break where a piece ends."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).translate(TRANSLATED), np.uint8)
        gap = (data == BLANK) | (data == BREAK)
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        starts, size = edge[::2], edge[1::2] - edge[::2]
        self.piece = np.searchsorted(np.flatnonzero(data == BREAK), starts)
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        self.data = np.full(int((size + 1).sum()), BLANK, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[self.ends] = False
        self.data[inside] = data[~gap]
        self.letters = self.data[inside]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(first word of each window of ``k`` words in a piece, number of its phrase, the phrases)."""
        n = max(len(self.starts) - k + 1, 0)
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 : n + k - 1])
        size = self.ends[at + k - 1] - self.starts[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = self.letters if k == 1 else self.data[ragged(self.starts[at], size)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        return at, coded.indices.to_numpy(), coded.dictionary

    def stretches(self, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where rows of about ROW bytes begin and end): the words of each chain of windows of ``k`` words, a line each."""
        chain = np.flatnonzero(np.diff(first, prepend=-2) != 1)
        last = first[np.append(chain[1:], len(first)) - 1] + k - 1
        low = self.starts[first[chain]]
        size = self.ends[last] - low + 1
        data, upto = self.data[ragged(low, size)], np.cumsum(size)
        data[upto - 1] = BREAK
        row = upto // ROW
        return data, np.concatenate([[0], upto[np.append(row[1:] != row[:-1], True)]])


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Laid]]:
    for batch, texts in chunks(batches):
        groups: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            groups.setdefault(lang, []).append(text)
        for lang, of in groups.items():
            yield lang, Laid(of)


def counted(texts: DataFrame, k: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of ``k`` words; with k = 1 also the words of each language, as a null phrase."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, laid in by_language(batches):
            _, number, phrases = laid.windows(k)
            f = np.bincount(number, minlength=len(phrases))
            told = phrases.cast(pa.large_string()).cast(pa.string())
            if k == 1:
                told, f = pa.concat_arrays([told, pa.nulls(1, pa.string())]), np.append(f, len(number))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(f)), told, pa.array(f, pa.int64())], ["lang", "phrase", "f"])

    return texts.mapInArrow(count, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bit_table(level: DataFrame) -> np.ndarray | None:
    """The hashes of a level's phrases as bits; None if it has none."""
    level = level.where("phrase IS NOT NULL")
    n = level.count()
    if not n:
        return None
    size = min(max(1 << (BITS * n - 1).bit_length(), 1 << 12), MOST_BITS)
    place = F.shiftrightunsigned(F.xxhash64("lang", "phrase"), 64 - (size.bit_length() - 1))
    words = level.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits")).toPandas()
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def known(table: np.ndarray, lang: str, phrases: pa.Array) -> np.ndarray:
    """Which phrases may be in the table: all that are, and few others."""
    from xxhash import xxh64_intdigest

    seed, shift = xxh64_intdigest(lang.encode(), 42), np.uint64(64 - (len(table).bit_length() - 1 + 6))
    told = phrases.to_numpy(zero_copy_only=False).tolist()
    place = np.fromiter((xxh64_intdigest(p, seed) for p in told), np.uint64, len(told)) >> shift
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def left_over(texts: DataFrame, k: int, table: np.ndarray) -> DataFrame:
    """(lang, text): the stretches in which two overlapping ``k``-grams may both be frequent everywhere."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, laid in by_language(batches):
            at, number, phrases = laid.windows(k)
            at = at[known(table, lang, phrases)[number]]
            first = at[:-1][np.diff(at) == 1]
            first = first[laid.piece[first] == laid.piece[first + k]]
            if len(first):
                data, rows = laid.stretches(first, k + 1)
                text = pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer(rows.astype(np.int32)), pa.py_buffer(data)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(text)), text], ["lang", "text"])

    return texts.mapInArrow(trim, "lang string, text string")


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """A written table (lang, phrase, f) for each level; the first also has each language's words, as a null phrase."""
    texts, out = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), []
    for k in range(1, longest + 1):
        out.append(materialise(counted(texts, k).where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{k}"))
        table = bit_table(out[-1]) if k < longest else None
        if table is None:
            break
        texts = materialise(left_over(texts, k, table), f"stretches-{k}")
    return out


def part(words: Column, low: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, low, n), " ")


def scored(candidates: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the cut of the lowest score, the first of these."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.col("words"), 1, F.col("cut")).alias("one"), part(F.col("words"), F.col("cut") + 1, F.size("words")).alias("two"))
    first = parts.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l"))
    rest = parts.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r"))
    few = totals.count() <= BROADCAST_LANGUAGES
    told = cuts.join(first, ["lang", "one"]).join(rest, ["lang", "two"]).join(F.broadcast(totals) if few else totals, "lang")
    wide = lambda x, y: F.col(x).cast("decimal(19,0)") * F.col(y).cast("decimal(18,0)")
    told = told.withColumn("units", 1000 * F.col("a")).withColumns({"over": wide("units", "n"), "under": wide("l", "r")})
    best = F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("best")
    return told.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def covered(candidates: DataFrame, longest: int, share: int = SHARE) -> DataFrame:
    """(lang, phrase) of the candidates that stand inside a longer one at least ``share`` hundredths as often."""
    long = candidates.select("lang", F.split("phrase", " ").alias("words"), "f")
    inner = []
    for n in range(2, longest):
        low = F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("low")
        inner.append(long.where(F.size("words") > n).select("lang", "words", "f", low).select("lang", part(F.col("words"), F.col("low"), n).alias("phrase"), "f"))
    if not inner:
        return candidates.select("lang", "phrase").limit(0)
    most = reduce(DataFrame.unionByName, inner).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return candidates.join(most, ["lang", "phrase"]).where(100 * F.col("most") >= share * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    tables = levels(docs, least, longest)
    totals = tables[0].where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    parts = reduce(DataFrame.unionByName, tables).where("phrase IS NOT NULL")
    candidates = parts.where(F.contains("phrase", F.lit(" ")))
    told = scored(candidates, parts, totals).join(covered(candidates, longest), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = told.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return dealt.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
