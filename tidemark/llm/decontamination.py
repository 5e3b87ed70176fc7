"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of an item (a shorter item is one window).  Windows must be
contained whole, so the necessary prefix of a window, its words in order of rarity over all
documents, is its rarest word.  Document words join windows on that word.  The length and positional
bounds (the window must begin and end inside the document) leave few candidates, whose words are
compared exactly.

The windows are broadcast while their counted number is at most ``BROADCAST_WINDOWS``; beyond that
the document words are shuffled, each with its place alone, and the texts once, to meet their candidates.

Cases: every row of the documents is one of the result, whatever its doc_id; rows are told apart by
doc_id and text (as a 64-bit hash within one doc_id), and equal rows have equal results, as many times
as they stand there.  A null or empty text has no words and no hits; an item without words has no
window; equal windows of several items count for each; an item whose item_id is null counts as one
item (all such items together) and is left out of the list of ids; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import ascii_lower, materialise

#: ASCII other than digits and letters parts words; A-Z are lower-cased first.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, words): every window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - width + 1, F.lit(1)))
    return items.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), F.lit(width)).alias("words")).distinct()


def with_rarest(windows: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """Adds ``token``, each window's rarest word over all documents, and ``shift``, its first place there."""
    vocabulary = windows.select(F.explode("words").alias("token")).distinct()
    spread = docs.select(F.explode(words(F.col("text"))).alias("token"))
    counts = spread.join(F.broadcast(vocabulary) if small else vocabulary, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = windows.select("item_id", "words", F.posexplode("words").alias("shift", "token")).join(counts, "token", "left")
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "shift")).alias("rarest")
    return ranked.groupBy("item_id", "words").agg(first).select("item_id", "words", "rarest.token", "rarest.shift")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, hash, n_words, item_id, start, length): a row for each occurrence, and one of length 0 for each row of ``docs``."""
    windows = materialise(item_windows(benchmark, width), "windows")
    small = windows.count() <= BROADCAST_WINDOWS
    keyed = materialise(with_rarest(windows, docs, small), "windows-keyed")
    told = docs.select("doc_id", text_hash(F.col("text")).alias("hash"), words(F.col("text")).alias("all")).withColumn("n_words", F.size("all").cast("bigint"))
    start = (F.col("at") - F.col("shift")).alias("start")
    inside = (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    own = ["doc_id", "hash", "n_words"]
    if small:
        # an empty word ends each list and meets one window without words: every row stays, in the same pass
        # (made by Spark itself: rows given from the driver would start Python workers on the executors)
        made = {"item_id": F.lit(None), "words": F.array(), "token": F.lit(""), "shift": F.lit(0)}
        none = keyed.sparkSession.range(1).select(*(made[f.name].cast(f.dataType).alias(f.name) for f in keyed.schema))
        placed = told.select(*own, "all", F.posexplode(F.array_append("all", F.lit(""))).alias("at", "token"))
        equal = F.slice("all", F.col("at") - F.col("shift") + 1, F.size("words")) == F.col("words")
        hit = (F.size("words") == 0) | (inside & F.when(inside, equal))
        return placed.join(F.broadcast(keyed.unionByName(none)), "token").where(hit).select(*own, "item_id", start, F.size("words").alias("length"))
    # words alone are dealt by themselves; a text meets its candidates once, by its own key
    near = told.select(*own, F.posexplode("all").alias("at", "token")).join(keyed, "token").where(inside).select(*own, "item_id", start, "words").distinct()
    near = near.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    once = docs.select("doc_id", text_hash(F.col("text")).alias("hash"), "text").dropDuplicates(["doc_id", "hash"])
    met = near.join(once, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    found = met.where(F.slice(words(F.col("text")), F.col("start") + 1, F.size("words")) == F.col("words")).select(*own, "item_id", "start", F.size("words").alias("length"))
    return found.unionByName(told.select(*own, F.lit(None).cast("string").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("length")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, hash, n_words, n_hit, n_items, items, contaminated) for every row of ``docs``."""
    found = occurrences(docs, benchmark, width)
    real = F.col("length") > 0
    spans = F.array_sort(F.collect_set(F.when(real, F.struct("start", "length"))))
    unnamed = F.coalesce(F.bool_or(real & F.col("item_id").isNull()), F.lit(False)).cast("int")
    per_doc = found.groupBy("doc_id", "hash", "n_words").agg(spans.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"), unnamed.alias("unnamed"), F.count_if(~real).alias("rows"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    told = per_doc.select("doc_id", "hash", "n_words", covered.alias("n_hit"), (F.size("items") + F.col("unnamed")).cast("bigint").alias("n_items"), "items", (F.size("spans") > 0).alias("contaminated"), "rows")
    return told.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))).drop("copy", "rows")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows without any hit word, every column as it was."""
    dirty = decontaminate(docs, benchmark, width).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_id"]) & (text_hash(docs["text"]) == dirty["_hash"]), "left_anti")
