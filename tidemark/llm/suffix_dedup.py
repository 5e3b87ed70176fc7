"""Removal of repeated passages by suffix arrays built block by block.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else.  Texts are reduced
to one of each exact copy first (a text with copies goes whole, if long enough).

Only stretches that can repeat are sorted.  Each window of ``LENGTH`` bytes has an anchor, its
smallest hash of ``GRAM`` bytes, which equal windows share.  Anchors that occur once drop out; around
the others the windows they rule are cut out as a stretch and dealt by the anchor, so that equal
windows meet in one task.  A frequent anchor (by a table of counters) is dealt further: its windows
are taken apart by the anchor's place within them, ``STEP`` places together, and by the bytes that all of these windows
hold; equal windows agree in both.  In a task the stretches are laid end to end, about ``BLOCK`` bytes at
a time, and their suffixes are sorted with a difference cover (``suffix_blocks``); windows that equal their
neighbour in the suffix array repeat.  Passages are compared by their bytes; only exact copies of whole
texts are known by a 64-bit hash and their length.

Cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; repeated rows are copies;
overlaps count, inside one text too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import discard, materialise
from tidemark.llm.counters import counter_of, frequent, hit_table
from tidemark.llm.shingling import BYTE_CODES, chunks, powers, splitmix
from tidemark.llm.suffix_blocks import repeated_windows

LENGTH, GRAM = 200, 32
#: Places of a frequent anchor in a window that are taken together, and parts that its rows are dealt into before.
STEP, SALTS = 24, 4096
#: Windows that are hashed at once; bytes of stretches that are sorted at once.
PIECE, BLOCK = 1 << 18, 4 << 20
#: Bytes of a table of copies that is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
BASE = 0x9E3779B97F4A7C15 | 1
PLACE_BITS = 20


class Hasher:
    """Hashes of all GRAM-byte strings of a piece; powers are kept between pieces."""

    def __init__(self):
        self.up = powers(PIECE + LENGTH + 1, BASE)
        self.down = powers(PIECE + LENGTH + 1, pow(BASE, -1, 1 << 64))

    def grams(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * self.up[: len(data)], out=total[1:])
        return splitmix((total[GRAM:] - total[:-GRAM]) * self.down[: len(data) - GRAM + 1])

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, first window, windows) of each anchor of a piece of at least LENGTH bytes."""
        grams = self.grams(data)
        low = (grams & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width = LENGTH - GRAM + 1
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        return place[first], grams[place[first]], first, np.diff(np.append(first, len(place)))


def pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes): overlapping parts of a text, each window in exactly one of them."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        yield at, data[at : at + PIECE + LENGTH - 1]


def text_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tid, n_bytes): texts are known by hash and length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tid"), F.octet_length(text).cast("bigint").alias("n_bytes"))


def text_anchors(hasher: Hasher, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, index of the text) of every anchor of a batch."""
    keys, places, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, text in enumerate(data):
        for at, piece in pieces(text):
            place, key, _, _ = hasher.anchors(piece)
            keys.append(key)
            places.append(place + at)
            owner.append(np.full(len(key), i))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(owner)


def spread(key: np.ndarray) -> np.ndarray:
    """Anchors are smallest hashes and so lie close together; their counters must not."""
    return splitmix(key)


def find_anchors(texts: DataFrame) -> DataFrame:
    """(anchor, tid, n_bytes, place, often); ``often``: the anchor's counter has many hits, alike for equal anchors."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent(hit_table(texts, lambda data: spread(text_anchors(Hasher(), data)[0]))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), sent.value
        for batch, data in chunks(batches):
            key, place, owner = text_anchors(hasher, data)
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("tid").take(owner), batch.column("n_bytes").take(owner), pa.array(place), pa.array(table[counter_of(spread(key))])], ["anchor", "tid", "n_bytes", "place", "often"])

    return texts.select("tid", "n_bytes", "text").mapInArrow(find, "anchor bigint, tid bigint, n_bytes bigint, place bigint, often boolean")


def dealt(key: int, text: bytes, place: int, first: int, n: int, often: bool) -> Iterator[tuple[int, int, int]]:
    """(key, first window, windows): the ``n`` windows that an anchor at ``place`` rules, in the parts that are dealt on their own."""
    if not often:
        yield key, first, n
        return
    for step in range((place - first - n + 1) // STEP, (place - first) // STEP + 1):
        # the windows that begin step * STEP to step * STEP + STEP - 1 bytes before the anchor, and what they share
        low, high = max(first, place - step * STEP - STEP + 1), min(first + n, place - step * STEP + 1)
        core = text[place - step * STEP : place - step * STEP - STEP + 1 + LENGTH]
        yield int.from_bytes(hashlib.blake2b(core, digest_size=8, key=key.to_bytes(8, "little", signed=True), salt=step.to_bytes(4, "little")).digest(), "little", signed=True), low, high - low


def cut_stretches(texts: DataFrame) -> DataFrame:
    """(key, stretch, owners): a row for each different stretch of a batch, with all its places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch, data in chunks(batches):
            tids, sizes = batch.column("tid").to_pylist(), batch.column("n_bytes").to_pylist()
            wanted, often = batch.column("places"), batch.column("often")
            found: dict[tuple[int, bytes], list[dict]] = {}
            for i, text in enumerate(data):
                places, hot = wanted[i].values.to_numpy(), set(often[i].as_py())
                for at, piece in pieces(text):
                    place, key, first, n = hasher.anchors(piece)
                    for k in np.flatnonzero(np.isin(place + at, places)):
                        spot = at + int(place[k])
                        for part, low, count in dealt(int(key[k].view(np.int64)), text, spot, at + int(first[k]), int(n[k]), spot in hot):
                            found.setdefault((part, text[low : low + count + LENGTH - 1]), []).append({"tid": tids[i], "n_bytes": sizes[i], "start": low})
            if found:
                kind = pa.list_(pa.struct([("tid", pa.int64()), ("n_bytes", pa.int64()), ("start", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary()), pa.array(list(found.values()), kind)], ["key", "stretch", "owners"])

    return texts.mapInArrow(cut, "key bigint, stretch binary, owners array<struct<tid:bigint,n_bytes:bigint,start:bigint>>")


def sort_stretches(stretches: DataFrame) -> DataFrame:
    """(tid, n_bytes, low, high): removed runs, of the windows that repeat."""

    def runs(group: list[tuple[bytes, list[dict]]]) -> pa.RecordBatch:
        own: dict[bytes, list[dict]] = {}
        for stretch, owners in group:
            own.setdefault(stretch, []).extend(owners)
        text = np.frombuffer(b"".join(own), np.uint8)
        base = np.cumsum([0, *map(len, own)])
        count = np.array([len(s) - LENGTH + 1 for s in own])
        starts = np.arange(count.sum()) + np.repeat(base[:-1] - (np.cumsum(count) - count), count)
        repeated = repeated_windows(text, starts, LENGTH)
        out = []
        edge = np.cumsum([0, *count])
        for i, owners in enumerate(own.values()):
            mark = repeated[edge[i] : edge[i + 1]]
            if len(owners) > 1:
                spans = [(0, len(mark))]
            elif mark.any():
                step = np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))
                spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
            else:
                continue
            out += [(o["tid"], o["n_bytes"], o["start"] + a, o["start"] + b + LENGTH - 1) for o in owners for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["tid", "n_bytes", "low", "high"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, last = [], 0, None
        for batch in batches:
            for key, stretch, owners in zip(batch.column("key").to_pylist(), batch.column("stretch").to_pylist(), batch.column("owners").to_pylist(), strict=True):
                if size > BLOCK and key != last:
                    yield runs(group)
                    group, size = [], 0
                group.append((stretch, owners))
                size, last = size + len(stretch), key
        if group:
            yield runs(group)

    return stretches.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "tid bigint, n_bytes bigint, low bigint, high bigint")


def small(table: DataFrame, size) -> DataFrame:
    """The table, marked for broadcast if its counted bytes allow that."""
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else table


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(tid, n_bytes, cuts): for each text with repeats, the removed runs (low, high), sorted; they may overlap."""
    texts = text_ids(docs.select("doc_id", "text"))
    known = materialise(texts.select("doc_id", "tid", "n_bytes").where(F.col("n_bytes") >= LENGTH), "texts")
    counted = materialise(known.groupBy("tid", "n_bytes").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")), "copies", tidy=True)
    others = known.join(counted.where("copies > 1"), ["tid", "n_bytes"]).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "tid", "n_bytes").distinct()
    others = materialise(others, "others", tidy=True)
    long_enough = texts.where(F.col("n_bytes") >= LENGTH)
    single = long_enough.join(small(others, F.lit(24)), ["doc_id", "tid", "n_bytes"], "left_anti")

    # frequent anchors are taken to repeat (sorting tells), so that their rows need not meet to be counted
    apart = F.when(F.col("often"), F.pmod(F.xxhash64("tid", "place"), F.lit(SALTS))).otherwise(F.lit(0))
    met = find_anchors(single).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("anchor", apart))).where("m > 1 OR often")
    often = F.collect_list(F.when(F.col("often"), F.col("place")))
    spots = materialise(met.groupBy("tid", "n_bytes").agg(F.collect_list("place").alias("places"), often.alias("often")), "spots", tidy=True)
    found = sort_stretches(cut_stretches(single.select("tid", "n_bytes", "text").join(spots, ["tid", "n_bytes"])))
    whole = counted.where("copies > 1").select("tid", "n_bytes", F.lit(0).cast("bigint").alias("low"), F.col("n_bytes").alias("high"))
    cuts = F.array_sort(F.collect_list(F.struct("low", "high"))).alias("cuts")
    told = materialise(found.unionByName(whole).groupBy("tid", "n_bytes").agg(cuts), "cuts", tidy=True)
    discard(known, counted, others, spots)
    return told


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for every row; ``kept`` is the remaining bytes."""
    return apply_cuts(docs, digest=False)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): the same with the remaining bytes' SHA-256."""
    return apply_cuts(docs, digest=True)


def apply_cuts(docs: DataFrame, digest: bool) -> DataFrame:
    cuts = repeated_runs(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = text_ids(docs.select("doc_id", "text")).join(cuts, ["tid", "n_bytes"], "left").select("doc_id", "text", "cuts")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in chunks(batches):
            n_removed, spans, kept = [], [], []
            for text, own in zip(data, batch.column("cuts").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for cut in own or ():
                    if merged and cut["low"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], cut["high"])
                    else:
                        merged.append([cut["low"], cut["high"]])
                edges = [0, *(x for span in merged for x in span), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n_removed.append(len(text) - len(rest))
                spans.append(merged)
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            size = pa.array([len(t) for t in data], pa.int64())
            count = pa.array([len(s) for s in spans], pa.int64())
            head, names = [batch.column("doc_id"), size, pa.array(n_removed, pa.int64()), count], ["doc_id", "n_bytes", "n_removed", "n_spans"]
            if digest:
                yield pa.RecordBatch.from_arrays([*head, pa.array(kept, pa.string())], [*names, "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*head, pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], [*names, "spans", "kept"])

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digest else "spans array<array<bigint>>, kept binary")
    return joined.mapInArrow(apply, schema)
