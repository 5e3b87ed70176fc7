"""Packing of tokenised documents into training sequences of a fixed size by the sum-of-squares rule.

``pieces`` tokenises whole texts, ends each document with ``end`` and cuts only documents longer than
``size``.  ``pack`` deals the pieces evenly into groups of about ``GROUP_TOKENS`` tokens and packs each group
in one task, longest piece first: of the open sequences with room for the piece, it takes the residual gap
whose choice leaves the sum over all gaps of (number of open sequences with that gap) squared smallest; the
smaller gap wins a tie, and a new sequence is opened only where no open one has room.  Only one group's
lengths are in memory, whatever the table's size; what a group leaves unfilled are a few sequences.
``sequences`` lays the ids of each sequence end to end.

Texts are tokenised part by part of words, each different part once for as long as a task remembers it.  This
is exact for tokenizers that drop white space, part words as ``SPLIT`` and mark word ends; others are refused.

Cases: a null or empty text is one piece that holds ``end`` alone; every row is a document of its own,
whatever its doc_id (null and repeated ids too); strings of special tokens in a text become those tokens, as
the tokenizer does by default; an empty table gives an empty result; other columns are ignored by ``pieces``
and carried by ``pack``.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shingling import chunks, ragged

SIZE, END = 2048, 0
#: Tokens and pieces of a group at most, about.
GROUP_TOKENS, GROUP_PIECES = 8 << 20, 500_000
#: Different word parts that a task remembers before it starts anew.
REMEMBERED = 1_000_000
#: Pieces in one Arrow batch.
BATCH = 2048
#: The pattern that parts words in the tokenizers that are taken.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of plain words: printable ASCII but for the apostrophe, and the letters of two bytes that begin with C3.
ODD = np.array([not (0x21 <= b <= 0x7E and b != 0x27 or b == 0xC3) for b in range(256)])
#: Letters, digits and other characters.
KIND = np.array([1 if b >= 0x80 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


class Lists:
    """Growing lists of ids by number."""

    def __init__(self):
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def append(self, count: np.ndarray, flat: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, flat])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each list, all ids end to end)."""
        count = self.count[numbers]
        return count, self.flat[ragged(self.first[numbers], count)]


class Encoder:
    """A tokenizer that remembers the parts of words.

    White space parts words; a plain word falls into letters, single digits and other characters, lower-cased, as
    the tokenizer's own pattern has it.  Words that are not plain go through the whole tokenizer, as one part.
    """

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        splits = [s["pattern"]["Regex"] for s in told["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        if told["model"].get("end_of_word_suffix") != "</w>" or splits != [SPLIT] or any(a["lstrip"] or a["rstrip"] or not a["content"].startswith("<|") for a in told["added_tokens"]):
            raise ValueError(f"{path} does not part words as {SPLIT} and mark their ends")
        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]  # these stand for themselves
        self.shown = np.zeros(256, "<u2")  # bytes as the model writes them; the blank parts words
        self.shown[own] = own
        hidden = [b for b in range(256) if b not in own]
        self.shown[hidden] = np.arange(256, 256 + len(hidden))
        self.shown[0x20] = 0x20
        self.ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
        self.ends[[k for w, k in told["model"]["vocab"].items() if w.endswith("</w>")]] = True
        self.end = np.array([end], np.uint32)
        self.forget()

    def forget(self) -> None:
        self.parts, self.ids = {}, Lists()

    def numbers(self, parts: list[bytes], plain: bool) -> np.ndarray:
        """The number of each part; new ones are encoded."""
        known, of = len(self.parts), self.parts
        out = np.array([of.setdefault(p, len(of)) for p in parts], np.int64)
        new = list(islice(of, known, None))
        if new and plain:
            shown = self.shown[np.frombuffer(b" ".join(new), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
            self.ids.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1), ids)
        elif new:
            ids = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast([p[1:].decode() for p in new], add_special_tokens=False)]
            self.ids.append(np.array([len(e) for e in ids], np.int64), np.concatenate(ids))
        return out

    def word_parts(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(parts in each word, their numbers end to end)."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        before = np.concatenate([[0], data[:-1]]).astype(np.uint8)[: len(data)]
        after_c3 = (before == 0xC3) & (data >= 0x80) & (data <= 0xBF)
        odd = np.where(after_c3, (data == 0x97) | (data == 0xB7), ODD[data]) | ((data == 0x7C) & (before == 0x3C))
        lower = data + np.where(after_c3 & (data <= 0x9E) | (data >= 0x41) & (data <= 0x5A), np.uint8(32), np.uint8(0))
        kind = KIND[data]
        begins = np.concatenate([[True], kind[1:] != kind[:-1]])[: len(data)] | (kind == 2)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        upto = lambda marks: np.concatenate([[0], np.cumsum(marks)])[offsets]
        count, plain = np.diff(upto(begins)), np.diff(upto(odd)) == 0
        starts = np.append(np.flatnonzero(begins), len(data))
        every = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(lower)])
        coded = every.filter(pa.array(np.repeat(plain, count))).dictionary_encode()
        flat = self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), True)[coded.indices.to_numpy()]
        strange = words.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist()
        single = self.numbers([b"\xff" + w for w in strange], False)  # told apart from plain parts
        count = np.where(plain, count, 1)
        first, out = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int64)
        out[ragged(first[plain], count[plain])] = flat
        out[first[~plain]] = single
        return count, out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, its end included; all ids end to end)."""
        if len(self.parts) > REMEMBERED:
            self.forget()
        parted = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        offsets = parted.offsets.to_numpy()
        coded = parted.values.cast(pa.large_binary()).dictionary_encode()
        count, flat = self.word_parts(coded.dictionary)
        sizes, ids = self.ids.take(flat)
        total = np.concatenate([[0], np.cumsum(sizes)])
        words = Lists()
        words.append(np.diff(total[np.concatenate([[0], np.cumsum(count)])]), ids)
        words.append(np.ones(1, np.int64), self.end)
        # one more word, the end, after each text's
        size, out = words.take(np.insert(coded.indices.to_numpy().astype(np.int64), offsets[1:] - offsets[0], len(count)))
        upto = np.concatenate([[0], np.cumsum(size)])
        return np.diff(upto[offsets[1:] - offsets[0] + np.arange(1, len(texts) + 1)], prepend=0), out


def pieces(docs: DataFrame, tokenizer: str, end: int = END, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids): ``ids`` are little-endian unsigned 32-bit numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end)
        for batch, texts in chunks(batches):
            count, flat = encoder.encode(texts)
            parts = -(-count // size)
            doc = np.repeat(np.arange(len(texts)), parts)
            piece = ragged(np.zeros(len(texts), np.int64), parts)
            length = np.minimum(count[doc] - piece * size, size)
            at = np.concatenate([[0], np.cumsum(length)])
            ids = batch.column("doc_id")
            for low in range(0, len(doc), BATCH):
                high = min(low + BATCH, len(doc))
                offsets = ((at[low : high + 1] - at[low]) * 4).astype(np.int32)
                data = flat[at[low] : at[high]].astype("<u4").tobytes()
                told = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc[low:high])), pa.array(piece[low:high], pa.int32()), pa.array(piece[low:high] * size, pa.int64()), pa.array(length[low:high], pa.int64()), told],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    kept = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(kept))


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; sequences are numbered from 0."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(size + 1)]  # open sequences by residual gap
    n = np.zeros(size + 1, np.int64)  # how many; of gap 0 and of new ones (gap ``size``) always 0
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        # taking gap g changes the sum of squares by 2 (n[g - length] - n[g]) + 2, a full fit by one less
        change = 2 * (n[: size - length] - n[length:size]) + 2
        change[:1] -= 1
        change[n[length:size] == 0] = np.iinfo(np.int64).max
        gap = length + int(change.argmin()) if len(change) else size
        if gap < size and n[gap]:
            sequence[k] = waiting[gap].pop()
            n[gap] -= 1
        else:
            gap, sequence[k] = size, made
            made += 1
        offset[k] = size - gap
        if gap > length:
            waiting[gap - length].append(sequence[k])
            n[gap - length] += 1
    return sequence, offset


def pack(cut: DataFrame, size: int = SIZE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``; ``length`` (1 to ``size``) is what they take.

    Rows should come from a written table: they are dealt into groups evenly, by no key.
    """
    tokens, rows = cut.agg(F.sum("length"), F.count(F.lit(1))).first()
    groups = max(1, math.ceil((tokens or 0) / group_tokens), math.ceil(rows / GROUP_PIECES))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sequence, offset = place(np.concatenate([b.column("length").to_numpy(zero_copy_only=False) for b in held]), size)
        sequence += TaskContext.get().partitionId() << 32
        at = 0
        for b in held:
            high = at + b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence[at:high]), pa.array(offset[at:high])], [*b.schema.names, "sequence_id", "offset"])
            at = high

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return cut.repartition(groups).mapInArrow(fill, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the ids of each sequence end to end; no sequence holds more than ``size`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), ""))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length")).select("sequence_id", "length", joined.alias("ids"))
