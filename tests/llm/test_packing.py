"""Packing against the tokenizer itself, a plain simulation of the rule, and an exact round trip."""

import random
import zlib
from itertools import islice

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, queries

VOCABULARY = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    signs = "aAbB'strevmld \t\n \u0085\x1c\x01<|endoftext|>éÉÀßİıΣσς²½٣ǅ́ẖe­ʼn\xa0 　中文😀1234!?#×÷'ɏɐ\x7f\x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b <|startoftext|>'s", "I'm DON'T 's '", "...x.,9a99", "É" * 5000]
    encoder = packing.Encoder(VOCABULARY, 7)
    for part in (texts[:1500], texts[1500:], texts[:10], []):
        count, flat = encoder.encode([t.encode() for t in part])
        want = [e.ids + [7] for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        ids = iter(flat.tolist())
        assert [list(islice(ids, n)) for n in count.tolist()] == want
        assert next(ids, None) is None


def test_rule_against_simulation():
    def simulate(lengths, size):
        open_, gaps, out = {}, [], []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            counts = {g: sum(x == g for x in gaps) for g in set(gaps) if g}
            fits = [g for g in counts if g >= lengths[k]]

            def cost(g, length=lengths[k], counts=counts):
                after = counts | {g: counts[g] - 1}
                if g > length:
                    after[g - length] = after.get(g - length, 0) + 1
                return sum(v * v for v in after.values()), g

            g = min(fits, key=cost) if fits else None
            if g is None:
                gaps.append(size - lengths[k])
            else:
                gaps[gaps.index(g)] -= lengths[k]
            out.append((lengths[k], g or size))
        open_.clear()
        return out, len(gaps)

    rng = np.random.default_rng(3)
    for size in (10, 37):
        for _ in range(20):
            lengths = rng.integers(1, size + 1, 60)
            sequence, offset = packing.place(lengths, size)
            want, n = simulate(lengths.tolist(), size)
            order = np.argsort(-lengths, kind="stable")
            assert [(int(lengths[k]), int(size - offset[k])) for k in order] == want
            assert sequence.max() + 1 == n


def gapless(rows, size):
    of = {}
    for r in rows:
        of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and 0 < length <= size
            at += length
        assert at <= size
    return len(of)


def test_query_on_whole_table(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = queries.queries()["op13_packing"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc, parts in by.items():
        ids = tokenizer.encode(texts[doc], add_special_tokens=False).ids + [0]
        for k, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            part = ids[k * 2048 : (k + 1) * 2048]
            assert (r["piece"], r["start"], r["length"]) == (k, k * 2048, len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(r["length"] for r in parts) == len(ids)
    made, tokens = gapless(rows, 2048), sum(r["length"] for r in rows)
    assert made <= -(-tokens // 2048) * 1.02 + 1


def test_odd_rows_and_round_trip(spark, docs, tokenizer):
    odd = docs.where("doc_id >= 9000 or doc_id < 20")
    cut = packing.pieces(odd, VOCABULARY, size=64).withColumn("key", F.lit("k")).cache()
    packed = packing.pack(cut, 64, group_tokens=4000).cache()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "key", "sequence_id", "offset"]
    rows = packed.collect()
    assert len(rows) == cut.count()
    made = gapless(rows, 64)
    assert len({r["sequence_id"] >> 32 for r in rows}) > 1  # several groups
    laid = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert len(laid) == made
    for r in rows:
        assert bytes(laid[r["sequence_id"]]["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    want = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r["length"] for r in rows) == want
    assert [(r["length"], bytes(r["ids"])) for r in rows if r["doc_id"] == 9001] == [(1, bytes(4))]


def test_empty_table(spark, empty):
    assert packing.pack(packing.pieces(empty, VOCABULARY)).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.Encoder(path("byte_bpe_50k.json"), 0)
