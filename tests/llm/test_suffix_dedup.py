import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffix_blocks, suffix_dedup


def test_cover_covers():
    for v in (8, 13, 32, 64):
        cover = suffix_blocks.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("letters,length,bucket", [("ab", 40, 1 << 18), ("a", 33, 64), ("abcdefgh", 200, 50), ("ab", 64, 16)])
def test_repeated_windows(letters, length, bucket, monkeypatch):
    monkeypatch.setattr(suffix_blocks, "BUCKET", bucket)
    rng = random.Random(3)
    text = "".join(rng.choice(letters) for _ in range(700))
    text += text[100:400] + "x" + text[350:650] + "y" * 90 + text[:220]
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(len(data) - length + 1)
    seen = [text[i : i + length] for i in starts]
    assert suffix_blocks.repeated_windows(data, starts, length).tolist() == [seen.count(s) > 1 for s in seen]


def check(got, rows):
    found = sorted(map(tuple, got.collect()))
    want = brute.repeats(list(enumerate(t for _, t in rows)))
    assert found == sorted((d, *want[i]) for i, (d, _) in enumerate(rows))


def test_matches_brute_force(docs, rows, empty):
    check(suffix_dedup.dedup_digest(docs), [r[:2] for r in rows])
    assert suffix_dedup.dedup_digest(empty).count() == 0


@pytest.mark.parametrize("piece,block,broadcast", [(1 << 18, 4 << 20, 32 << 20), (300, 2000, 0)])
def test_planted_repeats(spark, piece, block, broadcast, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", broadcast)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    base, passage = make(1500), make(230)
    texts = [make(300) + passage + make(100), passage, make(50) + passage[:199] + make(400), passage[10:209], passage[10:210], base, base[:700] + "Q" + base[700:], base[300:900] + make(10)]
    texts += ["z" * 650, "ab" * 300, ("line of text " * 20 + "\n") * 6, None, "", "short", "short", make(199), make(200)]
    texts += [texts[-1], make(200) * 2]
    rows = list(enumerate(texts))
    check(suffix_dedup.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    whole = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    digest = whole.select("doc_id", F.sha2("kept", 256).alias("d")).collect()
    want = brute.repeats(rows)
    assert {r["doc_id"]: r["d"] for r in digest} == {d: w[3] for d, w in want.items()}


def test_counters_of_anchors_are_spread(spark, monkeypatch):
    """Anchors are smallest hashes; those of text without repeats must not look frequent by sharing the low counters."""
    seen, real = [], suffix_dedup.frequent
    monkeypatch.setattr(suffix_dedup, "frequent", lambda hits: seen.append(hits) or real(hits))
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghijklmnop", k=100_000))) for i in range(10)]
    texts = suffix_dedup.text_ids(spark.createDataFrame(rows, "doc_id long, text string"))
    assert suffix_dedup.find_anchors(texts).count() == seen[0].sum() > 10_000
    assert (seen[0] > 0).sum() > 0.97 * seen[0].sum()


def test_parts_of_a_frequent_anchor():
    """The parts hold every window once, and equal windows have equal keys whatever stands around them."""
    one, two = b"x" * 300 + bytes(range(200)) + b"y" * 300, b"q" * 150 + bytes(range(200)) + b"z" * 300
    keys = []
    for text, place in ((one, 380), (two, 230)):
        found = {}
        for key, low, n in suffix_dedup.dealt(7, text, place, place - 168, 169, True):
            found |= {text[w : w + 200]: key for w in range(low, low + n)}
        assert len(found) == 169
        keys.append(found)
    both = keys[0].keys() & keys[1].keys()
    assert both == {bytes(range(200))} and all(keys[0][w] == keys[1][w] for w in both)
    assert list(suffix_dedup.dealt(7, one, 380, 300, 20, False)) == [(7, 300, 20)]


def test_frequent_anchors(spark, monkeypatch):
    """Every anchor taken for frequent, passages among many surroundings: the same result from finer parts."""
    monkeypatch.setattr(suffix_dedup, "frequent", lambda hits: hits >= 0)
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = make(330)
    texts = [make(rng.randint(0, 60)) + passage[rng.randint(0, 40) :] + make(rng.randint(0, 90)) for _ in range(25)]
    texts += ["z" * 500, "ab" * 400, make(1000), make(250) * 2, passage[:199], passage[5:205]]
    rows = list(enumerate(texts))
    check(suffix_dedup.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_leaves_no_shuffle_files_and_no_spent_tables(spark, docs):
    """Once the cuts are known, neither the shuffles that made them nor any other table is left on disk."""
    from pathlib import Path
    from urllib.parse import urlparse

    from tidemark.llm.base import shared_dir

    folder = Path(urlparse(shared_dir(spark)).path) / "tidemark"
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    tables = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    shuffles = lambda: {p.name for p in local.rglob("shuffle_*.data")}
    before, old = tables(), shuffles()
    cuts = suffix_dedup.repeated_runs(docs)
    assert {x.rsplit("-", 1)[0] for x in tables() - before} == {"cuts"}
    assert cuts.count() > 0
    spent = [p for p in local.rglob("shuffle_*.data") if p.name in shuffles() - old]
    assert sum(p.stat().st_size for p in spent) < 100_000  # only those of the counts
