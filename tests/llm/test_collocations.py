"""Phrases against SQL on the whole table and against counting by hand on invented texts."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, oracles, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.queries()["op12_collocations"](spark, sf).select(COLUMNS)
    want = c.sql(oracles.SQL["op12_collocations"]).fetchall()
    assert len(want) > 50
    assert sorted(map(tuple, got.collect())) == sorted(want)


def brute(rows, least, longest, top):
    pieces, f, n = {}, Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            pieces.setdefault(lang, []).append(re.findall("[^ \t]+", piece))
    for lang, of in pieces.items():
        for ws in of:
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    out = []
    for (lang, ws), a in f.items():
        if len(ws) < 2 or a < least:
            continue
        inside = any(x[0] == lang and len(x[1]) > len(ws) and c >= least and c >= a and any(x[1][i : i + len(ws)] == ws for i in range(len(x[1]))) for x, c in f.items())
        cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        if not inside:
            score, k = min(cuts)
            out.append((lang, " ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score))
    told = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        told += [(lang, r, *x[1:]) for r, x in enumerate(own, 1)]
    return told


@pytest.fixture(scope="module")
def invented():
    rng = np.random.default_rng(4)
    words = ["a", "B", "é", "É", "c d", "the", "The", "x1", "\x1c"]
    rows = []
    for k in range(120):
        ws = rng.choice(words, int(rng.integers(0, 40)), p=[0.2, 0.1, 0.1, 0.05, 0.1, 0.2, 0.1, 0.1, 0.05])
        gaps = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "], len(ws), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
        rows.append(("".join(w + g for w, g in zip(ws, gaps, strict=True)), [None, "und", "en", "fr"][k % 4]))
    rows += [(None, "en"), ("", None), (" \t\n", "xx"), ("a b " * 500, "de"), ("one two three four five six. " * 30, "en")]
    return rows + rows[:7]


@pytest.mark.parametrize(("least", "longest", "top"), [(5, 5, 30), (8, 4, 2000), (2, 2, 5), (10_000, 5, 10), (3, 1, 9)])
def test_invented_texts(spark, invented, least, longest, top):
    docs = spark.createDataFrame(invented, "text string, lang string").withColumns({"phrase": F.lit("p"), "n": F.lit(0), "f": F.lit("f")}).repartition(3)
    got = collocations.collocations(docs, least, longest, top)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(brute(invented, least, longest, top))


def test_a_full_bit_table_changes_nothing(spark, invented, monkeypatch):
    docs = spark.createDataFrame(invented, "text string, lang string")
    want = sorted(map(tuple, collocations.collocations(docs, 5).collect()))
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    monkeypatch.setattr(collocations, "BROADCAST_LANGUAGES", 0)
    assert sorted(map(tuple, collocations.collocations(docs, 5).collect())) == want


def test_hashes_are_the_same_in_tasks(spark):
    rows = [("en", "a b"), ("und", "é"), ("", "x" * 100)]
    table = collocations.bit_table(spark.createDataFrame(rows, "lang string, phrase string"))
    assert all(collocations.known(table, lang, pa.array([phrase.encode()]))[0] for lang, phrase in rows)
    assert collocations.known(table, "en", pa.array([f"{k}".encode() for k in range(1000)])).mean() < 0.05


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", big - 7)], "lang string, phrase string, f bigint")
    parts = phrases.union(spark.createDataFrame([("en", "a", big), ("en", "b", big + 1)], phrases.schema))
    totals = spark.createDataFrame([("en", 10 * big + 1)], "lang string, n bigint")
    assert collocations.scored(phrases, parts, totals).first()["score"] == 1000 * (big - 7) * (10 * big + 1) // (big * (big + 1))


def test_empty_table(empty):
    assert collocations.collocations(empty).count() == 0
