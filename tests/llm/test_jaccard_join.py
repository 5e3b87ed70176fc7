import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard_join
from tidemark.llm.components import components


def check(got, rows):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert len(got) == len(rows)
    assert found == brute.jaccard_components([r[:2] for r in {r[0]: r for r in rows}.values()])


def test_matches_brute_force(docs, rows, empty):
    check(jaccard_join.jaccard_components(docs).collect(), rows)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_one_of_each(docs, rows):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    part = brute.jaccard_components([r[:2] for r in {r[0]: r for r in rows}.values()])
    empty = [r[0] for r in rows if part[r[0]][0] == 0]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([d for d, (n, c) in part.items() if n and c == d] + empty)


def test_ids_of_any_kind(spark):
    """String ids, null ids, one id with two texts, whole rows twice."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("b", base), ("a", base + " x"), (None, base), (None, "other " * 3), ("c", "lone words stand here now"), ("c", base + " y"), ("d", "one two"), ("d", "one two"), ("e", None), ("e", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect() if r["doc_id"] is not None)
    assert got == sorted([("b", 57, "a"), ("a", 58, "a"), ("c", 2, "c"), ("c", 58, "a"), ("d", 1, "d"), ("d", 1, "d"), ("e", 0, "e"), ("e", 0, "e")])
    nulls = sorted((r["n_shingles"], r["component_id"] or "") for r in jaccard_join.jaccard_components(docs.where("doc_id IS NULL OR doc_id = 'b'")).collect() if r["doc_id"] is None)
    assert nulls == [(1, ""), (57, "b")]
    kept = sorted((r["doc_id"] or "", r["text"] or "") for r in jaccard_join.one_of_each(docs).collect())
    assert kept == sorted([("a", base + " x"), ("", "other " * 3), ("c", rows[4][1]), ("d", "one two"), ("e", ""), ("e", "")])


def test_other_sizes(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, 5, 80).collect()}
    assert got == brute.jaccard_components([r[:2] for r in {r[0]: r for r in rows}.values()], 5, 80)


@pytest.mark.parametrize("small", [1, 24])
def test_tree_against_all_pairs(small, monkeypatch):
    """The tree's pairs are those that the count vectors leave across components, whole cells and pairs of parts alike."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    rng = np.random.default_rng(3)
    kinds = [rng.integers(0, 1 << 63, 80, dtype=np.uint64) for _ in range(4)]
    rows = []
    for i in range(120):
        s = kinds[i % 4].copy()
        s[rng.integers(0, 80, rng.integers(0, 9))] = rng.integers(0, 1 << 63)
        s = np.unique(s[: rng.integers(66, 81)])
        whole = i % 2 == 0
        rows.append({"token": 5 + i % 2, "unit": 0 if whole else i % 3, "side": 2 if whole else int(rng.integers(0, 2)), "rep": i, "n": len(s), "comp": int(rng.integers(0, 12)), "vec": jaccard_join.vector(s)})
    rows.sort(key=lambda r: (r["token"], r["unit"], r["rep"]))
    p = jaccard_join.Points(pa.Table.from_pylist(rows), 85)
    a, b = jaccard_join.all_pairs(p)
    got = {(min(x, y), max(x, y)) for x, y in zip(p.ids[a].tolist(), p.ids[b].tolist(), strict=True)}

    def bound(r, s):
        return int(np.minimum(np.frombuffer(r["vec"], np.uint8), np.frombuffer(s["vec"], np.uint8)).sum(dtype=np.int64))

    want = {
        (min(r["rep"], s["rep"]), max(r["rep"], s["rep"])) for i, r in enumerate(rows) for s in rows[:i]
        if (r["token"], r["unit"]) == (s["token"], s["unit"]) and r["comp"] != s["comp"] and (r["side"] == 2 or r["side"] != s["side"])
        and 100 * min(r["n"], s["n"]) >= 85 * max(r["n"], s["n"]) and 185 * bound(r, s) >= 85 * (r["n"] + s["n"])
    }
    assert got == want and len(want) > 100


@pytest.mark.parametrize("cell,small", [(4096, 24), (20, 4)])
def test_large_groups_of_near_copies(spark, cell, small, monkeypatch):
    """Chains of edits, hot shared passages, small sets; with and without dealt cells."""
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage, texts = [word() for _ in range(120)], " ".join(word() for _ in range(30)), []
    for _ in range(60):
        w = base[:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    chain = base[:]
    for _ in range(30):
        chain[rng.randrange(len(chain))] = word()
        texts.append(" ".join(chain))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(60)]
    texts += ["a b c", "a b c", "A b  c", "a b c d", "a b c d e", "", None]
    rng.shuffle(texts)
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    check(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 499), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components(sorted({x for e in edges[:-2] for x in e}), edges[:-2])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
