"""Runs of words against the definition, on random strings and on the whole small table."""

import hashlib
import random
import zlib

import numpy as np

from tidemark.llm import periodic_runs, queries, tandem_repeats


def brute(words, least=2):
    """(start, length, period) of all maximal periodic stretches of at least two periods, smallest periods only."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_all_runs_of_random_strings():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n, k = int(rng.integers(1, 70)), int(rng.integers(1, 5))
        s = rng.integers(0, k, n)
        if rng.random() < 0.4:
            p, a = int(rng.integers(1, max(2, n // 2))), int(rng.integers(0, n))
            s[a:] = s[np.minimum(a + (np.arange(a, n) - a) % p, n - 1)]
        parts = [s, s[::-1], s] if rng.random() < 0.3 else [s]
        text = np.concatenate([np.append(x, k + i) for i, x in enumerate(parts)])
        assert list(zip(*(x.tolist() for x in tandem_repeats.find_runs(text)), strict=True)) == brute(text.tolist())


def test_only_recurring_stretches_are_searched_and_none_is_missed():
    rng = random.Random(2)
    for _ in range(60):
        words, doc = [], []
        for d in range(4):
            ws = [rng.randrange(9) for _ in range(rng.randrange(60))]
            if rng.random() < 0.7 and ws:
                part = ws[: rng.randrange(1, 14)]
                ws += part * rng.randrange(2, 6) + part[: rng.randrange(1, 5)] + [77] + part * 2
            words += ws
            doc += [d] * len(ws)
        words, doc = np.array(words, np.int64), np.array(doc, np.int64)
        want = []
        for d in range(4):
            at = np.flatnonzero(doc == d)
            want += [(s + int(at[0]), n, q) for s, n, q in brute(words[at].tolist(), 12)] if len(at) else []
        assert list(zip(*(x.tolist() for x in periodic_runs.runs_of(words, doc)), strict=True)) == sorted(want)


def digest(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def short_brute(words):
    """As ``brute``, by the distances at which six words recur, for long texts."""
    at, pairs = {}, set()
    for i in range(len(words) - 5):
        at.setdefault(tuple(words[i : i + 6]), []).append(i)
    for places in at.values():
        pairs.update(b - a for k, a in enumerate(places) for b in places[k + 1 :])
    found = {}
    for q in sorted(pairs):
        same = np.array([words[i] == words[i + q] for i in range(len(words) - q)] + [False])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(int)])))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s + q >= max(12, 2 * q):
                found.setdefault((int(s), int(e - s + q)), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.queries()["op11_periodic_runs"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        words = digest(r["doc_id"], r["text"])
        runs, told = short_brute(words), got[r["doc_id"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        some += bool(runs)
        assert told["n_runs"] == len(runs)
        assert (told["start"], told["length"], told["period"]) == best
        assert told["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert told["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert told["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert some > 10


def test_odd_rows(spark, docs):
    found = {(r["doc_id"], r["n_words"]): r for r in periodic_runs.periodic_runs(docs.where("doc_id >= 9000")).collect()}
    assert found[9001, 0]["collapsed"] == found[9002, 0]["collapsed"] == found[9003, 0]["collapsed"] == ""
    r = found[9006, 300]
    assert [tuple(x) for x in r["runs"]] == [(0, 300, 5)] and r["collapsed"] == "É é ß Ünï code"
    many = spark.createDataFrame([(None, "w " * 30000, "x"), (None, "a b " * 7, "x"), (None, "a b " * 5 + "a", "x")], "doc_id bigint, text string, runs string")
    assert sorted([tuple(x) for x in r["runs"]] for r in periodic_runs.periodic_runs(many).collect()) == [[], [(0, 14, 2)], [(0, 30000, 1)]]


def test_empty_table(empty):
    assert periodic_runs.periodic_runs(empty).count() == 0
