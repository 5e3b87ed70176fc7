import random
import re
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, mixing, quality, sharding


def test_shards_are_minimax_and_slots_gapless(docs, rows, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d, len((t or "").encode()) + 1, brute.crc(t)) for d, t, _ in rows)
    slots, groups, keys = defaultdict(list), defaultdict(set), defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        groups[r["key"]].add(r["shard"])
        keys[r["key"]].append(r["size"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    order = sorted(keys)
    best = brute.minimax([sum(keys[k]) for k in order], 8)
    load = defaultdict(int)
    for k in order:
        load[min(groups[k])] += sum(keys[k])
    assert max(load.values()) == best
    where = [min(groups[k]) for k in order]
    assert where == sorted(where)
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("extra", ["k", "_row", "_mixed_row", "_Mixed_Row_"])
def test_emitted_rows_are_the_mix(spark, extra):
    """Null and repeated ids: each row has its own decision, and the words taken are those of the mix."""
    rows = [(None if k < 500 else k % 400, "w " * (1 + k % 37), "a" if k % 3 else "b", k) for k in range(1300)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, source string, {extra} bigint")
    taken = {r["source"]: (r["t"], r["g"]) for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()}
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    size = F.regexp_count("text", F.lit("w"))
    got = {r["source"]: r["t"] for r in out.groupBy("source").agg(F.sum(size).alias("t")).collect()}
    assert got == {s: t for s, (t, _) in taken.items()}
    assert all(abs(t - goal) <= 2 * 37 for t, goal in taken.values())
    assert set(map(tuple, out.collect())) <= set(rows)


@pytest.mark.parametrize("sizes", [[5], [1, 1, 1, 1], [9, 1, 1, 1, 1, 9], list(range(1, 40)), [100, *[1] * 50]])
@pytest.mark.parametrize("k", [1, 2, 3, 8])
def test_smallest_capacity(sizes, k):
    assert sharding.smallest_capacity(sizes, k, max(sizes)) == brute.minimax(sizes, k)


def test_cuts_refine_to_the_optimum(spark):
    sizes = [(i * 7919) % 97 + 1 for i in range(3000)]
    keys = [(i * (1 << 60)) // 3000**1 if i < 2000 else (1 << 59) + i for i in range(3000)]
    pairs = sorted(dict(zip(keys, sizes, strict=True)).items())
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(pairs, "key long, size long"), 5)
    assert capacity == brute.minimax([s for _, s in pairs], 5)
    bounds = [-1, *cuts, 1 << 60]
    assert max(sum(s for k, s in pairs if a < k <= b) for a, b in zip(bounds, bounds[1:])) == capacity


def test_mix_reaches_targets(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.WS_WORD.findall(t or ""))
    want = brute.mix_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.2 * largest[s] + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0
    copies = {r["doc_id"]: r["copies"] for r in got}
    emitted = mixing.emit(docs.dropDuplicates(["doc_id"]))
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(copies.values())


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_contamination(spark, docs, rows, empty, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    odd = spark.createDataFrame([(7001, "one two"), (7002, None), (7003, ""), (7004, "ONE, two"), (7005, "É é")], bench.schema)
    items = bench.unionByName(odd)
    got = decontamination.decontaminate(docs, items)
    from pyspark.sql import functions as F

    found = {r[0]: tuple(r)[1:] for r in got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()}
    assert found == brute.contamination([r[:2] for r in rows], [tuple(r) for r in items.collect()])
    assert any(r[4] for r in found.values())
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for d, *_ in rows if not found[d][4])


def test_no_text_rides_with_its_words(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = decontamination.occurrences(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(token", plan)
    assert dealt and not any(re.search(r"\b(all|text)#", columns) for columns in dealt)


def test_no_rows_from_python(spark):
    """A row that is given from the driver comes by an RDD of Python, whose workers start on the executors."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet") for table in ("documents", "benchmark"))
    assert "ExistingRDD" not in decontamination.occurrences(docs, items)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_contaminated_rows(spark, broadcast, monkeypatch):
    """Null and repeated ids: one result for each row; an item without id counts once and has no place in the list."""
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    window = " ".join(f"w{i}" for i in range(10))
    rows = [(None, "clean words"), (None, window + " x"), (1, window), (1, "other"), (2, "twice"), (2, "twice"), (3, "lone item"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("a", window), (None, "lone item"), (None, window), (None, "lone")], "item_id string, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in decontamination.decontaminate(docs, items).collect()]
    want = [(None, 2, 0, 0, [], False), (None, 11, 10, 2, ["a"], True), (1, 10, 10, 2, ["a"], True), (1, 1, 0, 0, [], False), (2, 1, 0, 0, [], False), (2, 1, 0, 0, [], False), (3, 2, 2, 1, [], True), (4, 0, 0, 0, [], False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [tuple(r) for r in decontamination.clean(docs, items).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[3], rows[4], rows[5], rows[7]], key=str)


def test_base_measures(docs, rows, empty):
    got = quality.with_rates(quality.base_measures(docs)).collect()
    found = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert found == sorted((d, *brute.quality(t)) for d, t, _ in rows)
    assert quality.base_measures(empty).count() == 0


def marked(spark, n_good, n_bad, symbols_of_good=0):
    """Good texts, and bad ones whose words are symbols; a few good ones have symbols too."""
    rng = random.Random(8)
    words = lambda n: [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))]
    rows = [(i, " ".join(words(80) + ["##"] * 20 * (i < symbols_of_good))) for i in range(n_good)]
    rows += [(n_good + i, " ".join(words(60) + ["#$%"] * 30)) for i in range(n_bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < n_good), 0) for i in range(n_good + n_bad)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_thresholds_bind(spark):
    """Bad texts go that the base rule keeps; with too few good labels, or too many good texts hit, none goes."""
    docs, labels = marked(spark, 200, 14)
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(docs, labels).collect()}
    assert all(got[i] == (False, True) for i in range(200)) and not any(got[i][1] for i in range(200, 214))
    assert not any(got[i][0] for i in range(200, 214))
    assert sorted(r["doc_id"] for r in quality.keep_good(docs, labels).collect()) == list(range(200))
    for some in (labels.limit(0), labels.where("doc_id < 100 OR doc_id >= 200")):
        assert all(r["kept"] for r in quality.judge(docs, some).collect())


def test_thresholds_keep_their_promise(spark):
    """The adopted rules' rejections of good texts pass the exact test, and the next cutoff fails it."""
    docs, labels = marked(spark, 400, 8, symbols_of_good=30)
    rated = quality.with_rates(quality.base_measures(docs)).cache()
    chosen, grid = quality.choose_cutoffs(rated, labels), quality.cutoff_grid(rated)
    rows, least = [r.asDict() for r in rated.collect()], quality.DELTA / (len(quality.BANDS) * len(quality.RATES))
    good, gone = [r for r in rows if r["doc_id"] < 400], set()
    for rate in quality.RATES:
        units = sorted(r[rate] for r in rows)
        assert grid[(0, rate)] == sorted({units[-(-level * len(units) // 1000) - 1] for level in quality.LEVELS}, reverse=True)
        adopted = None
        for cut in grid[(0, rate)]:
            hit = gone | {r["doc_id"] for r in good if r[rate] > cut}
            if quality.binomial_tail(len(hit), len(good), quality.RISK) > least:
                break
            adopted, now = cut, hit
        assert chosen.get((0, rate)) == adopted
        gone = now if adopted is not None else gone
    assert len(gone) <= quality.RISK * len(good)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 20, 0.2), (50, 1000, 0.05), (0, 0, 0.5)])
def test_binomial_tail(k, n, p):
    from math import comb

    assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n else 1.0)
