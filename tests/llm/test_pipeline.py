from collections import defaultdict

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import quality


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontaminate", "mix_sources", "shard"]

    rows = {r["doc_id"]: r for r in docs.collect()}
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    want = {d for d, r in rows.items() if not brute.quality(r["text"])[-1]} & {d for d, k in verdict.items() if k}

    def step(name, frame):
        out = stages[name](spark, frame, sf)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    now = step("quality_rules", docs)
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == want

    part = brute.jaccard_components([(d, rows[d]["text"]) for d in sorted(want)], 5, 80)
    want = {d for d in want if part[d][1] == d or not part[d][0]}
    now = step("near_duplicates", now)
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == want

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = brute.contamination([(d, rows[d]["text"]) for d in want], items)
    want = {d for d in want if not dirty[d][4]}
    now = step("decontaminate", now)
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == want

    sizes = defaultdict(int)
    for d in want:
        sizes[rows[d]["source"]] += len(brute.WS_WORD.findall(rows[d]["text"]))
    target = brute.mix_targets(sizes)
    now = step("mix_sources", now)
    assert now.columns == columns
    taken, largest = defaultdict(int), defaultdict(int)
    mixed = now.collect()
    for r in mixed:
        n = len(brute.WS_WORD.findall(r["text"]))
        taken[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    assert all(abs(taken[s] - target[s]) <= 1.5 * max(largest[s], 1) for s in sizes)

    final = step("shard", now).collect()
    assert sorted(r["doc_id"] for r in final) == sorted(r["doc_id"] for r in mixed)
    assert all(r["size"] == len(rows[r["doc_id"]]["text"].encode()) + 1 for r in final)
    slots = defaultdict(list)
    for r in final:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_on_odd_rows(spark, docs, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table, each stage after the other."""
    sf = "/root/testdata/sf0.001"
    odd = docs.where("doc_id > 9000").unionByName(spark.range(2).select(*(F.lit(None).cast(kind).alias(c) for c, kind in docs.dtypes)))
    kept = {"quality_rules": [], "near_duplicates": [9001, 9002, 9003, 9004, 9006, 9007, None, None], "decontaminate": odd.select("doc_id").rdd.map(lambda r: r[0]).collect()}
    for name, stage in corpus_pipeline.STAGES:
        for some, n in ((odd, "odd"), (empty, "empty")):
            out = stage(spark, some, sf)
            out.write.parquet(str(tmp_path / f"{name}-{n}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{n}"))
            if n == "empty":
                assert out.count() == 0
            if name != "shard":
                assert out.columns == docs.columns
            if n == "odd" and name in kept:
                assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(kept[name], key=str)
            if n == "odd" and name == "shard":
                assert out.count() == odd.count() and out.where("shard IS NULL OR slot IS NULL").count() == 0
