"""The queries of this subpackage over the tables of a dataset folder, and the SQL that repeats them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import collocations, decontamination, html_extraction, jaccard_join, language_id, line_dedup, mixing, oracles, packing, periodic_runs, quality, sharding, suffix_dedup, toxicity
from tidemark.llm.base import materialise, read, ws_words


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    filters = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs, filters).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    classifier = toxicity.fit(docs, labels.where(~language_id.held_out()))
    return toxicity.score(docs, classifier).select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(read(spark, sf_dir, "documents"))


def unfolded(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts made periodic from some word on, by the CRC-32 of the doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        head, part = F.slice(words, 1, a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
        whole = F.concat(head, F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int"))))
        return F.when(n > 0, F.array_join(F.slice(whole, 1, F.size(words)), " "))

    # the list of one binds the words, which are split once
    made = F.transform(F.array(ws_words(F.col("text"))), periodic)[0]
    return docs.select("doc_id", "text", h.alias("h")).select("doc_id", F.when(F.col("h") % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(unfolded(read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = found.withColumn("best", best).withColumns({"length": F.col("best.length"), "start": -F.col("best.start"), "period": -F.col("best.period")})
    return told.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    cut = packing.pieces(read(spark, sf_dir, "documents"), path("word_bpe_49k.json"))
    return packing.pack(materialise(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top; it uses this package's operators

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_language_id": op2_language_id,
        "op3_html_extraction": op3_html_extraction,
        "op4_sharding": op4_sharding,
        "op5_mixing": op5_mixing,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_decontamination": op7_decontamination,
        "op8_quality": op8_quality,
        "op9_toxicity": op9_toxicity,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_collocations": op12_collocations,
        "op13_packing": op13_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
