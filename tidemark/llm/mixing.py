"""Mixing sources to target weights by systematic sampling.

A source's documents are laid out in a fixed order; each expects ``target / source_size`` copies.
The expected copies are summed up along the order, one random offset is added for the source, and a
document is emitted once for each integer boundary that its stretch crosses.  The order runs by
size, so a source's taken words stay within about one document of its target.

Targets: weights 5, 2, 1 in turn over the sources by code point (null last) share 150 % of all
words; a target stops at twice its source's words and the excess is reshared by weight until no
target is above.

Cases: a null source is a source of its own; a null or empty text has size 0 and takes no words; a
source without words has target 0 and its documents are not copied; an empty table gives an empty
result; repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import WS_WORD, materialise
from tidemark.llm.sharding import number_rows

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2


def source_ranks(sources: DataFrame) -> DataFrame:
    """``sources(source, ...)`` with ``rank`` from 0 by code point, null last, numbered a range at a time."""
    dealt = materialise(sources, "mix-sources")
    n = max(1, dealt.count() // 100_000)
    if n == 1:
        return dealt.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranged = materialise(dealt.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    return number_rows(ranged.withColumn("all", F.lit(0)), ["all"], ["part"], ["source"], "rank").drop("all", "part")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources(source, source_size)`` with ``target``; the resharing keeps two sums on the driver."""
    ranked = source_ranks(sources)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rated = materialise(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("most")), "mix-weights")
    total = rated.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight
    while True:
        full = F.col("most") <= F.col("weight") * level
        done, open_weight = rated.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        wanted = (total * share - (done or 0.0)) / open_weight
        if wanted <= level:
            break
        level = wanted
    return rated.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, and what to ``carry``) for every row of ``docs(doc_id, source, text)``."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WS_WORD)).cast("bigint")
    base = materialise(docs.select("doc_id", "source", size.alias("size"), *carry), "mix-base")
    goals = targets(base.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), weights, share, cap)
    celled = base.select(
        "*",
        F.floor(F.sqrt(F.col("size").cast("double"))).alias("bucket"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2).alias("salt"),
    )
    numbered = number_rows(celled, ["source"], ["bucket", "salt"], ["size", "doc_id", *carry], "row")
    joined = numbered.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(F.col("row") * F.col("rate") + F.col("rate") + F.col("offset")) - F.floor(F.col("row") * F.col("rate") + F.col("offset"))
    stepped = joined.withColumns({"rate": rate, "offset": offset}).withColumn("rate", F.when(F.col("rate") > float(cap), float(cap)).otherwise(F.col("rate")))
    copies = F.greatest(F.lit(0), F.least(crossed, F.ceil(F.col("rate")))).cast("bigint")
    return stepped.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def emit(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed corpus itself: every column of ``docs``, a row once for each copy taken.

    The rows are written once with a number of their own, so that each has its own decision, whatever its doc_id.
    """
    row = "_mixed_row"  # no name that the numbering below uses
    while row.lower() in {c.lower() for c in docs.columns}:
        row += "_"
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    copies = mix(numbered, seed, carry=(row,)).where("copies > 0").select(row, F.col("copies").cast("int").alias(f"{row}n"))
    taken = numbered.join(copies, row)
    return taken.withColumn(f"{row}k", F.explode(F.sequence(F.lit(1), F.col(f"{row}n")))).select(*docs.columns)
