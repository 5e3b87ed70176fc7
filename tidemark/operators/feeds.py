"""Text-feed cleaning, incremental loads and coverage audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYWORDS = ("bitcoin", "btc")


def clean_text(x: Column) -> Column:
    """NULL is empty, a newline becomes a blank, white space at both ends goes."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")), r"^\s+", ""), r"\s+$", "")


def mentions(title: Column, body: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """A keyword as a substring, in lower case."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))
    found = F.lit(False)
    for k in keywords:
        found = found | text.contains(k)
    return found


def first_filled(*columns: Column) -> Column:
    """COALESCE that takes '' for missing."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def news_rows(feed: DataFrame, name: str, id: str, body: str, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    told = feed.select(F.col(id).cast("string").alias("id"), clean_text(F.col(body)).alias("body"))
    return told.where(mentions(F.lit(""), F.col("body"), keywords)).select("id", F.lit(f"rss:{name}").alias("source"), F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"))


def common(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """The keys that both tables have, each once."""
    return one.select(key).intersect(two.select(key))


def unseen(batch: DataFrame, seen: DataFrame, id: str, within_batch: bool) -> DataFrame:
    """Rows whose id is not stored; with ``within_batch`` each id once."""
    known = seen.select(F.col(id).alias("_seen")).distinct()
    fresh = batch.join(known, batch[id] == known["_seen"], "left_anti")
    return fresh.dropDuplicates([id]) if within_batch else fresh


def hourly_rows(events: DataFrame, time: str, stream: str) -> DataFrame:
    return events.groupBy(F.col(stream).alias("stream"), F.date_trunc("hour", time).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def expected_hours(present: DataFrame) -> DataFrame:
    ends = present.groupBy("stream").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    return ends.select("stream", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))


def hard_gaps(present: DataFrame) -> DataFrame:
    """Hours without a row between a stream's first and last."""
    return expected_hours(present).join(present, ["stream", "hour"], "left_anti")


def soft_gaps(present: DataFrame, share: float = 0.2) -> DataFrame:
    """Hours with fewer rows than ``share`` of the stream's upper median, 1 at least."""
    w = Window.partitionBy("stream")
    ranked = present.withColumns({"_r": F.row_number().over(w.orderBy("n", "hour")), "_c": F.count(F.lit(1)).over(w)})
    median = ranked.where(F.col("_r") == F.floor(F.col("_c") / 2) + 1).select("stream", F.col("n").alias("median_n"))
    return present.join(median, "stream").where(F.col("n") < F.greatest(F.lit(1.0), share * F.col("median_n"))).select("stream", "hour", "n", "median_n")


def low_cadence(present: DataFrame, per_hour: float, share: float = 0.5) -> DataFrame:
    """Hours with fewer rows than ``share`` of what a stream of fixed cadence sends."""
    return present.where(F.col("n") < share * per_hour).select("stream", "hour", "n", F.lit(float(per_hour)).alias("expected_n"))


def coverage(present: DataFrame, share: float = 0.2) -> DataFrame:
    """One row for each stream: hours present and expected, hard and soft gaps."""
    count = lambda df, name: df.groupBy("stream").agg(F.count(F.lit(1)).alias(name))
    out = present.groupBy("stream").agg(F.count(F.lit(1)).alias("hours"), F.sum("n").alias("rows"))
    for part, name in ((expected_hours(present), "expected"), (hard_gaps(present), "hard_gaps"), (soft_gaps(present, share), "soft_gaps")):
        out = out.join(count(part, name), "stream", "left")
    return out.na.fill(0)
