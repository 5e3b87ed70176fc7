"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White-space separated words: any run of characters other than blank and \t \n \v \f \r.
WS_WORD = r"[^\x20\x09-\x0D]+"
WS = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session of one process may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark's setting by which a query's shuffle files are deleted as soon as it has ended.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Files of a table for each core, at least, and shuffle partitions that share a file beyond that.
FILES, SHARED = 4, 8


def files(spark: SparkSession) -> int:
    """Files that a table is written to, at most: enough to keep all cores busy, whatever the number of shuffle partitions."""
    return max(FILES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARED)


def materialise(df: DataFrame, tag: str, tidy: bool = False) -> DataFrame:
    """Cut the lineage by a table in the shared folder: a lost executor never forces a recomputation.

    Each file that is written to a local folder starts processes (``chmod``) that share the executor's
    memory for an instant, so that neighbouring partitions share a file beyond ``files``.
    ``tidy``: the shuffle files of making the table go at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_END)
    spark.conf.set(SHUFFLES_END, str(tidy or before == "true").lower())
    try:
        df.coalesce(files(spark)).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_END, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote, once all that was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ws_words(text: Column) -> Column:
    """array<string> of the white-space separated words; empty for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """60 bits of the text's SHA-256 as a non-negative bigint; null counts as the empty text."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("bigint")
