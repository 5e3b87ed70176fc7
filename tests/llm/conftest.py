import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

ODD = [
    (9001, None, None, None, None),
    (9002, "", "en", "src1", 0),
    (9003, " \n\t ", "en", None, 4),
    (9004, "one two", "en", "src2", 7),
    (9005, "One  TWO", None, "src2", 8),
    (9006, "É é ß Ünï code " * 60, "fr", "src3", None),
    (9006, "É é ß Ünï code " * 60, "fr", "src3", None),
    (9007, "longword" * 9000, "de", "src1", 72000),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The small table, with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame(ODD, small.schema)
    from pyspark.sql import functions as F

    return small.unionByName(odd).withColumns({"key": F.lit("k"), "size": F.lit(1), "words": F.lit("w"), "n": F.lit(0), "_id": F.lit(3)}).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
