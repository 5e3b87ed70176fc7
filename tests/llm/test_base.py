import os

from tidemark.llm import base


def test_neighbouring_partitions_share_a_file(spark):
    """A table of 211 shuffle partitions leaves at most 26 files (before: 211), with every row."""
    settings = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = base.materialise(spark.range(5000).groupBy("id").count(), "shared-files")
        path = out._written.removeprefix("file:")
        assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= max(base.FILES * spark.sparkContext.defaultParallelism, 211 // base.SHARED)
        assert out.selectExpr("count(DISTINCT id)", "sum(count)").first()[:] == (5000, 5000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
