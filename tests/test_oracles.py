"""Every registered query against its SQL on the small tables."""

import duckdb
import numpy as np
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shape(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    show = lambda v: "~" if v is None else f"{float(v):.5f}" if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v)
    return columns, sorted(tuple(map(show, r)) for r in plain.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_oracle(spark, duck, name):
    got, want = shape(registry.queries()[name](spark, SF).toPandas()), shape(duck.sql(registry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or float(x) == pytest.approx(float(y), rel=1e-6, abs=2e-5)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.01").count() >= 0
