"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import math
import os

import duckdb
import pytest

from eventide import catalog
from eventide.plans import queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("the tables are not there")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v) if hasattr(v, "isoformat") else v


def same(a, b):
    return a == b or isinstance(a, int | float) and isinstance(b, int | float) and abs(a - b) <= 2e-6 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert len(got) == len(want)
    assert all(all(same(x, y) for x, y in zip(a, b, strict=True)) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, duck, name):
    """Queries without SQL give rows, every column with values, the same rows in a second run."""
    first = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(first) and first.notna().any().all()
    order = list(first.columns)
    again = catalog.QUERIES[name](spark, DATA).toPandas()
    a, b = (sorted((tuple(plain(v) for v in r) for r in x[order].itertuples(index=False)), key=str) for x in (first, again))
    assert len(a) == len(b) and all(all(same(x, y) for x, y in zip(i, j, strict=True)) for i, j in zip(a, b, strict=True))
