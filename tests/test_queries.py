"""Every query that SQL can express against DuckDB on the smallest tables; the others must run."""

import os

import duckdb
import pytest

from larder.plans import evaluate_queries, kb_queries, prompt_queries, recommend_queries, registry, retrieval_queries, stream_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def _text(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_text, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    if name not in registry.SQL:
        assert got
        return
    result = duck.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_text(r[i]) for i in at) for r in result.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert "nutrient_target_topk" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
