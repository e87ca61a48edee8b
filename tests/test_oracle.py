"""Every registered query with SQL against DuckDB on the sf0.001 tables, and
the driver entry point."""
import pytest

from termlens.plans.queries import REGISTRY
from tools_check import rows

SF = "/root/testdata/sf0.001"
WITH_SQL = sorted(n for n, q in REGISTRY.items() if q.sql is not None)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_duckdb(spark, duck, name):
    q = REGISTRY[name]
    df = q.run(spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(q.sql)
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, res.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql is None))
def test_query_without_sql_runs(spark, name):
    assert REGISTRY[name].run(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["word_1", "word_2", "count", "prob_w1w2"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
