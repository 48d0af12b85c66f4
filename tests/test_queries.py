"""Every registered query with SQL gives what DuckDB gives."""

import pytest

from gridleaf.plans import queries as q
from tests.compare import check


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    check(spark, sf, q.QUERIES[name], q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_query_without_sql(spark, sf, name):
    """Skew: level pages, and one angle for each of them."""
    assert name == "page_skew"
    rows = q.QUERIES[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert all(abs(r["skew_angle"]) <= 10 and r["has_skew"] == (abs(r["skew_angle"]) > 0.5) for r in rows)


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
