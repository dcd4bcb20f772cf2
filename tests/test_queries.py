"""Every query against its SQL on the smallest tables; those without SQL must run and keep their columns."""

import pytest

from marginalia.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    import tools_oracle

    assert tools_oracle.compare(spark, sf, name).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.take(3)) > 0
    assert df.columns


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 20
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
