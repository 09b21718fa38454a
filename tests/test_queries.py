"""Every query against its SQL, and what must hold for those without."""

from __future__ import annotations

import pytest

from conftest import DATA, rows_of
from tidemark.plans import registry

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.all_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, sql = registry.QUERIES[name](spark, SMALL).toPandas(), duck.sql(registry.ORACLE_SQL[name]).to_df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows_of(ours) == rows_of(sql)


@pytest.mark.parametrize("name", sorted(set(registry.all_queries()) - set(registry.all_sql())))
def test_query_without_sql_runs(spark, name):
    a = registry.QUERIES[name](spark, SMALL).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows_of(a) == rows_of(registry.QUERIES[name](spark, SMALL).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
