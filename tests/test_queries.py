"""Every query of the library against its SQL on the same tables."""

import pytest

from tidelog.plans.oracles import ORACLES
from tidelog.plans.queries import QUERIES

ROWS_ONLY = {"workload_zipf"}


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rows = df.collect()
    assert sum(r["operations"] for r in rows) == events


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 9
