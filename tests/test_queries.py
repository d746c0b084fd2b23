"""Every registered batch query against its SQL, and the known counts of the road traffic."""

from __future__ import annotations

import pytest
from compare import difference, duck

import __spark_entry__ as spark_entry
from tollway.plans.oracle import oracle_queries
from tollway.plans.queries import batch_queries, live_path
from tollway.plans.stream_queries import stream_queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(batch_queries()))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert difference(spark, con, name, sf_dir) is None


def test_every_query_has_sql():
    own = batch_queries().keys() | stream_queries().keys()
    assert own == oracle_queries().keys()
    assert own <= spark_entry.queries().keys()
    assert spark_entry.oracle_sql().keys() <= spark_entry.queries().keys()


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() == 273
    assert "toll" in df.columns


def test_known_counts(spark, sf_dir):
    path = live_path(spark, sf_dir)
    assert path.reports.count() == 1000
    assert path.crossings.count() == 273
    assert path.state.where("is_stopped").count() == 22
    assert path.stop_changes.where("delta = 1").count() == 4
    assert path.accidents.count() == 1
    assert path.alerts.count() == 4
    assert path.events.where("typ = 2").count() == 202
    assert path.events.where("typ = 3").count() == 199
