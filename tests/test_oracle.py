"""Every registered query against its DuckDB SQL at sf0.01 (the driver's correctness gate)."""

import pytest

from paths import SF01
from oracle_check import compare

import __spark_entry__ as entry
from sluice.queries import QUERIES


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"event_id", "ts", "user_id", "event_type", "value", "props", "_source", "date", "has_ingestion_ts"}
    assert df.filter("user_id IS NULL OR value IS NULL").count() == 0


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(entry.oracle_sql()) == set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    assert compare(spark, SF01, [name]) == []
