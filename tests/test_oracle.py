"""Every registered query against its DuckDB SQL (bag equality after rounding to 6 places)."""

import os

import pytest

from tests.oracle_check import compare, duck_connect

SF_DIR = os.environ.get("PRICETIDE_TEST_SF", "/root/testdata/sf0.001")


def _keys():
    from pricetide.plans.registry import QUERIES
    return list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_DIR)


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, con, key):
    info = compare(spark, key, SF_DIR, con)
    assert info["ok"] in (True, None), info
    assert info.get("types_ok", True), info
    assert info["rows"] >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["product_id", "live_price", "last_update_time"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
