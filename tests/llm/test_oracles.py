"""Queries that SQL can express, against that SQL."""

import os

import pytest

from tests.oracle_check import canon_rows, duck_connect

SF_DIR = os.environ.get("PRICETIDE_TEST_SF", "/root/testdata/sf0.001")


def _keys():
    from pricetide.llm.queries import ORACLE
    return list(ORACLE)


@pytest.mark.parametrize("key", _keys())
def test_query_matches_sql(spark, key):
    from pricetide.llm.queries import ORACLE, QUERIES
    con = duck_connect(SF_DIR)
    df = QUERIES[key](spark, SF_DIR)
    res = con.execute(ORACLE[key])
    want = canon_rows([d[0] for d in res.description], res.fetchall())
    assert canon_rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry_has_all_operators():
    import __spark_entry__ as entry
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
