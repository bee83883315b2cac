"""Every registered query against its DuckDB statement on the sf0.001 tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import compare, duck
from tillscope.plans import oracle, reports

# the operators of the optional subpackage have tests of their own
NAMES = sorted(reports.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(oracle.statements())
    assert set(NAMES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF_SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "POS_DESCRIPTION", "label", "total_sales", "total_units"]
    assert 0 < len(rows) <= 5
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_schemas_are_stable_across_scale_factors(spark):
    for name, q in reports.QUERIES.items():
        small = q(spark, SF_SMALL).schema.simpleString()
        larger = q(spark, "/root/testdata/sf0.01").schema.simpleString()
        assert small == larger, name
