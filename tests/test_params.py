"""Parameterised analyses (store lists, date ranges, payment sides) against DuckDB on sf0.001."""

import datetime as dt

import pytest

from conftest import SF_SMALL
from oracle_check import duck, rows_of
from tillscope.operators import brands, payments, products
from tillscope.plans import oracle
from tillscope.plans.enrich import enrich_weighted_tables
from tillscope.plans.reports import _finish
from tillscope.sources import fixtures

RANGE = (dt.date(1996, 3, 4), dt.date(1999, 8, 29))
STORES = ["1", "3", "4", "8"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def _same(sdf, con, sql):
    res = con.execute(oracle._settled(sql))
    d_cols = [d[0] for d in res.description]
    s_rows, s_cols = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    d_rows, d_cols = rows_of(d_cols, res.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows) and s_rows == d_rows
    return len(s_rows)


def test_weekly_sales_with_stores_and_dates(spark, con):
    t = fixtures.load(spark, SF_SMALL)
    got = _finish(products.weekly_sales(enrich_weighted_tables(t), True, STORES, RANGE),
                  money=("weekly_sales", "units_sold"))
    sql = oracle._with() + f"""SELECT year, week, POS_DESCRIPTION, CATEGORY,
       round({oracle._sum('total_sales')}, 2) AS weekly_sales, round({oracle._sum('UNIT_QUANTITY')}, 2) AS units_sold,
       {oracle._DISTINCT_ITEMS} AS transaction_count
FROM enriched
WHERE (NOT regexp_matches(CATEGORY, 'FUEL|GAS') OR CATEGORY IS NULL)
  AND STORE_ID IN ('1', '3', '4', '8') AND date >= DATE '{RANGE[0]}' AND date <= DATE '{RANGE[1]}'
GROUP BY ALL"""
    assert _same(got, con, sql) > 0


def test_beverage_brands_with_stores_and_dates(spark, con):
    t = fixtures.load(spark, SF_SMALL)
    got = _finish(brands.beverage_brands(enrich_weighted_tables(t), STORES, RANGE),
                  money=("total_sales", "units_sold"), ratio=("avg_price",))
    sql = oracle._with() + f"""SELECT BRAND, round({oracle._sum('total_sales')}, 2) AS total_sales,
       round({oracle._sum('UNIT_QUANTITY')}, 2) AS units_sold, {oracle._DISTINCT_ITEMS} AS transaction_count,
       round({oracle._avg('UNIT_PRICE')}, 4) AS avg_price
FROM enriched
WHERE regexp_matches(CATEGORY, 'BEVERAGE|DRINK|SODA|WATER') AND BRAND IS NOT NULL
  AND STORE_ID IN ('1', '3', '4', '8') AND date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'
GROUP BY BRAND"""
    assert _same(got, con, sql) > 0


def test_payment_page_credit_only_with_dates_and_exclusions(spark, con):
    t = fixtures.load(spark, SF_SMALL)
    rows = payments.page_rows(enrich_weighted_tables(t), RANGE, ["Supplier#000000005"], cash=False, credit=True)
    got = _finish(payments.category_breakdown(rows), money=("total_sales",))
    sql = oracle._with() + f"""SELECT 'CREDIT/DEBIT' AS payment_group, CATEGORY,
       round({oracle._sum('total_sales')}, 2) AS total_sales, {oracle._DISTINCT_ITEMS} AS transactions
FROM enriched
WHERE PAYMENT_TYPE IN ('CREDIT', 'DEBIT') AND NOT (STORE_NAME IN ('Supplier#000000005'))
  AND date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'
GROUP BY CATEGORY"""
    assert _same(got, con, sql) > 0


def test_page1_with_dates_and_exclusions(spark, con):
    t = fixtures.load(spark, SF_SMALL)
    rows = products.page_rows(enrich_weighted_tables(t), t.stores, RANGE, ["Supplier#000000003"], ["SODA"])
    got = _finish(products.top_products(rows, 5), money=("total_sales", "total_units"))
    sql = oracle._with() + f"""SELECT CAST(row_number() OVER (ORDER BY round(ts, 2) DESC, POS_DESCRIPTION) AS BIGINT) AS rank,
       POS_DESCRIPTION, substring(POS_DESCRIPTION, 1, 20) AS label,
       round(ts, 2) AS total_sales, round(tu, 2) AS total_units
FROM (SELECT * FROM (SELECT POS_DESCRIPTION, {oracle._sum('total_sales')} AS ts, {oracle._sum('UNIT_QUANTITY')} AS tu
      FROM enriched
      WHERE NONSCAN_CATEGORY <> 'FUEL' AND date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'
        AND NOT (STORE_ID IN (SELECT CAST(STORE_ID AS VARCHAR) FROM stores WHERE STORE_NAME = 'Supplier#000000003'))
        AND (CATEGORY <> 'SODA' OR CATEGORY IS NULL)
      GROUP BY POS_DESCRIPTION) a
      ORDER BY round(ts, 2) DESC, POS_DESCRIPTION LIMIT 5) x"""
    assert _same(got, con, sql) == 5
