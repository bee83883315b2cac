"""The role tables reproduce the sizes documented in FIXTURES.md (sf0.001 column)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillscope.operators import brands
from tillscope.plans.enrich import enrich_tables
from tillscope.sources import fixtures


def test_fixture_sizes_match_the_documented_table(spark):
    t = fixtures.load(spark, SF_SMALL)
    e = enrich_tables(t)
    agg = e.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("TRANSACTION_ITEM_ID").alias("items"),
        F.count_if(F.col("PAYMENT_TYPE").isNull()).alias("no_payment"),
        F.count_if(F.col("NONSCAN_CATEGORY").isNull()).alias("null_nonscan"),
        F.count_if(F.col("UNIT_PRICE").isNull()).alias("null_price"),
    ).first()
    assert (agg.rows, agg.items) == (6729, 4599)
    assert (agg.no_payment, agg.null_nonscan, agg.null_price) == (1200, 943, 356)
    pay = t.payments.agg(F.count(F.lit(1)), F.count_distinct("TRANSACTION_SET_ID")).first()
    assert tuple(pay) == (1674, 1500)
    assert t.stores.count() == 10
    assert e.transform(brands.flt.packaged_beverages()).count() == 1276
