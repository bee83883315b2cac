"""Property: aggregates over the weighted frame equal those over the raw payment fan-out.

The raw side joins the payment rows as they are (the dashboard's join), built
independently of ``plans.enrich``; the weighted side is what every analysis uses.
"""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retail_fixture import CATALOG, ITEMS, PAYMENTS, STORES
from tillscope.functions.expr import distinct_with_null, zero_sum, payment_group, wmean, wsum
from tillscope.plans.enrich import enrich_weighted

TSIDS = ["a", "b", "c", "d", None]
TYPES = ["CASH", "CHANGE", "CREDIT", "DEBIT", "EBT", None]

item_st = st.tuples(
    st.sampled_from(TSIDS),
    st.one_of(st.none(), st.integers(1, 6)),
    st.integers(0, 3),
    st.sampled_from(["1", "2"]),
    st.sampled_from([dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9), dt.datetime(2024, 2, 29)]),
    st.sampled_from(["P1", "P2", None]),
    st.sampled_from(["NONE", "FUEL", None]),
    st.one_of(st.none(), st.integers(1, 500).map(lambda c: c / 100)),
    st.integers(1, 4).map(float),
)
payment_st = st.tuples(st.sampled_from(TSIDS[:-1]), st.sampled_from(TYPES))


def _raw(spark, its, pays, cat, sts):
    # the dashboard's join: raw payment rows, fan-out included
    i = spark.createDataFrame(its, ITEMS)
    c = spark.createDataFrame(cat, CATALOG)
    p = spark.createDataFrame(pays, PAYMENTS)
    s = spark.createDataFrame(sts, STORES).withColumn("STORE_ID", F.col("STORE_ID").cast("string"))
    return (i.join(c, "GTIN", "left").join(p, "TRANSACTION_SET_ID", "left").join(s, "STORE_ID", "left")
            .withColumn("total_sales", F.col("UNIT_PRICE") * F.col("UNIT_QUANTITY")))


def _round(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    its=st.lists(item_st, min_size=1, max_size=25),
    pays=st.lists(payment_st, max_size=12),
    cat=st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["A", "B", None]), st.sampled_from(["x", None])),
                 max_size=6),
)
def test_weighted_equals_raw_fan_out(spark, its, pays, cat):
    sts = [(1, "S1", "Rigby", "ID"), (2, "S2", None, "ID")]
    weighted = enrich_weighted(
        spark.createDataFrame(its, ITEMS), spark.createDataFrame(cat, CATALOG),
        spark.createDataFrame(pays, PAYMENTS), spark.createDataFrame(sts, STORES),
        check_sizes=False,
    ).withColumn("g", payment_group())
    raw = _raw(spark, its, pays, cat, sts).withColumn("g", payment_group()).withColumn("payment_weight", F.lit(1))
    keys = ["g", "CATEGORY", "POS_DESCRIPTION"]
    got = weighted.groupBy(*keys).agg(
        wsum("total_sales"), wsum("UNIT_QUANTITY"), wmean("UNIT_PRICE"), distinct_with_null("TRANSACTION_ITEM_ID"))
    want = raw.groupBy(*keys).agg(
        zero_sum("total_sales"), zero_sum("UNIT_QUANTITY"), F.avg("UNIT_PRICE"),
        distinct_with_null("TRANSACTION_ITEM_ID"))
    assert _round(got.collect()) == _round(want.collect())
