"""A hot transaction: one TRANSACTION_SET_ID holds a third of all items and many payment rows.

Results must stay exact (no row dropped or capped) and AQE must split the
hot item-side partition of the payment join instead of sending it to one task.
"""

import pyspark.sql.functions as F

from retail_fixture import frames, item
from tillscope.operators import payments, products
from tillscope.plans.enrich import enrich_weighted

N = 3000


def _data(spark):
    its = []
    for i in range(N):
        tsid = "HOT" if i % 3 == 0 else f"t{i}"
        its.append(item(tsid, i, i % 7, str(i % 5), f"2024-0{1 + i % 6}-1{i % 9} 00:00:00", f"P{i % 11}",
                        price=float(1 + i % 13), qty=float(1 + i % 3)))
    pays = [("HOT", "CASH")] * 40 + [("HOT", "CREDIT")] * 25 + [(f"t{i}", "DEBIT") for i in range(1, N, 3)]
    cat = [(g, f"C{g}", f"B{g}") for g in range(7)]
    return frames(spark, its, cat, pays)


def _truth(its_rows):
    # brute force over the row-level fan-out
    mult = {"HOT": {"CASH": 40, "CREDIT/DEBIT": 25}}
    out = {}
    for r in its_rows:
        groups = mult.get(r[0]) or ({"CREDIT/DEBIT": 1} if int(r[0][1:]) % 3 == 1 else {})
        for g, w in groups.items():
            s = out.setdefault(g, [0.0, 0.0])
            s[0] += r[7] * r[8] * w
            s[1] += r[8] * w
    return {g: (round(a, 2), round(b, 2)) for g, (a, b) in out.items()}


def test_hot_transaction_exact_and_split(spark):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        its, cat, pays, sts = _data(spark)
        e = enrich_weighted(its, cat, pays, sts)
        cmp_ = payments.payment_comparison(payments.page_rows(e))
        got = {r.payment_group: (round(r.total_sales, 2), round(r.total_items, 2)) for r in cmp_.collect()}
        assert got == _truth([tuple(r) for r in its.collect()])
        plan = cmp_._jdf.queryExecution().executedPlan().toString()
        assert "isSkewJoin=true" in plan or "skew=true" in plan, plan
        # distinct counts stay exact under the same skew
        tc = {r.payment_group: r.transaction_count for r in cmp_.collect()}
        assert tc["CASH"] == N // 3
        # page-1 weekly sums over the same skew: every item, repeated per payment row (65 for HOT)
        weekly = products.weekly_product_sales(e).agg(F.sum("weekly_sales")).first()[0]
        truth = sum(r[7] * r[8] * (65 if r[0] == "HOT" else 1) for r in its.collect())
        assert round(weekly, 2) == round(truth, 2)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_group_of_copies_in_the_catalog(spark):
    """A third of the catalog rows are identical copies of one GTIN; results equal the raw fan-out."""
    from retail_fixture import CATALOG, ITEMS, PAYMENTS, STORES
    from tillscope.functions.expr import zero_sum

    its = [item(f"t{i % 50}", i, i % 4, "1", "2024-01-02 00:00:00", f"P{i % 3}", price=float(1 + i % 7))
           for i in range(300)]
    cat = [(g, f"C{g}", "B") for g in range(4)] * 3 + [(0, "C0", "B")] * 6  # GTIN 0: 9 identical copies
    pays = [(f"t{i}", "CASH") for i in range(0, 50, 2)] + [("t0", "CREDIT")]
    sts = [(1, "S1", "Rigby", "ID")]
    e = enrich_weighted(spark.createDataFrame(its, ITEMS), spark.createDataFrame(cat, CATALOG),
                        spark.createDataFrame(pays, PAYMENTS), spark.createDataFrame(sts, STORES))
    got = {r.CATEGORY: round(r.s, 2) for r in e.groupBy("CATEGORY").agg(
        F.expr("sum(total_sales * payment_weight)").alias("s")).collect()}
    raw = (spark.createDataFrame(its, ITEMS).join(spark.createDataFrame(cat, CATALOG), "GTIN", "left")
           .join(spark.createDataFrame(pays, PAYMENTS), "TRANSACTION_SET_ID", "left")
           .withColumn("total_sales", F.col("UNIT_PRICE") * F.col("UNIT_QUANTITY")))
    want = {r.CATEGORY: round(r.s, 2) for r in raw.groupBy("CATEGORY").agg(zero_sum("total_sales").alias("s")).collect()}
    assert got == want
    # the copies travel as a weight: the weighted frame has one row per item and payment type
    assert e.count() == spark.createDataFrame(its, ITEMS).join(
        spark.createDataFrame(pays, PAYMENTS).distinct(), "TRANSACTION_SET_ID", "left").count()


def test_one_row_of_large_weight_is_repeated_in_blocks_over_tasks(spark):
    from tillscope.plans import enrich

    df = spark.sql("SELECT 'hot' AS TRANSACTION_SET_ID, 1 AS TRANSACTION_ITEM_ID, 95001L AS payment_weight "
                   "UNION ALL SELECT 'b', 2, 1L UNION ALL SELECT 'c', 3, 0L")
    for spread in (False, True):
        got = {r.TRANSACTION_SET_ID: r["count"] for r in
               enrich.expand_weight(df, spread).groupBy("TRANSACTION_SET_ID").count().collect()}
        assert got == {"hot": 95001, "b": 1}
    parts = enrich.expand_weight(df, True).where("TRANSACTION_SET_ID = 'hot'").select(F.spark_partition_id()).distinct()
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert parts.count() > 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
