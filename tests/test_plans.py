"""Physical-plan properties that matter at scale, plus result invariants."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillscope.operators import demographics, payments, products
from tillscope.plans import reports
from tillscope.plans.enrich import enrich_weighted
from tillscope.sources import fixtures, readers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udfs_anywhere(spark):
    for name, q in reports.QUERIES.items():
        plan = _plan(q(spark, SF_SMALL))
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
            assert node not in plan, (name, node)


def test_top_k_per_group_is_limited_before_shuffle(spark):
    df = reports.q_payment_product_detail(spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "TakeOrderedAndProject" in _plan(reports.q_top_products(spark, SF_SMALL))


def test_payment_join_is_a_shuffle_join_beyond_the_broadcast_threshold(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1KB")
    try:
        t = fixtures.load(spark, SF_SMALL)
        e = enrich_weighted(t.items, t.catalog, t.payments, t.stores)
        join = [x for x in _plan(products.weekly_sales(e)).splitlines() if "TRANSACTION_SET_ID" in x and "Join" in x]
        assert join and "SortMergeJoin" in join[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_trends_scan_the_items_once(spark):
    for query in (reports.q_product_trend, reports.q_product_target, reports.q_brand_trend):
        plan = _plan(query(spark, SF_SMALL))
        assert plan.count("lineitem.parquet") == 1, plan
        assert "WindowGroupLimit" in plan


def test_plans_are_built_without_jobs(spark):
    """Of every query but the one that lands files, once the tables' version has been measured."""
    from tillscope.plans import measure, reuse

    names = [n for n in reports.QUERIES if n != "landed_weekly_sales"]
    for n in names:
        reports.QUERIES[n](spark, SF_SMALL)
    tracker = spark.sparkContext.statusTracker()
    # with the process's measurements, then with the ones kept beside the checkpoints
    for again in ("memory", "folder"):
        if again == "folder":
            measure.forget()
        for n in names:
            reuse.clear()
            spark.sparkContext.setJobGroup(f"built-{again}-{n}", "plan only")
            reports.QUERIES[n](spark, SF_SMALL)
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            assert not tracker.getJobIdsForGroup(f"built-{again}-{n}"), n


def test_a_changed_file_is_measured_again(spark, scratch):
    from tillscope.plans import measure

    path = os.path.join(scratch, "dim.parquet")
    spark.range(10).select(F.col("id").alias("k")).write.parquet(path)
    assert measure.measure(spark.read.parquet(path), "k") == measure.measure(spark.read.parquet(path), "k")
    assert measure.measure(spark.read.parquet(path), "k").keys == 10
    spark.range(30).select((F.col("id") % 20).alias("k")).write.mode("overwrite").parquet(path)
    found = measure.measure(spark.read.parquet(path), "k")
    assert (found.keyed, found.keys) == (30, 20)
    other = measure.measure(spark.read.parquet(path).where("k < 5"), "k")  # another frame of the same files
    assert other.keys == 5
    assert measure.largest(spark.read.parquet(path), "k") == 19


def test_excluded_stores_do_not_shuffle_the_items(spark):
    df = reports.q_weekly_sales_page(spark, SF_SMALL)
    plan = _plan(df)
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan.split("LeftAnti")[0]
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(STORE_ID" in x or "Exchange hashpartitioning(coalesce(STORE" in x]
    assert plan.count("Exchange hashpartitioning") <= 3, plan


def test_a_wide_text_column_counts_in_a_broadcast_side(spark):
    from tillscope.plans.joins import prepare_dimension

    wide = spark.range(1000).select(F.col("id").alias("GTIN"), F.repeat(F.lit("x"), 200).alias("CATEGORY"))

    def hinted(limit):
        spark.conf.set("spark.tillscope.broadcastMaxBytes", str(limit))
        try:
            return "Hint broadcast" in prepare_dimension(wide, "GTIN", "n")[0]._jdf.queryExecution().logical().toString()
        finally:
            spark.conf.unset("spark.tillscope.broadcastMaxBytes")

    assert not hinted(300_000) and hinted(600_000)


def test_item_filters_reach_the_scan(spark, scratch):
    # land the items as a real table, as the retail inputs would be
    t = fixtures.load(spark, SF_SMALL)
    items_dir = os.path.join(scratch, "transaction_items")
    t.items.write.parquet(items_dir)
    items = readers.read_transaction_items(spark, items_dir)
    e = enrich_weighted(items, t.catalog, t.payments, t.stores)
    rows = products.page_rows(e, t.stores, date_range=("1996-01-01", "1996-12-31"))
    q = products.weekly_product_sales(rows)
    scan = [line for line in q._jdf.queryExecution().executedPlan().toString().splitlines()
            if "FileScan parquet" in line and "transaction_items" in line]
    assert scan, "item scan not found"
    assert "NONSCAN_CATEGORY" in scan[0] and "PushedFilters" in scan[0]
    assert "DATE_TIME" in scan[0].split("PushedFilters")[1]
    # only the needed columns are read
    assert "TRANSACTION_ITEM_ID" not in scan[0].split("ReadSchema")[1]


def test_top_is_subset_of_totals_and_shares_sum_to_one(spark):
    t = fixtures.load(spark, SF_SMALL)
    e = enrich_weighted(t.items, t.catalog, t.payments, t.stores)
    rows = products.page_rows(e, t.stores)
    totals = {r.POS_DESCRIPTION: r.total_sales for r in products.product_totals(rows).collect()}
    top = products.top_products(rows).collect()
    assert all(abs(totals[r.POS_DESCRIPTION] - r.total_sales) < 1e-6 for r in top)
    assert min(r.total_sales for r in top) >= sorted(totals.values())[-5] - 1e-6
    share = payments.payment_share(payments.payment_comparison(payments.page_rows(e)))
    assert abs(share.agg(F.sum("share")).first()[0] - 1.0) < 1e-9


def test_unpivot_then_pivot_restores_profiles(spark):
    t = fixtures.load(spark, SF_SMALL)
    loc = demographics.store_locations(t.items, t.stores)
    prof = demographics.census_profiles(loc, t.census)
    long = demographics.demographics_long(prof)
    assert long.count() == 14 * loc.count()
    pair = demographics.default_pair(loc)
    names = [r.Store for r in pair.orderBy("position").collect()]
    piv = {r.Variable: r for r in demographics.demographic_pivot(long, pair, names).collect()}
    wide = {r.Store: r for r in prof.where(F.col("Store").isin(names)).collect()}
    from tillscope.sources.schemas import CENSUS_MEASURES
    for code, label, _ in CENSUS_MEASURES:
        for n in names:
            assert piv[label][n] == wide[n][code]


def test_enriched_rows_equal_items_times_payment_multiplicity(spark):
    t = fixtures.load(spark, SF_SMALL)
    mult = t.payments.groupBy("TRANSACTION_SET_ID").count()
    expected = (t.items.join(mult, "TRANSACTION_SET_ID", "left")
                .agg(F.sum(F.coalesce("count", F.lit(1)))).first()[0])
    assert reports.q_enriched(spark, SF_SMALL).count() == expected


def test_checked_broadcast_both_sides_of_the_limit(spark):
    from tillscope.plans.joins import checked_broadcast

    t = fixtures.load(spark, SF_SMALL)
    small = checked_broadcast(t.stores, max_bytes=64 * 1024 * 1024)
    big = checked_broadcast(t.stores, max_bytes=10)

    def hinted(df):
        return "Hint broadcast" in df._jdf.queryExecution().logical().toString()

    assert hinted(small) and not hinted(big)
    j_small = t.items.join(small.select(F.col("STORE_ID").cast("string").alias("STORE_ID")), "STORE_ID", "left")
    assert "BroadcastHashJoin" in _plan(j_small)
    j_big = t.items.join(big.select(F.col("STORE_ID").cast("string").alias("STORE_ID")), "STORE_ID", "left")
    assert j_small.count() == j_big.count()
