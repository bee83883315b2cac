"""Items and payments by day, payments reduced to the selected items, and numbering in ranges."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from retail_fixture import frames, item
from tillscope.operators import payments, products
from tillscope.plans import enrich, order, reduce
from tillscope.plans.enrich import enrich_selected, enrich_weighted_tables
from tillscope.sources import fixtures, layout, readers

WEEK = ("1996-03-04", "1996-03-10")


def _rows(df, digits=6):
    return sorted(tuple(repr(round(v, digits) if isinstance(v, float) else v) for v in r) for r in df.collect())


def _march(spark):
    """The driver tables with the items of some weeks: few days, so few files."""
    t = fixtures.load(spark, SF_SMALL)
    return readers.RetailInputs(t.items.where(F.to_date("DATE_TIME").between("1996-02-20", "1996-03-20")), t.catalog,
                                t.payments, t.stores)


@pytest.fixture(scope="module")
def by_day(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("by-day"))
    layout.write_by_day(_march(spark), folder, files_a_day=2)
    return layout.load_by_day(spark, folder)


def test_by_day_gives_the_same_results(spark, by_day):
    t = _march(spark)
    for dates in (None, WEEK, ("1996-03-01", None)):
        want = products.weekly_sales(enrich_weighted_tables(t), date_range=dates)
        assert _rows(products.weekly_sales(enrich_weighted_tables(by_day), date_range=dates)) == _rows(want)
        assert _rows(products.weekly_sales(enrich_selected(by_day, date_range=dates))) == _rows(want)
    rows = lambda e: payments.page_rows(e, excluded_store_names=["Supplier#000000001"])
    assert _rows(payments.payment_comparison(rows(enrich_weighted_tables(by_day)))) == _rows(
        payments.payment_comparison(rows(enrich_weighted_tables(t))))
    assert enrich_weighted_tables(by_day).columns == enrich_weighted_tables(t).columns


def test_a_week_reads_its_days_of_items_and_of_payments(spark, by_day):
    for e in (enrich_selected(by_day, date_range=WEEK), enrich_weighted_tables(by_day)):
        df = products.weekly_sales(e, date_range=WEEK)
        df.collect()
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].splitlines()
                 if "FileScan" in x and "_by_day" in x]
        assert len(scans) == 2
        for line in scans:
            filters = line.split("PartitionFilters")[1].split("PushedFilters")[0]
            assert "item_date" in filters and ("1996-03-04" in filters or "9559" in filters), line
    listed = by_day.items.where(F.col("item_date").between(*WEEK)).select("item_date").distinct().count()
    assert 0 < listed <= 7


def test_rows_without_a_time_stay(spark, tmp_path):
    items = [item("t1", 1, 1, "1", "2024-01-02 00:00:00", "P", price=1.0, qty=1.0),
             item("t1", 2, 1, "1", "2024-01-03 00:00:00", "P", price=2.0, qty=1.0)]
    its, cat, pays, sts = frames(spark, items, [(1, "C", "B")], [("t1", "CASH"), ("t1", "CASH"), ("t9", "CASH")])
    its = its.unionByName(its.limit(1).withColumn("DATE_TIME", F.lit(None).cast(its.schema["DATE_TIME"].dataType)))
    t = readers.RetailInputs(its, cat, pays, sts)
    layout.write_by_day(t, str(tmp_path / "d"))
    got = enrich_weighted_tables(layout.load_by_day(spark, str(tmp_path / "d")))
    assert _rows(got) == _rows(enrich_weighted_tables(t))


def test_only_payments_of_the_selected_items_are_shuffled(spark):
    t = fixtures.load(spark, SF_SMALL)
    items = t.items.where(F.to_date("DATE_TIME").between(*WEEK))
    kept = reduce.reduced(t.payments, "TRANSACTION_SET_ID", items)
    exact = t.payments.join(items.select("TRANSACTION_SET_ID").distinct(), "TRANSACTION_SET_ID", "left_semi")
    assert kept.columns == t.payments.columns
    assert 0 < exact.count() == kept.count() < t.payments.count() / 10
    # far too few bits: more payments pass, the joined result stays exact
    coarse = reduce.reduced(t.payments, "TRANSACTION_SET_ID", items, bits=1 << 6)
    assert exact.exceptAll(coarse).count() == 0 and coarse.count() > exact.count()
    want = products.weekly_sales(enrich_weighted_tables(t), date_range=WEEK)
    assert _rows(products.weekly_sales(enrich_selected(t, date_range=WEEK))) == _rows(want)
    df = products.weekly_sales(enrich_selected(t, ["1", "3"], WEEK))
    assert _rows(df) == _rows(products.weekly_sales(enrich_weighted_tables(t), True, ["1", "3"], WEEK))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "Python" not in plan


def test_bitmaps_hold_every_bit(spark):
    ids = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("k"))
    for bits in (1 << 15, 1 << 20):
        kept = reduce.reduced(ids, "k", ids.where("k like '%7'"), bits)
        assert kept.where("k like '%7'").count() == 500
    assert kept.count() < 520
    assert reduce.reduced(ids, "k", ids.limit(0)).count() == 0
    mixed = spark.createDataFrame([(None,), ("a",)], "k string")
    assert [r.k for r in reduce.reduced(mixed, "k", mixed).collect()] == ["a"]


def test_places_equal_a_sort(spark):
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else f"n{i % 37}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b string, c long").repartition(7)
    for ranges in (1, 5, 256):
        got = [r.c for r in sorted(order.numbered(df, [F.col("b"), -F.col("a")], ranges=ranges).collect(), key=lambda r: r.place)]
        assert got == [r[2] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", -r[0]))]
    numbered = order.numbered(df, [F.col("c")])
    assert numbered.columns == ["a", "b", "c", "place"] and numbered.agg(F.max("place")).first()[0] == 1000
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [row_number()" in x]
    assert windows and all("[_range" in x for x in windows)  # the rows' window has ranges as its partitions
    assert order.numbered(df.limit(0), [F.col("c")]).count() == 0


def test_ranges_are_taken_of_groups_not_of_their_rows(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(100)], "a long, b long")
    ids = spark.createDataFrame([(i,) for i in range(0, 100, 2)], "b long")
    for df in (rows.join(ids, "b").groupBy("a").agg(F.sum("b").alias("s")), rows.join(ids, "b").select("a").distinct()):
        numbered = order.numbered(df, [-F.col("a")])
        assert [(r.a, r.place) for r in numbered.orderBy("place").collect()] == [(6 - i, i + 1) for i in range(7)]
        plan = numbered._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert any("array_position" in x for x in plan)
        assert not [x for x in plan if "array_position" in x and ("Filter" in x or "Join" in x)]


def test_a_heavy_row_is_spread_by_default(spark):
    items = [item("hot", 1, 1, "1", "2024-01-02 00:00:00", "P", price=1.0, qty=1.0),
             item("t2", 2, 1, "1", "2024-01-02 00:00:00", "P", price=1.0, qty=1.0)]
    its, cat, pays, sts = frames(spark, items, [(1, "C", "B")], [("t2", "CASH")])
    hot = spark.range(95_000).select(F.lit("hot").alias("TRANSACTION_SET_ID"), F.lit("CASH").alias("PAYMENT_TYPE"))
    light = readers.RetailInputs(its, cat, pays, sts)
    assert not enrich.has_heavy_rows(light)
    heavy = readers.RetailInputs(its, cat, pays.unionByName(hot), sts)
    assert enrich.has_heavy_rows(heavy)
    out = enrich.enrich_tables(heavy)
    assert out.count() == 95_001
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = out.where("TRANSACTION_SET_ID = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < 95_000 / 2


def test_landed_folder_by_day(spark, by_day):
    assert {"catalog", "items", "payments", "stores"} <= set(by_day.__dataclass_fields__)
    assert os.path.basename(layout.ITEMS) == "transaction_items_by_day"
