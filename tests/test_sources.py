"""Readers and sinks: CSV round trips, census responses, report file names."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tillscope.operators import demographics
from tillscope.sources import readers, schemas, sinks


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_csv_to_parquet_and_sales_csv(spark, scratch):
    src = os.path.join(scratch, "sales_data.csv")
    _write(src, "date,store,product_name,category,quantity,sales_amount,payment_type\n"
                "2021-07-09,Elm Street,Pear Fizz,Fizzy,4,9.20,Debit\n"
                "2021-07-11,Elm Street,Rope Candy,Sweets,3,1.80,Cash\n")
    n = sinks.csv_to_parquet(spark, src, os.path.join(scratch, "sales_data.parquet"))
    assert n == 2
    back = spark.read.parquet(os.path.join(scratch, "sales_data.parquet"))
    assert back.where(F.col("product_name") == "Pear Fizz").first()["sales_amount"] == 9.2
    typed = readers.read_sales_csv(spark, src)
    assert typed.schema == schemas.SALES_CSV_SCHEMA
    assert typed.agg(F.sum("quantity")).first()[0] == 7
    prod = os.path.join(scratch, "products.csv")
    _write(prod, "product_id,product_name,category,brand,unit_price\n7,Pear Fizz,Fizzy,Orchard Works,3.10\n")
    assert readers.read_products_csv(spark, prod).first()["unit_price"] == 3.1


def test_report_csv_name_and_content(spark, scratch):
    df = spark.createDataFrame([(1, "A", "A", 1.5, 2.0)],
                               "rank int, POS_DESCRIPTION string, label string, total_sales double, total_units double")
    path = sinks.write_top_products(df, scratch, (dt.date(2023, 1, 1), dt.date(2023, 12, 31)))
    assert path.endswith("top_products_2023-01-01_2023-12-31.csv") and os.path.isfile(path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["POS_DESCRIPTION", "total_sales", "total_units"]
    assert back.collect()[0]["POS_DESCRIPTION"] == "A"
    assert sinks.write_payment_summary(df, scratch).endswith("payment_comparison_summary.csv")
    folder = sinks.write_payment_summary(df, scratch, single_file=False)
    assert folder.endswith("payment_comparison_summary") and os.path.isdir(folder)


def test_a_download_is_replaced_whole_or_not_at_all(spark, scratch):
    good = spark.range(3).select(F.lit("A").alias("payment_group"), "id")
    path = sinks.write_payment_summary(good, scratch)
    first = open(path).read()
    assert first.splitlines()[0] == "payment_group,id" and len(first.splitlines()) == 4
    broken = spark.range(3).select(F.expr("raise_error('stop')").cast("string").alias("payment_group"), "id")
    with pytest.raises(Exception, match="stop"):
        sinks.write_payment_summary(broken, scratch)
    assert open(path).read() == first
    assert sinks.write_payment_summary(good.limit(1), "file://" + scratch) == "file://" + path
    assert len(open(path).read().splitlines()) == 2
    assert [f for f in os.listdir(scratch) if f.startswith("payment")] == ["payment_comparison_summary.csv"]


def test_conversion_reads_the_input_once(spark, scratch):
    src, out = os.path.join(scratch, "in.csv"), os.path.join(scratch, "out.parquet")
    _write(src, "date,store,product_name,category,quantity,sales_amount,payment_type\n"
                + "2021-07-09,Elm Street,Pear Fizz,Fizzy,4,9.20,Debit\n" * 500)
    spark.sparkContext.setJobGroup("convert", "one write")
    try:
        assert sinks.csv_to_parquet(spark, src, out, schema=schemas.SALES_CSV_SCHEMA) == 500
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("convert")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert spark.read.parquet(out).schema == schemas.SALES_CSV_SCHEMA
    assert sinks.csv_to_parquet(spark, src, out, infer_schema=False) == 500
    assert {t for _, t in spark.read.parquet(out).dtypes} == {"string"}


_FILE = ("TRANSACTION_SET_ID string, TRANSACTION_ITEM_ID {item}, GTIN {gtin}, STORE_ID {store}, DATE_TIME timestamp_ntz, "
         "POS_DESCRIPTION string, NONSCAN_CATEGORY string, UNIT_PRICE {price}, UNIT_QUANTITY {price}{more}")


def _item_file(spark, folder, rows, more="", **types):
    schema = _FILE.format(more=more, **{"item": "bigint", "gtin": "bigint", "store": "string", "price": "double", **types})
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_item_files_of_different_columns_and_types(spark, scratch):
    day, folder = dt.datetime(2024, 1, 2), os.path.join(scratch, "a")
    _item_file(spark, folder, [("t1", 1, 12, "7", day, "P", "NONE", 1.5, 2.0)])
    _item_file(spark, folder, [("t2", 2, 13, "8", day, "Q", "NONE", 2.5, 1.0, "x")], more=", CLERK string")
    rows = {r.POS_DESCRIPTION: (r.GTIN, r.CLERK) for r in readers.read_transaction_items(spark, folder).collect()}
    assert rows == {"P": (12, None), "Q": (13, "x")}
    # codes as text in one file, as numbers in others; whole prices; numeric store ids
    _item_file(spark, folder, [("t3", "3", "00012", 9, day, "R", "NONE", 3, 4)], item="string", gtin="string", store="int", price="int")
    found = readers.read_transaction_items(spark, folder)
    assert dict(found.dtypes)["GTIN"] == "string" and dict(found.dtypes)["UNIT_PRICE"] == "double"
    rows = {r.POS_DESCRIPTION: (r.GTIN, r.STORE_ID, r.TRANSACTION_ITEM_ID, r.UNIT_PRICE, r.CLERK) for r in found.collect()}
    assert rows == {"P": ("12", "7", "1", 1.5, None), "Q": ("13", "8", "2", 2.5, "x"), "R": ("00012", "9", "3", 3.0, None)}
    # a mixture without a common type is an error that names it
    _item_file(spark, folder, [("t4", 4, 14, "8", day, "S", "NONE", 2.5, 1.0, [1])], more=", EXTRA array<int>")
    _item_file(spark, folder, [("t5", 5, 14, "8", day, "S", "NONE", 2.5, 1.0, True)], more=", EXTRA boolean")
    with pytest.raises(schemas.SchemaError, match="EXTRA"):
        readers.read_transaction_items(spark, folder)


def _response(cells: dict, drop=(), short=False):
    header = ["NAME", *[c for c in schemas.CENSUS_CODES if c not in drop], "state", "county"]
    row = ["Some County", *[cells.get(c, "100") for c in schemas.CENSUS_CODES if c not in drop], "16", cells["county"]]
    if short:
        row = row[:3]
    return json.dumps([header, row])


def test_census_responses_cells_and_whole_county_default(spark, scratch):
    d = os.path.join(scratch, "census")
    os.makedirs(d)
    # county 019: every no-value form reads 0.0, a decimal text parses
    _write(f"{d}/a.json", _response({"county": "019", "B01001_001E": None, "B01002_001E": "null",
                                     "B25077_001E": "-666666666", "B19013_001E": "12.5"}))
    # county 065: one cell is not a number → whole default profile
    _write(f"{d}/b.json", _response({"county": "065", "B23025_005E": "abc"}))
    # county 001: a code missing from the header → default
    _write(f"{d}/c.json", _response({"county": "001"}, drop=("B08303_001E",)))
    # county 003: data row too short → default
    _write(f"{d}/e.json", _response({"county": "003"}, short=True))
    # not a response at all
    _write(f"{d}/f.json", "<html>error</html>")
    cen = readers.read_census_responses(spark, d)
    flags = {r.county: r.complete for r in cen.collect()}
    assert flags["019"] and flags["065"] and flags["001"] is False and None in flags

    loc = spark.createDataFrame(
        [("S019", "1", "x", "16", "019"), ("S065", "2", "x", "16", "065"), ("S001", "3", "x", "16", "001"),
         ("S003", "4", "x", "16", "003"), ("S999", "5", "x", "16", "999")],
        "Store string, STORE_ID string, CITY string, state string, county string")
    prof = {r.Store: r for r in demographics.census_profiles(loc, cen).collect()}
    a = prof["S019"]
    assert a.census_ok and a.B01001_001E == 0.0 and a.B01002_001E == 0.0 and a.B25077_001E == 0.0
    assert a.B19013_001E == 12.5 and a.B23025_005E == 100.0
    for s in ["S065", "S001", "S003", "S999"]:
        p = prof[s]
        assert not p.census_ok
        assert p.B01001_001E == 27000.0 and p.B01002_001E == 35.5 and p.B08303_001E == 22.5


def test_cluster_conf_scales_with_input():
    from tillscope.session import cluster_conf

    small = cluster_conf(10 * 1024 ** 3, executors=10, cores_per_executor=4)
    big = cluster_conf(100 * 1024 ** 4, executors=1000, cores_per_executor=8, executor_memory_gb=32)
    assert int(small["spark.sql.shuffle.partitions"]) == 120  # 3 waves of 40 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 102400  # one per GiB of 100 TiB
    assert int(big["spark.tillscope.broadcastMaxBytes"]) == 512 * 1024 ** 2


def test_load_retail_from_a_dashboard_data_folder(spark, scratch):
    from tillscope.plans import pages
    from tillscope.sources import fixtures

    t = fixtures.load(spark, "/root/testdata/sf0.001")
    t.items.write.parquet(os.path.join(scratch, readers.ITEMS_DIR))
    t.catalog.write.parquet(os.path.join(scratch, readers.CATALOG_FILE))
    t.payments.write.parquet(os.path.join(scratch, readers.PAYMENTS_FILE))
    t.stores.write.parquet(os.path.join(scratch, readers.STORES_FILE))
    cen = os.path.join(scratch, "census")
    fixtures.census_documents(spark, "/root/testdata/sf0.001").coalesce(1).write.text(cen)
    inputs = readers.load_retail(spark, scratch, census_dir=cen)
    landed = pages.top_products_page(inputs)["top_products"].collect()
    direct = pages.top_products_page(t)["top_products"].collect()
    assert landed == direct
    p4 = pages.demographics_page(inputs)
    assert p4["long"].count() == 14 * p4["locations"].count()


def test_checkpoint_needs_the_sessions_folder(spark):
    from tillscope.plans import reuse

    assert reuse.can_checkpoint(spark)  # set in conftest, as a cluster would
    assert reuse.landing_folder(spark).startswith(spark.sparkContext.getCheckpointDir().rstrip("/"))


def test_keys_keep_their_file_type(spark, scratch):
    from tillscope.plans.enrich import enrich_weighted

    items = [("t1", "a", "00012", "007", dt.datetime(2024, 1, 2), "P", "NONE", 1.0, 1.0),
             ("t1", "b", "12", "7", dt.datetime(2024, 1, 2), "Q", "NONE", 2.0, 1.0),
             ("t2", "c", "X12", "8", dt.datetime(2024, 1, 2), "R", "NONE", 4.0, 1.0)]
    spark.createDataFrame(items, "TRANSACTION_SET_ID string, TRANSACTION_ITEM_ID string, GTIN string, STORE_ID string, "
                          "DATE_TIME timestamp_ntz, POS_DESCRIPTION string, NONSCAN_CATEGORY string, UNIT_PRICE double, "
                          "UNIT_QUANTITY double").write.parquet(f"{scratch}/{readers.ITEMS_DIR}")
    spark.createDataFrame([("00012", "padded", "B"), ("12", "plain", "B"), ("X12", "coded", "B")],
                          "GTIN string, CATEGORY string, BRAND string").write.parquet(f"{scratch}/{readers.CATALOG_FILE}")
    spark.createDataFrame([("t1", "CASH")], "TRANSACTION_SET_ID string, PAYMENT_TYPE string").write.parquet(
        f"{scratch}/{readers.PAYMENTS_FILE}")
    spark.createDataFrame([("007", "Bond", "Rigby", "ID"), ("7", "Seven", "Rigby", "ID")],
                          "STORE_ID string, STORE_NAME string, CITY string, STATE string").write.parquet(
        f"{scratch}/{readers.STORES_FILE}")
    t = readers.load_retail(spark, scratch)
    got = {r.POS_DESCRIPTION: (r.CATEGORY, r.STORE_NAME) for r in
           enrich_weighted(t.items, t.catalog, t.payments, t.stores).collect()}
    assert got == {"P": ("padded", "Bond"), "Q": ("plain", "Seven"), "R": ("coded", None)}
    # a catalog with numbers as keys is compared as text
    numbers = spark.createDataFrame([(12, "number", "B")], "GTIN bigint, CATEGORY string, BRAND string")
    got = {r.POS_DESCRIPTION: r.CATEGORY for r in enrich_weighted(t.items, numbers, t.payments, t.stores).collect()}
    assert got == {"P": None, "Q": "number", "R": None}
