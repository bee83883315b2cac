"""Hand-written retail tables for edge-case tests (FIXTURES.md §3)."""

import datetime as dt

from tillscope.plans.enrich import enrich_weighted, expand_weight

ITEMS = ("TRANSACTION_SET_ID string, TRANSACTION_ITEM_ID bigint, GTIN bigint, STORE_ID string, "
         "DATE_TIME timestamp_ntz, POS_DESCRIPTION string, NONSCAN_CATEGORY string, UNIT_PRICE double, "
         "UNIT_QUANTITY double")
CATALOG = "GTIN bigint, CATEGORY string, BRAND string"
PAYMENTS = "TRANSACTION_SET_ID string, PAYMENT_TYPE string"
STORES = "STORE_ID bigint, STORE_NAME string, CITY string, STATE string"


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def item(tsid, item_id, gtin, store, when, product, nonscan="NONE", price=1.0, qty=1.0):
    return (tsid, item_id, gtin, store, ts(when), product, nonscan, price, qty)


def frames(spark, items, catalog=(), payments=(), stores=()):
    return (
        spark.createDataFrame(list(items), ITEMS),
        spark.createDataFrame(list(catalog), CATALOG),
        spark.createDataFrame(list(payments), PAYMENTS),
        spark.createDataFrame(list(stores), STORES),
    )


def weighted(spark, items, catalog=(), payments=(), stores=()):
    return enrich_weighted(*frames(spark, items, catalog, payments, stores))


def rows_level(spark, items, catalog=(), payments=(), stores=()):
    return expand_weight(weighted(spark, items, catalog, payments, stores))
