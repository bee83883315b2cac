"""A data folder laid out by day.

Payments have no date, so a date range prunes the items alone, and the payment
join shuffles all payments whatever the range.  Here both are stored by the day
of the items: ``items_by_day/item_date=...`` and ``payments_by_day/item_date=...``,
where a transaction's payment weights lie in each day on which it has items.  The
join is on transaction and day, and a date range reads only its days of both.

Rows without a time are kept in a day of their own (``plans.enrich.no_day``).  Payments of
transactions without items are left out: no analysis reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.expr import WEIGHT
from tillscope.plans.enrich import DAY, no_day, payment_weights
from tillscope.plans.joins import left_join
from tillscope.sources import schemas as S
from tillscope.sources.readers import CATALOG_FILE, ITEMS_DIR, STORES_FILE, RetailInputs, read_catalog, read_stores

ITEMS, PAYMENTS = f"{ITEMS_DIR}_by_day", "payments_by_day"


def _days(items: DataFrame) -> DataFrame:
    return items.withColumn(DAY, F.coalesce(F.to_date("DATE_TIME"), no_day()))


def write_by_day(inputs, folder: str, files_a_day: int = 1) -> None:
    """Lay ``inputs`` (items, catalog, payments, stores) out in ``folder``.

    A day's rows are dealt over ``files_a_day`` tasks by a hash of the item, so
    neither a busy day nor a hot transaction is written by one task; choose it
    so that a file has some 512 MiB.
    """
    base = folder.rstrip("/")
    items = _days(inputs.items)
    part = F.pmod(F.xxhash64("TRANSACTION_ITEM_ID", "TRANSACTION_SET_ID"), F.lit(files_a_day))
    items.repartition(DAY, part).write.partitionBy(DAY).parquet(f"{base}/{ITEMS}")
    seen = items.select("TRANSACTION_SET_ID", DAY).distinct()
    weights = left_join(seen, payment_weights(inputs.payments), "TRANSACTION_SET_ID").where(F.col(WEIGHT).isNotNull())
    part = F.pmod(F.xxhash64("TRANSACTION_SET_ID"), F.lit(files_a_day))
    weights.repartition(DAY, part).write.partitionBy(DAY).parquet(f"{base}/{PAYMENTS}")
    inputs.catalog.write.parquet(f"{base}/{CATALOG_FILE}")
    inputs.stores.write.parquet(f"{base}/{STORES_FILE}")


def load_by_day(spark: SparkSession, folder: str) -> RetailInputs:
    """The inputs of a folder written by ``write_by_day``; ``plans.enrich`` joins them by transaction and day."""
    base = folder.rstrip("/")
    items = spark.read.parquet(f"{base}/{ITEMS}").withColumn(DAY, F.col(DAY).cast("date"))
    weights = spark.read.parquet(f"{base}/{PAYMENTS}").withColumn(DAY, F.col(DAY).cast("date"))
    return RetailInputs(
        items=S.require_columns(items, S.ITEM_COLUMNS, "items by day"),
        catalog=read_catalog(spark, f"{base}/{CATALOG_FILE}"),
        payments=S.require_columns(weights, S.PAYMENT_COLUMNS, "payments by day"),
        stores=read_stores(spark, f"{base}/{STORES_FILE}"),
    )
