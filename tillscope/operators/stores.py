"""Store list, store names seen in transactions, and date bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import filters as flt
from tillscope.plans.joins import checked_broadcast, left_join


def store_list(stores: DataFrame) -> DataFrame:
    """T5: STORE_ID, STORE_NAME, CITY sorted by name (nulls first, N8)."""
    return stores.select("STORE_ID", "STORE_NAME", "CITY").orderBy(
        F.col("STORE_NAME").asc_nulls_first(), F.col("STORE_ID").asc_nulls_first()
    )


def stores_seen(items: DataFrame, stores: DataFrame) -> DataFrame:
    """Distinct (STORE_ID, STORE_NAME, CITY, STATE) of the enriched frame.

    The enriched frame's left joins never drop an item, so its distinct
    store columns equal the distinct item store ids joined to the store
    table.  Only STORE_ID is read from the items; the distinct is partially
    aggregated, so the shuffle carries at most one row per store and map task.
    """
    ids = items.select("STORE_ID").distinct()
    st = stores.select(F.col("STORE_ID").cast("string").alias("STORE_ID"), "STORE_NAME", "CITY", "STATE")
    return ids.join(checked_broadcast(st), "STORE_ID", "left").distinct()


def store_names(items: DataFrame, stores: DataFrame) -> DataFrame:
    """D3: distinct STORE_NAME of the enriched frame, null included, sorted."""
    return stores_seen(items, stores).select("STORE_NAME").distinct().orderBy(F.col("STORE_NAME").asc_nulls_first())


def date_bounds(frame: DataFrame, column: str = "date") -> DataFrame:
    """M1: one row, ``min_date`` and ``max_date`` (exact over all rows, N20)."""
    return frame.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))


def item_date_bounds(items: DataFrame, fuel_code_filter: bool = True) -> DataFrame:
    """M1 on page-1 rows, computed from the items alone.

    min/max of ``date`` over the enriched frame equal min/max over its items
    (left joins keep every item; repeats do not move a bound), so only
    DATE_TIME and NONSCAN_CATEGORY are scanned and no join runs.
    """
    rows = items.transform(flt.drop_fuel_code()) if fuel_code_filter else items
    return date_bounds(rows.select(F.to_date("DATE_TIME").alias("date")))


def beverage_date_bounds(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """M1 on page-2 rows (F9), or on all rows when there are none.

    Both pairs of bounds come from one pass over items ⟕ catalog.
    """
    day = F.to_date("DATE_TIME")
    rows = left_join(items.select("GTIN", "DATE_TIME"), catalog.select("GTIN", "CATEGORY", "BRAND"), "GTIN")
    own = (F.col("CATEGORY") == flt.PACKAGED_BEVERAGES) & F.col("BRAND").isNotNull()
    both = rows.agg(
        F.count_if(own).alias("n"),
        F.min(F.when(own, day)).alias("own_min"), F.max(F.when(own, day)).alias("own_max"),
        F.min(day).alias("all_min"), F.max(day).alias("all_max"),
    )
    return both.select(
        F.when(F.col("n") > 0, F.col("own_min")).otherwise(F.col("all_min")).alias("min_date"),
        F.when(F.col("n") > 0, F.col("own_max")).otherwise(F.col("all_max")).alias("max_date"),
    )


def time_bounds(items: DataFrame) -> DataFrame:
    """M1 of the API: one row, the earliest and latest DATE_TIME of all items."""
    return items.agg(F.min("DATE_TIME").alias("min_time"), F.max("DATE_TIME").alias("max_time"))
