"""Packaged beverage brands: performance, drop candidates and their impact (page 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import filters as flt
from tillscope.functions.expr import distinct_with_null, money, week_label, wmean, wsum, zero_sum

MIN_SALES = 500
MIN_TRANSACTIONS = 50


def beverage_brands(
    enriched: DataFrame, stores: Sequence[str] | None = None, date_range: tuple | None = None
) -> DataFrame:
    """A4: brand → total_sales, units_sold, transaction_count, avg_price.

    Beverages by pattern (F8, null category dropped), brand present (F10).
    """
    df = (
        enriched.transform(flt.beverages_by_pattern())
        .transform(flt.keep_stores(stores))
        .transform(flt.date_between(date_range))
        .transform(flt.brand_present())
    )
    return df.groupBy("BRAND").agg(
        wsum("total_sales").alias("total_sales"),
        wsum("UNIT_QUANTITY").alias("units_sold"),
        distinct_with_null("TRANSACTION_ITEM_ID").alias("transaction_count"),
        wmean("UNIT_PRICE").alias("avg_price"),
    )


def page_rows(
    enriched: DataFrame,
    stores: DataFrame,
    date_range: tuple | None = None,
    excluded_store_names: Sequence[str] | None = None,
) -> DataFrame:
    """Rows behind page 2: F9 (exact category, brand present), F4, F5."""
    return (
        enriched.transform(flt.packaged_beverages())
        .transform(flt.date_between(date_range))
        .transform(flt.exclude_stores_by_name(stores, excluded_store_names))
    )


def brand_performance(rows: DataFrame) -> DataFrame:
    """A5 + P11: brand → total_sales, total_units, transaction_count, avg_price,
    sales_per_transaction; sorted by sales (cents, nulls first), then brand."""
    agg = rows.groupBy("BRAND").agg(
        wsum("total_sales").alias("total_sales"),
        wsum("UNIT_QUANTITY").alias("total_units"),
        distinct_with_null("TRANSACTION_ITEM_ID").alias("transaction_count"),
        wmean("UNIT_PRICE").alias("avg_price"),
    )
    return agg.withColumn(
        "sales_per_transaction", F.try_divide(F.col("total_sales"), F.col("transaction_count"))
    ).orderBy(money("total_sales").desc_nulls_first(), F.col("BRAND").asc_nulls_first())


def ranking_view(perf: DataFrame) -> DataFrame:
    """The ranking table's columns."""
    return perf.select("BRAND", "total_sales", "total_units", "transaction_count", "sales_per_transaction")


def weak_condition(min_sales: float, min_transactions: int):
    return (F.col("total_sales") < min_sales) | (F.col("transaction_count") < min_transactions)


def underperforming(perf: DataFrame, min_sales: float = MIN_SALES, min_transactions: int = MIN_TRANSACTIONS) -> DataFrame:
    """F13 + P16: brands under either threshold (sales < a OR count < b)."""
    return perf.where(weak_condition(min_sales, min_transactions)).select(
        "BRAND", "total_sales", "transaction_count", "total_units", "avg_price"
    )


def brand_kpis(perf: DataFrame, min_sales: float = MIN_SALES, min_transactions: int = MIN_TRANSACTIONS) -> DataFrame:
    """M4: one row — total_brands, underperforming_brands, avg_brand_sales, total_sales (0 if no brand)."""
    return perf.agg(
        F.count(F.lit(1)).alias("total_brands"),
        F.count_if(weak_condition(min_sales, min_transactions)).alias("underperforming_brands"),
        F.coalesce(F.avg("total_sales"), F.lit(0.0)).alias("avg_brand_sales"),
        zero_sum("total_sales").alias("total_sales"),
    )


def drop_impact(perf: DataFrame, min_sales: float = MIN_SALES, min_transactions: int = MIN_TRANSACTIONS) -> DataFrame:
    """M5: one row — lost_sales, lost_transactions, total_brand_sales, pct_sales
    (0 unless the total is positive), brands_removed, pct_brands (0 without brands)."""
    weak = weak_condition(min_sales, min_transactions)
    agg = perf.agg(
        zero_sum(F.when(weak, F.col("total_sales"))).alias("lost_sales"),
        F.coalesce(F.sum(F.when(weak, F.col("transaction_count"))), F.lit(0)).alias("lost_transactions"),
        zero_sum("total_sales").alias("total_brand_sales"),
        F.count_if(weak).alias("brands_removed"),
        F.count(F.lit(1)).alias("total_brands"),
    )
    return agg.select(
        "lost_sales",
        "lost_transactions",
        "total_brand_sales",
        F.when(F.col("total_brand_sales") > 0, F.col("lost_sales") / F.col("total_brand_sales") * 100)
        .otherwise(F.lit(0.0)).alias("pct_sales"),
        "brands_removed",
        F.when(F.col("total_brands") > 0, F.col("brands_removed") / F.col("total_brands") * 100)
        .otherwise(F.lit(0.0)).alias("pct_brands"),
    )


def top_brands(perf: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows of the sorted performance table (30, 15, 10 on the page)."""
    return perf.limit(n)


def brand_trend(rows: DataFrame, n: int = 10) -> DataFrame:
    """Weekly sales of the top-n brands with a week label, in week order.

    The brands' totals are sums of their weekly sums, so the rows are read
    and aggregated once (see ``filters.keep_largest``).
    """
    weekly = rows.groupBy("year", "week", "BRAND").agg(wsum("total_sales").alias("weekly_sales"))
    return (
        weekly.transform(flt.keep_largest("BRAND", "weekly_sales", n))
        .withColumn("week_label", week_label())
        .orderBy("year", "week", F.col("BRAND").asc_nulls_first())
    )
