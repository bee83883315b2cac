"""Top products by weekly sales (page 1) and the weekly-sales API.

Inputs are the weighted enriched frame (``plans.enrich.enrich_weighted``);
sums and means are weighted by payment multiplicity, which equals the
dashboard's arithmetic over its row-level join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions import filters as flt
from tillscope.functions.expr import distinct_with_null, money, week_label, wsum, zero_sum
from tillscope.plans.joins import left_join

WEEK_KEYS = ["year", "week", "POS_DESCRIPTION", "CATEGORY"]


def weekly_sales(
    enriched: DataFrame,
    exclude_fuels: bool = True,
    stores: Sequence[str] | None = None,
    date_range: tuple | None = None,
) -> DataFrame:
    """A1: (year, week, product, category) → weekly_sales, units_sold, transaction_count.

    Filters F2 (fuel by pattern, null kept), F3 (store ids) and F4 (dates).
    """
    df = enriched
    if exclude_fuels:
        df = df.transform(flt.drop_fuel_pattern())
    df = df.transform(flt.keep_stores(stores)).transform(flt.date_between(date_range))
    return df.groupBy(*WEEK_KEYS).agg(
        wsum("total_sales").alias("weekly_sales"),
        wsum("UNIT_QUANTITY").alias("units_sold"),
        distinct_with_null("TRANSACTION_ITEM_ID").alias("transaction_count"),
    )


def page_rows(
    enriched: DataFrame,
    stores: DataFrame,
    date_range: tuple | None = None,
    excluded_store_names: Sequence[str] | None = None,
    excluded_categories: Sequence[str] | None = None,
) -> DataFrame:
    """Rows behind page 1: F1 (fuel code), F4, F5 (stores by name), F7."""
    return (
        enriched.transform(flt.drop_fuel_code())
        .transform(flt.date_between(date_range))
        .transform(flt.exclude_stores_by_name(stores, excluded_store_names))
        .transform(flt.exclude_categories(excluded_categories))
    )


def weekly_product_sales(rows: DataFrame) -> DataFrame:
    """A2: (year, week, product, category) → weekly_sales, units_sold."""
    return rows.groupBy(*WEEK_KEYS).agg(
        wsum("total_sales").alias("weekly_sales"),
        wsum("UNIT_QUANTITY").alias("units_sold"),
    )


def product_totals(frame: DataFrame, from_weekly: bool = False) -> DataFrame:
    """A3 without the cut: product → total_sales, total_units.

    From page rows this is one aggregation (sums are associative, so the
    dashboard's sum of weekly sums equals it); ``from_weekly`` re-aggregates
    an A2 result instead, which lets one plan share the weekly shuffle.
    """
    if from_weekly:
        return frame.groupBy("POS_DESCRIPTION").agg(
            zero_sum("weekly_sales").alias("total_sales"),
            zero_sum("units_sold").alias("total_units"),
        )
    return frame.groupBy("POS_DESCRIPTION").agg(
        wsum("total_sales").alias("total_sales"),
        wsum("UNIT_QUANTITY").alias("total_units"),
    )


def top_k(totals: DataFrame, k: int = 5) -> DataFrame:
    """K products with the highest total sales.

    Sorted on the cent-rounded amount, nulls first (N8), product name as
    the tie-break (N12); planned as a bounded TakeOrderedAndProject.
    """
    return totals.orderBy(
        money("total_sales").desc_nulls_first(), F.col("POS_DESCRIPTION").asc_nulls_first()
    ).limit(k)


def ranked(top: DataFrame) -> DataFrame:
    """Rank number and the 20-character product label of a top-k table."""
    w = Window.orderBy(money("total_sales").desc_nulls_first(), F.col("POS_DESCRIPTION").asc_nulls_first())
    return top.select(
        F.row_number().over(w).alias("rank"),
        "POS_DESCRIPTION",
        F.substring("POS_DESCRIPTION", 1, 20).alias("label"),
        "total_sales",
        "total_units",
    )


def top_products(rows: DataFrame, k: int = 5) -> DataFrame:
    """A3 + T1 + P17: the k best products with rank and label.

    The window runs over the k rows left after the limit only.
    """
    return ranked(top_k(product_totals(rows), k))


def product_trend(weekly: DataFrame, k: int = 5) -> DataFrame:
    """A13 + P8 + T7: the top k products' weekly rows with a week label, in week order.

    Rows stay per (product, category) as the dashboard keeps them.  The top
    products are found on the weekly rows themselves, so the items are read
    once (see ``filters.keep_largest``).
    """
    return (
        weekly.transform(flt.keep_largest("POS_DESCRIPTION", "weekly_sales", k))
        .withColumn("week_label", week_label())
        .orderBy("year", "week", F.col("POS_DESCRIPTION").asc_nulls_first(), F.col("CATEGORY").asc_nulls_first())
    )


def product_target(weekly: DataFrame, k: int = 5, factor: float = 0.7, fallback: float = 1000.0) -> DataFrame:
    """M2 + P19: highest weekly value among the top products and the default target.

    One row: ``max_weekly_sales``, ``target_default`` (factor × max, or the
    fallback when the max is null or zero) and ``target_max`` (the max, or
    10000 then).
    """
    mx = weekly.transform(flt.keep_largest("POS_DESCRIPTION", "weekly_sales", k)).agg(F.max("weekly_sales").alias("m"))
    has = F.col("m").isNotNull() & (F.col("m") != 0)
    return mx.select(
        F.col("m").alias("max_weekly_sales"),
        F.when(has, F.col("m") * factor).otherwise(F.lit(fallback)).alias("target_default"),
        F.when(has, F.col("m")).otherwise(F.lit(10000.0)).alias("target_max"),
    )


def category_list(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """D2 + F16: sorted distinct non-null categories of the non-fuel items.

    Equal to the categories of page-1 rows: payment and store joins only
    repeat rows, so they cannot change the set.  Only items ⋈ catalog runs,
    and the distinct is partially aggregated before its shuffle.
    """
    return (
        items.transform(flt.drop_fuel_code())
        .select("GTIN")
        .transform(left_join, catalog.select("GTIN", "CATEGORY"), "GTIN")
        .transform(flt.category_present())
        .select("CATEGORY")
        .distinct()
        .orderBy("CATEGORY")
    )
