"""The four dashboard pages as bundles of lazy result tables.

Each function returns every table a page shows, built over one shared base
so that Spark reuses identical shuffles inside a plan.  Use ``page_session``
to keep the shared aggregate cached while the tables are read and written:

    with page_session(brand_page(tables), share="performance") as page:
        page["kpis"].show(); sinks.write_brand_analysis(page["performance"], out, dates)

Selections mirror the page widgets: date range, excluded stores or
categories, thresholds, payment sides, and the store or store pair on page 4.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tillscope.operators import brands, demographics, payments, products, stores
from tillscope.plans.enrich import enrich_weighted_tables


class Page(dict):
    """A page's tables by name; ``kept`` is an aggregate that was marked to be kept for them."""

    kept: DataFrame | None = None


class RetailTables(Protocol):
    """The inputs a page reads: ``sources.readers.load_retail`` for a data
    folder, ``sources.fixtures.load`` for the driver tables.  ``census`` is
    needed by page 4 only."""

    items: DataFrame
    catalog: DataFrame
    payments: DataFrame
    stores: DataFrame
    census: DataFrame | None


def top_products_page(
    t: RetailTables,
    date_range: tuple | None = None,
    excluded_store_names: Sequence[str] | None = None,
    excluded_categories: Sequence[str] | None = None,
    k: int = 5,
) -> dict[str, DataFrame]:
    """Page 1 (§3.1): bounds, store list, categories, weekly sales, top k, trend, target."""
    e = enrich_weighted_tables(t, catalog_first=bool(excluded_categories))
    rows = products.page_rows(e, t.stores, date_range, excluded_store_names, excluded_categories)
    weekly = products.weekly_product_sales(rows)
    top = products.ranked(products.top_k(products.product_totals(weekly, from_weekly=True), k))
    return {  # the trend and the target rank the weekly rows themselves
        "date_bounds": stores.item_date_bounds(t.items),
        "store_list": stores.store_list(t.stores),
        "categories": products.category_list(t.items, t.catalog),
        "weekly": weekly,
        "top_products": top,
        "trend": products.product_trend(weekly, k),
        "target": products.product_target(weekly, k),
    }


def brand_page(
    t: RetailTables,
    date_range: tuple | None = None,
    excluded_store_names: Sequence[str] | None = None,
    min_sales: float = brands.MIN_SALES,
    min_transactions: int = brands.MIN_TRANSACTIONS,
) -> dict[str, DataFrame]:
    """Page 2 (§3.2): performance ranking, KPIs, drop candidates and impact, top-n views, trend."""
    rows = brands.page_rows(enrich_weighted_tables(t, catalog_first=True), t.stores, date_range, excluded_store_names)
    perf = brands.brand_performance(rows)
    return {
        "date_bounds": stores.beverage_date_bounds(t.items, t.catalog),
        "store_list": stores.store_list(t.stores),
        "performance": perf,
        "ranking": brands.ranking_view(perf),
        "kpis": brands.brand_kpis(perf, min_sales, min_transactions),
        "underperforming": brands.underperforming(perf, min_sales, min_transactions),
        "drop_impact": brands.drop_impact(perf, min_sales, min_transactions),
        "top30": brands.top_brands(perf, 30),
        "top15": brands.top_brands(perf, 15),
        "trend": brands.brand_trend(rows, 10),
    }


def payments_page(
    t: RetailTables,
    date_range: tuple | None = None,
    excluded_store_names: Sequence[str] | None = None,
    cash: bool = True,
    credit: bool = True,
    shared: bool = True,
) -> dict[str, DataFrame]:
    """Page 3 (§3.3): comparison, deltas, shares, top products, weekly, daily max, breakdown.

    The eight tables come from one aggregation over the joined rows
    (``payments.page_cube``), which is kept in memory or on disk once the first
    table is read: the payment join runs once for the page.  ``page_session``
    lets it go.  With ``shared=False`` each table is a plan of its own, for a
    caller who reads one.
    """
    e = enrich_weighted_tables(t, catalog_first=False)
    rows = payments.page_rows(e, date_range, excluded_store_names, cash, credit)
    page = Page(date_bounds=stores.item_date_bounds(t.items, fuel_code_filter=False),
                store_names=stores.store_names(t.items, t.stores))
    if shared:
        page.kept = payments.page_cube(rows).persist(StorageLevel.MEMORY_AND_DISK)
        page.update(payments.cube_tables(page.kept))
        return page
    cmp_ = payments.payment_comparison(rows)
    page.update({
        "comparison": cmp_,
        "deltas": payments.payment_deltas(cmp_),
        "share": payments.payment_share(cmp_),
        "top_products": payments.top_products_by_group(rows, 10),
        "weekly": payments.weekly_by_group(rows),
        "daily_max": payments.daily_max(rows),
        "category_breakdown": payments.category_breakdown(rows),
        "product_detail": payments.product_detail(rows, 20),
    })
    return page


def demographics_page(
    t: RetailTables, first: str | None = None, second: str | None = None
) -> dict[str, DataFrame]:
    """Page 4 (§3.4): locations, long table, families, profiles; pair views when two stores are compared.

    The page opens with one store, ``first`` (by default the first name in
    sorted order): its table, and the names offered for comparison.  With
    ``second`` the pair views are added.  ``selected`` has the rows of the
    selected stores, which is what the page offers for download.
    """
    loc = demographics.store_locations(t.items, t.stores)
    prof = demographics.census_profiles(loc, t.census)
    long = demographics.demographics_long(prof)
    spark = t.items.sparkSession
    one = demographics.chosen(spark, [first]) if first else demographics.default_pair(loc, 1)
    pair = demographics.chosen(spark, [first, second]) if first and second else None
    if second and not first:
        pair = demographics.default_pair(loc, 1).unionByName(demographics.chosen(spark, [second], at=2))
    out = {
        "locations": loc,
        "profiles": prof,
        "long": long,
        "selected": demographics.selected_rows(long, pair if pair is not None else one),
        "single_store": demographics.first_store_rows(long, one),
        "compare_options": demographics.compare_options(loc, one),
        "family_share": demographics.family_share(long),
        "store_profile": demographics.store_profile(prof),
    }
    if pair is not None:
        out["delta"] = demographics.demographic_delta(long, pair)
        out["normalised"] = demographics.demographic_normalised(long, pair)
        if first:
            out["pivot"] = demographics.demographic_pivot(long, pair, [first, second])
    for family in ("economic", "education", "housing", "race"):
        out[f"family_{family}"] = demographics.family_rows(long, family)
    return out


_SHARED = {"performance", "comparison", "weekly", "long"}


@contextlib.contextmanager
def page_session(
    page: dict[str, DataFrame], share: str | None = None, level: StorageLevel = StorageLevel.MEMORY_AND_DISK
) -> Iterator[dict[str, DataFrame]]:
    """Cache the page's shared aggregate while its tables are read.

    Only the aggregate is cached (one row per brand, group or week and
    product), never the item-level rows.  Tables built from it before the
    block reuse the cached data because Spark matches cached plans.
    """
    key = share or next((k for k in page if k in _SHARED), None)
    cached = page[key].persist(level) if key else None
    try:
        yield page
    finally:
        for frame in (cached, getattr(page, "kept", None)):
            if frame is not None:
                frame.unpersist()
