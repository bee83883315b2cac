"""Registered queries: one callable per driver key, ``(spark, sf_dir) -> DataFrame``.

Each query reads the whole driver tables of ``sf_dir`` through the role
mapping in ``sources.fixtures`` and runs one analysis with the dashboard's
default settings (full date range, no store filter) unless the key exists to
exercise a filter.  Output columns are rounded as the oracle rounds them:
amounts to cents, means and ratios to 4 (shares to 6) digits, and integer
columns widened to bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.expr import money, settled
from tillscope.operators import brands, demographics, payments, products, stores
from tillscope.plans.enrich import enrich_selected, enrich_weighted_tables, expand_weight, has_heavy_rows
from tillscope.plans.order import numbered
from tillscope.plans.reuse import frames_for, landing_folder
from tillscope.sources import fixtures, readers

# Parameters of the keys that exercise the exclusion filters.
EXCLUDED_STORE_NAMES = ["Supplier#000000001", "Supplier#000000002"]
EXCLUDED_CATEGORIES = ["STANDARD"]
# Column names of the registered pivot: the first two store names.
PIVOT_STORES = ["Supplier#000000001", "Supplier#000000002"]
# Slider positions (within the page's ranges) at which some brands fall
# under the thresholds at sf0.01; the page defaults flag none there.
TIGHT_MIN_SALES = 10000
TIGHT_MIN_TRANSACTIONS = 300


def _finish(df: DataFrame, money: tuple = (), ratio: tuple = (), share: tuple = ()) -> DataFrame:
    """Round named columns and widen integer columns to bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in money:
            c = settled(c, 2)
        elif f.name in ratio:
            c = settled(c, 4)
        elif f.name in share:
            c = settled(c, 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _tables(spark: SparkSession, sf_dir: str) -> fixtures.RetailTables:
    return frames_for(spark, f"tables:{sf_dir}", lambda: fixtures.load(spark, sf_dir))


def _base(spark: SparkSession, sf_dir: str, catalog_first: bool = False):
    """Tables and the weighted enriched frame; ``catalog_first`` for analyses
    that filter on catalog columns (see ``plans.enrich.enrich_weighted``)."""
    t = _tables(spark, sf_dir)
    key = f"enriched:{sf_dir}:{'catalog_first' if catalog_first else 'catalog_last'}"
    return t, frames_for(spark, key, lambda: enrich_weighted_tables(t, catalog_first=catalog_first))


def q_enriched(spark, sf_dir):
    t, e = _base(spark, sf_dir)
    return _finish(expand_weight(e, has_heavy_rows(t)))


def q_weekly_sales(spark, sf_dir):
    _, e = _base(spark, sf_dir, catalog_first=True)
    return _finish(products.weekly_sales(e), money=("weekly_sales", "units_sold"))


def q_weekly_sales_page(spark, sf_dir):
    t, e = _base(spark, sf_dir, catalog_first=True)
    rows = products.page_rows(
        e, t.stores, excluded_store_names=EXCLUDED_STORE_NAMES, excluded_categories=EXCLUDED_CATEGORIES
    )
    return _finish(products.weekly_product_sales(rows), money=("weekly_sales", "units_sold"))


def q_top_products(spark, sf_dir):
    t, e = _base(spark, sf_dir)
    return _finish(products.top_products(products.page_rows(e, t.stores)), money=("total_sales", "total_units"))


def _weekly(spark, sf_dir):
    t, e = _base(spark, sf_dir)
    return products.weekly_product_sales(products.page_rows(e, t.stores))


def q_product_trend(spark, sf_dir):
    return _finish(products.product_trend(_weekly(spark, sf_dir)), money=("weekly_sales", "units_sold"))


def q_product_target(spark, sf_dir):
    return _finish(
        products.product_target(_weekly(spark, sf_dir)), money=("max_weekly_sales", "target_default", "target_max")
    )


def q_date_bounds(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return stores.item_date_bounds(t.items)


def q_store_list(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return _finish(stores.store_list(t.stores))


def q_store_names(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return frames_for(spark, f"store_names:{sf_dir}", lambda: stores.store_names(t.items, t.stores))


def q_category_list(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return products.category_list(t.items, t.catalog)


_BRAND_MONEY = ("total_sales", "units_sold", "total_units", "lost_sales", "total_brand_sales", "weekly_sales")
_BRAND_RATIO = ("avg_price", "sales_per_transaction", "avg_brand_sales", "pct_sales", "pct_brands")


def q_beverage_brands(spark, sf_dir):
    _, e = _base(spark, sf_dir, catalog_first=True)
    return _finish(brands.beverage_brands(e), money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def _brand_perf(spark, sf_dir):
    t, e = _base(spark, sf_dir, catalog_first=True)
    rows = brands.page_rows(e, t.stores)
    return rows, brands.brand_performance(rows)


def q_brand_performance(spark, sf_dir):
    _, perf = _brand_perf(spark, sf_dir)
    return _finish(perf, money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_brand_underperforming(spark, sf_dir):
    _, perf = _brand_perf(spark, sf_dir)
    return _finish(brands.underperforming(perf), money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_brand_underperforming_tight(spark, sf_dir):
    _, perf = _brand_perf(spark, sf_dir)
    weak = brands.underperforming(perf, TIGHT_MIN_SALES, TIGHT_MIN_TRANSACTIONS)
    return _finish(weak, money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_brand_drop_impact_tight(spark, sf_dir):
    _, perf = _brand_perf(spark, sf_dir)
    impact = brands.drop_impact(perf, TIGHT_MIN_SALES, TIGHT_MIN_TRANSACTIONS)
    return _finish(impact, money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_brand_ranking(spark, sf_dir):
    _, perf = _brand_perf(spark, sf_dir)
    return _finish(brands.ranking_view(perf), money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_brand_top15(spark, sf_dir):
    _, perf = _brand_perf(spark, sf_dir)
    return _finish(brands.top_brands(perf, 15), money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_brand_kpis(spark, sf_dir):
    _, perf = _brand_perf(spark, sf_dir)
    return _finish(brands.brand_kpis(perf), money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_brand_drop_impact(spark, sf_dir):
    _, perf = _brand_perf(spark, sf_dir)
    return _finish(brands.drop_impact(perf), money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_brand_trend(spark, sf_dir):
    rows, _ = _brand_perf(spark, sf_dir)
    return _finish(brands.brand_trend(rows), money=_BRAND_MONEY)


_PAY_MONEY = ("total_sales", "total_items", "weekly_sales", "units_sold", "delta_sales", "max_daily_sales",
              "target_max", "weekly_target")
_PAY_RATIO = ("avg_transaction", "avg_items_per_transaction", "delta_avg_transaction")


def _pay_rows(spark, sf_dir, **kw):
    _, e = _base(spark, sf_dir)
    return payments.page_rows(e, **kw)


def q_payment_comparison(spark, sf_dir):
    return _finish(payments.payment_comparison(_pay_rows(spark, sf_dir)), money=_PAY_MONEY, ratio=_PAY_RATIO)


def q_store_exclusion_by_name(spark, sf_dir):
    rows = _pay_rows(spark, sf_dir, excluded_store_names=EXCLUDED_STORE_NAMES, credit=False)
    return _finish(payments.group_summary(rows, "CASH"), money=_PAY_MONEY, ratio=_PAY_RATIO)


def q_payment_rows(spark, sf_dir):
    t, e = _base(spark, sf_dir)
    return _finish(expand_weight(payments.payment_rows(e), has_heavy_rows(t)))


def q_payment_deltas(spark, sf_dir):
    cmp_ = payments.payment_comparison(_pay_rows(spark, sf_dir))
    return _finish(payments.payment_deltas(cmp_), money=_PAY_MONEY, ratio=_PAY_RATIO)


def q_payment_share(spark, sf_dir):
    cmp_ = payments.payment_comparison(_pay_rows(spark, sf_dir))
    return _finish(payments.payment_share(cmp_), money=_PAY_MONEY, share=("share",))


def q_payment_top_products(spark, sf_dir):
    return _finish(payments.top_products_by_group(_pay_rows(spark, sf_dir)), money=_PAY_MONEY)


def q_payment_product_detail(spark, sf_dir):
    return _finish(payments.product_detail(_pay_rows(spark, sf_dir)), money=_PAY_MONEY)


def q_payment_weekly(spark, sf_dir):
    return _finish(payments.weekly_by_group(_pay_rows(spark, sf_dir)), money=_PAY_MONEY)


def q_payment_daily_max(spark, sf_dir):
    return _finish(payments.daily_max(_pay_rows(spark, sf_dir)), money=_PAY_MONEY)


def q_category_breakdown(spark, sf_dir):
    return _finish(payments.category_breakdown(_pay_rows(spark, sf_dir)), money=_PAY_MONEY)


def _locations(spark, sf_dir):
    def build():
        t = _tables(spark, sf_dir)
        return demographics.store_locations(t.items, t.stores)

    return frames_for(spark, f"locations:{sf_dir}", build)


def _profiles(spark, sf_dir):
    return frames_for(spark, f"profiles:{sf_dir}", lambda: demographics.census_profiles(
        _locations(spark, sf_dir), _tables(spark, sf_dir).census))


def _long(spark, sf_dir):
    return frames_for(spark, f"long:{sf_dir}", lambda: demographics.demographics_long(_profiles(spark, sf_dir)))


def q_store_locations(spark, sf_dir):
    return _locations(spark, sf_dir)


def q_store_demographics(spark, sf_dir):
    return _finish(_long(spark, sf_dir), ratio=("Value",))


def q_demographic_pivot(spark, sf_dir):
    loc, long = _locations(spark, sf_dir), _long(spark, sf_dir)
    piv = demographics.demographic_pivot(long, demographics.default_pair(loc), PIVOT_STORES)
    return _finish(piv, ratio=tuple(PIVOT_STORES))


def q_demographic_delta(spark, sf_dir):
    loc, long = _locations(spark, sf_dir), _long(spark, sf_dir)
    return _finish(
        demographics.demographic_delta(long, demographics.default_pair(loc)),
        ratio=("first_value", "second_value", "delta"),
    )


def q_demographic_normalised(spark, sf_dir):
    loc, long = _locations(spark, sf_dir), _long(spark, sf_dir)
    return _finish(
        demographics.demographic_normalised(long, demographics.default_pair(loc)), ratio=("Value", "normalised")
    )


def q_demographic_family_share(spark, sf_dir):
    return _finish(demographics.family_share(_long(spark, sf_dir)), ratio=("Value",), share=("share",))


def q_demographic_single_store(spark, sf_dir):
    loc, long = _locations(spark, sf_dir), _long(spark, sf_dir)
    return _finish(demographics.first_store_rows(long, demographics.default_pair(loc)), ratio=("Value",))


def q_store_compare_options(spark, sf_dir):
    loc = _locations(spark, sf_dir)
    return demographics.compare_options(loc, demographics.default_pair(loc))


def q_store_profile(spark, sf_dir):
    return _finish(
        demographics.store_profile(_profiles(spark, sf_dir)), ratio=("population", "median_age", "median_income")
    )


# Parameters of the keys that pass a store list and a date range.
KEPT_STORES = ["1", "3", "4", "8"]
DATES = ("1996-03-04", "1999-08-29")


def q_weekly_sales_filtered(spark, sf_dir):
    e = enrich_selected(_tables(spark, sf_dir), KEPT_STORES, DATES)
    return _finish(products.weekly_sales(e), money=("weekly_sales", "units_sold"))


def q_beverage_brands_filtered(spark, sf_dir):
    e = enrich_selected(_tables(spark, sf_dir), KEPT_STORES, DATES)
    return _finish(brands.beverage_brands(e), money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_payment_rows_filtered(spark, sf_dir):
    t = _tables(spark, sf_dir)
    e = enrich_selected(t, KEPT_STORES, DATES, catalog_first=False)
    return _finish(expand_weight(payments.payment_rows(e), has_heavy_rows(t)))


def q_payment_comparison_neither(spark, sf_dir):
    rows = _pay_rows(spark, sf_dir, cash=False, credit=False)
    return _finish(payments.payment_comparison(rows), money=_PAY_MONEY, ratio=_PAY_RATIO)


def q_brand_top30(spark, sf_dir):
    _, perf = _brand_perf(spark, sf_dir)
    return _finish(brands.top_brands(perf, 30), money=_BRAND_MONEY, ratio=_BRAND_RATIO)


def q_date_bounds_beverages(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return stores.beverage_date_bounds(t.items, t.catalog)


def q_date_bounds_all(spark, sf_dir):
    return stores.item_date_bounds(_tables(spark, sf_dir).items, fuel_code_filter=False)


def q_time_bounds(spark, sf_dir):
    return stores.time_bounds(_tables(spark, sf_dir).items)


def q_store_locations_shared_names(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return demographics.store_locations(t.items, fixtures.shared_names(t.stores))


def q_store_demographics_default(spark, sf_dir):
    profiles = demographics.census_profiles(_locations(spark, sf_dir), fixtures.census(spark, sf_dir, bad_county="019"))
    return _finish(demographics.demographics_long(profiles), ratio=("Value",))


def q_category_breakdown_ordered(spark, sf_dir):
    rows = payments.category_breakdown(_pay_rows(spark, sf_dir))
    return numbered(rows, [F.col("payment_group"), -money("total_sales"), F.col("CATEGORY")]).select(
        "place", "payment_group", "CATEGORY")


def q_payment_weekly_ordered(spark, sf_dir):
    rows = payments.weekly_by_group(_pay_rows(spark, sf_dir))
    return numbered(rows, [F.col("year"), F.col("week"), F.col("payment_group")]).select(
        "place", "week_label", "payment_group")


def q_store_names_ordered(spark, sf_dir):
    return numbered(q_store_names(spark, sf_dir), [F.col("STORE_NAME")])


def q_store_compare_options_ordered(spark, sf_dir):
    return numbered(q_store_compare_options(spark, sf_dir), [F.col("Store")])


def q_landed_weekly_sales(spark, sf_dir):
    """Weekly sales from landed files: the role tables are written as the data
    folder's files in the session's checkpoint folder and read by the readers (S1-S5)."""
    folder = landing_folder(spark)
    t = _tables(spark, sf_dir)
    t.items.write.parquet(f"{folder}/{readers.ITEMS_DIR}")
    t.catalog.write.parquet(f"{folder}/{readers.CATALOG_FILE}")
    t.payments.write.parquet(f"{folder}/{readers.PAYMENTS_FILE}")
    t.stores.write.parquet(f"{folder}/{readers.STORES_FILE}")
    e = enrich_weighted_tables(readers.load_retail(spark, folder))
    return _finish(products.weekly_sales(e), money=("weekly_sales", "units_sold"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "enriched": q_enriched,
    "weekly_sales": q_weekly_sales,
    "weekly_sales_page": q_weekly_sales_page,
    "top_products": q_top_products,
    "product_trend": q_product_trend,
    "product_target": q_product_target,
    "date_bounds": q_date_bounds,
    "store_list": q_store_list,
    "store_names": q_store_names,
    "category_list": q_category_list,
    "beverage_brands": q_beverage_brands,
    "brand_performance": q_brand_performance,
    "brand_underperforming": q_brand_underperforming,
    "brand_underperforming_tight": q_brand_underperforming_tight,
    "brand_ranking": q_brand_ranking,
    "brand_top15": q_brand_top15,
    "brand_kpis": q_brand_kpis,
    "brand_drop_impact": q_brand_drop_impact,
    "brand_drop_impact_tight": q_brand_drop_impact_tight,
    "brand_trend": q_brand_trend,
    "store_exclusion_by_name": q_store_exclusion_by_name,
    "payment_comparison": q_payment_comparison,
    "payment_rows": q_payment_rows,
    "payment_deltas": q_payment_deltas,
    "payment_share": q_payment_share,
    "payment_top_products": q_payment_top_products,
    "payment_product_detail": q_payment_product_detail,
    "payment_weekly": q_payment_weekly,
    "payment_daily_max": q_payment_daily_max,
    "category_breakdown": q_category_breakdown,
    "store_locations": q_store_locations,
    "store_demographics": q_store_demographics,
    "demographic_pivot": q_demographic_pivot,
    "demographic_delta": q_demographic_delta,
    "demographic_normalised": q_demographic_normalised,
    "demographic_family_share": q_demographic_family_share,
    "demographic_single_store": q_demographic_single_store,
    "store_compare_options": q_store_compare_options,
    "store_profile": q_store_profile,
    "weekly_sales_filtered": q_weekly_sales_filtered,
    "beverage_brands_filtered": q_beverage_brands_filtered,
    "payment_rows_filtered": q_payment_rows_filtered,
    "payment_comparison_neither": q_payment_comparison_neither,
    "brand_top30": q_brand_top30,
    "date_bounds_beverages": q_date_bounds_beverages,
    "date_bounds_all": q_date_bounds_all,
    "time_bounds": q_time_bounds,
    "store_locations_shared_names": q_store_locations_shared_names,
    "store_demographics_default": q_store_demographics_default,
    "category_breakdown_ordered": q_category_breakdown_ordered,
    "payment_weekly_ordered": q_payment_weekly_ordered,
    "store_names_ordered": q_store_names_ordered,
    "store_compare_options_ordered": q_store_compare_options_ordered,
    "landed_weekly_sales": q_landed_weekly_sales,
}
