"""Cash against credit customers (page 3) and the payment-rows API.

All group-wise results are computed in one pass over both payment groups;
per-group top-k uses a row_number window that Spark plans as a
WindowGroupLimit, so each map task keeps only k rows per group before the
shuffle — a group holding most of the data never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions import filters as flt
from tillscope.functions.expr import distinct_with_null, money, payment_category, payment_group, week_label, wmean, wsum

GROUPS = ["CASH", "CREDIT/DEBIT"]
DAILY_TARGET = 5000.0


def payment_rows(
    enriched: DataFrame, stores: Sequence[str] | None = None, date_range: tuple | None = None
) -> DataFrame:
    """Rows with ``payment_category`` (P9: CHANGE counts as cash), only
    CASH and CREDIT kept (F11), then F3 and F4.  Rows, not groups.

    Takes the weighted frame and returns it weighted; ``plans.enrich.expand_weight``
    gives the row-level form.
    """
    return (
        enriched.withColumn("payment_category", payment_category())
        .transform(flt.keep_values("payment_category", ["CASH", "CREDIT"]))
        .transform(flt.keep_stores(stores))
        .transform(flt.date_between(date_range))
    )


def page_rows(
    enriched: DataFrame,
    date_range: tuple | None = None,
    excluded_store_names: Sequence[str] | None = None,
    cash: bool = True,
    credit: bool = True,
) -> DataFrame:
    """Rows behind page 3: F4, F6 (store names), F12, then P10 ``payment_group``."""
    return (
        enriched.transform(flt.date_between(date_range))
        .transform(flt.exclude_store_names(excluded_store_names))
        .transform(flt.payment_selection(cash, credit))
        .withColumn("payment_group", payment_group())
    )


def _in_groups(rows: DataFrame) -> DataFrame:
    return rows.transform(flt.keep_values("payment_group", GROUPS))


def payment_comparison(rows: DataFrame) -> DataFrame:
    """payment_group → transaction_count (distinct item ids, N16),
    total_sales, avg_transaction (mean per item row), total_items,
    avg_items_per_transaction."""
    return (
        _in_groups(rows)
        .groupBy("payment_group")
        .agg(
            distinct_with_null("TRANSACTION_ITEM_ID").alias("transaction_count"),
            wsum("total_sales").alias("total_sales"),
            wmean("total_sales").alias("avg_transaction"),
            wsum("UNIT_QUANTITY").alias("total_items"),
            wmean("UNIT_QUANTITY").alias("avg_items_per_transaction"),
        )
        .orderBy("payment_group")
    )


def payment_deltas(comparison: DataFrame) -> DataFrame:
    """M7: one row of credit − cash deltas of count, sales and mean.

    An absent group counts as 0; every delta is null when there is no cash row.
    """
    g = F.col("payment_group")

    def pick(group: str, c: str):
        return F.max(F.when(g == group, F.col(c)))

    agg = comparison.agg(
        F.max((g == "CASH").cast("int")).alias("has_cash"),
        pick("CASH", "transaction_count").alias("cash_count"),
        pick("CREDIT/DEBIT", "transaction_count").alias("credit_count"),
        pick("CASH", "total_sales").alias("cash_sales"),
        pick("CREDIT/DEBIT", "total_sales").alias("credit_sales"),
        pick("CASH", "avg_transaction").alias("cash_avg"),
        pick("CREDIT/DEBIT", "avg_transaction").alias("credit_avg"),
    )
    has_cash = F.coalesce(F.col("has_cash"), F.lit(0)) == 1

    def delta(a: str, b: str, zero):
        return F.when(has_cash, F.coalesce(F.col(a), zero) - F.coalesce(F.col(b), zero))

    return agg.select(
        F.coalesce(F.col("cash_count"), F.lit(0)).alias("cash_transactions"),
        F.coalesce(F.col("credit_count"), F.lit(0)).alias("credit_transactions"),
        delta("credit_count", "cash_count", F.lit(0)).alias("delta_transactions"),
        delta("credit_sales", "cash_sales", F.lit(0.0)).alias("delta_sales"),
        delta("credit_avg", "cash_avg", F.lit(0.0)).alias("delta_avg_transaction"),
    )


def payment_share(comparison: DataFrame) -> DataFrame:
    """M6: each group's share of total sales (the pie chart's percent).

    The window spans the comparison table, which has at most two rows.
    """
    return comparison.select(
        "payment_group",
        "total_sales",
        F.try_divide(F.col("total_sales"), F.sum("total_sales").over(Window.partitionBy())).alias("share"),
    )


def _top_per_group(agg: DataFrame, order_cols: list, k: int) -> DataFrame:
    w = Window.partitionBy("payment_group").orderBy(*order_cols)
    return agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_products_by_group(rows: DataFrame, k: int = 10) -> DataFrame:
    """A7 + T3: per group, the k products with most distinct item ids
    (ties by product name), with purchase_count and total_sales."""
    agg = (
        _in_groups(rows)
        .groupBy("payment_group", "POS_DESCRIPTION")
        .agg(
            distinct_with_null("TRANSACTION_ITEM_ID").alias("purchase_count"),
            wsum("total_sales").alias("total_sales"),
        )
    )
    return _top_products(agg, k)


def _top_products(agg: DataFrame, k: int) -> DataFrame:
    return _top_per_group(
        agg, [F.col("purchase_count").desc_nulls_first(), F.col("POS_DESCRIPTION").asc_nulls_first()], k
    )


def product_detail(rows: DataFrame, k: int = 20) -> DataFrame:
    """A10 + A11 + T4: per group, the k products with the highest sales,
    with units_sold and transactions, in one aggregation over both groups."""
    agg = (
        _in_groups(rows)
        .groupBy("payment_group", "POS_DESCRIPTION")
        .agg(
            wsum("total_sales").alias("total_sales"),
            wsum("UNIT_QUANTITY").alias("units_sold"),
            distinct_with_null("TRANSACTION_ITEM_ID").alias("transactions"),
        )
    )
    return _best_selling(agg, k)


def _best_selling(agg: DataFrame, k: int) -> DataFrame:
    return _top_per_group(
        agg, [money("total_sales").desc_nulls_first(), F.col("POS_DESCRIPTION").asc_nulls_first()], k
    )


def weekly_by_group(rows: DataFrame, daily_target: float = DAILY_TARGET) -> DataFrame:
    """A8 + P8 + P18: (year, week, group) → weekly_sales, transaction_count,
    week_label and the weekly target (7 × daily target)."""
    return _weekly(
        _in_groups(rows)
        .groupBy("year", "week", "payment_group")
        .agg(
            wsum("total_sales").alias("weekly_sales"),
            distinct_with_null("TRANSACTION_ITEM_ID").alias("transaction_count"),
        ),
        daily_target,
    )


def _weekly(agg: DataFrame, daily_target: float) -> DataFrame:
    return (
        agg.withColumn("week_label", week_label())
        .withColumn("weekly_target", F.lit(daily_target) * 7)
        .orderBy("year", "week", "payment_group")
    )


def daily_max(rows: DataFrame) -> DataFrame:
    """M3: highest (date, group) sales sum; one row with the input bound
    (the max, or 10000 when there is none or it is zero)."""
    daily = rows.groupBy("date", "payment_group").agg(wsum("total_sales").alias("s"))
    return _daily_max(daily)


def _daily_max(daily: DataFrame) -> DataFrame:
    mx = daily.agg(F.max("s").alias("max_daily_sales"))
    has = F.col("max_daily_sales").isNotNull() & (F.col("max_daily_sales") != 0)
    return mx.select(
        "max_daily_sales", F.when(has, F.col("max_daily_sales")).otherwise(F.lit(10000.0)).alias("target_max")
    )


def category_breakdown(rows: DataFrame) -> DataFrame:
    """A9 + T6: (group, category) → total_sales, transactions; group asc, sales desc."""
    return _by_sales(
        _in_groups(rows)
        .groupBy("payment_group", "CATEGORY")
        .agg(
            wsum("total_sales").alias("total_sales"),
            distinct_with_null("TRANSACTION_ITEM_ID").alias("transactions"),
        )
    )


def _by_sales(agg: DataFrame) -> DataFrame:
    return agg.orderBy(
        F.col("payment_group").asc_nulls_first(),
        money("total_sales").desc_nulls_first(),
        F.col("CATEGORY").asc_nulls_first(),
    )


# Groupings of the page's tables, besides the payment group.
CUBE_SETS = {"group": (), "product": ("POS_DESCRIPTION",), "category": ("CATEGORY",), "week": ("year", "week"), "day": ("date",)}
_CUBE_KEYS = ["payment_group", "POS_DESCRIPTION", "CATEGORY", "year", "week", "date"]


def page_cube(rows: DataFrame) -> DataFrame:
    """All aggregates of page 3 from one pass over its rows, by GROUPING SETS.

    Columns: the keys (null where a set lacks them), ``part`` (a name of
    ``CUBE_SETS``), sums, means and the exact distinct count of item ids.  One
    distinct column keeps Spark on partial aggregation by keys, set and id, so
    a hot group is spread before the final shuffle.
    """
    sets = [["payment_group", *more] for more in CUBE_SETS.values()]
    # grouping_id has a bit for each key that a set lacks, the first key's the highest
    ids = [sum(1 << (len(_CUBE_KEYS) - 1 - i) for i, k in enumerate(_CUBE_KEYS) if k not in keys) for keys in sets]
    cube = rows.groupingSets(sets, *_CUBE_KEYS).agg(
        F.grouping_id(*_CUBE_KEYS).alias("_id"),
        distinct_with_null("TRANSACTION_ITEM_ID").alias("transactions"),
        wsum("total_sales").alias("total_sales"), wmean("total_sales").alias("avg_transaction"),
        wsum("UNIT_QUANTITY").alias("units"), wmean("UNIT_QUANTITY").alias("avg_items"),
    )
    part = F.create_map(*(F.lit(x) for name, i in zip(CUBE_SETS, ids) for x in (i, name)))
    return cube.withColumn("part", part[F.col("_id").cast("int")]).drop("_id")


def cube_tables(cube: DataFrame, top: int = 10, detail: int = 20, daily_target: float = DAILY_TARGET) -> dict[str, DataFrame]:
    """Page 3's tables from its cube; rows and columns are those of the functions above."""
    def part(name: str) -> DataFrame:
        return cube.where(F.col("part") == name)

    group, product = _in_groups(part("group")), _in_groups(part("product"))
    comparison = group.select(
        "payment_group", F.col("transactions").alias("transaction_count"), "total_sales", "avg_transaction",
        F.col("units").alias("total_items"), F.col("avg_items").alias("avg_items_per_transaction")).orderBy("payment_group")
    return {
        "comparison": comparison,
        "deltas": payment_deltas(comparison),
        "share": payment_share(comparison),
        "top_products": _top_products(product.select(
            "payment_group", "POS_DESCRIPTION", F.col("transactions").alias("purchase_count"), "total_sales"), top),
        "weekly": _weekly(_in_groups(part("week")).select(
            "year", "week", "payment_group", F.col("total_sales").alias("weekly_sales"),
            F.col("transactions").alias("transaction_count")), daily_target),
        "daily_max": _daily_max(part("day").select(F.col("total_sales").alias("s"))),
        "category_breakdown": _by_sales(_in_groups(part("category")).select(
            "payment_group", "CATEGORY", "total_sales", "transactions")),
        "product_detail": _best_selling(product.select(
            "payment_group", "POS_DESCRIPTION", "total_sales", F.col("units").alias("units_sold"), "transactions"), detail),
    }


def group_summary(rows: DataFrame, group: str) -> DataFrame:
    """one group's row of the comparison table."""
    return payment_comparison(rows).where(F.col("payment_group") == group)

