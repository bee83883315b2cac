"""Row filters of the dashboard, each a ``DataFrame -> DataFrame`` for ``df.transform``.

Filters on item columns sit below the joins in the optimized plan, so
equality, null and date-bound predicates reach the Parquet scan as pushed
filters.  Regex predicates are evaluated right after the scan.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.expr import money
from tillscope.plans.joins import fits

Transform = Callable[[DataFrame], DataFrame]

# Patterns, category and code must equal the dashboard's.
FUEL_PATTERN = "FUEL|GAS"
BEVERAGE_PATTERN = "BEVERAGE|DRINK|SODA|WATER"
PACKAGED_BEVERAGES = "Packaged Beverages"
FUEL_CODE = "FUEL"


def _identity(df: DataFrame) -> DataFrame:
    return df


def drop_fuel_code() -> Transform:
    """``NONSCAN_CATEGORY != 'FUEL'``; a null category is dropped too."""
    return lambda df: df.where(F.col("NONSCAN_CATEGORY") != FUEL_CODE)


def drop_fuel_pattern() -> Transform:
    """drop categories matching FUEL|GAS (case-sensitive), keep null."""
    return lambda df: df.where(~F.col("CATEGORY").rlike(FUEL_PATTERN) | F.col("CATEGORY").isNull())


def keep_stores(store_ids: Sequence[str] | None) -> Transform:
    """keep listed store ids; ``None`` or empty keeps every store."""
    if not store_ids:
        return _identity
    ids = [str(s) for s in store_ids]
    return lambda df: df.where(F.col("STORE_ID").isin(ids))


def _as_date(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.date.fromisoformat(str(d))


def date_between(date_range: tuple | None, column: str = "date") -> Transform:
    """inclusive date range on ``date`` (N17); ``None`` keeps all.

    A single date (or a one-element tuple) means that one day, as the
    date picker normalises it.  A bound that is ``None`` is open.
    """
    if date_range is None:
        return _identity
    if not isinstance(date_range, (tuple, list)):
        date_range = (date_range, date_range)
    elif len(date_range) == 1:
        date_range = (date_range[0], date_range[0])
    lo, hi = (None if d is None else _as_date(d) for d in date_range)

    def apply(df: DataFrame) -> DataFrame:
        if lo is not None:
            df = df.where(F.col(column) >= F.lit(lo))
        return df if hi is None else df.where(F.col(column) <= F.lit(hi))

    return apply


def exclude_stores_by_name(stores: DataFrame, names: Sequence[str] | None) -> Transform:
    """Resolve store names to ids on the store table, anti-join them.

    If no id was found, nothing is excluded, null ids included (an empty
    ``~is_in``, N6); otherwise a null ``STORE_ID`` is dropped as ``~is_in`` drops
    it (N7): every id found brings a null along, and nulls match nulls.  The
    ids are part of the store table, so they are broadcast when that is under
    the limit (its measured size, whatever the names); beyond it, Spark
    chooses the join.
    """
    if not names:
        return _identity
    ids = stores.select(F.col("STORE_ID").cast("string").alias("_excluded"), "STORE_NAME")
    excluded = ids.where(F.col("STORE_NAME").isin(list(names)) & F.col("_excluded").isNotNull()).select(
        F.explode(F.array("_excluded", F.lit(None).cast("string"))).alias("_excluded"))
    excluded = F.broadcast(excluded) if fits(ids) else excluded.distinct()

    def apply(df: DataFrame) -> DataFrame:
        return df.join(excluded, df["STORE_ID"].eqNullSafe(excluded["_excluded"]), "left_anti")

    return apply


def exclude_store_names(names: Sequence[str] | None) -> Transform:
    """drop rows whose STORE_NAME is listed; non-empty list drops null names."""
    if not names:
        return _identity
    return lambda df: df.where(~F.col("STORE_NAME").isin(list(names)))


def exclude_categories(categories: Sequence[str] | None) -> Transform:
    """drop listed categories, always keep a null category."""
    if not categories:
        return _identity
    return lambda df: df.where(~F.col("CATEGORY").isin(list(categories)) | F.col("CATEGORY").isNull())


def beverages_by_pattern() -> Transform:
    """F8: category matches BEVERAGE|DRINK|SODA|WATER (case-sensitive, N10)."""
    return lambda df: df.where(F.col("CATEGORY").rlike(BEVERAGE_PATTERN))


def packaged_beverages() -> Transform:
    """category is exactly 'Packaged Beverages' and a brand is present."""
    return lambda df: df.where((F.col("CATEGORY") == PACKAGED_BEVERAGES) & F.col("BRAND").isNotNull())


def brand_present() -> Transform:
    """F10."""
    return lambda df: df.where(F.col("BRAND").isNotNull())


def category_present() -> Transform:
    """F16."""
    return lambda df: df.where(F.col("CATEGORY").isNotNull())


def keep_values(column: str, values: Sequence[str]) -> Transform:
    """Keep rows whose ``column`` is in a fixed list."""
    return lambda df: df.where(F.col(column).isin(list(values)))


def payment_selection(cash: bool = True, credit: bool = True) -> Transform:
    """CASH rows and/or CREDIT+DEBIT rows; neither side → no rows."""
    cond = F.lit(False)
    if cash:
        cond = cond | F.col("PAYMENT_TYPE").isin("CASH")
    if credit:
        cond = cond | F.col("PAYMENT_TYPE").isin("CREDIT", "DEBIT")
    return lambda df: df.where(cond)


def keep_largest(key: str, amount: str, k: int) -> Transform:
    """Rows of the k keys with the largest total of ``amount``.

    Totals are ranked at cents, nulls first (N8), ties by key (N12).  The rows
    are an aggregate (one per key and period): a window totals each key's own
    rows, and the rank filter is planned as a WindowGroupLimit, so each task
    passes on the rows of k keys at most.
    """
    def apply(df: DataFrame) -> DataFrame:
        order = Window.orderBy(money("_total").desc_nulls_first(), F.col(key).asc_nulls_first())
        total = df.withColumn("_total", F.sum(amount).over(Window.partitionBy(key)))
        return total.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= k).drop("_total", "_rank")

    return apply
