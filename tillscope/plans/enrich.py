"""The enriched transaction frame: items joined to catalog, payments and stores.

Two forms are offered:

* ``enrich_weighted`` — the form every analysis uses.  Payments are first
  reduced to one row per (transaction, payment type) carrying the number of
  payment rows, ``payment_weight``.  Joining that instead of the raw payment
  rows gives every item exactly the payment types it would get with the raw
  join, and sums/means weighted by ``payment_weight`` equal the sums/means
  over the raw fan-out (N11).  The raw fan-out is never materialised, so one
  transaction with very many payment rows cannot blow up a single join task;
  only the (item-side) skew remains, which AQE splits.  Identical copies in
  the catalog or store table are folded into the same weight.
* ``enrich`` — the row-level frame the dashboard builds (one row per item and
  payment row), produced by exploding the weight after the join.

Join strategy: catalog and stores are broadcast only after their size is
measured to be under a limit (``plans.joins.prepare_dimension``) and are
sort-merge joined otherwise; items ⟕ payments at scale is a shuffle join on
TRANSACTION_SET_ID: sort-merge, which spills, or shuffle-hash where AQE finds
the partitions small enough (it splits skewed item-side partitions too).
Catalyst prunes every input to the columns a query uses and pushes item
filters into the item scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions import filters as flt
from tillscope.functions.expr import WEIGHT
from tillscope.plans.joins import left_join, prepare_dimension
from tillscope.plans.measure import largest, measure
from tillscope.plans.reduce import reduced
from tillscope.sources.fixtures import RetailTables
from tillscope.sources.readers import RetailInputs


def _suffix_clashes(left_columns: list[str], right: DataFrame, keys: list[str]) -> DataFrame:
    """Rename right-side columns that clash with left ones to ``<name>_right``."""
    out = right
    for name in right.columns:
        if name not in keys and name in left_columns:
            out = out.withColumnRenamed(name, f"{name}_right")
    return out


def payment_weights(payments: DataFrame) -> DataFrame:
    """One row per (TRANSACTION_SET_ID, PAYMENT_TYPE) with its row count.

    Partial aggregation runs map-side, so a hot transaction shrinks to one
    row per input partition before the shuffle.  Payments that come as weights
    (``sources.layout``) stay as they are.
    """
    if WEIGHT in payments.columns:
        return payments
    return payments.groupBy("TRANSACTION_SET_ID", "PAYMENT_TYPE").agg(F.count(F.lit(1)).alias(WEIGHT))


def enrich_weighted(
    items: DataFrame,
    catalog: DataFrame,
    payments: DataFrame,
    stores: DataFrame,
    check_sizes: bool = True,
    catalog_first: bool = True,
) -> DataFrame:
    """J1–J3 with P1–P7: items ⟕ catalog ⟕ payment weights ⟕ stores, plus derived columns.

    P1 narrows payments and stores, P2 casts STORE_ID to string, P3–P7 add
    ``datetime``, ``date``, ``total_sales``, ``week`` and ``year``.

    Columns: every item column, catalog columns, PAYMENT_TYPE, STORE_NAME,
    CITY, STATE, ``datetime``, ``date``, ``total_sales``, ``week`` (ISO),
    ``year`` (calendar, N9) and ``payment_weight``: how many rows the
    dashboard's join makes of this one — payment rows of the transaction
    (1 when none) times identical copies of the catalog and store rows.
    ``check_sizes`` takes key uniqueness and size of the dimensions from their
    measurements (see ``plans.joins.prepare_dimension``); with False the dimensions
    are always collapsed and the join strategy is left to Spark.

    ``catalog_first`` picks the join order (left joins on different keys
    commute, so results are the same).  Catalog first suits analyses that
    filter on catalog columns: the filter then shrinks the item shuffle of
    the payment join.  Catalog last suits the others: the shuffle carries
    the 8-byte GTIN instead of category and brand strings, and the catalog
    lookup runs in the parallel post-shuffle tasks.
    """
    weights = []
    cat, copies = prepare_dimension(
        _suffix_clashes(items.columns, catalog, ["GTIN"]), "GTIN", "_catalog_copies", check_sizes
    )
    weights += ["_catalog_copies"] if copies else []
    cat_cols = [c for c in cat.columns if c != "GTIN" and c not in weights]
    # inputs laid out by day are joined within the day
    by_day = [DAY] if DAY in payments.columns and DAY in items.columns else []
    pay = _suffix_clashes(items.columns + cat_cols, payment_weights(payments), ["TRANSACTION_SET_ID", *by_day])
    pay_cols = [c for c in pay.columns if c not in ("TRANSACTION_SET_ID", WEIGHT, *by_day)]
    weights.append(WEIGHT)
    out = left_join(items, cat, "GTIN") if catalog_first else items
    # Payments grow with transactions and are never date-pruned.  The strategy
    # is left to Spark: a sort-merge join, which spills, unless the measured
    # partitions are small enough for a hash table
    # (spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold) or the whole
    # side is under the broadcast threshold.
    out = left_join(out, pay, "TRANSACTION_SET_ID", *by_day)
    if not catalog_first:
        out = left_join(out, cat, "GTIN")
    st = stores.select(F.col("STORE_ID").cast("string").alias("STORE_ID"), "STORE_NAME", "CITY", "STATE")
    st, copies = prepare_dimension(
        _suffix_clashes(items.columns + cat_cols + pay_cols, st, ["STORE_ID"]), "STORE_ID", "_store_copies", check_sizes
    )
    weights += ["_store_copies"] if copies else []
    st_cols = [c for c in st.columns if c != "STORE_ID" and c not in weights]
    out = left_join(out, st, "STORE_ID")
    weight = F.lit(1).cast("long")
    for w in weights:
        weight = weight * F.coalesce(F.col(w), F.lit(1)).cast("long")
    # the stored day prunes partitions where a date is asked for
    day = F.nullif(F.col(DAY), no_day()) if by_day else F.to_date(F.col("DATE_TIME"))
    return out.select(
        *(c for c in items.columns if c not in by_day),
        *cat_cols,
        *pay_cols,
        *st_cols,
        F.col("DATE_TIME").cast("timestamp_ntz").alias("datetime"),
        day.alias("date"),
        (F.col("UNIT_PRICE") * F.col("UNIT_QUANTITY")).alias("total_sales"),
        F.weekofyear(day).alias("week"),
        F.year(day).alias("year"),
        weight.alias(WEIGHT),
    )


def enrich_weighted_tables(t: RetailTables, catalog_first: bool = True) -> DataFrame:
    return enrich_weighted(t.items, t.catalog, t.payments, t.stores, catalog_first=catalog_first)


def enrich_selected(t: RetailTables, stores: Sequence[str] | None = None, date_range: tuple | None = None,
                    catalog_first: bool = True) -> DataFrame:
    """``enrich_weighted_tables`` of the items of some stores and days, with only their payments.

    The filters run on the items, and payments that cannot belong to one of
    them are dropped before their shuffle (``plans.reduce``).  Inputs laid out
    by day need no reduction: the days prune their payments.
    """
    items = t.items.transform(flt.keep_stores(stores))
    if DAY in items.columns:
        items = items.transform(flt.date_between(date_range, DAY))
    else:
        items = items.withColumn(DAY, F.to_date("DATE_TIME")).transform(flt.date_between(date_range, DAY)).drop(DAY)
    payments = t.payments
    if (stores or date_range) and DAY not in payments.columns:
        payments = reduced(payments, "TRANSACTION_SET_ID", items)
    return enrich_weighted(items, t.catalog, payments, t.stores, catalog_first=catalog_first)


# Day of the items where inputs are laid out by day, and the day of those without a time (``sources.layout``).
DAY = "item_date"


def no_day() -> Column:
    return F.expr("DATE'0001-01-01'")


# Copies of a row that one step of ``expand_weight`` makes.
COPIES = 10_000


def has_heavy_rows(t: RetailTables) -> bool:
    """Whether a row may have so large a weight that one task should not write all of its copies.

    The largest number of payment rows of one transaction and type is measured
    once for each version of the payments; copies in the catalog or store table
    multiply it, so a table with repeated keys counts as heavy.
    """
    if largest(payment_weights(t.payments), WEIGHT) > COPIES:
        return True
    stores = t.stores.select("STORE_ID")
    return any(m.keyed != m.keys for m in (measure(t.catalog, "GTIN"), measure(stores, "STORE_ID")))


def expand_weight(weighted: DataFrame, spread: bool = False) -> DataFrame:
    """Repeat each row ``payment_weight`` times and drop the weight column.

    Rows are repeated in blocks of at most ``COPIES``, so no array is as long as
    a weight.  ``spread`` deals the blocks to tasks in between, by row and block;
    it costs a shuffle of the blocks, so callers choose it by the measured
    weights (``has_heavy_rows``).
    """
    cols = [c for c in weighted.columns if c != WEIGHT]
    last = F.expr(f"({WEIGHT} - 1) div {COPIES}")
    blocks = weighted.where(F.col(WEIGHT) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block"))
    if spread:
        blocks = blocks.repartition(F.xxhash64("_block", *[c for c in cols if c in ("TRANSACTION_SET_ID", "TRANSACTION_ITEM_ID")]))
    copies = F.least(F.lit(COPIES).cast("long"), F.col(WEIGHT) - F.col("_block") * COPIES).cast("int")
    return blocks.select(*cols, F.explode(F.array_repeat(F.lit(1), copies)).alias("_rep")).drop("_rep")


def enrich(items: DataFrame, catalog: DataFrame, payments: DataFrame, stores: DataFrame) -> DataFrame:
    """The dashboard's enriched frame, one row per item and payment row."""
    return enrich_tables(RetailInputs(items, catalog, payments, stores))


def enrich_tables(t: RetailTables) -> DataFrame:
    return expand_weight(enrich_weighted_tables(t), spread=has_heavy_rows(t))
