"""Area demographics around stores (page 4).

The dashboard asks a web service for one county at a time; here the census
table (one row per state and county, cells as response text — see
``sources.readers.read_census_responses``) is joined to every store, so the
work is a small join over all stores instead of a request loop.  The long
(Store, Variable, Value) table covers all stores; a store pair (the
dashboard's two select boxes) drives the comparison views.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.expr import cell_ok, census_cell, county_from_city
from tillscope.operators.stores import stores_seen
from tillscope.sources import schemas as S


def store_locations(items: DataFrame, stores: DataFrame) -> DataFrame:
    """D1 + D4 + P12 + P13: one row per store name seen in transactions.

    Columns: Store (name), STORE_ID, CITY, state ('16'), county (019 when the
    city names FALLS or IDAHO, else 065; a null city gives 065).  When two
    ids share a name the greatest id wins (the dashboard keeps the later
    row of an unordered list).  Rows without a name are dropped.
    """
    seen = stores_seen(items, stores).where(F.col("STORE_NAME").isNotNull())
    w = Window.partitionBy("STORE_NAME").orderBy(F.col("STORE_ID").desc_nulls_last())
    return (
        seen.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") == 1)
        .select(
            F.col("STORE_NAME").alias("Store"),
            "STORE_ID",
            "CITY",
            F.lit(S.STORE_STATE_FIPS).alias("state"),
            county_from_city("CITY").alias("county"),
        )
    )


def census_profiles(locations: DataFrame, census: DataFrame) -> DataFrame:
    """J4 + J5 + P14 + P15: every store with its county's 14 measures (wide, by code).

    A county whose row is missing, incomplete, or has any cell that is not
    a number takes the whole default profile (N18); null and no-value texts
    read as 0.0.  ``census_ok`` says which applied.
    """
    cen = census.select(
        "state",
        "county",
        *S.CENSUS_CODES,
        F.col("complete").alias("_complete"),
        F.lit(True).alias("_found"),
    )
    joined = locations.join(cen, ["state", "county"], "left")
    ok = F.expr("coalesce(_found, false) AND coalesce(_complete, false)")
    for code in S.CENSUS_CODES:
        ok = ok & cell_ok(code)
    store = ["Store", "STORE_ID", "CITY", "state", "county"]
    return joined.select(*store, *S.CENSUS_CODES, ok.alias("census_ok")).select(
        *store,
        *[
            F.when(F.col("census_ok"), census_cell(code))
            .otherwise(F.lit(S.CENSUS_DEFAULTS[S.CENSUS_LABELS[code]])).alias(code)
            for code in S.CENSUS_CODES
        ],
        "census_ok",
    )


def demographics_long(profiles: DataFrame) -> DataFrame:
    """(Store, Variable, Value) — one row per store and measure label."""
    long = profiles.unpivot(["Store"], S.CENSUS_CODES, "code", "Value")
    labels = F.create_map(*[F.lit(x) for code in S.CENSUS_CODES for x in (code, S.CENSUS_LABELS[code])])
    return long.select("Store", labels[F.col("code")].alias("Variable"), F.col("Value").cast("double").alias("Value"))


def default_pair(locations: DataFrame, stores: int = 2) -> DataFrame:
    """The select boxes' defaults: the first (two) store names in sorted order.

    Returns (Store, position) with positions from 1; the limit bounds it to
    ``stores`` rows, so it is broadcast wherever it is joined.
    """
    first = locations.select("Store").orderBy("Store").limit(stores)
    return first.withColumn("position", F.row_number().over(Window.orderBy("Store")))


def chosen(spark, names: Sequence[str], at: int = 1) -> DataFrame:
    """Chosen stores as (Store, position), positions from ``at``."""
    return spark.createDataFrame([(n, at + i) for i, n in enumerate(names)], "Store string, position int")


def selected_rows(long: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected stores' rows of the long table, in the order of selection."""
    return _with_pair(long, selection).orderBy("position", "Variable").select("Store", "Variable", "Value")


def _with_pair(long: DataFrame, pair: DataFrame) -> DataFrame:
    return long.join(F.broadcast(pair.select("Store", "position")), "Store", "inner")


def family_rows(long: DataFrame, family: str) -> DataFrame:
    """one indicator family's rows."""
    return long.where(F.col("Variable").isin(S.MEASURE_FAMILIES[family]))


def family_share(long: DataFrame) -> DataFrame:
    """F15 + M6: each measure's share of its family total, per store.

    Columns: Store, family, Variable, Value, share (null when the family
    total is 0).  The window is per (store, family): at most four rows.
    """
    fam = F.create_map(*[F.lit(x) for f, vs in S.MEASURE_FAMILIES.items() for v in vs for x in (v, f)])
    df = long.withColumn("family", fam[F.col("Variable")]).where(F.col("family").isNotNull())
    w = Window.partitionBy("Store", "family")
    return df.select(
        "Store", "family", "Variable", "Value", F.try_divide(F.col("Value"), F.sum("Value").over(w)).alias("share")
    )


def demographic_delta(long: DataFrame, pair: DataFrame) -> DataFrame:
    """Second − first store on population, age, income and home value.

    One conditional aggregation per Variable over the pair's rows (no self-join).
    """
    rows = _with_pair(long, pair).where(F.col("Variable").isin(S.DELTA_MEASURES))
    pos = F.col("position")
    agg = rows.groupBy("Variable").agg(
        F.max(F.when(pos == 1, F.col("Store"))).alias("first_store"),
        F.max(F.when(pos == 1, F.col("Value"))).alias("first_value"),
        F.max(F.when(pos == 2, F.col("Store"))).alias("second_store"),
        F.max(F.when(pos == 2, F.col("Value"))).alias("second_value"),
    )
    return agg.withColumn("delta", F.col("second_value") - F.col("first_value"))


def demographic_normalised(long: DataFrame, pair: DataFrame) -> DataFrame:
    """M8: radar values, value / max over the selected stores × 100; 0 when the max is not positive."""
    rows = _with_pair(long, pair).where(F.col("Variable").isin(S.RADAR_MEASURES))
    mx = F.max("Value").over(Window.partitionBy("Variable"))
    return rows.select(
        "Store", "Variable", "Value", F.when(mx > 0, F.col("Value") / mx * 100).otherwise(F.lit(0.0)).alias("normalised")
    )


def demographic_pivot(long: DataFrame, pair: DataFrame, store_names: Sequence[str]) -> DataFrame:
    """R2: Variable plus one column per selected store; the caller names the stores."""
    return _with_pair(long, pair).groupBy("Variable").agg(
        *(F.max(F.when(F.col("Store") == name, F.col("Value"))).alias(name) for name in store_names)
    )


def first_store_rows(long: DataFrame, pair: DataFrame) -> DataFrame:
    """F17 + P16 for the selected (position 1) store of a pair, without naming it."""
    first = pair.where(F.col("position") == 1)
    return _with_pair(long, first).select("Variable", "Value")


def compare_options(locations: DataFrame, pair: DataFrame) -> DataFrame:
    """F18 + T8: the names offered for comparison — all but the selected store, sorted.

    An anti-join with the (broadcast, one-row) selection.
    """
    first = F.broadcast(pair.where(F.col("position") == 1).select("Store"))
    return locations.select("Store").join(first, "Store", "left_anti").orderBy("Store")


def store_profile(profiles: DataFrame) -> DataFrame:
    """Store id, city, state, county and three headline measures, per store."""
    return profiles.select(
        "Store",
        "STORE_ID",
        "CITY",
        F.lit("Idaho").alias("state_name"),
        "county",
        F.col("B01001_001E").alias("population"),
        F.col("B01002_001E").alias("median_age"),
        F.col("B19013_001E").alias("median_income"),
    )
