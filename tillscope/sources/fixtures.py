"""Role tables derived from the driver's TPC-H-style Parquet files.

The driver data has no retail schema, so each retail input is derived from a
driver table by plain column expressions (mapping documented in
``FIXTURES.md``).  The mapping deliberately adds what the driver data lacks:
catalog orphans, null categories and prices, transactions without payment,
split-tender payments (multiplicity) and stores missing from the store table.
Every derivation reads the whole driver table, so work grows with the scale
factor.  The DuckDB oracle in ``tillscope.plans.oracle`` states the same
mapping as SQL text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.sources import readers
from tillscope.sources import schemas as S


# Schemas of the driver tables in use (declared, so no inference job runs).
DRIVER_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transaction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem → transaction items (one row per sold item)."""
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("TRANSACTION_SET_ID"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("TRANSACTION_ITEM_ID"),
        # every 40th part is missing from the catalog (left-join orphans)
        F.when(F.col("l_partkey") % 40 == 7, F.col("l_partkey") + 1000000)
        .otherwise(F.col("l_partkey")).alias("GTIN"),
        F.col("l_suppkey").cast("string").alias("STORE_ID"),
        F.col("l_shipdate").alias("DATE_TIME"),
        F.concat(F.lit("PRODUCT_"), (F.col("l_partkey") % 500).cast("string")).alias("POS_DESCRIPTION"),
        F.when(F.col("l_linenumber") == 1, F.lit("FUEL"))
        .when(F.col("l_linenumber") == 2, F.lit(None).cast("string"))
        .otherwise(F.lit("NONE")).alias("NONSCAN_CATEGORY"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), F.lit(None).cast("double"))
        .otherwise(F.col("l_extendedprice")).alias("UNIT_PRICE"),
        F.col("l_quantity").alias("UNIT_QUANTITY"),
    )


def master_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part → product master catalog (GTIN, CATEGORY, BRAND)."""
    part = _read(spark, sf_dir, "part")
    category = (
        F.when(F.col("p_type") == "PROMO", F.lit("Packaged Beverages"))
        .when(F.col("p_type") == "SMALL", F.lit(None).cast("string"))
        .when(F.col("p_type") == "LARGE", F.lit("GAS SUPPLIES"))
        .when(F.col("p_type") == "ECONOMY", F.lit("SODA"))
        .when(F.col("p_type") == "MEDIUM", F.lit("BOTTLED WATER"))
        .otherwise(F.col("p_type"))
    )
    return part.select(
        F.col("p_partkey").alias("GTIN"),
        category.alias("CATEGORY"),
        F.when(F.col("p_brand") == "Brand#6", F.lit(None).cast("string"))
        .otherwise(F.col("p_brand")).alias("BRAND"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → payment rows.

    Priority picks the tender; the rows of 5-LOW orders carry a transaction
    id that no item has, so those transactions have no payment.  Urgent
    orders also get a second row: CHANGE when finished (status F), CREDIT
    when pending (status P) — the split tenders that multiply items.
    """
    orders = _read(spark, sf_dir, "orders")
    tender = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("CASH"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("CREDIT"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("DEBIT"))
        .otherwise(F.lit("EBT"))
    )
    urgent = F.col("o_orderpriority") == "1-URGENT"
    tenders = (
        F.when(urgent & (F.col("o_orderstatus") == "F"), F.array(tender, F.lit("CHANGE")))
        .when(urgent & (F.col("o_orderstatus") == "P"), F.array(tender, F.lit("CREDIT")))
        .otherwise(F.array(tender))
    )
    # one scan of orders; the split tender is a second array element
    return orders.select(
        F.concat(
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit("UNMATCHED-")).otherwise(F.lit("")),
            F.col("o_orderkey").cast("string"),
        ).alias("TRANSACTION_SET_ID"),
        F.explode(tenders).alias("PAYMENT_TYPE"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier ⋈ nation → store table.

    STORE_ID stays numeric (the enrichment casts it).  Suppliers whose key
    ends in 9 carry its negative, so some items reference an unknown store.
    """
    sup = _read(spark, sf_dir, "supplier")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    bucket = F.col("n_nationkey") % 5
    city = (
        F.when(bucket == 0, F.lit("Idaho Falls"))
        .when(bucket == 1, F.lit("American Falls"))
        .when(bucket == 2, F.lit("Rigby"))
        .when(bucket == 3, F.lit(None).cast("string"))
        .otherwise(F.col("n_name"))
    )
    return sup.join(nation, sup["s_nationkey"] == nation["n_nationkey"], "inner").select(
        F.when(F.col("s_suppkey") % 10 == 9, -F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("STORE_ID"),
        F.col("s_name").alias("STORE_NAME"),
        city.alias("CITY"),
        F.lit("ID").alias("STATE"),
    )


def shared_names(stores: DataFrame) -> DataFrame:
    """The store table with every five ids in a row under one name."""
    group = F.expr("abs(STORE_ID) div 5").cast("string")
    return stores.withColumn("STORE_NAME", F.concat(F.lit("Group#"), group))


def census_documents(spark: SparkSession, sf_dir: str, bad_county: str | None = None) -> DataFrame:
    """customer → one census response text per county (the service's JSON layout).

    ``bad_county`` names a county whose population cell is not a number.

    Measure number i (from 1) counts customers whose key is a multiple of i.
    Two cells carry the texts the census service uses for "no value": a
    '-666666666' home value for county 065 and a null commute time for 019.
    """
    cust = _read(spark, sf_dir, "customer")
    county = F.when(F.col("c_nationkey") % 2 == 0, F.lit(S.COUNTY_FALLS)).otherwise(F.lit(S.COUNTY_OTHER))
    counts = [
        F.count(F.when(F.col("c_custkey") % i == 0, F.lit(1))).cast("string").alias(code)
        for i, code in enumerate(S.CENSUS_CODES, start=1)
    ]
    agg = cust.groupBy(county.alias("county")).agg(*counts)

    def cell(code: str):
        if code == "B01001_001E" and bad_county:
            return F.when(F.col("county") == bad_county, F.lit("n/a")).otherwise(F.col(code))
        if code == "B25077_001E":
            return F.when(F.col("county") == S.COUNTY_OTHER, F.lit("-666666666")).otherwise(F.col(code))
        if code == "B08303_001E":
            return F.when(F.col("county") == S.COUNTY_FALLS, F.lit(None).cast("string")).otherwise(F.col(code))
        return F.col(code)

    header = F.array(*[F.lit(h) for h in ["NAME", *S.CENSUS_CODES, "state", "county"]])
    row = F.array(
        F.concat(F.lit("County "), F.col("county")),
        *[cell(code) for code in S.CENSUS_CODES],
        F.lit(S.STORE_STATE_FIPS),
        F.col("county"),
    )
    return agg.select(F.to_json(F.array(header, row)).alias("value"))


def census(spark: SparkSession, sf_dir: str, bad_county: str | None = None) -> DataFrame:
    """Census table parsed from the derived response texts, as landed files would be."""
    return readers.parse_census_documents(census_documents(spark, sf_dir, bad_county))


class RetailTables:
    """The four retail inputs plus census, as lazy DataFrames built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    @cached_property
    def items(self) -> DataFrame:
        return transaction_items(self._spark, self._dir)

    @cached_property
    def catalog(self) -> DataFrame:
        return master_catalog(self._spark, self._dir)

    @cached_property
    def payments(self) -> DataFrame:
        return payments(self._spark, self._dir)

    @cached_property
    def stores(self) -> DataFrame:
        return stores(self._spark, self._dir)

    @cached_property
    def census(self) -> DataFrame:
        return census(self._spark, self._dir)


def load(spark: SparkSession, sf_dir: str) -> RetailTables:
    """All role tables for one scale-factor directory."""
    return RetailTables(spark, sf_dir)
