"""Readers for the retail inputs, the flat CSV layout and landed census files.

All readers are lazy: they return a DataFrame whose scan Catalyst prunes to
the columns and filters a later analysis needs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.sources import schemas as S


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    """Store table (id, name, city, state)."""
    return S.require_columns(spark.read.parquet(path), S.STORE_COLUMNS, "stores")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Product master catalog (GTIN, category, brand)."""
    return S.require_columns(spark.read.parquet(path), S.CATALOG_COLUMNS, "catalog")


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    """S3: payment rows; a transaction may have several."""
    return S.require_columns(spark.read.parquet(path), S.PAYMENT_COLUMNS, "payments")


def read_transaction_items(spark: SparkSession, directory: str, one_schema: bool = False) -> DataFrame:
    """Scan every Parquet file under ``directory`` (one logical table).

    Files may differ: the table has the columns of all of them, null where a file
    lacks one.  A column that has several types takes its contract's type; a key,
    or one that some file has as text, becomes text; numbers become doubles; any
    other mixture is an error that names the column and its types.  With
    ``one_schema`` the caller vouches that all files are alike, and only one
    file's schema is read.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    try:
        df = reader.option("mergeSchema", not one_schema).parquet(directory)
    except (PySparkException, Py4JJavaError) as e:  # Spark passes this one on as the JVM raised it
        if one_schema or "CANNOT_MERGE_SCHEMAS" not in str(e):
            raise
        df = _reconciled(spark, directory)
    return S.require_columns(df, S.ITEM_COLUMNS, "transaction_items")


def _reconciled(spark: SparkSession, directory: str) -> DataFrame:
    """The files of ``directory`` as one table, those of each schema read together."""
    listed = spark.read.option("pathGlobFilter", "*.parquet").schema("GTIN string").parquet(directory).inputFiles()

    def layout(batches):
        for paths in batches:
            own = []
            for path in paths["path"]:
                store, plain = fs.FileSystem.from_uri(path)
                own.append(str([(f.name, str(f.type)) for f in pq.read_schema(plain, filesystem=store)]))
            yield paths.assign(layout=own)

    # the footers are read by tasks; a schema and its files come back
    tasks = max(1, min(len(listed), 4 * spark.sparkContext.defaultParallelism))
    files = spark.createDataFrame([(p,) for p in listed], "path string").repartition(tasks)
    groups = files.mapInPandas(layout, "path string, layout string").groupBy("layout").agg(
        F.sort_array(F.collect_list("path")).alias("paths")).orderBy("layout").collect()
    frames = [spark.read.parquet(g["paths"][0]).schema for g in groups]
    types: dict[str, set[str]] = {}
    for schema in frames:
        for f in schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    target = {name: _common_type(name, found) for name, found in types.items()}
    out = None
    for g, schema in zip(groups, frames):
        own = spark.read.schema(schema).parquet(*g["paths"])
        own = own.select(*(F.col(f"`{c}`").cast(target[c]).alias(c) for c in own.columns))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def _common_type(name: str, types: set[str]) -> str:
    if len(types) == 1:
        return next(iter(types))
    contract = S.ITEM_COLUMNS.get(name)
    if contract is not None:
        return contract.simpleString()
    if name in S.ITEM_COLUMNS or "string" in types:
        return "string"
    if all(re.match(r"(tinyint|smallint|int|bigint|float|double|decimal)", t) for t in types):
        return "double"
    raise S.SchemaError(f"transaction_items: column {name} has types {sorted(types)} in different files")


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat sales CSV with a header, read against a declared schema."""
    return spark.read.schema(S.SALES_CSV_SCHEMA).option("header", True).csv(path)


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat products CSV with a header, read against a declared schema."""
    return spark.read.schema(S.PRODUCTS_CSV_SCHEMA).option("header", True).csv(path)


def read_census_responses(spark: SparkSession, path: str) -> DataFrame:
    """Parse landed census responses, one JSON document per file.

    See ``parse_census_documents`` for the result.
    """
    return parse_census_documents(spark.read.text(path, wholetext=True))


def parse_census_documents(docs: DataFrame, column: str = "value") -> DataFrame:
    """Census response texts → one row per document.

    A response is an array of arrays of strings: a header row (NAME, the
    measure codes, ``state``, ``county``) then one data row.  The result has
    ``state``, ``county``, one string column per measure code, and
    ``complete`` — false when the text is not such a document, a code is
    missing from the header, or the data row is too short.  The whole county
    then takes the default profile (see ``operators.demographics.census_profiles``).
    """
    doc = F.from_json(F.col(column), "array<array<string>>")
    parsed = docs.select(
        F.try_element_at(doc, F.lit(1)).alias("header"),
        F.try_element_at(doc, F.lit(2)).alias("row"),
    )

    def cell(name: str) -> str:  # array_position is 0 when absent
        return f"CASE WHEN array_position(header, '{name}') > 0 THEN " \
               f"try_element_at(row, CAST(array_position(header, '{name}') AS INT)) END AS `{name}`"

    codes = ", ".join(f"'{code}'" for code in S.CENSUS_CODES)
    complete = f"""forall(array({codes}), code -> coalesce(array_position(header, code), 0)
                   BETWEEN 1 AND coalesce(size(row), 0)) AS complete"""
    return parsed.selectExpr(*(cell(c) for c in ("state", "county", *S.CENSUS_CODES)), complete)


# --- Fixed values: file layout of the dashboard's data folder -------------
ITEMS_DIR = "transaction_items"
CATALOG_FILE = "cstore_master_ctin.parquet"
PAYMENTS_FILE = "cstore_payments.parquet"
STORES_FILE = "cstore_stores.parquet"
# --- end of fixed values --------------------------------------------------


@dataclass(frozen=True)
class RetailInputs:
    """The retail inputs as lazy DataFrames (same attributes as the driver fixtures)."""

    items: DataFrame
    catalog: DataFrame
    payments: DataFrame
    stores: DataFrame
    census: DataFrame | None = None


def load_retail(spark: SparkSession, data_dir: str, census_dir: str | None = None) -> RetailInputs:
    """All inputs of a data folder laid out as the dashboard expects.

    ``census_dir`` holds landed census responses (one JSON text per file);
    the demographics analyses need it.
    """
    base = data_dir.rstrip("/")
    return RetailInputs(
        items=read_transaction_items(spark, f"{base}/{ITEMS_DIR}"),
        catalog=read_catalog(spark, f"{base}/{CATALOG_FILE}"),
        payments=read_payments(spark, f"{base}/{PAYMENTS_FILE}"),
        stores=read_stores(spark, f"{base}/{STORES_FILE}"),
        census=read_census_responses(spark, census_dir) if census_dir else None,
    )
