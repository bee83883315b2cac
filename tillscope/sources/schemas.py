"""Input table contracts and the census measure table.

Every reader validates its input against one of the column contracts below,
so a missing column fails at plan time with a clear message instead of deep
inside an analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column contracts of the four retail inputs.  Types are the ones the
# analyses rely on; readers cast where the file type may legitimately differ.
# ``None`` is a key: it keeps its file type, so a code like "00012" stays as it
# is; a join compares keys of different types as text (``plans.joins``).
ITEM_COLUMNS = {
    "TRANSACTION_SET_ID": None,
    "TRANSACTION_ITEM_ID": None,
    "GTIN": None,
    "STORE_ID": T.StringType(),
    "DATE_TIME": T.TimestampNTZType(),
    "POS_DESCRIPTION": T.StringType(),
    "NONSCAN_CATEGORY": T.StringType(),
    "UNIT_PRICE": T.DoubleType(),
    "UNIT_QUANTITY": T.DoubleType(),
}
CATALOG_COLUMNS = {
    "GTIN": None,
    "CATEGORY": T.StringType(),
    "BRAND": T.StringType(),
}
PAYMENT_COLUMNS = {
    "TRANSACTION_SET_ID": None,
    "PAYMENT_TYPE": T.StringType(),
}
STORE_COLUMNS = {
    "STORE_ID": None,
    "STORE_NAME": T.StringType(),
    "CITY": T.StringType(),
    "STATE": T.StringType(),
}

# Flat layouts documented for CSV inputs.
SALES_CSV_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("store", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("sales_amount", T.DoubleType()),
    T.StructField("payment_type", T.StringType()),
])
PRODUCTS_CSV_SCHEMA = T.StructType([
    T.StructField("product_id", T.IntegerType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("unit_price", T.DoubleType()),
])

# --- Fixed values: census measures (must equal the dashboard's) -----------
# (ACS 5-year code, display label, value used when a county lookup fails),
# in the dashboard's order.
CENSUS_MEASURES = [
    ("B01001_001E", "Total Population", 27000.0),
    ("B01002_001E", "Median Age", 35.5),
    ("B19013_001E", "Median Household Income", 58000.0),
    ("B25077_001E", "Median Home Value", 245000.0),
    ("B23025_005E", "Unemployed", 850.0),
    ("B15003_022E", "Bachelor's Degree", 3500.0),
    ("B15003_023E", "Master's Degree", 1200.0),
    ("B02001_002E", "White Alone", 23500.0),
    ("B02001_003E", "Black or African American", 150.0),
    ("B03003_003E", "Hispanic or Latino", 2800.0),
    ("B11001_002E", "Family Households", 6800.0),
    ("B25003_002E", "Owner Occupied Housing", 5200.0),
    ("B25003_003E", "Renter Occupied Housing", 3100.0),
    ("B08303_001E", "Average Commute Time", 22.5),
]
# Cell texts that mean "no value" and read as 0.0.
CENSUS_EMPTY_CELLS = ["null", "-666666666"]
# State code of every store, and the two county codes.
STORE_STATE_FIPS = "16"
COUNTY_FALLS = "019"
COUNTY_OTHER = "065"
# Indicator families shown together on the demographics page.
MEASURE_FAMILIES = {
    "economic": ["Total Population", "Median Household Income", "Median Home Value", "Unemployed"],
    "education": ["Bachelor's Degree", "Master's Degree"],
    "housing": ["Owner Occupied Housing", "Renter Occupied Housing"],
    "race": ["White Alone", "Black or African American", "Hispanic or Latino"],
}
# Measures compared store against store, and the radar-chart measures.
DELTA_MEASURES = ["Total Population", "Median Age", "Median Household Income", "Median Home Value"]
RADAR_MEASURES = [
    "Total Population", "Median Household Income", "Bachelor's Degree",
    "Owner Occupied Housing", "Family Households",
]
# --- end of fixed values --------------------------------------------------

CENSUS_CODES = [code for code, _, _ in CENSUS_MEASURES]
CENSUS_LABELS = {code: label for code, label, _ in CENSUS_MEASURES}
CENSUS_DEFAULTS = {label: default for _, label, default in CENSUS_MEASURES}


class SchemaError(ValueError):
    """An input lacks a column the analyses need."""


def require_columns(df: DataFrame, contract: dict, table: str) -> DataFrame:
    """Fail fast when ``df`` lacks a contracted column; cast to contract types.

    Extra columns are kept (the enrichment keeps every item column), and so is
    the file type of a column whose contract has none.
    """
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise SchemaError(f"{table}: missing column(s) {missing}; has {df.columns}")
    out = df
    for name, dtype in contract.items():
        if dtype is not None and out.schema[name].dataType != dtype:
            out = out.withColumn(name, out[name].cast(dtype))
    return out
