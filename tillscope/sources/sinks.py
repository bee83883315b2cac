"""Sinks: CSV → Parquet conversion and the dashboard's CSV downloads.

Writers are distributed; nothing passes through the driver.  A download is one
file of the stated name: a task writes it beside its place, and it is renamed
when it is whole, so a failed write leaves the old file.  ``single_file=False``
writes a folder of parts instead, for results that are not small.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_to_parquet(spark: SparkSession, input_path: str, output_path: str, infer_schema: bool = True,
                   schema: T.StructType | str | None = None) -> int:
    """Read a CSV with a header, write Parquet, return the rows written.

    The count is observed while the rows are written, so the output is not read
    again.  With ``schema`` (or ``infer_schema=False``, all columns as text) the
    input is read once; inferring types reads it one more time.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer_schema)
    written = Observation()
    rows = reader.csv(input_path).observe(written, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").parquet(output_path)
    return written.get["rows"]


def _store(address: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", address):
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


def _publish(folder: str, path: str) -> None:
    """Give the one part file of ``folder`` its name; an older file of that name is replaced."""
    store, staged = _store(folder)
    _, target = _store(path)
    parts = [f.path for f in store.get_file_info(fs.FileSelector(staged)) if re.match(r"part-.*\.csv$", f.base_name)]
    if len(parts) != 1:
        raise RuntimeError(f"{folder}: {len(parts)} part files where one was written")
    if store.get_file_info(target).type == fs.FileType.Directory:
        raise IsADirectoryError(f"{path} is a folder")
    try:
        store.move(parts[0], target)
    except FileExistsError:  # stores whose rename does not replace
        store.delete_file(target)
        store.move(parts[0], target)
    store.delete_dir(staged)


def _stamp(d) -> str:
    if isinstance(d, (_dt.date, _dt.datetime)):
        return d.isoformat()[:10]
    return str(d)


def report_name(stem: str, date_range: tuple | None = None) -> str:
    """``stem`` or ``stem_<start>_<end>`` as the download file names it."""
    if not date_range:
        return stem
    if None in date_range:
        raise ValueError("a report's name needs both ends of its date range")
    return f"{stem}_{_stamp(date_range[0])}_{_stamp(date_range[1])}"


def write_report_csv(
    df: DataFrame, out_dir: str, stem: str, date_range: tuple | None = None, single_file: bool = True
) -> str:
    """Write a result table as CSV with a header; return its path.

    ``out_dir/<report name>.csv``, or the folder ``out_dir/<report name>`` with ``single_file=False``.
    """
    base = f"{out_dir.rstrip('/')}/{report_name(stem, date_range)}"
    if not single_file:
        df.write.mode("overwrite").option("header", True).csv(base)
        return base
    staged = f"{out_dir.rstrip('/')}/.{report_name(stem, date_range)}-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(staged)
    _publish(staged, f"{base}.csv")
    return f"{base}.csv"


def write_top_products(df: DataFrame, out_dir: str, date_range: tuple | None = None, **kw) -> str:
    """Product, sales and units of the top products."""
    df = df.select("POS_DESCRIPTION", "total_sales", "total_units")
    return write_report_csv(df, out_dir, "top_products", date_range, **kw)


def write_brand_analysis(df: DataFrame, out_dir: str, date_range: tuple | None = None, **kw) -> str:
    """S10."""
    return write_report_csv(df, out_dir, "beverage_brand_analysis", date_range, **kw)


def write_payment_summary(df: DataFrame, out_dir: str, **kw) -> str:
    """S11."""
    return write_report_csv(df, out_dir, "payment_comparison_summary", **kw)


def write_category_breakdown(df: DataFrame, out_dir: str, **kw) -> str:
    """S12."""
    return write_report_csv(df, out_dir, "category_breakdown", **kw)


def write_demographics(df: DataFrame, out_dir: str, **kw) -> str:
    """The selected stores' rows."""
    return write_report_csv(df, out_dir, "demographic_analysis", **kw)
