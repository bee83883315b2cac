"""Measurements of inputs, taken once for each version of the data.

A join's strategy depends on a dimension's size and on whether its key is
unique.  Measuring both takes a Spark job; doing that whenever a plan is built
would cost more than many analyses.  A measurement is therefore kept for the
frame's plan and the version of its files (paths, lengths, modification times):
in the process, and as a small JSON file in the folder that
``spark.tillscope.measurements`` names (by default, one in the shared checkpoint
folder, if the session has that).  Later plans, also of other processes, are
built without a job until a file changes.

Frames that read no files, or files whose store does not tell times, are
measured again: at once, or after ``TTL_SECONDS``.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import re
import time
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TTL_SECONDS = 3600.0
FOLDER_KEY = "spark.tillscope.measurements"

_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
    T.DecimalType: 16,
}
# hash-relation and row-header overhead per broadcast row, as a factor
_OVERHEAD = 2


@dataclass(frozen=True)
class Measured:
    """Bytes that a frame takes as a broadcast side; rows with a key, and distinct keys."""

    bytes: int
    keyed: int
    keys: int


_KNOWN: dict[tuple, tuple[float, Measured]] = {}


def measured_bytes(schema: T.StructType) -> Column:
    """Aggregate: bytes of all rows of ``schema``; strings and binaries by their real length."""
    fixed, total = 8, F.lit(0)
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            fixed += 8
            total = total + F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`"))), F.lit(0))
        elif type(f.dataType) in _WIDTH:
            fixed += _WIDTH[type(f.dataType)]
        else:  # arrays, maps, structs: by the length of their JSON text
            total = total + F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))), F.lit(0))
    return (total + F.count(F.lit(1)) * fixed) * _OVERHEAD


def _take(df: DataFrame, key: str | None) -> Measured:
    keyed = F.count(F.col(key)) if key else F.lit(0)
    keys = F.count_distinct(F.col(key)) if key else F.lit(0)
    row = df.agg(measured_bytes(df.schema).alias("bytes"), keyed.alias("keyed"), keys.alias("keys")).first()
    return Measured(int(row["bytes"]), int(row["keyed"]), int(row["keys"]))


def file_version(paths: list[str]) -> tuple | None:
    """``(path, length, time)`` of the files; None without files or times."""
    found = []
    for path in sorted(paths):
        try:
            store, plain = fs.FileSystem.from_uri(path)
            info = store.get_file_info(plain)
        except (OSError, ValueError, pa.ArrowException):
            return None  # a store that only Spark reads
        if info.mtime_ns is None:
            return None
        found.append((path, info.size, info.mtime_ns))
    return tuple(found) or None


def _folder(df: DataFrame) -> str | None:
    spark = df.sparkSession
    named = spark.conf.get(FOLDER_KEY, None)
    if named:
        return named.rstrip("/")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/measurements" if shared else None


def _address(df: DataFrame, key: str | None, version: tuple) -> str | None:
    """Where the measurement is kept: by the text of the plan, its files and the key."""
    folder = _folder(df)
    if not folder:
        return None
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    logical = out.getvalue().partition("== Optimized")[0].partition("== Analyzed")[2]
    plan = re.sub(r"#\d+L?|\[plan_id=\d+\]", "", logical)
    name = hashlib.sha256(json.dumps([plan, version, key]).encode()).hexdigest()
    return f"{folder}/{name}.json"


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", address):
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


def _read(address: str) -> Measured | None:
    with contextlib.suppress(OSError, ValueError, pa.ArrowException, TypeError):
        store, path = _opened(address)
        with store.open_input_stream(path) as file:
            return Measured(**json.loads(file.read()))
    return None


def _write(address: str, value: Measured) -> None:
    # a cache: a folder that cannot be written costs a measurement next time
    with contextlib.suppress(OSError, ValueError, pa.ArrowException):
        store, path = _opened(address)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as file:
            file.write(json.dumps(asdict(value)).encode())


def measure(df: DataFrame, key: str | None = None) -> Measured:
    """The frame's measurement: a kept one if its files are unchanged, else by one Spark job."""
    files = df.inputFiles()
    if not files:
        return _take(df, key)
    version = file_version(files)
    slot = (df.semanticHash(), key, version or tuple(sorted(files)))
    now, hit = time.monotonic(), _KNOWN.get(slot)
    if hit and (version or now - hit[0] < TTL_SECONDS):
        return hit[1]
    address = _address(df, key, version) if version else None
    value = _read(address) if address else None
    if value is None:
        value = _take(df, key)
        if address:
            _write(address, value)
    _KNOWN[slot] = (now, value)
    return value


def largest(df: DataFrame, column: str) -> int:
    """The greatest value of a column (0 without rows), measured once for each version of the frame's files."""
    top = df.agg(F.max(column).alias("top")).select(F.coalesce("top", F.lit(0)).cast("long").alias("top"))
    files = df.inputFiles()
    if not files:
        return int(top.first()["top"])
    # kept like a dimension's measurement, as the number of its keys
    version = file_version(files)
    slot = (df.semanticHash(), f"max:{column}", version)
    if version is None or slot not in _KNOWN:
        address = _address(df, f"max:{column}", version) if version else None
        value = _read(address) if address else None
        if value is None:
            value = Measured(0, 0, int(top.first()["top"]))
            if address:
                _write(address, value)
        _KNOWN[slot] = (time.monotonic(), value)
    return _KNOWN[slot][1].keys


def forget() -> None:
    """Drop the measurements kept in this process (those in the folder stay)."""
    _KNOWN.clear()
