"""Helpers shared by the operators: column picking, shared folders, cut lineage."""

from __future__ import annotations

import io
import os
import pkgutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_position(df: DataFrame, prefix: str = "c") -> DataFrame:
    """``df`` with columns renamed by position.

    Spark matches names without regard to case, so a table with ``text`` and
    ``TEXT`` (or two equal names) cannot be addressed by name; positions can.
    """
    return df.toDF(*(f"{prefix}{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns ``wanted`` (new name = exact source name), whatever other columns exist.

    The first column of exactly that name is taken; a missing one raises.
    """
    names, plain = df.columns, by_position(df)
    missing = [c for c in wanted.values() if c not in names]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {names}")
    return plain.select(*(plain[f"c{names.index(src)}"].alias(new) for new, src in wanted.items()))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def semi_join(df: DataFrame, keep: DataFrame, **keys: tuple[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows of ``df``, all columns, whose keys are in ``keep``.

    ``keys`` maps a column of ``keep`` to an exact column name of ``df`` and
    what is done to that column to make the key.  Nulls match nulls.
    """
    names, plain = df.columns, by_position(df)
    on = []
    for key, (name, of) in keys.items():
        on.append(of(plain[f"c{names.index(name)}"]).eqNullSafe(keep[key]))
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    return plain.join(keep, condition, "left_semi").toDF(*names)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``, as in tests) may lack it;
    a folder of its own is then made and set for the session.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="llm-shared-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return (sc.getCheckpointDir() or made).rstrip("/")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, lineage cut.

    The files outlive lost executors; they stay until the shared folder is cleared.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, by ``addPyFile`` from the shared folder, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import tillscope
    from tillscope.llm import files

    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for found in pkgutil.walk_packages(tillscope.__path__, "tillscope."):
            path = found.name.replace(".", "/") + ("/__init__.py" if found.ispkg else ".py")
            z.writestr(path, pkgutil.get_data("tillscope", path.removeprefix("tillscope/")) or b"")
        z.writestr("tillscope/__init__.py", pkgutil.get_data("tillscope", "__init__.py") or b"")
    path = fresh_folder(spark, "code") + "/tillscope.zip"
    with files.create(path) as out:
        out.write(body.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
