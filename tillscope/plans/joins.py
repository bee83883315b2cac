"""Fact-to-dimension joins: broadcast behind a measured size, shuffle join beyond it.

Spark's own planner guesses a dimension's size from file sizes and, for a
derived dimension, multiplies the sizes of its inputs, so a small derived
table can miss the broadcast and cost a full shuffle of the fact side.
``checked_broadcast`` and ``prepare_dimension`` measure the dimension
instead (``plans.measure``): its rows and the bytes of its strings, once for
each version of its files.  Under the limit the side is broadcast; over it the join is left to
Spark, which sort-merge joins it with AQE skew handling.
``prepare_dimension`` also folds repeated dimension rows into a copy count,
so a group of copies cannot multiply rows inside the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.plans.measure import measure

# Default limit on the in-memory size of a broadcast side; a session can
# set ``spark.tillscope.broadcastMaxBytes`` to change it.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
CONF_KEY = "spark.tillscope.broadcastMaxBytes"


def broadcast_limit(df: DataFrame) -> int:
    value = df.sparkSession.conf.get(CONF_KEY, None)
    return int(value) if value else BROADCAST_MAX_BYTES


def fits(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether the frame's measured size is under the limit for broadcasts."""
    return measure(df).bytes <= (max_bytes if max_bytes is not None else broadcast_limit(df))


def checked_broadcast(dim: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``broadcast(dim)`` when its measured size is under the limit, else ``dim`` unchanged."""
    return F.broadcast(dim) if fits(dim, max_bytes) else dim


def left_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join on ``keys``; keys of different types are compared as text."""
    text = {k: f"_text_{k}" for k in keys if left.schema[k].dataType != right.schema[k].dataType}
    if not text:
        return left.join(right, list(keys), "left")
    for k, name in text.items():
        right = right.withColumn(name, F.col(k).cast("string")).drop(k)
        left = left.withColumn(name, F.col(k).cast("string"))
    return left.join(right, [text.get(k, k) for k in keys], "left").drop(*text.values())


def prepare_dimension(dim: DataFrame, key: str, copies_col: str, check: bool = True) -> tuple[DataFrame, bool]:
    """Ready a dimension for a left join on ``key``: collapse copies, size the broadcast.

    Size and uniqueness of ``key`` are measured once for each version of the
    dimension's files.  A
    dimension with repeated keys is reduced to one row per distinct row with
    its count in ``copies_col`` (the join's fan-out then travels as a weight
    instead of repeated rows, like the payment weight), and the side is
    broadcast when its measured size is under the limit.  Returns the frame
    and whether ``copies_col`` was added.  With ``check=False`` no job runs:
    the dimension is always collapsed and the join left to Spark.
    """
    def collapse(d: DataFrame) -> DataFrame:
        return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias(copies_col))

    if not check:
        return collapse(dim), True
    found = measure(dim, key)
    out, added = (collapse(dim), True) if found.keyed != found.keys else (dim, False)
    return (F.broadcast(out) if found.bytes <= broadcast_limit(dim) else out), added
