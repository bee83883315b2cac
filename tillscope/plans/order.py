"""Row numbers of a whole table in a given order, without one task that holds it.

``row_number`` over an unpartitioned window sends every row to one task.  Here
the rows are first cut into ranges of the order: a bounded sample of the rows'
order keys gives the borders, each row's range is how many borders lie below
it, and the ranges are numbered on their own.  A table of the ranges'
counts, never more than ``RANGES`` + 1 rows, gives each range its offset.  All of
it is one lazy plan; the numbers do not depend on the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Borders between ranges.
RANGES = 256


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place", ranges: int = RANGES) -> DataFrame:
    """``df`` with each row's place, from 1, in ascending order of ``order`` (nulls first).

    ``order`` tells all rows apart, or rows that it does not are numbered in any order.
    """
    keyed = df.withColumn("_order", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))))
    # the keys of least hash: a sample of the distinct keys, the same in every run
    sample = keyed.select("_order").distinct().orderBy(F.xxhash64("_order"), "_order").limit(ranges)
    borders = sample.agg(F.sort_array(F.collect_list("_order"))).scalar()
    # the key's place among the borders: one more than the borders below it
    at = F.array_position(F.sort_array(F.array_append(borders, F.col("_order"))), F.col("_order"))
    # Never null, and said so: Spark would test a range that may be null before the
    # join, and push that test below df's aggregates, onto each of their input rows.
    dealt = keyed.withColumn("_range", F.coalesce(at, F.lit(0)))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # over at most RANGES + 1 rows
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_order"))
    placed = dealt.withColumn("_own", own).join(F.broadcast(offsets), "_range")
    return placed.select(*df.columns, (F.col("_before") + F.col("_own")).cast("bigint").alias(name))
