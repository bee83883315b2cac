"""Exact dedup: 128-bit content hash, bytes compared inside hash groups.

Only DataFrame functions run here.  The texts cross the network once, in an
aggregation on (hash, text): Spark compares the whole text when it groups, so
two texts that share a hash stay apart, and each map task sends one row per
distinct text, so a huge group of copies is a few rows before the shuffle.
Everything after that step carries the 16-byte hash instead of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import cut, pick, text_or_empty


def content_hash(text: Column) -> Column:
    """128-bit hash of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Classes of byte-equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the row of a class that stays: the ``smallest`` (default)
    or ``largest`` id.  Every input row gives one output row.

    * null text counts as empty; texts are compared as they are, whole;
    * a null id never stays while its class has another id; in a class of null
      ids only, ``keep_id`` is null and every row is kept;
    * rows that repeat both id and text are all kept when that id stays (they
      are the same record);
    * an empty table gives an empty result; other columns are ignored,
      whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    rows = pick(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("body"))
    keyed = rows.withColumn("h", hash_fn(F.col("body")))
    classes = keyed.groupBy("h", "body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    per_hash = cut(classes.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), best("keep_id").alias("keep_id"),
                                            F.sum("n").alias("n")))
    narrow = keyed.select("id", "h", F.sha2(F.col("body"), 256).alias("sha"))
    own = per_hash.where("texts = 1").select("h", "keep_id", "n")
    found = narrow.join(own, "h").select("id", "sha", "keep_id", "n")
    shared = per_hash.where("texts > 1").select("h")
    if not shared.isEmpty():  # different texts under one hash: these rows are told apart by their text
        clash = keyed.join(shared, "h").select("id", "h", "body")
        told = clash.groupBy("h", "body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        found = found.unionByName(clash.join(told, ["h", "body"]).select(
            "id", F.sha2("body", 256).alias("sha"), "keep_id", "n"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"))
