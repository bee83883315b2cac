"""How filters interact: what each removes, in every order of applying them.

Five filters fail a document by its text alone (``FILTERS``) or by the texts of
the whole table: ``E`` fails a document if one of smaller id has its very text.
That is an existential self-join, a left-semi join on hash, exact text and
smaller id.  Only rows whose hash occurs twice enter it; its right side has one
row for each text, with the smallest id, and hashes of many rows are dealt over
salts, so a text that a third of all rows share meets in many tasks.

The ids that ``E`` marks are united with the ids that fail other filters; the
failures of an id's text add up to a set of bits.  Rows are then counted by part,
bits and labels, and all orders are worked out from those counts.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import pick, stored, text_or_empty
from tillscope.plans.joins import checked_broadcast

FILTERS = "ABCDE"
BIT = {f: 1 << n for n, f in enumerate(FILTERS)}
# Fixed values of the filters.
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # per cent of the words
MOST_CAPITALS = 3  # per cent of the code points
MARKS = "[#$%&*|]"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows of one hash that one task compares.
SALT_ROWS = 2_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def own_failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that the text alone decides."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def fingerprint(text: Column) -> Column:
    """256-bit hash that stands for a text where it is not compared itself."""
    return F.unhex(F.sha2(text, 256))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, print, part, n, bits``: rows of equal id, text and part, and the filters that their text fails."""
    rows = pick(docs, doc_id=id_col, text=text_col, part=part_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
        text_or_empty().alias("text")).withColumn("words", word_list(F.col("text")))
    bits = sum((F.when(fails, BIT[f]).otherwise(0) for f, fails in own_failures(F.col("text"), F.col("words")).items()),
               F.lit(0))
    return rows.select("doc_id", fingerprint(F.col("text")).alias("print"), "part", bits.alias("bits")).groupBy(
        "doc_id", "print", "part", "bits").agg(F.count(F.lit(1)).alias("n"))


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=F.xxhash64,
                 salt_rows: int = SALT_ROWS) -> DataFrame:
    """``doc_id, print`` of the rows whose text a row of smaller id has (``E``)."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn(
        "hash", hash_fn(F.col("text")))
    # hashes of two ids or more: their rows alone carry texts any further
    again = stored(rows.groupBy("hash").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where(
        "low < high").select("hash", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts")), "repeated-hashes")
    met = stored(rows.join(checked_broadcast(again), "hash"), "repeated")
    # one row for each text, with its smallest id, for each salt
    first = stored(met.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.first("salts").alias("salts")).select(
        "hash", "text", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "first-copies")
    later = met.select("doc_id", "hash", "text", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    same = (later["hash"] == first["hash"]) & (later["salt"] == first["salt"]) & (later["text"] == first["text"])
    copies = later.join(first, same & (first["first"] < later["doc_id"]), "left_semi")
    return copies.select("doc_id", fingerprint(F.col("text")).alias("print")).distinct()


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang", label_id: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic",
                 hash_fn=F.xxhash64, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``part, bits, good, toxic, n``: documents by part, failed filters and labels.

    ``good`` and ``toxic`` say whether any label row of the id has a 1 there.
    """
    own = failures(docs, id_col, text_col, part_col)
    marked = later_copies(docs, id_col, text_col, hash_fn, salt_rows).select(
        "doc_id", "print", F.lit(None).cast("string").alias("part"), F.lit(BIT["E"]).alias("bits"),
        F.lit(0).cast("long").alias("n"))
    # the failures of an id's text are united; a few parts at most share both
    of_id = own.unionByName(marked).groupBy("doc_id", "print").agg(
        F.bit_or("bits").alias("bits"),
        F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "n"))).alias("rows"))
    counted = of_id.select("doc_id", "bits", F.inline("rows")).groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    flags = pick(labels, doc_id=label_id, good=good_col, toxic=toxic_col).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(c) for c in ("good", "toxic")))
    labelled = stored(counted, "counted").join(stored(flags, "flags"), "doc_id", "left")
    return labelled.groupBy("part", "bits", F.coalesce("good", F.lit(False)).alias("good"),
                            F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each part, order and step: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley`` (counts of documents of the part).

    ``redundant`` fail the step's filter but were removed before, ``unique_fails``
    fail it alone; ``shapley`` is what the filter removes at its step, summed over all orders.

    * a null text counts as empty, a null part as the empty string; texts of any length are read whole;
    * each row counts, also repeated ones; rows of one id and text are no copies of each other;
    * a null id has no labels and is neither a copy nor the first of copies;
      label rows that repeat an id are taken together, null labels are no label;
    * every part has all rows, zeros too; an empty table gives none; other columns are ignored.
    """
    counts = combinations(docs, labels, **options)
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = [(o, n + 1, sum(BIT[f] for f in o[:n]), BIT[f]) for o in orders for n, f in enumerate(o)]
    kind = "struct<filter_order:string,step:int,before:int,own:int>"
    table = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "before", "own"), s)) for s in steps])),
                        f"array<{kind}>")
    # at most 32 bits x 4 labels a part, times a constant
    rows = counts.select("*", F.inline(table))
    fails, earlier = F.col("bits").bitwiseAND(F.col("own")) > 0, F.col("bits").bitwiseAND(F.col("before")) > 0
    total = lambda cond, n=F.col("n"): F.sum(F.when(cond, n).otherwise(0)).cast("long")
    # of the orders, the filter comes first of k failing ones in one of k
    share = F.expr(f"n * ({len(orders)} div greatest(bit_count(bits), 1))")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"), total(F.col("bits") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier & F.col("good")).alias("good_lost"),
        total(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"))
