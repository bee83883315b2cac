"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, as a table of documents, and all but
the last return the columns of documents.  ``run`` writes each stage's result
to the shared folder and reads it again.

Both dedup stages keep one row of each group, whether ids are unique, repeated
or null.  In every stage an empty table gives an empty result, texts of any
length are taken whole, and other columns, also of clashing names, go along
unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import exact_dedup, language_id, packing, queries, simhash, suffix_dedup
from tillscope.llm.common import by_position, ship_package, stored, table, text_or_empty

#: Bytes from which a repeated string is cut: some 40 words of this corpus, so that passages of over 50 words
#: that repeat go whole.  Longer than its boilerplate lines, which stay.
REPEAT_BYTES = 240


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found: null texts and texts without a letter.

    All others stay, each row of repeated ones too: a low cosine is no proof against a document.
    """
    ship_package(spark)
    names, plain = docs.columns, by_position(docs)
    own_id, text, lang = (f"c{names.index(c)}" for c in ("doc_id", "text", "lang"))
    model = language_id.train(plain.where(~language_id.held_out(own_id)), own_id, text, lang)
    found = plain.withColumn("found", language_id.language_of(F.col(text).cast("string"), model))
    return found.where(F.col("found.lang_pred") != language_id.UNKNOWN).drop("found").toDF(*names)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays: that of the largest doc_id, a null one only where the class has no other.

    A null text equals an empty one.  The rows' other columns go through the grouping with their text, which
    each map task sends once; so no row has to be found again by its id.
    """
    ship_package(spark)
    names, plain = docs.columns, by_position(docs)
    own_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    others = [c for c in plain.columns if c != text]
    rows = plain.select(text_or_empty(text).alias("body"), F.monotonically_increasing_id().alias("row"),
                        F.struct(*others, F.col(text).isNull().alias("no_text")).alias("rest"))
    last = rows.groupBy(exact_dedup.content_hash(F.col("body")).alias("h"), "body").agg(
        F.max_by("rest", F.struct(f"rest.{own_id}", "row")).alias("rest"))
    back = F.when(~F.col("rest.no_text"), F.col("body")).cast(plain.schema[text].dataType)
    return last.select(*(back if c == text else F.col(f"rest.{c}") for c in plain.columns)).toDF(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, one row stays: that of the smallest doc_id, a null one only if all are null.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows are told apart by a number of their own; the numbered table is stored,
    so that a row has the same number in every scan.
    """
    ship_package(spark)
    names = docs.columns
    own_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    rows = stored(by_position(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    classes = simhash.near_duplicates(rows, shingle=3, reach=2, id_col="row", text_col=text)
    ids = rows.select(F.col("row").alias("doc_id"), F.struct(F.col(own_id).isNull(), own_id, "row").alias("place"))
    first = classes.join(ids, "doc_id").groupBy("component_id").agg(F.min("place").alias("place"))
    return rows.join(first.select("place.row"), "row", "left_semi").drop("row").toDF(*names)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of strings of ``REPEAT_BYTES`` that start at several places; ``n_chars`` follows the text.

    Every row stays, null texts and shorter ones as they are.
    """
    ship_package(spark)
    names = docs.columns
    cut = suffix_dedup.without_repeats(docs, length=REPEAT_BYTES)
    if "n_chars" not in names:
        return cut
    plain, size, text = by_position(cut), f"c{names.index('n_chars')}", f"c{names.index('text')}"
    kind = docs.dtypes[names.index("n_chars")][1]
    return plain.withColumn(size, F.when(F.col(size).isNotNull(), F.length(text_or_empty(text))).cast(kind)).toDF(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids; a null or empty text is its end id alone."""
    ship_package(spark)
    return packing.pack(docs, queries.WORDS, length=2048, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: The stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
