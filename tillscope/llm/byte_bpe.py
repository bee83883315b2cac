"""Byte-level BPE encoding and decoding of document texts.

Encoding runs the tokenizers library inside tasks, over Arrow batches; the
vocabulary is built from a rank file through the byte-to-character table
(``token_cache.ByteEncoder``).  Decoding looks ids up in the byte table.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import pick, text_or_empty
from tillscope.llm.token_cache import byte_encoder, byte_table

#: Ids or bytes of a task's output batches.
BATCH_IDS = 1_000_000


def _in_batches(items: Iterable[tuple], names: list[str], types: list, size) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for row in items:
        rows.append(row)
        held += size(row)
        if held >= BATCH_IDS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text",
           with_offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int) for every whole text; with ``with_offsets`` also ``offsets``.

    ``offsets`` has the byte offset of each id in the UTF-8 text, and the end.
    An id can begin inside a character; its offset then lies inside it too.

    * null text counts as empty and gives an empty array;
    * null and repeated ids are carried as they are, one row out per row in;
    * an empty table gives an empty result; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    types = [pa.int64(), pa.list_(pa.int32())] + [pa.list_(pa.int64())] * with_offsets

    def run(batches):
        coder = byte_encoder(ranks)

        def rows_of():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    packed = coder.encode(text.as_py())
                    ids = np.frombuffer(packed, "<i4")
                    yield (doc, ids, coder.offsets(packed)) if with_offsets else (doc, ids)

        yield from _in_batches(rows_of(), ["doc_id", "ids", "offsets"][:len(types)], types, lambda r: len(r[1]) + 8)

    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", offsets array<long>" * with_offsets)


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for (null ids: empty)."""

    def run(batches):
        table = byte_table(ranks).bytes_of

        def rows_of():
            for batch in batches:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                    values = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                    yield doc, values, b"".join([table[i] for i in values.tolist()])

        yield from _in_batches(rows_of(), ["doc_id", "ids", "decoded"],
                               [pa.int64(), pa.list_(pa.int32()), pa.binary()], lambda r: len(r[1]) + 8)

    return pick(tokens, doc_id="doc_id", ids="ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def decode_pieces(pieces: Iterable[Iterable[int]], ranks: str) -> Iterator[str]:
    """Text of consecutive runs of ids.

    A character whose bytes are split between two runs comes out whole with the
    run that completes it; bytes that end no character become U+FFFD.
    """
    table, decoder = byte_table(ranks).bytes_of, codecs.getincrementaldecoder("utf-8")("replace")
    for ids in pieces:
        yield decoder.decode(b"".join([table[i] for i in ids]))
    if rest := decoder.decode(b"", final=True):
        yield rest
