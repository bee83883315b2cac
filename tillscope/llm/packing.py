"""Packing documents into training sequences with a bounded number of open windows.

Each partition keeps ``open_windows`` windows.  What is left of a document
after its full-length pieces goes to the window that it fits best; when it
fits none and no more windows may be opened, the fullest window is topped up
with the document's next ids and emitted, so an emitted window is always full.
The windows still open when a partition ends are the leftovers; they are
merged over groups of partitions.  What remains of a group is emitted as
sequences whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import pick, stored, text_or_empty
from tillscope.llm.token_cache import word_encoder

#: Partitions whose leftovers are merged in one task: 64 x 16 windows of 8 KB.
MERGED_PARTITIONS = 64
#: Rows of a task's output batches.
FLUSH_ROWS = 20_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Open windows of one partition.  A piece is (doc, start, ids, doc_tokens); ids are 4-byte integers."""

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.windows: list[tuple[int, list]] = []  # (ids in it, its pieces)

    def add(self, doc, ids: bytes) -> Iterator[list]:
        """Place a document; yields each window that became full."""
        total, at = len(ids) // 4, 0

        def piece(size: int) -> tuple:
            return (doc, at, ids[at * 4:(at + size) * 4], total)

        while total - at >= self.length:
            yield [piece(self.length)]
            at += self.length
        while at < total:
            left = total - at
            fits = [w for w in range(len(self.windows)) if self.windows[w][0] + left <= self.length]
            if fits:
                w, size = max(fits, key=lambda w: self.windows[w][0]), left
            elif len(self.windows) < self.most:
                self.windows.append((0, []))
                w, size = len(self.windows) - 1, left
            else:
                w = max(range(len(self.windows)), key=lambda w: self.windows[w][0])
                size = self.length - self.windows[w][0]
            used, pieces = self.windows[w]
            pieces.append(piece(size))
            at += size
            if used + size == self.length:
                yield self.windows.pop(w)[1]
            else:
                self.windows[w] = (used + size, pieces)


def merged(pieces: Iterable[tuple], length: int) -> Iterator[list]:
    """Leftover pieces, recut into full windows and at last into powers of two."""
    window, used = [], 0
    for doc, start, ids, total in pieces:
        at, size = 0, len(ids) // 4
        while at < size:
            take = min(size - at, length - used)
            window.append((doc, start + at, ids[at * 4:(at + take) * 4], total))
            at, used = at + take, used + take
            if used == length:
                yield window
                window, used = [], 0
    power = length
    while used:
        while power > used:
            power //= 2
        sequence, got = [], 0
        while got < power:
            doc, start, ids, total = window.pop(0)
            take = min(len(ids) // 4, power - got)
            sequence.append((doc, start, ids[:take * 4], total))
            if take * 4 < len(ids):
                window.insert(0, (doc, start + take, ids[take * 4:], total))
            got += take
        yield sequence
        used -= power


def _rows(windows: Iterable[list], first_id: int, keep_ids: bool) -> Iterator[tuple]:
    for n, window in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            size = len(ids) // 4
            row = (doc, start, size, zlib.crc32(ids), total, first_id + n, offset)
            yield (*row, ids) if keep_ids else row
            offset += size


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, open_windows: int = 16,
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``length`` ids (a power of two).

    Returns per piece ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``, and with ``keep_ids`` the piece's ``ids`` (binary,
    little-endian unsigned 32-bit).  Each id of each document (its end id
    included) is in exactly one piece; every sequence is full or has a length
    that is a power of two, so none needs padding.

    * null text counts as empty: the document is its end id alone;
    * a null or repeated id is carried as it is: each row is a document;
    * texts of any length are cut into as many pieces as they need;
    * an empty table gives an empty result; other columns are ignored.
    """
    if length & (length - 1):
        raise ValueError("length is a power of two")
    schema = PIECE + (", ids binary" if keep_ids else "")
    columns = COLUMNS + (["ids"] if keep_ids else [])
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tail = np.array([end_id], dtype="<u4").tobytes()
    types = {"doc_id": pa.int64(), "ids": pa.binary(), "open_ids": pa.binary()}

    def batch_of(out: list[tuple], names: list[str]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, cols)], names)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_encoder(tokenizer).encode, TaskContext.get().partitionId()
        packer, names, n, out = Packer(length, open_windows), [*columns, "part", "open_ids"], 0, []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for window in packer.add(doc, encode(text.as_py()) + tail):
                    out += [(*r, part, None) for r in _rows([window], (part << 33) + n, keep_ids)]
                    n += 1
                if len(out) >= FLUSH_ROWS:
                    yield batch_of(out, names)
                    out = []
        for _, window in packer.windows:  # leftovers, with their ids
            for doc, start, ids, total in window:
                row = (doc, start, len(ids) // 4, 0, total, -1, 0, *([None] * keep_ids))
                out.append((*row, part, ids))
        yield batch_of(out, names)

    placed = stored(rows.mapInArrow(place, schema + ", part long, open_ids binary"), "packed")

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "n"])
        docs_ = [None if pd.isna(d) else int(d) for d in group["doc_id"]]
        pieces = zip(docs_, group["start"].tolist(), group["open_ids"].tolist(), group["doc_tokens"].tolist())
        made = list(_rows(merged(pieces, length), (1 << 62) + (int(key[0]) << 33), keep_ids))
        frame = pd.DataFrame(made, columns=columns)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    leftovers = placed.where("open_ids is not null").select(
        "doc_id", "start", "open_ids", "doc_tokens", "part", F.monotonically_increasing_id().alias("n"),
        F.expr(f"part div {MERGED_PARTITIONS}").alias("merge_group"))
    return placed.where("open_ids is null").select(*columns).unionByName(
        leftovers.groupBy("merge_group").applyInPandas(merge, schema))
