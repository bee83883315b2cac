"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of a range of documents, one after the other, as
little-endian unsigned 32-bit integers:

* data frames: ``FRAME_IDS`` ids each (fewer in the last), each an independent
  zstandard frame with its own checksum;
* a skippable frame with the document index: ids and lengths of the documents;
* a skippable frame with the seek table of the public zstd seekable format:
  compressed size, plain size and XXH64 checksum of each data frame, then the
  number of frames and the closing magic.

A reader seeks to the end, reads table and index, and decompresses only the
frames that hold the wanted documents.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm import files
from tillscope.llm.common import fresh_folder, pick, stored, text_or_empty
from tillscope.llm.token_cache import word_encoder

#: Ids in a frame: 256 KiB before compression.
FRAME_IDS = 65_536
# Magic numbers of the zstandard skippable frames and the seekable format (fixed values).
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
CLOSING_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "part long, path string, docs long, tokens long"


class Writer:
    """Writes one file; holds one frame and the document index."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.table, self.buffer = stream, [], bytearray()
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.doc_ids, self.lengths = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.buffer += ids
        while len(self.buffer) >= FRAME_IDS * 4:
            self._frame(bytes(self.buffer[:FRAME_IDS * 4]))
            del self.buffer[:FRAME_IDS * 4]

    def _frame(self, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.stream.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def finish(self) -> int:
        """Writes index and seek table; the number of ids in the file."""
        if self.buffer:
            self._frame(bytes(self.buffer))
        known = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        lengths = np.array(self.lengths, dtype="<i8")
        index = self.packer.compress(known.tobytes() + ids.tobytes() + lengths.tobytes())
        self._skippable(INDEX_MAGIC, struct.pack("<Q", len(ids)) + index)
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        self._skippable(TABLE_MAGIC, rows + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, CLOSING_MAGIC))
        self.stream.close()
        return int(lengths.sum())

    def _skippable(self, magic: int, body: bytes) -> None:
        self.stream.write(struct.pack("<II", magic, len(body)) + body)


class Reader:
    """Reads one file by its trailing tables; ``frames_read`` counts what it decompressed."""

    def __init__(self, file):
        self.file, size = file, file.size()
        self.unpacker, self.frames_read = zstandard.ZstdDecompressor(), 0
        count, flag, closing = struct.unpack("<IBI", self._at(size - 9, 9))
        if closing != CLOSING_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a file of token frames")
        table_at = size - 9 - 12 * count - 8
        table = np.frombuffer(self._at(table_at + 8, 12 * count), "<u4").reshape(count, 3)
        self.sizes, self.plain, self.sums = (table[:, k].astype(np.int64) for k in range(3))
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        magic, length = struct.unpack("<II", self._at(int(self.begins[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("document index not found")
        body = self._at(int(self.begins[-1]) + 8, length)
        (docs,) = struct.unpack("<Q", body[:8])
        index = self.unpacker.decompress(body[8:]) if docs else b""
        self.known = np.frombuffer(index, np.uint8, docs).astype(bool)
        self.doc_ids = np.frombuffer(index, "<i8", docs, docs)
        self.lengths = np.frombuffer(index, "<i8", docs, 9 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self._last = (-1, b"")

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        """Frame ``k``, its checksum tested; the last one read is kept."""
        if self._last[0] != k:
            plain = self.unpacker.decompress(self._at(int(self.begins[k]), int(self.sizes[k])))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k] or len(plain) != self.plain[k]:
                raise ValueError(f"frame {k} is damaged")
            self._last, self.frames_read = (k, plain), self.frames_read + 1
        return self._last[1]

    def document(self, n: int) -> bytes:
        """ids of the file's ``n``-th document."""
        begin, end, out = int(self.starts[n]), int(self.starts[n + 1]), []
        while begin < end:
            k = begin // FRAME_IDS
            upto = min(end, (k + 1) * FRAME_IDS)
            out.append(self.frame(k)[(begin - k * FRAME_IDS) * 4:(upto - k * FRAME_IDS) * 4])
            begin = upto
        return b"".join(out)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", n_files: int | None = None, folder: str | None = None) -> DataFrame:
    """Write the ids of every document to files in ascending id order; returns the manifest.

    Documents are range-partitioned by id, so file ``k`` holds smaller ids
    than file ``k + 1``.  Each task streams its range into one file of the
    shared folder under a name of its own attempt; the manifest, written by
    Spark's committer, names only the files of tasks that ended well.

    * null text counts as empty: the document is its end id alone;
    * rows with a null id come first; rows that repeat an id are all written,
      ordered among themselves by their text's hash and input position, which
      also lets a hot id span several files;
    * an empty table gives an empty manifest; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "tokens")
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("pos", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("pos")]
    dealt = rows.repartitionByRange(n_files, *order) if n_files else rows.repartitionByRange(*order)
    tail = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, task, encode = None, TaskContext.get(), word_encoder(tokenizer).encode
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.zids"
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = Writer(files.create(path))
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                writer.add(doc_id, encode(text.as_py()) + tail)
        if writer is not None:
            tokens = writer.finish()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [path],
                                              "docs": [len(writer.doc_ids)], "tokens": [tokens]})

    return stored(dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, MANIFEST),
                  "tokens-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids`` (ids as little-endian 32-bit integers).

    ``start`` counts the ids of all documents before it, over all files.  The
    running sum is taken over the manifest, which has one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    spread = based.select("path", "base").repartition(
        manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with files.random_access(path) as file:
                    reader, n = Reader(file), 0
                    while n < len(reader.lengths):
                        # as many documents as make about 1 M ids
                        upto = max(n + 1, int(np.searchsorted(reader.starts, reader.starts[n] + 1_000_000)))
                        upto = min(upto, len(reader.lengths))
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(reader.doc_ids[n:upto], mask=~reader.known[n:upto]),
                            "start": reader.starts[n:upto] + base,
                            "n_tokens": reader.lengths[n:upto],
                            "ids": pa.array([reader.document(k) for k in range(n, upto)], pa.binary())})
                        n = upto

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """ids of the wanted documents only: ``doc_id, ids``.

    The files' indexes are joined to the wanted ids, and only the frames that
    hold those documents are decompressed.  An id that is not in the files gives
    no row; one that several documents share gives a row for each.
    """
    def index(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.random_access(path) as file:
                    reader = Reader(file)
                at = np.flatnonzero(reader.known)
                for k in range(0, len(at), 100_000):
                    part = at[k:k + 100_000]
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(part), "n": part, "want": reader.doc_ids[part]})

    def fetch(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        with files.random_access(key[0]) as file:
            reader, own = Reader(file), sorted(group["n"])
            return pd.DataFrame({"doc_id": reader.doc_ids[own], "ids": [reader.document(int(n)) for n in own]})

    asked = pick(wanted, want=id_col).where("want is not null").distinct()
    found = manifest.select("path").mapInArrow(index, "path string, n long, want long").join(asked, "want")
    return found.groupBy("path").applyInPandas(fetch, "doc_id long, ids binary")
