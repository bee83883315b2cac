"""Removal of benchmark passages from training documents.

The benchmark's word windows (``window`` consecutive words of an item; a
shorter item is one window) are hashed into sorted arrays with a filter table
before them, and broadcast.  Each task scans its documents' windows of the same
lengths against the table, a block of bytes at a time, and compares the words
of every hit with the item's words, so that a hash alone decides nothing.

The benchmark is broadcast in blocks whose measured size is under
``BLOCK_BYTES``.  Usually there is one, and the documents are scanned once
without a shuffle; a larger benchmark takes one scan for each block, and the
blocks' findings meet by the hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.common import by_position, pick, stored, text_or_empty
from tillscope.llm.worker import kept

WINDOW = 10
#: Bytes of benchmark words in one broadcast table.
BLOCK_BYTES = 8 << 20
#: Words of an item that stay together in a block (besides the overlap of a window).
PIECE_WORDS = 20_000
#: Text bytes scanned at once.
SCAN_BYTES = 1 << 20
#: Filter entries for each window, at least (a power of two).
FILTER = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# lower case of each byte of a word, 0 for a byte outside of words
_CLASS = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0
                   for b in range(256)], np.uint8)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "begin", "end")]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    return (h ^ (h >> np.uint64(29))) * _MIX[1]


def _powers(base: int, size: int) -> list[np.ndarray]:
    """``size`` powers or more of an odd number modulo 2**64, and of its inverse; the worker keeps the longest."""
    known = kept("decontaminate")
    if base not in known or len(known[base][0]) < size:
        known[base] = []
        for b in (base, pow(base, -1, 1 << 64)):
            factors = np.full(1 << max(10, size.bit_length()), b, np.uint64)
            factors[0] = 1
            known[base].append(np.multiply.accumulate(factors))
    return known[base]


def _ranges_hashed(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[begin:end]`` for each range: equal for equal ranges, wherever they lie."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return _mixed((total[end] - total[begin]) * down[begin])


def words_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(begin, end, hash)`` of each word of a text given as bytes."""
    low = _CLASS[text]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], low != 0, [False]])))
    begin, end = edges[::2], edges[1::2]
    return begin, end, _ranges_hashed(low.astype(np.uint64), begin, end, _BASE)


def windows_hashed(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, given the words' hashes."""
    first = np.arange(max(0, len(words) - size + 1))
    return _ranges_hashed(words, first, first + size, _WORD_BASE)


def normalised(text: bytes) -> bytes:
    """Words in lower case, one space between."""
    low = _CLASS[np.frombuffer(text, np.uint8)]
    return b" ".join(np.where(low == 0, 32, low).astype(np.uint8).tobytes().split())


class Table:
    """Windows of one block of items: by length, sorted hashes and the windows that have them."""

    def __init__(self, pieces: list[tuple[str | None, str]], window: int = WINDOW):
        self.names = sorted({name for name, _ in pieces if name is not None})
        number = {name: n for n, name in enumerate(self.names)}
        self.text = [text.encode() for _, text in pieces]
        self.item = [number.get(name, -1) for name, _ in pieces]
        self.places, found = [], {}
        for n, text in enumerate(self.text):
            begin, end, words = words_of(np.frombuffer(text, np.uint8))
            self.places.append((begin.astype(np.int32), end.astype(np.int32)))
            size = min(window, len(words))
            hashes = windows_hashed(words, size)
            found.setdefault(size, []).append((hashes, np.full(len(hashes), n), np.arange(len(hashes))))
        self.sizes = {}
        for size, parts in found.items():
            hashes, piece, first = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            bits = max(10, int(len(hashes) * FILTER).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[hashes >> np.uint64(64 - bits)] = True
            self.sizes[size] = (hashes[order], piece[order], first[order], seen, np.uint64(64 - bits))

    def scan(self, words: np.ndarray, same: np.ndarray, text_of) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """``(first word, words, items)`` of each window that occurs.

        ``words`` are hashes, ``same`` says of each word which document it is of;
        ``text_of(first, last)`` gives the words' bytes as they stand in the text.
        """
        for size, (hashes, piece, first, seen, shift) in self.sizes.items():
            if len(words) < size:
                continue
            own = windows_hashed(words, size)
            maybe = np.flatnonzero(seen[own >> shift] & (same[:len(own)] == same[size - 1:]))
            left, right = (np.searchsorted(hashes, own[maybe], side) for side in ("left", "right"))
            verified: dict[bytes, tuple[int, ...]] = {}
            for at, a, b in zip(maybe[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist()):
                raw = text_of(at, at + size - 1)
                if raw not in verified:
                    verified[raw] = self._verified(normalised(raw), size, piece[a:b], first[a:b])
                if verified[raw]:
                    yield at, size, verified[raw]

    def _verified(self, words: bytes, size: int, piece: np.ndarray, first: np.ndarray) -> tuple[int, ...]:
        """Items of the windows that are these very words."""
        return tuple({self.item[p] for p, w in zip(piece.tolist(), first.tolist())
                      if self.text[p][self.places[p][0][w]:self.places[p][1][w + size - 1]] == words})


def _merged(runs: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs ``(first word, last word, first byte, end byte)`` in order, overlapping and touching ones as one."""
    out: list[tuple[int, int, int, int]] = []
    for run in sorted(runs):
        if out and run[0] <= out[-1][1] + 1:
            a, b, c, d = out[-1]
            out[-1] = (a, max(b, run[1]), c, max(d, run[3]))
        else:
            out.append(run)
    return out


def _blocks(text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``SCAN_BYTES`` that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SCAN_BYTES)
        while end < len(text):
            outside = np.flatnonzero(_CLASS[text[end - 1:end - 1 + SCAN_BYTES]] == 0)
            if len(outside):
                end += int(outside[0])
                break
            end = min(len(text), end + SCAN_BYTES)
        yield at, end
        at = end


def scan_texts(texts: list[bytes], table: Table) -> list[tuple[int, list[tuple], set[int]]]:
    """``(words, runs of hit words, items)`` of each text; texts are scanned together, up to a block at a time."""
    longest = max(table.sizes, default=1)
    counts, runs, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]

    def scan(parts: list[tuple[int, int, bytes]], base: int, carried: int):
        """Parts ``(document, byte offset, bytes)``; the first ``carried`` words were counted before."""
        joined = b"\n".join(p for _, _, p in parts)
        begin, end, hashes = words_of(np.frombuffer(joined, np.uint8))
        edges = np.cumsum([0] + [len(p) + 1 for _, _, p in parts])
        same = np.searchsorted(edges, begin, "right") - 1
        starts = np.searchsorted(same, np.arange(len(parts) + 1))
        for n, (doc, _, _) in enumerate(parts):
            counts[doc] += int(starts[n + 1] - starts[n])
        counts[parts[0][0]] -= carried
        spans: dict[int, list] = {}
        for at, size, found in table.scan(hashes, same, lambda a, b: joined[begin[a]:end[b]]):
            n = int(same[at])
            items[parts[n][0]].update(found)
            spans.setdefault(n, []).append((at, at + size - 1))
        for n, own in spans.items():
            doc, offset, _ = parts[n]
            shift = base - int(starts[n])
            for a, b, _, _ in _merged((a, b, 0, 0) for a, b in own):
                runs[doc].append((a + shift, b + shift, int(begin[a] - edges[n]) + offset, int(end[b] - edges[n]) + offset))
        return begin, end, len(hashes)

    waiting, held = [], 0
    for doc, text in enumerate(texts):
        if len(text) > SCAN_BYTES:  # by itself, in blocks that overlap by a window
            own, tail, base = np.frombuffer(text, np.uint8), b"", 0
            for a, b in _blocks(own):
                part, carried = tail + text[a:b], words_of(np.frombuffer(tail, np.uint8))[0].size
                begin, _, n = scan([(doc, a - len(tail), part)], base - carried, carried)
                base += n - carried
                tail = part[begin[max(0, n - longest + 1)]:] if n and longest > 1 else b""
            continue
        waiting.append((doc, 0, text))
        held += len(text)
        if held >= SCAN_BYTES:
            scan(waiting, 0, 0)
            waiting, held = [], 0
    if waiting:
        scan(waiting, 0, 0)
    return list(zip(counts, (_merged(r) for r in runs), items))


def benchmark_pieces(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """``item_id`` (as text), ``words`` (joined by a space): the items' words in pieces.

    Pieces of long items overlap by a window, so that each window lies in one.
    """
    low = F.translate(text_or_empty("text"), _UPPER, _LOWER)
    rows = pick(benchmark, item_id=id_col, text=text_col).select(
        F.col("item_id").cast("string").alias("item_id"),
        F.regexp_extract_all(low, F.lit(f"({_WORD})")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.size("w") - F.lit(window))
    cut = rows.select("item_id", "w", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_WORDS))).alias("at"))
    return cut.select("item_id", F.array_join(F.slice("w", F.col("at") + 1, PIECE_WORDS + window - 1), " ").alias("words"))


def _tables(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """The benchmark's tables, broadcast one by one; none holds more than ``block_bytes`` of words."""
    pieces = stored(benchmark_pieces(benchmark, id_col, text_col, window).distinct(), "benchmark")
    size = F.sum(F.octet_length("words") + F.lit(1))
    total = pieces.agg(size).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    while True:  # the measured size of every block is under the bound, or the block is a single piece
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
        largest = dealt.groupBy("block").agg(size.alias("size"), F.count(F.lit(1)).alias("n")).where("n > 1").agg(
            F.max("size")).first()[0] or 0
        if largest <= block_bytes or blocks == 1:
            break
        blocks *= 2
    sc, own = benchmark.sparkSession.sparkContext, ("item_id", "words")
    return [sc.broadcast(Table([tuple(r[c] for c in own) for r in dealt.where(F.col("block") == block).collect()], window))
            for block in range(blocks)]


_SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("begin", "end")])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                       T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))])
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
_PART = "k string, runs array<struct<first:long,last:long,begin:long,end:long>>, items array<string>"


def _finished(words: int, runs: list[tuple], names: Iterable[str]) -> tuple:
    return words, sum(b - a + 1 for a, b, _, _ in runs), sorted(names), [{"begin": c, "end": d} for _, _, c, d in runs]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts of a batch's parts of a bounded size."""
    first, texts, held = 0, [], 0
    for n, text in enumerate(batch.column("body")):
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= 4 * SCAN_BYTES:
            yield first, texts
            first, texts, held = n + 1, [], 0
    if texts:
        yield first, texts


def _arrays(rows: list[tuple], types: list) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows), types)]


def _shared(rows: DataFrame, tables: list) -> DataFrame:
    """``key, n_words, n_hit, items, spans`` of rows ``key, body`` (a binary), given broadcast tables."""
    out = T.StructType([T.StructField("key", rows.schema["key"].dataType), *_FOUND.fields])
    names = out.names

    if len(tables) == 1:
        table = tables[0]

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in _texts(batch):
                    own = table.value.names
                    found = [_finished(words, runs, (own[i] for i in items if i >= 0))
                             for words, runs, items in scan_texts(texts, table.value)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").slice(first, len(texts)), *_arrays(found, _TYPES)], names)

        return rows.mapInArrow(whole, out)

    # findings depend on the text alone: those of each block are kept by its hash
    keyed = rows.withColumn("k", F.sha2("body", 256))
    parts = None
    for table in tables:

        def part(batches: Iterable[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("k").to_pylist()
                for first, texts in _texts(batch):
                    own = table.value.names
                    found = [(k, [dict(zip(("first", "last", "begin", "end"), r)) for r in runs],
                              sorted(own[i] for i in items if i >= 0))
                             for k, (_, runs, items) in zip(keys[first:], scan_texts(texts, table.value)) if runs]
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            _arrays(found, [pa.string(), _RUNS, pa.list_(pa.string())]), ["k", "runs", "items"])

        own = stored(keyed.select("k", "body").mapInArrow(part, _PART).dropDuplicates(["k"]), "hits")
        parts = own if parts is None else parts.unionByName(own)
    met = stored(parts.groupBy("k").agg(F.flatten(F.collect_list("runs")).alias("runs"),
                                        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "hits")
    low = F.translate(F.col("body").cast("string"), _UPPER, _LOWER)
    counted = keyed.select("key", "k", F.regexp_count(low, F.lit(_WORD)).cast("long").alias("n"))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_finished(n, _merged(tuple(r.values()) for r in runs or []), items or [])
                     for n, runs, items in zip(*(batch.column(c).to_pylist() for c in ("n", "runs", "items")))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("key"), *_arrays(found, _TYPES)], names)

    return counted.join(met, "k", "left").select("key", "n", "runs", "items").mapInArrow(merge, out)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What each document shares with the benchmark: ``doc_id, n_words, n_hit, items, spans``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` has
    the ids (as text, sorted as text) of items with such windows, ``spans`` the
    byte ranges of the runs of hit words.

    * a null text has no words; an item without words has no window;
    * ids may be null or repeat: one row out per document row; items that share
      an id are one item, and an item with a null id hits words but is not named;
    * texts of any length are scanned whole, in blocks that overlap by a window;
    * empty tables give an empty result or documents without hits; other columns are ignored.
    """
    rows = pick(docs, key=id_col, text=text_col).select("key", text_or_empty().cast("binary").alias("body"))
    tables = _tables(benchmark, item_col, item_text_col, window, block_bytes)
    return _shared(rows, tables).withColumnRenamed("key", "doc_id")


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", most_hit: float | None = None,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all of its columns, with the hit spans gone from the texts.

    With ``most_hit``, documents with a larger share of hit words go as a whole
    (0: every document with a hit).  A text without hits stays as it is, null
    ones too; ids are not read; long texts and empty tables as in ``scan``.
    """
    names, plain = docs.columns, by_position(docs)
    text = f"c{names.index(text_col)}"
    # the whole row goes through the scan as its key, so that nothing has to be joined back
    rows = plain.select(F.struct(*plain.columns).alias("key"), text_or_empty(text).cast("binary").alias("body"))
    found = _shared(rows, _tables(benchmark, item_col, item_text_col, window, block_bytes))
    if most_hit is not None:
        found = found.where(F.col("n_hit") <= F.col("n_words") * F.lit(most_hit))

    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in parts:
            out = []
            for text, own in zip(texts, spans):
                if len(own):
                    raw, end, left = text.encode(), 0, []
                    for s in own:
                        left.append(raw[end:s["begin"]])
                        end = s["end"]
                    text = b"".join([*left, raw[end:]]).decode()
                out.append(text)
            yield pd.Series(out, dtype=object)

    own = F.col(f"key.{text}")
    left = F.pandas_udf(cut, "string")(own.cast("string"), F.col("spans")).cast(plain.schema[text].dataType)
    return found.select(*(left.alias(c) if c == text else F.col(f"key.{c}").alias(c) for c in plain.columns)).toDF(*names)
