"""Removal of long repeated substrings with merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts at any
other place, in the same or another document.

1.  Every window of ``length`` bytes has an anchor: of the strings of
    ``anchor_bytes`` in it, the one with the least hash, the first of equals.  Equal windows have equal
    anchors at equal places, so the windows can be dealt by anchor.  An anchor
    that occurs once has no repeated window; all others are candidates.
2.  The consecutive windows of one anchor occurrence make a segment.  Equal
    segments are counted, and one copy is kept with the count.
3.  A bucket of anchors is a multi-string text of symbols: a symbol is the name
    of ``SYMBOL`` bytes, the symbol before a suffix is the one ``SYMBOL`` bytes to its
    left.  The bucket's segments form shards; each shard's suffixes are sorted,
    which gives its transform and, from equal neighbours, its own repeats.
    The shards' transforms are merged by refining their interleave: in round
    ``t`` the interleave is in order of the first ``t`` symbols, and the
    symbols that the transforms hold, sorted stably, give the next one.  No
    suffixes are compared or sorted again.  Blocks of one suffix, or of one
    shard, are final and leave.  The blocks left after ``length / SYMBOL``
    rounds share ``length`` bytes across shards: the repeated intervals.
4.  The repeated windows go back to the documents that hold the segments.

Anchors with very many different segments are cut into narrower windows, keyed
by the bytes that the windows share, until no task has a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import by_position, pick, stored, text_or_empty
from tillscope.llm.worker import kept

LENGTH = 400
#: Bytes of a symbol (divides the length, a multiple of 8).
SYMBOL = 40
#: Windows whose anchors are searched at once; bounds memory for long texts.
BLOCK = 1 << 18
#: Segment bytes of a bucket and of a shard; bytes of one anchor's segments from which they are cut again.
BUCKET_BYTES = 1_000_000
SHARD_BYTES = 400_000
HOT_BYTES = 2_000_000
#: Windows of the narrower segments that large groups are cut into, in turn.
NARROW = (16, 1)
FLUSH_ROWS = 50_000
#: Bytes of an anchor's place: its position, its first and its last window.
PLACE_BYTES = 12

_BYTE_HASH = np.random.default_rng(400).integers(1, 2**64, 256, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PLACE = np.uint64((1 << 20) - 1)


def anchor_bytes(length: int) -> int:
    """Bytes of an anchor: the largest power of two up to a third of the length (128 of 400, 64 of 240)."""
    return 1 << (length // 3).bit_length() - 1


def anchors(text: bytes, length: int = LENGTH, anchor: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """``(hash, position, first window, last window)`` arrays of the text's runs of windows with one anchor."""
    anchor = anchor or anchor_bytes(length)
    for at in range(0, len(text) - length + 1, BLOCK):
        yield tuple(x if n == 0 else x + at for n, x in enumerate(
            _anchors(text[at:at + BLOCK + length - 1], length, anchor)))


def _anchors(text: bytes, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    h, size = _BYTE_HASH[np.frombuffer(text, np.uint8)], 1
    while size < anchor:  # hash of twice as many bytes from two hashes
        h = (h[:-size] * _MIX[0]) ^ ((h[size:] >> np.uint64(29)) + h[size:] * _MIX[1])
        size *= 2
    h ^= h >> np.uint64(31)
    h *= _MIX[2]
    h ^= h >> np.uint64(29)
    # least hash, then first place: the place is written into the low bits
    least, size, wide = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1, length - anchor + 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    windows = len(h) - wide + 1
    place = (np.minimum(least[:windows], least[wide - size:wide - size + windows]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[first]].view(np.int64), place[first], first, np.append(first[1:], windows) - 1


def _named(keys: np.ndarray) -> np.ndarray:
    """Names 1, 2, ... of the keys in their order."""
    order = np.argsort(keys)
    ordered = keys[order]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return names


class Collection:
    """Segments as one text with an end mark after each, and the symbols at each place."""

    def __init__(self, segments: list[bytes], symbol: int = SYMBOL):
        sizes = np.array([len(s) for s in segments])
        ends = np.cumsum(sizes + 1) - 1
        self.symbol, self.begins = symbol, ends - sizes
        text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
        self.left_over = np.repeat(ends, sizes + 1) - np.arange(len(text))  # bytes up to the end mark
        self.place = np.arange(len(text)) - np.repeat(self.begins, sizes + 1)
        # names of 8 bytes, then of twice as many until they are a symbol
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        packed = np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(text)]
        names, size, rest = _named(np.ascontiguousarray(packed).view(">u8").ravel()), 8, []
        while True:
            if symbol & size:
                rest.append((size, names))
            if size * 2 > symbol:
                break
            names, size = self._joined(names, names, size), size * 2
        size, names = rest[0]
        for more, other in rest[1:]:
            # joined from the longest down: size bytes, then the next ones
            names, size = self._joined(names, other, size), size + more
        self.names = np.where(self.left_over >= symbol, names, 0)

    def _joined(self, first: np.ndarray, second: np.ndarray, after: int) -> np.ndarray:
        """Names of the pairs ``first`` here and ``second`` ``after`` bytes on."""
        later = np.zeros(len(first), np.int64)
        later[:-after] = second[after:]
        return _named((first << 32) | np.where(self.left_over >= after, later, 0))


def shard_order(text: Collection, places: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's places in order of their suffixes' first ``rounds`` symbols, and the classes of equal ones.

    ``places`` is a range of the text that holds whole segments.
    """
    low, span, total = places[0], text.symbol, len(places)
    own, left = text.names[low:low + total], text.left_over[low:low + total]

    def joined(first, second, symbols):
        later = np.zeros(total, np.int64)
        if (step := symbols * span) < total:
            later[:-step] = second[step:]
        return _named((first << 32) | np.where(left >= step, later, 0))

    names, size, parts = own, 1, []
    while True:
        if rounds & size:
            parts.append((size, names))
        if size * 2 > rounds:
            break
        names, size = joined(names, names, size), size * 2
    size, names = parts[-1]
    for more, other in parts[-2::-1]:
        names, size = joined(names, other, size), size + more
    order = np.argsort(names, kind="stable")
    return places[order], names[order]


def merge_shards(text: Collection, shards: list[np.ndarray], rounds: int) -> np.ndarray:
    """True at each place whose first ``rounds`` symbols start at another place too.

    ``shards`` has the places of each shard, whole segments each.
    """
    total, repeated = len(text.names), np.zeros(len(text.names), bool)
    row_of, place_of, shard_of = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int32)
    enough = rounds * text.symbol
    at = 0
    for n, places in enumerate(shards):
        order, classes = shard_order(text, places, rounds)
        same = (classes[1:] == classes[:-1]) & (text.left_over[order[1:]] >= enough)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        rows = np.arange(at, at + len(order))
        place_of[rows], row_of[order], shard_of[rows] = order, rows, n
        at += len(order)
    # the transforms: the symbol before each row's suffix, and the row of the suffix that begins with it
    before = place_of - text.symbol
    begins = text.place[place_of] < text.symbol
    before[begins] = 0
    transform = np.where(begins, 0, text.names[before])
    previous = np.where(begins, -1, row_of[before])
    rows, block = np.arange(total), np.zeros(total, np.int64)
    for _ in range(rounds):
        symbols = transform[rows]
        going = symbols > 0
        rows, block, symbols = rows[going], block[going], symbols[going]
        if not len(rows):
            return repeated
        # stable sort by symbol: the refined interleave
        order = (np.sort((symbols.astype(np.uint64) << np.uint64(32)) | np.arange(len(rows), dtype=np.uint64))
                 & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows, block, symbols = previous[rows[order]], block[order], symbols[order]
        first = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(rows))
        # rows of a block are in order of their shards
        mixed = shard_of[rows[begin]] != shard_of[rows[end - 1]]
        block = np.cumsum(first) - 1
        keep = mixed[block]
        rows, block = rows[keep], block[keep]
    repeated[place_of[rows]] = True
    return repeated


def repeated_windows(segments: list[bytes], counts: list[int], groups: list, length: int = LENGTH,
                     shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each segment, whether the window that starts at each of its first places is repeated.

    ``groups`` has each segment's anchor.  A segment counted twice or more is
    repeated throughout; one that is alone with its anchor has nothing to merge with.
    """
    found = [np.full(len(s) - length + 1, n > 1) for s, n in zip(segments, counts)]
    _, group, members = np.unique(np.array(groups), return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(members[group] > 1)
    if not len(chosen):
        return found
    texts = [segments[i] for i in chosen]
    text = Collection(texts)
    sizes = np.array([len(s) + 1 for s in texts])
    total = int(sizes.sum())
    wanted = max(2, -(-total // shard_bytes))
    shard = np.minimum((np.cumsum(sizes) - sizes) * wanted // total, wanted - 1)
    cuts = [0, *np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(texts)]
    edges = np.append(text.begins, total)
    shards = [np.arange(edges[a], edges[b]) for a, b in zip(cuts, cuts[1:])]
    repeated = merge_shards(text, shards, length // SYMBOL)
    for i, begin in zip(chosen, text.begins):
        found[i] |= repeated[begin:begin + len(found[i])]
    return found


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def segment_key(anchor: int, left: int, content: bytes) -> bytes:
    """128-bit key of a segment: its anchor, the anchor's place in it, its bytes."""
    return hashlib.blake2b(content, digest_size=16, key=b"%d/%d" % (anchor, left)).digest()


def _narrower(anchor: int, left: int, content: bytes, width: int, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``(anchor, left, begin, content)`` of narrower segments of ``width`` windows.

    The cuts lie at fixed places around the anchor, so equal windows fall into
    equal cuts; the new anchor's hash is made of the bytes that all windows of the cut share.
    """
    windows = len(content) - length + 1
    for cut in range(-left // width, (windows - 1 - left) // width + 1):
        begin, end = max(0, cut * width + left), min(windows - 1, cut * width + width - 1 + left)
        core = content[(cut + 1) * width - 1 + left:cut * width + length + left]
        digest = hashlib.blake2b(core, digest_size=8, key=b"%d/%d" % (anchor, cut)).digest()
        yield int.from_bytes(digest, "little", signed=True), left - begin, begin, content[begin:end + length]


_SEGMENT = "anchor long, seg binary, left int, content binary, n long"


def _segment_batches(rows: Iterable[tuple[tuple[int, int, bytes], int]]) -> Iterator[pa.RecordBatch]:
    """Equal segments counted within the task, in batches; a row is a segment and how often it counts."""
    counts: dict[tuple, int] = {}
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([a for a, _, _ in counts], pa.int64()),
            pa.array([segment_key(*k) for k in counts], pa.binary()),
            pa.array([x for _, x, _ in counts], pa.int32()),
            pa.array([c for _, _, c in counts], pa.binary()),
            pa.array(counts.values(), pa.int64())], ["anchor", "seg", "left", "content", "n"])

    for key, n in rows:
        if key in counts:
            counts[key] += n
        else:
            counts[key] = n
            held += len(key[2]) + 200
        if held >= 48 << 20:
            yield batch()
            counts.clear()
            held = 0
    if counts:
        yield batch()


def _counted(segments: DataFrame) -> DataFrame:
    return segments.groupBy("anchor", "seg", "left", "content").agg(F.sum("n").alias("n"))


def _windows_found(segments: DataFrame, length: int) -> DataFrame:
    """``seg, begins, ends``: runs of repeated windows of the counted segments, bucket by bucket."""
    size = segments.agg(F.sum(F.length("content") + F.lit(1))).first()[0] or 0
    buckets = int(max(1, -(-size // BUCKET_BYTES)))

    def merge(key, group):
        contents = group["content"].tolist()
        found = repeated_windows(contents, group["n"].tolist(), group["anchor"].tolist(), length)
        out = [(seg, *(x.tolist() for x in runs(flags))) for seg, flags in zip(group["seg"], found) if flags.any()]
        return pd.DataFrame(out, columns=["seg", "begins", "ends"])

    dealt = segments.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int"))
    return dealt.select("bucket", "anchor", "seg", "content", "n").groupBy("bucket").applyInPandas(
        merge, "seg binary, begins array<int>, ends array<int>")


def _search(segments: DataFrame, length: int, hot_bytes: int, widths: tuple[int, ...]) -> DataFrame:
    """``_windows_found`` of the segments; anchors with too many bytes of segments are cut again first."""
    segments = stored(segments, "segments")
    if not widths:
        return _windows_found(segments, length)
    heavy = segments.groupBy("anchor").agg(F.sum(F.length("content")).alias("bytes")).where(
        F.col("bytes") > hot_bytes).select("anchor")
    heavy = stored(heavy, "hot-anchors")
    if heavy.isEmpty():
        return _windows_found(segments, length)
    wide = segments.join(heavy, "anchor", "left_anti")
    hot = stored(segments.join(heavy, "anchor"), "hot-segments")
    width = widths[0]

    def cuts(batches):
        for batch in batches:
            yield from zip(batch.column("anchor").to_pylist(), batch.column("left").to_pylist(),
                           batch.column("content").to_pylist(), batch.column("n").to_pylist(),
                           batch.column("seg").to_pylist())

    def narrow(batches):
        for anchor, left, content, n, _ in cuts(batches):
            yield from _segment_batches(((a, x, c), n) for a, x, _, c in _narrower(anchor, left, content, width, length))

    def parts(batches):
        for anchor, left, content, _, seg in cuts(batches):
            own = list(_narrower(anchor, left, content, width, length))
            yield pa.RecordBatch.from_arrays([
                pa.array([segment_key(a, x, c) for a, x, _, c in own], pa.binary()),
                pa.array([seg] * len(own), pa.binary()),
                pa.array([b for _, _, b, _ in own], pa.int32())], ["seg", "parent", "shift"])

    inner = _search(_counted(hot.mapInArrow(narrow, _SEGMENT)), length, hot_bytes, widths[1:])
    moved = inner.join(hot.mapInArrow(parts, "seg binary, parent binary, shift int"), "seg").select(
        F.col("parent").alias("seg"),
        F.transform("begins", lambda x: x + F.col("shift")).alias("begins"),
        F.transform("ends", lambda x: x + F.col("shift")).alias("ends"))
    return _windows_found(wide, length).unionByName(moved)


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
            hot_bytes: int = HOT_BYTES) -> DataFrame:
    """What goes from each document that loses bytes: ``k, n_removed, n_spans, spans, kept``.

    ``k`` is ``row_key`` of the document, ``spans`` the removed byte ranges
    (begin, end), ``kept`` the remaining bytes (``as_text`` makes text of them).
    """
    if length % SYMBOL or length < SYMBOL:
        raise ValueError(f"length is a multiple of {SYMBOL}")
    long_enough = _once(_keyed(docs, id_col, text_col).where(F.octet_length("body") >= length).select("k", "body"))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one row for each anchor of a text, with all of its places
        kept("suffixes")
        for batch in batches:
            keys, copies, names, places, sizes = [], [], [], [], []
            for k, n, text in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist(), batch.column("body")):
                own = [np.concatenate(x) for x in zip(*anchors(text.as_py().encode(), length))]
                order = np.argsort(own[0], kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(own[0][order]) != 0]))
                keys += [k] * len(first)
                copies += [n] * len(first)
                names.append(own[0][order][first])
                sizes.append(np.diff(np.append(first, len(order))))
                places.append(np.stack(own[1:], axis=1).astype("<i4")[order])
            if keys:
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) * PLACE_BYTES
                packed = pa.Array.from_buffers(pa.binary(), len(keys), [
                    None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(places).tobytes())])
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.binary()), pa.array(copies, pa.int64()), pa.array(np.concatenate(names)), packed],
                    ["k", "n", "anchor", "places"])

    placed = stored(long_enough.mapInArrow(find, "k binary, n long, anchor long, places binary"), "anchors")
    # a table of its own, so that the join below can be split where an anchor is hot
    twice = stored(placed.groupBy("anchor").agg(F.sum(F.octet_length("places") * F.col("n")).alias("n")).where(
        F.col("n") > PLACE_BYTES).select("anchor"), "repeated-anchors")
    of_doc = placed.join(twice, "anchor").groupBy("k").agg(
        F.collect_list(F.struct("anchor", "places")).alias("found"))
    touched = stored(long_enough.join(of_doc, "k"), "touched")

    def occurrences(batches):
        for batch in batches:
            for k, n, text, found in zip(*(batch.column(c).to_pylist() for c in ("k", "n")), batch.column("body"),
                                         batch.column("found")):
                body, rows = text.as_py().encode(), found.values
                for anchor, places in zip(*(rows.field(c).to_pylist() for c in ("anchor", "places"))):
                    for pos, low, high in np.frombuffer(places, "<i4").reshape(-1, 3).tolist():
                        yield k, low, (anchor, pos - low, body[low:high + length]), n

    def cut(batches):
        yield from _segment_batches((key, n) for _, _, key, n in occurrences(batches))

    def place(batches):
        rows = []
        names = ["seg", "k", "low"]
        of = lambda r: pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in r], pa.binary()), pa.array([x[1] for x in r], pa.binary()),
            pa.array([x[2] for x in r], pa.int32())], names)
        for k, low, key, _ in occurrences(batches):
            rows.append((segment_key(*key), k, low))
            if len(rows) >= FLUSH_ROWS:
                yield of(rows)
                rows = []
        if rows:
            yield of(rows)

    found = stored(_search(_counted(touched.mapInArrow(cut, _SEGMENT)), length, hot_bytes, NARROW), "repeated")
    ranges = touched.mapInArrow(place, "seg binary, k binary, low int").join(found, "seg").select(
        "k", "low", "begins", "ends")
    of_text = ranges.groupBy("k").agg(F.collect_list(F.struct("low", "begins", "ends")).alias("ranges"))

    def remove(batches):
        for batch in batches:
            rows = []
            for k, text, ranges in zip(batch.column("k").to_pylist(), batch.column("body"), batch.column("ranges")):
                body = np.frombuffer(text.as_py().encode(), np.uint8)
                change = np.zeros(len(body) + 1, np.int64)
                for r in ranges.as_py():
                    np.add.at(change, np.array(r["begins"]) + r["low"], 1)
                    np.add.at(change, np.array(r["ends"]) + (r["low"] + length - 1), -1)
                gone = np.cumsum(change)[:-1] > 0
                begin, end = runs(gone)
                rows.append((k, int(gone.sum()), len(begin), [{"begin": int(a), "end": int(b)} for a, b in zip(begin, end)],
                             body[~gone].tobytes()))
                if sum(len(r[4]) for r in rows[-1:]) > 1 << 20 or len(rows) >= 1000:
                    yield _changes(rows)
                    rows = []
            if rows:
                yield _changes(rows)

    return touched.select("k", "body").join(of_text, "k").mapInArrow(
        remove, "k binary, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept binary")


def _changes(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.int64(),
             pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["k", "n_removed", "n_spans", "spans", "kept"])


def row_key():
    """Key of a row by its id and text (columns ``id`` and ``body``); rows equal in both lose the same bytes."""
    return F.unhex(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("text"), F.col("body"))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("body")).withColumn("k", row_key())


def _once(keyed: DataFrame) -> DataFrame:
    """One row for each ``k`` with the count ``n`` of its rows.

    Only the keys are grouped; texts move only where a key occurs twice or
    more, and each task passes one copy on.
    """
    again = stored(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-rows")
    if again.isEmpty():
        return keyed.withColumn("n", F.lit(1).cast("long"))
    alone = keyed.join(again, "k", "left_anti").withColumn("n", F.lit(1).cast("long"))
    copies = keyed.join(again.select("k"), "k", "left_semi").groupBy("k").agg(F.first("body").alias("body"))
    return stored(alone.select("k", "body", "n").unionByName(copies.join(again, "k")), "distinct-rows")


def as_text(kept: Column) -> Column:
    """Text of remaining bytes; what a cut has left of a character is dropped."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if b is None else bytes(b).decode("utf-8", "ignore") for b in part], dtype=object)

    return F.pandas_udf(run, "string")(kept)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                    hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``docs``, all of its columns, with the repeated bytes gone from the texts.

    Rows stay even if nothing is left of their text; a row that loses nothing is as it was.
    Nulls, short and long texts, ties, repeated rows and empty tables are as in ``remove_repeats``.
    """
    names, plain = docs.columns, by_position(docs)
    at, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    changed = repeats(docs, length, id_col, text_col, hot_bytes).select("k", as_text(F.col("kept")).alias("left"))
    keyed = plain.withColumn("id", F.col(at)).withColumn("body", text_or_empty(text)).withColumn("k", row_key())
    joined = keyed.join(changed, "k", "left").withColumn(text, F.coalesce("left", text))
    return joined.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    * null text counts as empty, and texts under ``length`` bytes lose nothing;
    * rows that repeat a text of ``length`` bytes or more (with the same or
      another id, or a null one) lose all of it, each of them;
    * spans are of bytes and may cut a character; overlapping strings count;
    * texts of any length are taken whole (their anchors are found in blocks);
    * an empty table gives an empty result; other columns are ignored.
    """
    every = _keyed(docs, id_col, text_col).select(
        "id", "k", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("own_sha"))
    changed = repeats(docs, length, id_col, text_col, hot_bytes).select(
        "k", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    return every.join(changed, "k", "left").select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "own_sha").alias("kept_sha256"))
