"""WARC archives with revisit records for repeated payloads.

Pages are written as response records; the headers are read back and shuffled
by payload digest, which names one response for each payload; each archive is
then written anew, its repeated payloads as revisit records that refer to that
response.  Payloads move only between an archive and its rewritten form, in one
task; the shuffle carries headers.

An archive holds up to ``ARCHIVE_BYTES`` of payload, each record its own gzip
member, so a record can be read by offset and size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm import files
from tillscope.llm.common import fresh_folder, pick, stored, text_or_empty

#: Bytes after which a task starts a new archive, of payloads or of (empty) records, whichever are more.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
HEADER_ROWS = 20_000

# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long"
HEADERS = ("path string, at long, size long, record_type string, record_id string, page_id long, uri string, "
           "payload_digest string, payload_bytes long, refers_to_record string")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    plain = f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(plain, 1, mtime=0)


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def response_record(record_id: str, page_id: int | None, uri: str | None, date: str, payload: bytes,
                    digest: str | None = None) -> bytes:
    return _record([
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest or payload_digest(payload)}"),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response")], _http(len(payload)) + payload)


def revisit_record(record_id: str, page_id: int | None, uri: str | None, date: str, digest: str,
                   refers_to: str, refers_to_uri: str | None, payload_bytes: int) -> bytes:
    return _record([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", REVISIT_PROFILE),
        ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Refers-To-Target-URI", refers_to_uri),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response")], _http(payload_bytes))


def info_record(date: str) -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def parsed(plain: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length does not match its header")
    return fields, rest[:size]


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def records(file) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(offset, size, headers, block)`` of each record of a gzipped archive, read in order."""
    at, buffer = 0, b""
    while True:
        unpack, parts, size = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not buffer:
                buffer = file.read(READ_BYTES)
                if not buffer:
                    if size:
                        raise ValueError("an archive ends inside a record")
                    return
            parts.append(unpack.decompress(buffer))
            size += len(buffer) - len(unpack.unused_data)
            buffer = unpack.unused_data
        yield (at, size, *parsed(b"".join(parts)))
        at += size


def write_archives(pages: DataFrame, date: str, folder: str | None = None, id_col: str = "page_id",
                   uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """One response record per row; returns the manifest ``path, records``.

    Each task writes its rows to archives of its own; the manifest names only
    the archives of tasks that ended well.  Null html is an empty payload, a
    null url or id leaves its header out.
    """
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    rows = pick(pages, page_id=id_col, uri=uri_col, html=html_col).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("uri").cast("string").alias("uri"),
        text_or_empty("html").alias("html"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, stream, n, held, number, done = TaskContext.get(), None, 0, 0, 0, []

        def close():
            stream.close()
            done.append((path, n))

        for batch in batches:
            for page_id, uri, html in zip(batch.column("page_id").to_pylist(), batch.column("uri").to_pylist(),
                                          batch.column("html")):
                if stream is None:
                    path = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    stream, n, held, number = files.create(path), 0, 0, number + 1
                    stream.write(info_record(date))
                payload = html.as_py().encode()
                safe = None if uri is None else quote(uri, safe="%/:=&?~#+!$,;'@()*[]")
                record = response_record(f"urn:uuid:{uuid.uuid4()}", page_id, safe, date, payload)
                stream.write(record)
                n, held = n + 1, held + max(len(record), len(payload))
                if held >= ARCHIVE_BYTES:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()),
                                          pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return stored(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_headers(manifest: DataFrame) -> DataFrame:
    """Headers of all response and revisit records of the archives, with place and payload length.

    ``payload_bytes`` is null for revisits, which hold no payload.
    """
    paths = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    bare = lambda x: x[1:-1] if x else None

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
                 pa.int64(), pa.string()]
        names = [x.split()[0] for x in HEADERS.split(", ")]
        batch_of = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        rows = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.random_access(path) as file:
                    for at, size, fields, block in records(file):
                        if (kind := fields["WARC-Type"]) not in ("response", "revisit"):
                            continue
                        page = fields.get("X-Page-ID")
                        length, digest = None, fields["WARC-Payload-Digest"].partition(":")[2]
                        if kind == "response":
                            payload = payload_of(block)
                            length = len(payload)
                            if payload_digest(payload) != digest:
                                raise ValueError(f"{path}: the payload at {at} does not match its digest")
                        rows.append((path, at, size, kind, bare(fields["WARC-Record-ID"]), page and int(page),
                                     fields.get("WARC-Target-URI"), digest, length, bare(fields.get("WARC-Refers-To"))))
                        if len(rows) >= HEADER_ROWS:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    return paths.mapInArrow(read, HEADERS)


def resolve(headers: DataFrame, min_bytes: int = 0, keep: str = "largest") -> DataFrame:
    """Which records become revisits: ``headers`` with ``target`` (the response that stays) or null.

    Among records of equal digest and length with payloads of ``min_bytes`` or
    more, the one of the largest (or smallest) page id is the response; others
    refer to it.  Records that share that page id, and groups without any page
    id, are all responses.
    """
    best = F.max if keep == "largest" else F.min
    facts = F.struct("page_id", "record_id", "uri")
    # a table of its own, so that the join below can be split where a digest is hot
    winners = stored(headers.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy(
        "payload_digest", "payload_bytes").agg(best(facts).alias("target")), "warc-winners")
    return headers.join(winners, ["payload_digest", "payload_bytes"], "left").withColumn(
        "target", F.when(~F.col("page_id").eqNullSafe(F.col("target.page_id")), F.col("target")))


def rewrite(resolved: DataFrame, date: str, folder: str | None = None) -> DataFrame:
    """Deduplicated archives with fresh headers, one for each source archive; returns their manifest.

    Responses are copied whole under their record id, with a new date; revisits
    hold the header of the reply and no payload.
    """
    folder = folder or fresh_folder(resolved.sparkSession, "warc-deduplicated")

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{key[0].rpartition('/')[2].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:12]}.warc.gz"
        group = group.sort_values("at").astype(object).where(lambda x: x.notna(), None)
        with files.random_access(key[0]) as source, files.create(path) as out:
            out.write(info_record(date))
            for r in group.itertuples():
                page = None if r.page_id is None else int(r.page_id)
                if r.target_record is None:
                    source.seek(int(r.at))
                    _, block = parsed(gzip.decompress(source.read(int(r.size))))
                    out.write(response_record(r.record_id, page, r.uri, date, payload_of(block), r.payload_digest))
                else:
                    out.write(revisit_record(r.record_id, page, r.uri, date, r.payload_digest, r.target_record,
                                             r.target_uri, int(r.payload_bytes)))
        return pd.DataFrame({"path": [path], "records": [len(group)]})

    flat = resolved.select("path", "at", "size", "record_id", "page_id", "uri", "payload_digest", "payload_bytes",
                           F.col("target.record_id").alias("target_record"), F.col("target.uri").alias("target_uri"))
    return stored(flat.groupBy("path").applyInPandas(write, MANIFEST), "warc-manifest")


def with_originals(headers: DataFrame) -> DataFrame:
    """Archive headers with each revisit joined to the response it refers to.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` (the
    response's page id for revisits, else null).
    """
    responses = headers.where("record_type = 'response'")
    originals = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"),
                                 F.col("payload_bytes").alias("original_bytes"))
    revisits = headers.where("record_type = 'revisit'").join(originals, "refers_to_record", "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type",
                            F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type",
                        "refers_to"))


def deduplicate(pages: DataFrame, date: str, min_bytes: int = 0, keep: str = "largest", id_col: str = "page_id",
                uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives, resolve repeated payloads, write deduplicated archives, read those back.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    * payloads are equal if their SHA-1 and their lengths are;
    * null html is an empty payload (compared like any other); null url is
      left out of the record; pages of any length are one record each;
    * a page with a null id becomes a revisit if a page with an id has its
      payload, else it is a response; pages that share the winning id and
      payload are all responses;
    * an empty table gives an empty result; other columns are ignored.
    """
    raw = write_archives(pages, date, id_col=id_col, uri_col=uri_col, html_col=html_col)
    headers = stored(read_headers(raw), "warc-headers")
    clean = rewrite(resolve(headers, min_bytes, keep), date)
    return with_originals(stored(read_headers(clean), "warc-headers"))
