"""WARC archives with payload de-duplication, and their records as a table of chunks.

``write_archives`` writes a record for each page into gzip archives (a member for each record) in the shared
folder and returns their index.  Of the pages with equal payloads of at least ``LEAST`` bytes the one with the
largest page_id is a response record, the others are revisit records that refer to it; all others are
responses.  The payload is the html in UTF-8; a null html is empty.  ``read_archives`` reads the archives back as
rows ``(..., chunk, start, size, digest, last, data)``: a payload of any length is streamed in
chunks of ``CHUNK`` bytes, each with the SHA-1 of the payload as far as it goes, and never held whole by the
writer or the reader beyond the row in which it came.

An archive is part of the result only once its task has ended and its index rows are written; what a lost
executor left behind is in no index.  A response whose payload has not the digest of its header, and a record that is cut short, raise.  Defined cases: null page_ids are never a group's response unless all are null, when
all are responses; repeated rows with the group's largest page_id are all responses; an empty table
gives an empty index.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm._shared import Tables, own_columns

LEAST, CHUNK, ARCHIVE_BYTES = 1000, 1 << 16, 1 << 30
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "archive string, offset long, length long, page_id long, type string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = [(k, " ".join(str(v).split())) for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode()


class _Archive:
    """One archive file, written record by record."""

    def __init__(self, root: str) -> None:
        where, path = fs.FileSystem.from_uri(root)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out, self.at = where.open_output_stream(f"{path}/{self.name}", compression=None), 0

    def add(self, fields: list[tuple[str, object]], before: bytes, payload: memoryview) -> int:
        """Write a record; its length in the file."""
        z, start = zlib.compressobj(4, zlib.DEFLATED, 31), self.at
        size = len(before) + len(payload)
        self._put(z.compress(_header([*fields, ("Content-Length", size)]) + before))
        for i in range(0, len(payload), CHUNK):
            self._put(z.compress(payload[i : i + CHUNK]))
        self._put(z.compress(b"\r\n\r\n") + z.flush())
        return self.at - start

    def _put(self, x: bytes) -> None:
        if x:
            self.out.write(x)
            self.at += len(x)


def _write(root: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page, url, digest, top = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                if archive is None or archive.at >= archive_bytes:
                    if archive:
                        archive.out.close()
                    archive = _Archive(root)
                revisit = top is not None and top != page
                held = batch.column(2)[i].as_buffer()
                payload = memoryview(b"" if revisit or held is None else held).cast("B")
                length = memoryview(held).nbytes if held is not None else 0
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page", page)]
                if revisit:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(top, digest))]
                at = archive.at
                rows.append((archive.name, at, archive.add(fields, http, payload), page, fields[0][1]))
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["archive", "offset", "length", "page_id", "type"])
        if archive:
            archive.out.close()

    return run


def write_archives(pages: DataFrame, tables: Tables, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """The folder of the archives, and the index of their records."""
    root = tables.new_path()
    where, path = fs.FileSystem.from_uri(root)
    where.create_dir(path)
    p = own_columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1("html"))
    equal = p.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("k")).where("k > 1").select("digest", "top")
    # null tops leave all responses; only payloads that occur again are in the right side
    decided = p.join(equal, "digest", "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "top")
    return root, tables.keep(decided.mapInArrow(_write(root, archive_bytes), INDEX))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _inflated(stream, length: int) -> Iterator[bytes]:
    z = zlib.decompressobj(31)
    while length > 0:
        raw = stream.read(min(CHUNK, length))
        if not raw:
            raise EOFError("a record ends before its length")
        length -= len(raw)
        while raw:
            x = z.decompress(raw, CHUNK)
            raw = z.unconsumed_tail
            if x:
                yield x
    if x := z.flush():
        yield x


def stream_record(stream, length: int) -> Iterator[tuple[dict[str, str], int, int, int, str, bool, bytes]]:
    """(fields, chunk number, start, size, digest so far, whether last, data) of a record's payload; an empty payload has one empty chunk."""
    held, fields, left, body = b"", None, 0, False
    sha, chunk, start, ready = hashlib.sha1(usedforsecurity=False), 0, 0, None
    for piece in _inflated(stream, length):
        held += piece
        if fields is None:
            cut = held.find(b"\r\n\r\n")
            if cut < 0:
                continue
            fields, held = _fields(held[:cut]), held[cut + 4 :]
            left = int(fields["content-length"])
            body = not fields.get("content-type", "").startswith("application/http")
        if not body:
            cut = held.find(b"\r\n\r\n")
            if cut < 0:
                continue
            held, left, body = held[cut + 4 :], left - cut - 4, True
        while left > 0 and (len(held) >= CHUNK or len(held) >= left):
            data = held[: min(CHUNK, left)]
            held, left = held[len(data) :], left - len(data)
            if ready:
                yield (*ready[:5], False, ready[5])
            sha.update(data)
            ready = (fields, chunk, start, len(data), sha.copy().hexdigest(), data)
            chunk, start = chunk + 1, start + len(data)
    if fields is None or left > 0:
        raise EOFError("a record is cut short")
    ready = ready or (fields, 0, 0, 0, sha.hexdigest(), b"")
    stated = fields.get("warc-payload-digest")
    if stated and fields.get("warc-type") == "response" and stated != f"sha1:{ready[4]}":
        raise ValueError(f"the payload of {fields.get('warc-record-id')} has not the digest that its header states")
    yield (*ready[:5], True, ready[5])


CHUNKS = "archive string, offset long, record_id string, page_id long, type string, refers_to string, payload_digest string, chunk long, start long, size long, digest string, last boolean, data binary"


def _read(root: str, with_data: bool):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(root)
        name, stream, out, held = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if archive != name:
                    if stream:
                        stream.close()
                    name, stream = archive, where.open_input_file(f"{path}/{archive}")
                stream.seek(offset)
                for f, chunk, start, size, digest, last, data in stream_record(stream, length):
                    page = f.get("warc-page")
                    out.append((archive, offset, f["warc-record-id"], int(page) if page else None, f["warc-type"], f.get("warc-refers-to"), f["warc-payload-digest"].removeprefix("sha1:"), chunk, start, size, digest, last, data if with_data else None))
                    held += 200 + size * with_data
                    if held > 4_000_000:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, held = [], 0
        if stream:
            stream.close()
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(root: str, index: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the records in an index.  Stretches of 16 MB of an archive are read by different tasks."""
    spark = index.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("archive", "offset", "length").repartition(parts, "archive", F.shiftright("offset", 24)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read(root, with_data), CHUNKS)


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from archives written and read back."""
    spark: SparkSession = pages.sparkSession
    tables = Tables(spark, "warc")
    root, index = write_archives(pages, tables)
    ends = tables.keep(read_archives(root, index, with_data=False).where("last").select("record_id", "page_id", "type", "refers_to", "payload_digest", (F.col("start") + F.col("size")).alias("bytes"), "digest"))
    where, path = fs.FileSystem.from_uri(root)
    where.delete_dir(path)
    full = ends.where("type = 'response'")
    out = full.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    to = full.groupBy("record_id").agg(F.first("page_id").alias("to"), F.first("bytes").alias("payload_bytes"), F.first("digest").alias("full"))
    again = ends.where("type = 'revisit'").join(to.withColumnRenamed("record_id", "r"), F.col("refers_to") == F.col("r"), "left")
    return out.unionByName(again.select("page_id", "payload_bytes", F.col("full").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to").alias("refers_to")))


#: The same in DuckDB's SQL.
ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
top AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1),
r AS (SELECT p.page_id, n, p.d, top, coalesce(top IS NOT NULL AND top IS DISTINCT FROM page_id, false) AS again FROM p LEFT JOIN top ON p.d = top.d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to
FROM r
"""
