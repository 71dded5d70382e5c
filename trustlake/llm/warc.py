"""WARC archives with an index written first, and coalesced sorted byte-range reads of selected records.

``write_archives`` writes one record per page as a gzip member of its own, so that a record is a byte range. Each task
returns, for every record, file, offset, length, URL and digest; these rows are the index, kept as Parquet. A retried
task writes files under a new name and the index names only what the surviving attempt wrote.

``read_records`` takes any selection of index rows, sorts them by file and offset, joins neighbouring ranges into one
read, and parses the members.

Of records with equal payloads of ``revisit_bytes`` or more, the one with the largest id is the response and the others
are revisits that name it. Defined cases: a null payload is empty; a null URL has no target header; rows that tie at the
largest id of a payload are all responses; a null id is never a response while another row has an id, and its revisit
names the response like any other (rows of a payload without any id are all responses); white space and controls in a
URL are percent-encoded in its header; other columns are ignored; an empty table makes an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.common import column, in_small_batches, materialize, new_folder, qualified, utf8

#: A file is closed at this size; neighbouring ranges join over gaps up to GAP and up to READ bytes.
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string, refers_to long, payload_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str | None, page_id: int | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, str]:
    """A WARC/1.1 record of an HTTP response (or of its revisit, without the payload) and the payload's digest."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", sha


def member(data: bytes) -> bytes:
    """One gzip member; it holds no time stamp, so equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> dict:
    """The named fields and the HTTP body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    own = lambda k: int(v) if (v := fields.get(k, "")[len("<urn:page:") : -1]) else None
    return {"page_id": own("WARC-Record-ID"), "refers_to": own("WARC-Refers-To"), "record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": length, "payload": None if fields["WARC-Type"] == "revisit" else body}


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder in the form Spark writes it; a path without a scheme is the worker's own, so ``qualified`` comes first.

    ``s3a`` and ``s3n``, the names of S3 in Hadoop, are ``s3`` in pyarrow.
    """
    path = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", path))
    if "://" not in path:
        raise ValueError(f"{path} has no scheme")
    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write the archives into ``folder`` and return their index, a written table with the columns of INDEX.

    Ids that are no numbers are null in the index.
    """
    folder = qualified(pages.sparkSession, folder)
    own = pages.select(F.col(id_col).try_cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = own.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    narrow = own.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n"))
    repeated = narrow.filter(F.col("n") >= revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    roles = keyed.join(repeated.select("sha", "first_id"), "sha", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, name, at, rows = None, None, "", 0, []
        names = INDEX.replace(",", "").split()[::2]
        try:
            for batch in batches:
                ids, urls, refs = (column(batch, c).to_pylist() for c in ("page_id", "url", "refers_to"))
                for page_id, url, ref, payload in zip(ids, urls, refs, utf8(batch, "html")):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        if store is None:
                            store, root = filesystem(folder)
                            store.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data, sha = record(url, page_id, payload, ref, ref is not None, date)
                    data = member(data)
                    out.write(data)
                    rows.append((name, at, len(data), url, sha, page_id, "response" if ref is None else "revisit", ref, len(payload)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in ARROW], names)
                rows = []
        finally:
            if out is not None:
                out.close()

    return materialize(in_small_batches(roles).mapInArrow(run, INDEX), "warc-index")


ARROW = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def read_records(index: DataFrame, folder: str, payload: bool = True, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records of the selected index rows, read back from the archives.

    Columns: page_id, url, record_type, refers_to, payload_digest, payload_bytes and, if ``payload``, payload (null for
    a revisit). A response's size and digest are computed from the bytes read; a record that differs from its index
    row fails the read.
    """
    folder = qualified(index.sparkSession, folder)
    wanted = (
        index.select("file", "offset", "length", "payload_digest", F.floor(F.col("offset") / read_bytes).alias("span"))
        .repartition("file", "span")
        .sortWithinPartitions("file", "offset")
    )
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    kept = 7 if payload else 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)

        def fetch(name: str, ranges: list[tuple[int, int, str]]) -> pa.RecordBatch:
            start, end = ranges[0][0], max(o + n for o, n, _ in ranges)
            with store.open_input_file(f"{root}/{name}") as source:
                data = source.read_at(end - start, start)
            rows = []
            for offset, length, sha in ranges:
                r = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                if r["payload"] is not None:
                    r["payload_bytes"], r["payload_digest"] = len(r["payload"]), digest(r["payload"])
                if r["payload_digest"] != sha:
                    raise ValueError(f"{name} at {offset}: the payload is not what the index says")
                rows.append([r[k] for k in names[:kept]])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[:kept])

        name, ranges = None, []
        for batch in batches:
            for f, o, n, sha in zip(*(column(batch, c).to_pylist() for c in ("file", "offset", "length", "payload_digest"))):
                if ranges and (f != name or o - (ranges[-1][0] + ranges[-1][1]) > gap_bytes or o + n - ranges[0][0] > read_bytes):
                    yield fetch(name, ranges)
                    ranges = []
                name = f
                ranges.append((o, n, sha))
        if ranges:
            yield fetch(name, ranges)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payload
    return in_small_batches(wanted).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, payload: bool = False, **options) -> DataFrame:
    """Write all pages and read all of them back."""
    folder = new_folder(spark, "warc")
    return read_records(write_archives(pages, folder, **options), folder, payload)
