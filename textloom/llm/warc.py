"""WARC archives with an index: write once, read back by byte ranges.

Every page is one gzip member of an archive file, so a record can be read
without what surrounds it. Writing a record yields its index row: file, offset,
length, URL and payload digest. Readers start from the index: the selected
records of a file, in order of their offsets, are joined into ranges where
little lies between them, and a task reads a range with one request.

Of pages with equal payloads the one with the largest id is written in full and
the others as revisits of it. Digests are counted before the shuffle and only
those that occur twice are joined back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import files
from textloom.plans.shared_dir import fresh_path, materialise

FILE_BYTES = 128 << 20  # of an archive file, before it is closed
RANGE_BYTES = 8 << 20  # a range ends beyond this
GAP_BYTES = 64 << 10  # bytes between records that are read rather than skipped
LEAST_PAYLOAD = 0
DATE = "2000-01-01T00:00:00Z"

_NAMES = uuid.UUID("8c5ff0de-1b3b-4c5a-9f0e-3a5f6c1d2e4b")
_INDEX = "file string, offset bigint, length bigint, url string, digest string, record_type string, page_id bigint"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    own = uuid.uuid4() if page_id is None else uuid.uuid5(_NAMES, str(page_id))
    return f"<urn:uuid:{own}>"


def _field(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> tuple[bytes, str]:
    """A response record, or a revisit of the page ``refers_to``, and its payload digest."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """The fields of one record, with its payload if it holds one. Raises on a damaged record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    full = fields["WARC-Type"] == "response"
    if full and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
        "payload": payload if full else None,
    }


def write_archives(pages: DataFrame, folder: str | None = None, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives and return their index.

    The payload is the html in UTF-8, null being empty. Payloads of fewer than
    ``least_payload`` bytes are always written in full. Rows that share the
    largest id of a payload are all responses; a null id can only revisit, and
    pages without any id are all responses. Other columns are ignored. Empty
    in, empty index.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_sha1"))
    keys = keyed.select("page_id", "_sha1", F.octet_length("html").alias("_bytes"))
    copies = keys.where(F.col("_bytes") >= least_payload).groupBy("_sha1").agg(F.max("page_id").alias("_whole"), F.count("*").alias("_n"))
    # few rows, and of known size once written: sent to the tasks if small, else joined, where a hot payload can be split
    copies = materialise(copies.where("_n > 1 AND _whole IS NOT NULL").select("_sha1", "_whole"), "copied-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_whole")), F.col("_whole")).alias("refers_to")
    rows = keyed.join(copies, "_sha1", "left").select("page_id", "url", "html", refers)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at, n = None, "", 0, 0
        for batch in source:
            index = []
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, at, n = files.attempt_path(folder, n, ".warc.gz"), 0, n + 1
                    out = files.create(path)
                data, digest = record(page_id, url, text.encode(), refers_to)
                data = gzip.compress(data, 6, mtime=0)
                out.write(data)
                index.append((path, at, len(data), url, digest, "response" if refers_to is None else "revisit", page_id))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pandas(pd.DataFrame(index, columns=_COLUMNS), schema=_ARROW, preserve_index=False)
        if out is not None:
            out.close()

    return materialise(rows.mapInArrow(work, _INDEX), "warc-index")


_COLUMNS = [c.split()[0] for c in _INDEX.split(", ")]
_ARROW = pa.schema([(c, pa.string() if "string" in kind else pa.int64()) for c, kind in (x.split() for x in _INDEX.split(", "))])


def ranges(index: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges ``file, start, end, records`` that hold the records of ``index``.

    Records of a file lie in one range while the gaps between them are at most
    ``gap`` bytes and the range began less than ``most`` bytes before. A window
    sees one file's records; files are bounded by ``FILE_BYTES``.
    """
    in_file = Window.partitionBy("file").orderBy("offset", "length")
    ends = F.max(F.col("offset") + F.col("length")).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    apart = index.select("file", "offset", "length", F.coalesce((F.col("offset") - ends > gap).cast("int"), F.lit(1)).alias("_new"))
    run = apart.withColumn("_run", F.sum("_new").over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min("offset").over(Window.partitionBy("file", "_run"))
    part = run.withColumn("_part", F.floor((F.col("offset") - first) / most))
    return part.groupBy("file", "_run", "_part").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    )


def read_records(index: DataFrame, with_payload: bool = True, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """The records of (any selection of) an index: ``page_id, payload_bytes, payload_digest, record_type, refers_to``
    and, unless turned off, ``payload`` (null for revisits). Sizes and digests are those of the full payload;
    a response whose payload does not match its digest fails the job."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in batch.to_pylist():
                with files.open_input(r["file"]) as held:
                    held.seek(r["start"])
                    data = held.read(r["end"] - r["start"])
                found = []
                for x in r["records"]:
                    at = x["offset"] - r["start"]
                    own = parse(zlib.decompress(data[at : at + x["length"]], wbits=31))
                    found.append(own if with_payload else own | {"payload": None})
                yield pa.RecordBatch.from_pylist(found, schema=_READ)

    # dealt out by what there is to read; the index itself is small and would be gathered in few tasks
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, total // most)
    spans = ranges(index, gap, most).select("file", "start", "end", "records").repartition(tasks, "file", "start")
    out = spans.mapInArrow(work, _RECORD)
    return out if with_payload else out.drop("payload")


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_READ = pa.schema([(c, _KINDS[kind]) for c, kind in (x.split() for x in _RECORD.split(", "))])

