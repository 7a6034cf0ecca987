"""WARC archives, index first.

Writing tasks append one gzip member for each record to archives of their own
and emit, for each record, an index row with file, offset, length, URL and payload
digest.  Readers select index rows, sort them by file and offset, merge ranges
that lie close together into single reads and cut the records out of them.

Archives are reached through ``pyarrow.fs`` by URI, so the folder can be any
store that all executors share.  Each attempt of a task writes files of its own
name; the written index only names those of attempts that succeeded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lookup, materialize, new_path, small_batches

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
NEW_FILE_BYTES = 1 << 30
TASK_BYTES, MOST_TASKS = 1 << 24, 20_000  # archive bytes that a reading task gets, unless there are too many tasks
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def build_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; a revisit keeps the HTTP header block but not the payload."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest.hex())}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest.hex())}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


URL_SAFE = "".join(chr(i) for i in range(0x21, 0x7F))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload; ValueError if it isn't one whole record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length doesn't match its header")
    return headers, rest[:n].partition(b"\r\n\r\n")[2]


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads the largest page_id stays.

    ``refers_to`` is null for responses.  Payloads under ``least_bytes`` are all
    responses.  Rows with the kept page_id and the same payload are all
    responses; a null page_id never is the kept one unless all are null.  Only
    digests that occur twice are looked up, hot ones without a shuffle.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    keyed = p.select("page_id", F.sha1("payload").alias("_sha1"), F.octet_length("payload").alias("_n"))
    copies = (
        keyed.where(F.col("_n") >= least_bytes).groupBy("_sha1", "_n")
        .agg(F.max("page_id").alias("_keep"), F.count("*").alias("_c")).where("_c > 1 and _keep is not null")
    )
    copies = materialize(copies, "warc-copies")
    joined = lookup(p.withColumns({"_sha1": F.sha1("payload"), "_n": F.octet_length("payload")}), copies, ["_sha1", "_n"], "_c")
    other = F.col("_keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("_keep")).alias("refers_to"))


def write(marked: DataFrame, folder: str, new_file_bytes: int = NEW_FILE_BYTES) -> DataFrame:
    """Write archives under ``folder``; the index as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= new_file_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    revisit = r["refers_to"] is not None
                    data = gzip.compress(build_record(r["page_id"], r["url"], r["payload"], r["refers_to"], revisit), 6, mtime=0)
                    out.write(data)
                    rows.append((name, at, len(data), r["url"], hashlib.sha1(r["payload"]).hexdigest(), r["page_id"], "revisit" if revisit else "response"))
                    at += len(data)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return materialize(marked.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX), "warc-index")


def read(selected: DataFrame, folder: str, gap: int = 1 << 16, most: int = 1 << 23, payloads: bool = False) -> DataFrame:
    """The records of the selected index rows.

    Rows are dealt and sorted by file and offset, so each task reads runs of
    neighbours: ranges at most ``gap`` bytes apart are read at once, up to
    ``most`` bytes (a longer record alone).  Payloads of responses are checked
    against their digest.
    """
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows, span = [], []
            todo = batch.to_pylist()
            for i, r in enumerate(todo):
                span.append(r)
                nxt = todo[i + 1] if i + 1 < len(todo) else None
                end = r["offset"] + r["length"]
                if nxt is None or nxt["file"] != r["file"] or nxt["offset"] - end > gap or nxt["offset"] + nxt["length"] - span[0]["offset"] > most:
                    rows += _cut(store, f"{root}/{r['file']}", span, payloads)
                    span = []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds, strict=True)], names=[c.split()[0] for c in fields.split(", ")])

    held = selected.agg(F.sum("length")).first()[0] or 0  # by archive bytes: index rows say nothing about the work
    tasks = max(1, min(MOST_TASKS, -(-held // TASK_BYTES)))
    dealt = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, fields)


def _cut(store, path: str, span: list[dict], payloads: bool) -> list[tuple]:
    start, end = span[0]["offset"], max(r["offset"] + r["length"] for r in span)
    with store.open_input_file(path) as f:
        data = f.read_at(end - start, start)
    out = []
    for r in span:
        lo = r["offset"] - start
        headers, payload = parse_record(zlib.decompress(data[lo : lo + r["length"]], 31))
        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = headers["warc-type"]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{path} at {r['offset']}: the payload doesn't match its digest")
        number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
        out.append((number("x-page-id"), headers.get("warc-target-uri"), number("x-payload-length"), digest, kind, number("x-refers-to-page"), *[payload] * payloads))
    return out


def archive(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write all pages as archives in the shared folder and read every record back.

    Null html is an empty payload, a null url leaves out the target URI, repeated
    rows give a record each, other columns are not stored; an empty table gives no
    rows.
    """
    folder = new_path(small_batches(pages).sparkSession, "warc")
    return read(write(mark_revisits(pages, least_bytes), folder), folder)
