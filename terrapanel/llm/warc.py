"""WARC archives written per record and read back by byte ranges.

Writing: every page is one WARC record in a gzip member of its own; a record
whose payload equals that of a page with a smaller id is a revisit of it.
Equal payloads are found by a grouped minimum over (digest, length), so a
payload that a third of all pages share costs one row per task.

Reading (the splittable reader): archives are cut into byte ranges whatever
their records; a task scans its range for the gzip magic, takes a candidate for
a member only if its head decodes to a WARC header, and owns the records that
start inside its range, reading past the end for the last of them.

Archives are written through ``pyarrow.fs`` into a shared folder under a
temporary name and then renamed; a task that runs again replaces its own file
with the same records.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm.common import materialize
from terrapanel.session import checkpoint_dir

RANGE_BYTES = 4 << 20
#: Reading tasks at most; beyond it a task reads several ranges.
MAX_TASKS = 20_000
CHUNK = 1 << 16
LEVEL = 5
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


def open_fs(uri: str):
    """(file system, path) of a folder or file name as Spark gives it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record; a revisit holds the HTTP head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[:int(fields.get("content-length", "0"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.fullmatch(rf"<{URN}(-?\d+)>", fields.get(name, ""))) else None
    url = fields.get("warc-target-uri")
    if url is not None:
        url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) <= 0x20 or m[1] in ("7F", "25") else m[0], url)
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return {"page_id": number("warc-record-id"), "url": url, "record_type": fields.get("warc-type"), "refers_to": number("warc-refers-to"),
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": payload, "length": int(length[1]) if length else len(payload)}


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   revisit_min_bytes: int = 0, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Write one record per row of ``pages``; returns the manifest (path, bytes, records), one row per archive.

    Of rows with equal payloads of at least ``revisit_min_bytes`` bytes, those
    with the smallest id are responses and the others revisit it; smaller
    payloads are all responses.  A null payload is empty.  A row with a null id
    revisits a page that has an id if it can, and is never revisited.  Rows that
    repeat an id and payload are of one type.  An empty table gives an empty
    manifest; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("n"))
    firsts = materialize(keyed.filter(F.col("n") >= revisit_min_bytes).groupBy("sha", "n")
                         .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
                         .filter("rows > 1 and first is not null").select("sha", "n", "first"), "warc_firsts")
    revisits = materialize(keyed.select("page_id", "sha", "n").join(firsts, ["sha", "n"]).filter("page_id is null or page_id <> first")
                           .select(F.col("page_id").alias("id"), F.col("sha").alias("s"), "first").distinct(), "warc_revisits")
    typed = (keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("s")), "left")
             .select("page_id", "url", "payload", "sha", "first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, n = TaskContext.get(), None, 0
        fs, base = open_fs(folder)
        name = f"part-{task.partitionId():06d}.warc.gz"
        temporary = posixpath.join(base, f"_writing-{name}-{task.taskAttemptId()}")
        for b in batches:
            for page_id, url, body, sha, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(temporary, compression=None)
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page_id, url, body, base32(bytes.fromhex(sha)), first, first is not None, date)
                out.write(press.compress(data) + press.flush())
                n += 1
        if out is None:
            return
        size = out.tell()
        out.close()
        fs.move(temporary, posixpath.join(base, name))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    return materialize(typed.mapInArrow(write, "path string, bytes long, records long"), "warc_manifest")


def member(f, at: int) -> tuple[bytes, int] | None:
    """(record bytes, end) of the gzip member at ``at``, or None if no whole member with a WARC header starts there."""
    press, parts, got, pos = zlib.decompressobj(31), [], 0, at
    while not press.eof:
        raw = f.read_at(CHUNK, pos)
        if not raw:
            return None
        pos += len(raw)
        try:
            data = press.decompress(raw)
        except zlib.error:
            return None
        parts.append(data)
        got += len(data)
        if len(parts) < 3 and got >= 6 and not b"".join(parts).startswith(b"WARC/"):
            return None
    data = b"".join(parts)
    return (data, pos - len(press.unused_data)) if data.startswith(b"WARC/") else None


def records_in_range(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record bytes) of the records that start in [start, end)."""
    pos = start
    while pos < end:
        raw = f.read_at(min(CHUNK, end - pos) + len(MAGIC) - 1, pos)
        hit = raw.find(MAGIC)
        if hit < 0 or pos + hit >= end:
            if len(raw) < len(MAGIC):
                return
            pos += max(1, len(raw) - len(MAGIC) + 1)
            continue
        pos += hit
        found = member(f, pos)
        if found is None:
            pos += 1
            continue
        yield pos, found[0]
        pos = found[1]


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``manifest`` (path, bytes).

    Returns (path, offset, page_id, url, record_type, refers_to, payload_bytes,
    payload_digest[, payload]).  Length and digest are those of the full payload:
    computed from a response's payload, and as recorded in a revisit, which has
    none.  Bytes that are no whole member with a WARC header are skipped.
    """
    ranges = (manifest.filter("bytes > 0")
              .select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
              .select("path", "start", F.least("bytes", F.col("start") + range_bytes).alias("end")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    rows, held = [], 0
                    for at, data in records_in_range(f, start, end):
                        r = parse(data)
                        whole = r["record_type"] == "response"
                        digest = base32(hashlib.sha1(r["payload"]).digest()) if whole else r["digest"]
                        rows.append((path, at, r["page_id"], r["url"], r["record_type"], r["refers_to"], len(r["payload"]) if whole else r["length"], digest,
                                     *([r["payload"] if whole else None] if with_payload else [])))
                        held += len(data) if with_payload else 64
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["path", "offset", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][:8 + with_payload]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    # one task a range, up to MAX_TASKS: a number given is not coalesced, however small the table of ranges is
    tasks = max(1, min(ranges.count(), MAX_TASKS))
    return (ranges.repartition(tasks)
            .mapInArrow(read, "path string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
                        + ", payload binary" * with_payload))
