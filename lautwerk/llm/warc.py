"""WARC archives: written from pages, one gzip member a record, and read back by byte ranges.

Writing: payloads are known by their SHA-1 (and a second hash); of equal ones
the page with the smallest id is a response, the others are revisits that name
it and keep only the HTTP head.  Digests that hold more than a thousandth of
the pages, so at most a thousand, are joined by broadcast, the rest by
shuffle.  Each task writes one archive under the name of its attempt and
renames it, so a task that runs again leaves the same file.

Reading: a task owns a byte range of an archive.  It looks for the magic of
gzip, takes a candidate for a member only if it decodes to the head of a WARC
record, and reads each record that starts inside its range to its end, wherever
that lies.  Ranges need no index and don't depend on one another.

Defined cases: a null page is an empty payload, a null url leaves its header
out, control characters and spaces of a url are percent-encoded; a null id
writes an empty name and comes back as null, and revisits a page that has one;
repeated ids with equal payloads are all responses where theirs is the smallest
id; a null in any column and columns besides those named change nothing else; an
empty table writes no archive and gives no rows; payloads of any length are
read to their end; members that are cut off, damaged, or not WARC are left out,
and the search goes on behind their first byte.  An archive that lies raw inside
another's payload can be taken for records only where a range starts in it.
Paths are opened by ``pyarrow.fs``: local and shared mounts, HDFS, object stores.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lautwerk.llm.common import Scratch

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range; bytes read at once; bytes decoded at once; a payload of at least so many bytes may be a revisit.
RANGE, CHUNK, STEP, LEAST = 32 << 20, 1 << 20, 1 << 14, 0
#: Tasks of a read, at most; each then takes several ranges.
TASKS = 100_000
#: Digests that more than this share of the pages hold are joined by broadcast.
HOT = 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(chr(c) for c in range(33, 127))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(where: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(where if "://" in where else re.sub("^file:/*", "/", where))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode()) + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def referred(pages: DataFrame, least_bytes: int = LEAST) -> DataFrame:
    """``page_id, url, payload, refers_to``: the response's id for each page whose payload a smaller id holds too."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"h1": F.sha1("payload"), "h2": F.xxhash64("payload")})
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("h1", "h2").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and least is not null")
    total = pages.count()
    hot = groups.where(F.col("n") * HOT > total).select("h1", "h2", F.col("least").alias("of_hot"), F.lit(True).alias("is_hot"))
    rare = groups.where(F.col("n") * HOT <= total).select("h1", "h2", "least")
    rows = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    # rows of hot digests have their answer: they keep clear of the shuffled key
    own = F.when(F.col("is_hot"), F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.uuid()))).otherwise(F.col("h1"))
    rows = rows.withColumn("h1", own).join(rare, ["h1", "h2"], "left").withColumn("first", F.coalesce("of_hot", "least"))
    refers = F.when(F.col("page_id").isNull() | (F.col("first") < F.col("page_id")), F.col("first"))
    return rows.select("page_id", "url", "payload", refers.alias("refers_to"))


def written(rows: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Archives of ``rows`` (see ``referred``) in a shared folder, one a task: ``path, length, records``; written when the frame is."""

    def kernel(batches):
        context = TaskContext.get()
        fs, base = opened(folder)
        name = f"{base}/archive-{context.partitionId():06d}"
        part, out, n = f"{name}.{context.taskAttemptId()}.part", None, 0
        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for k in range(batch.num_rows):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(part)
                page_id, url, payload, refers = (c[k].as_py() for c in columns)
                out.write(record(page_id, url, payload, refers, date))
                n += 1
        if out is not None:
            length = out.tell()
            out.close()
            fs.move(part, f"{name}.warc.gz")
            where = f"{folder}/archive-{context.partitionId():06d}.warc.gz"
            yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([length], pa.int64()), pa.array([n], pa.int64())], ["path", "length", "records"])

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(kernel, "path string, length long, records long")


def archives(spark: SparkSession, folder: str, pattern: str = "*.warc.gz") -> DataFrame:
    """``path, length`` of the archives of a folder, listed by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def member(read, size: int, at: int, data: bytes = b"") -> tuple[dict, bytes, int] | None:
    """Headers, block and end of the record whose gzip member starts at ``at``; None if none does.

    read(length, offset) gives bytes; data: what is known from ``at`` on.
    """
    decoder, out, k, head = zlib.decompressobj(31), bytearray(), 0, None
    try:
        while not decoder.eof:
            piece = data[k : k + STEP]
            if not piece:
                if at + k >= size:
                    return None  # cut off
                piece = read(STEP, at + k)
            k += len(piece)
            out += decoder.decompress(piece)
            if head is None:
                if not out.startswith(b"WARC/"[: len(out)]):
                    return None
                end = out.find(b"\r\n\r\n")
                if end >= 0:
                    lines = bytes(out[:end]).decode("utf-8", "replace").split("\r\n")[1:]
                    head = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines)}
                    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
                        return None
    except zlib.error:
        return None
    if head is None:
        return None
    start = out.find(b"\r\n\r\n") + 4
    block = bytes(out[start : start + int(head["content-length"])])
    return (head, block, at + k - len(decoder.unused_data)) if len(block) == int(head["content-length"]) else None


def records(read, size: int, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, block) of the records that start in start..end of a file."""
    at, base, data = start, start, b""
    while at < min(end, size):
        if at < base or at + len(MAGIC) > base + len(data):
            base, data = at, read(min(chunk, size - at), at)
            if len(data) < len(MAGIC):
                return
        k = data.find(MAGIC, at - base)
        if k < 0:
            at = base + len(data) - len(MAGIC) + 1
            continue
        at = base + k
        if at >= end:
            return
        # a copy of a few steps; what lies behind is read
        found = member(read, size, at, data[k : k + 4 * STEP])
        if found is None:
            at += 1
        else:
            head, block, after = found
            yield at, after - at, head, block
            at = after


SCHEMA = "archive string, offset long, length long, record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string"


def read(files: DataFrame, payloads: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """Records of ``files(path, length)``, a row each (SCHEMA, and the payload if wanted), in tasks of a byte range.

    Length and digest of a response are those of the payload as it was read;
    those of a revisit are what its headers say of the payload it stands for.
    """
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", begins.alias("start"))
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *[(c, pa.string()) for c in ("record_id", "record_type", "refers_to", "target_uri")], ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payloads)

    def rows(path, size, start):
        fs, where = opened(path)
        with fs.open_input_file(where) as f:
            for offset, length, head, block in records(lambda n, o: f.read_at(n, o), size, start, start + range_bytes):
                payload, digest, kind = block, head.get("warc-payload-digest", "").removeprefix("sha1:"), head["warc-type"]
                n = len(block)
                if head.get("content-type", "").startswith("application/http"):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
                    n = int(said[1]) if kind == "revisit" and said else len(payload)
                if kind != "revisit":
                    digest = digest_of(payload)
                yield (path, offset, length, head.get("warc-record-id"), kind, head.get("warc-refers-to"), head.get("warc-target-uri"), n, digest, *[payload] * payloads)

    def kernel(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held, weight = [], 0
                for row in rows(path, size, start):
                    held.append(row)
                    weight += 200 + (len(row[-1]) if payloads else 0)
                    if weight > 8 * CHUNK:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)

    # a task for each range, up to as many as a driver plans with ease
    tasks = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0]
    return ranges.repartition(max(1, min(int(tasks or 0), TASKS))).mapInArrow(kernel, SCHEMA + ", payload binary" * payloads)


def round_trip(pages: DataFrame, least_bytes: int = LEAST, range_bytes: int = RANGE) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from archives of the pages, which are removed again."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    files = scratch.keep(written(referred(pages, least_bytes), f"{scratch.base}/archives"), "files")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    out = read(files, range_bytes=range_bytes).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
    out = scratch.keep(out, "result")
    scratch.drop(files)
    scratch.remove("archives")
    return out


SUMMARY_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY n, h) AS least FROM d),
x AS (SELECT *, n >= {LEAST} AND least IS NOT NULL AND (page_id IS NULL OR least < page_id) AS again FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((((strpos('0123456789abcdef', substr(h || '0', 1 + CAST(i * 5 // 4 AS INT), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h || '0', 2 + CAST(i * 5 // 4 AS INT), 1)) - 1)
      >> CAST(3 - i * 5 % 4 AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to
FROM x
"""
