"""WARC archives: writing with revisit records, and a reader that salvages damaged ones.

Archives are gzip members, one per record, in files of bounded size. A task writes files under a
name of its own and returns their names; only those are read, so that a repeated task leaves no
second copy in the result.

The reader checks each member (gzip, version line, Content-Length, digests). Where a check
fails it searches the next gzip magic number or version line that starts a valid record, goes on
there, and reports the bytes between as a quarantined gap. A member is inflated in slices and never
beyond the length that its own header declares, so that a pass over an archive is linear in its bytes.

WARC-Block-Digest is taken over the block, WARC-Payload-Digest over the payload: for HTTP messages
the body behind their head. A digest by an unknown algorithm, of one segment among several, or of a
chunked body is not checked. A revisit has no payload of its own; its digest and length stand in its
header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsense.llm.tables import read
from airsense.llm.text import batches_of
from airsense.sources.stored import new_path, store

#: Bytes after which a task begins the next archive.
ARCHIVE = 16 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
START = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
#: Bytes that a member is inflated by, and the longest header of a record.
SLICE, HEADER = 1 << 16, 1 << 20
#: Algorithms of digests that are checked.
ALGORITHMS = ("md5", "sha1", "sha256", "sha512")
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def file_system(path: str):
    """The file system and path that executors write archives to."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, sha: str, size: int, kind: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; ``date`` is the time of its capture."""
    target = re.sub(r"[\r\n]+", " ", url or "").encode("utf-8", "replace").decode("utf-8")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"Content-Length: {len(payload)}", "", ""]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode()) + press.compress(payload + b"\r\n\r\n") + press.flush()


def writer(folder: str, date: str):
    """Writes rows (page_id, url, html, sha, size, kind, refers_to); returns (path, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, size, records, name = None, 0, 0, ""
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, records = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                payload = b"" if row["kind"] == "revisit" else (row["html"] or "").encode()
                member = record(row["page_id"], row["url"], payload, row["sha"], row["size"], row["kind"], row["refers_to"], date)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= ARCHIVE:
                    out.close()
                    done.append((f"{folder}/{name}", records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return write


def agrees(stated: str, data: bytes) -> bool:
    """Whether a labelled digest, in base32 or hexadecimal, is that of ``data``; true if it can't be told."""
    algorithm, _, value = stated.partition(":")
    if algorithm.lower() not in ALGORITHMS:
        return True
    own = hashlib.new(algorithm.lower(), data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def header(data: bytes, at: int = 0) -> tuple[dict, int, int] | None:
    """Fields of the record at ``at``, and where its block begins and ends; None if that can't be read."""
    cut = data.find(b"\r\n\r\n", at, at + HEADER)
    if not data.startswith(VERSION, at) or cut < 0:
        return None
    head = {}
    for line in data[at:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            return None
        head[key.strip().lower()] = value.strip()
    size = head.get("content-length", "")
    return (head, cut + 4, cut + 4 + int(size)) if re.fullmatch("[0-9]{1,18}", size) else None


def parse(data: bytes, at: int = 0) -> dict | None:
    """The record that begins at ``at``, or None if a check fails."""
    known = header(data, at)
    if known is None:
        return None
    head, begin, end = known
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = payload = bytes(data[begin:end])
    if not agrees(head.get("warc-block-digest", ""), block):
        return None
    kind = head.get("warc-type", "")
    sure = kind != "revisit" and "warc-segment-number" not in head
    if head.get("content-type", "").lower().startswith("application/http"):
        top, blank, payload = block.partition(b"\r\n\r\n")
        sure &= bool(blank) and not re.search(rb"(?im)^transfer-encoding:.*chunked", top)
    sha = head.get("warc-payload-digest", "")
    if sure and not agrees(sha, payload):
        return None
    page = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-record-id", ""))
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-refers-to", ""))
    length = head.get("x-payload-length", "")
    return {
        "page_id": int(page[1]) if page else None, "payload_bytes": int(length) if kind == "revisit" and length.isdigit() else len(payload),
        "payload_digest": sha.partition(":")[2] or digest(payload), "record_type": kind, "refers_to": int(refers[1]) if refers else None,
        "url": head.get("warc-target-uri"), "payload": payload, "end": end + 4,
    }


def inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``; None if it is damaged, does not begin with a
    version line, or is longer than its header says."""
    unzip, parts, piece, size, most = zlib.decompressobj(31), [], b"", 0, None
    view, start = memoryview(data), at
    try:
        while not unzip.eof:
            if start >= len(data) and len(piece) < SLICE:
                return None
            piece = unzip.decompress(view[start : start + SLICE], SLICE)
            # at the end of a member the rest is unused_data, whatever unconsumed_tail still holds
            start += min(SLICE, len(data) - start) - len(unzip.unused_data if unzip.eof else unzip.unconsumed_tail)
            parts.append(piece)
            size += len(piece)
            if most is None and size:
                content = b"".join(parts)
                parts = [content]
                if not (content.startswith(VERSION) or VERSION.startswith(content)):
                    return None
                known = header(content)
                if known is None and size > HEADER:
                    return None
                most = known and known[2] + 4
            if most is not None and size > most:
                return None
    except zlib.error:
        return None
    return b"".join(parts), start


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | None]]:
    """("record", start, end, fields) and ("gap", start, end, None) that cover all of ``data``."""
    at = gap = 0
    while at < len(data):
        found, end = None, at
        if data.startswith(MAGIC, at):
            member = inflate(data, at)
            found = member and parse(member[0])
            if found:
                found, end = (found, member[1]) if found["end"] == len(member[0]) else (None, at)
        elif data.startswith(VERSION, at):
            found = parse(data, at)
            end = found["end"] if found else at
        if found:
            if gap < at:
                yield "gap", gap, at, None
            yield "record", at, end, found
            at = gap = end
            continue
        after = START.search(data, at + 1)
        at = after.start() if after else len(data)
    if gap < len(data):
        yield "gap", gap, len(data), None


READ = "path string, kind string, start long, end long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
READ_ARROW = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
])


def salvager(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for kind, start, end, f in salvage(data.as_buffer().to_pybytes()):
                    f = f or {}
                    payload = f.get("payload") if with_payload else None
                    rows.append((path, kind, start, end, f.get("page_id"), f.get("payload_bytes"), f.get("payload_digest"), f.get("record_type"), f.get("refers_to"), f.get("url"), payload))
                    size += len(payload or b"")
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, g.type) for x, g in zip(zip(*rows, strict=True), READ_ARROW, strict=True)], schema=READ_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, g.type) for x, g in zip(zip(*rows, strict=True), READ_ARROW, strict=True)], schema=READ_ARROW)

    return run


def read_archives(spark: SparkSession, paths: str | list[str], with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``kind``) of archives. One archive is read by one task.

    A batch holds the archives of one scan partition at most, that is one archive or
    ``spark.sql.files.maxPartitionBytes`` of smaller ones."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(salvager(with_payload), READ)


def base32_sha1(data):
    """Bare upper-case base32 of the SHA-1: four digits for each five hexadecimal ones."""
    hexa = F.sha1(data)
    out = []
    for k in range(0, 40, 5):
        number = F.conv(F.substring(hexa, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(DIGITS), F.shiftright(number, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with digest, size and record type: of equal payloads of ``least_bytes`` and more, the
    largest page_id is the response. A null html is an empty payload. Ids must be unique."""
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", base32_sha1(data).alias("sha"), F.octet_length(data).cast("long").alias("size"))
    first = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("response")).withColumnRenamed("size", "of")
    joined = rows.join(first, (rows.sha == first.sha) & (rows["size"] == first["of"]), "left").drop(first.sha, first["of"])
    revisit = F.col("response") != F.col("page_id")
    return joined.select(
        "page_id", "url", F.when(~F.coalesce(revisit, F.lit(False)), F.col("html")).alias("html"), "sha", "size",
        F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("response")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page below ``folder``, dated now; returns the stored list of archives."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    with batches_of(pages.sparkSession, 500):
        return store(planned(pages, least_bytes).mapInArrow(writer(folder, date), "path string, records long"), "warc-files")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, as the archives say."""
    files = write_archives(read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    paths = [r.path for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    rows = read_archives(spark, paths, with_payload=False).where("kind = 'record'")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
h AS (SELECT page_id, octet_length(data)::BIGINT AS payload_bytes, sha1(data) AS hexa FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
 substr('{DIGITS}', ((('0x' || substr(hexa, (k // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), '') AS payload_digest FROM h),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN response <> page_id THEN response END AS refers_to FROM r
"""
