"""Archives by other writers, damage, and the time and settings of a read."""

import gzip
import time

import pytest

from airsense.llm import warc

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def plain(kind, fields, block):
    head = ["WARC/1.0", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def http(body, sha, *more):
    return plain("response", ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {sha}", *more], HTTP + body)


@pytest.mark.parametrize("packed", [False, True])
def test_usual_response_records(packed):
    body = b"<p>hello</p>"
    good, bad = "sha1:" + warc.digest(body), "sha1:" + warc.digest(b"other")
    block = "sha1:" + warc.digest(HTTP + body)
    records = [
        http(body, good), http(body, bad), http(body, good, f"WARC-Block-Digest: {block}"), http(body, good, f"WARC-Block-Digest: {bad}"),
        http(body, "blake9:abc"), http(body, bad, "WARC-Segment-Number: 1"), plain("warcinfo", ["Content-Type: application/warc-fields"], b"software: x\r\n"),
    ]
    data = b"".join(gzip.compress(r) if packed else r for r in records)
    parts = list(warc.salvage(data))
    assert [p[0] for p in parts] == ["record", "gap", "record", "gap", "record", "record", "record"]
    assert parts[0][3]["payload"] == body and parts[0][3]["payload_bytes"] == len(body) and parts[0][3]["payload_digest"] == warc.digest(body)
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:])) and parts[-1][2] == len(data)


def test_hexadecimal_and_other_algorithms():
    import hashlib

    assert warc.agrees("sha256:" + hashlib.sha256(b"x").hexdigest(), b"x") and not warc.agrees("md5:" + "0" * 32, b"x")
    assert warc.agrees("sha1:" + hashlib.sha1(b"x").hexdigest().upper(), b"x") and warc.agrees("", b"x")


def test_members_longer_than_they_say_and_cut_short():
    whole = gzip.compress(plain("response", [], b"a" * 300_000))
    longer = gzip.compress(plain("response", [], b"a") + b"b" * 5_000_000)
    assert [p[0] for p in warc.salvage(longer + whole + whole[:-9])] == ["gap", "record", "gap"]
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(warc.MAGIC)) == [("gap", 0, 3, None)]


def test_time_grows_with_the_bytes():
    members = b"".join(warc.record(i, "u", b"x%d" % i * 90, warc.digest(b"x%d" % i * 90), 0, "response", None) for i in range(16_000))
    start = time.monotonic()
    assert sum(p[0] == "record" for p in warc.salvage(members)) == 16_000
    assert time.monotonic() - start < 4


def test_settings_and_dates(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = spark.createDataFrame([(1, "u", "a"), (2, None, None)], "page_id long, url string, html string")
    files = [r.path for r in warc.write_archives(pages, f"file:{tmp_path}/w").collect()]
    assert warc.read_archives(spark, files).count() == 2
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    import glob

    assert all(b"\r\nWARC-Date: 20" in gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/*.gz"))


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op2_warc(spark, str(tmp_path)).isEmpty()


def test_long_payloads_between_short_ones():
    bodies = [b"a", b"b" * 300_000, b"c", bytes(range(256)) * 2_000, b"d"]
    data = b"".join(warc.record(i, "u", b, warc.digest(b), 0, "response", None) for i, b in enumerate(bodies))
    parts = list(warc.salvage(data))
    assert [p[3]["payload"] for p in parts] == bodies and all(a[2] == b[1] for a, b in zip(parts, parts[1:])) and parts[-1][2] == len(data)
