"""WARC archives: exact round trips, one member per record, offsets, revisits and damaged input."""

import base64
import glob
import gzip
import hashlib
import os
import random
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from touchline.llm import warc


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def round_trip(spark, rows, kinds="page_id long, url string, html string", most=warc.ARCHIVE_BYTES, parts=3):
    at = folder()
    df = spark.createDataFrame(rows, kinds).repartition(parts)
    warc.write_archives(warc.as_records(df, "page_id", "url", "html"), f"{at}/streams")
    index = warc.normalise(spark, f"{at}/streams", f"{at}/out", most)
    return at, index


def bodies(seed, n):
    r = random.Random(seed)
    some = [b"", b"\r\n", b"\r\n\r\n", b"\r\n\r\n\r\n\r\n", b"\r\r\n\r\n\n", b"WARC/1.1\r\n\r\n", b"\0" * 2000, b"\xff\xfe\x00bytes"]
    some += [b"".join(r.choice((b"\r", b"\n", b"\r\n", b"\r\n\r\n", b"x", b"\0", b"\xc3")) for _ in range(r.randint(0, 3000))) for _ in range(n)]
    return some


def test_bytes_survive_and_every_record_is_a_member(spark):
    rows = [(i, f"http://h/{i}", b) for i, b in enumerate(bodies(1, 60))]
    at, index = round_trip(spark, rows, "page_id long, url string, html binary", most=20_000)
    got = {warc_row.record_id: warc_row for warc_row in warc.read_archives(spark, f"{at}/out").collect()}
    first = {}
    for i, _, b in reversed(rows):
        kept = first.setdefault(b, i) if len(b) >= 1000 else i
        x = got[f"<urn:key:{i}>"]
        assert x.record_type == ("response" if kept == i else "revisit")
        assert x.payload == (bytearray(b) if kept == i else None)
        assert x.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    places = index.collect()
    assert len(places) == len(rows) and len({p.archive for p in places}) > 3
    for archive in {p.archive for p in places}:
        (path,) = glob.glob(f"{at}/out/archives/archive={archive}/part-*")
        content = open(path, "rb").read()
        mine = sorted((p for p in places if p.archive == archive), key=lambda p: p.at)
        assert [p.at for p in mine] == list(range(len(mine)))
        assert len(gzip.decompress(content)) == sum(p.record_bytes + 4 for p in mine)
        for p, following in zip(mine, [*[p.offset for p in mine[1:]], len(content)]):
            assert p.offset + p.length == following
            record = zlib.decompress(content[p.offset:p.offset + p.length], 31)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and p.record_id.encode() in record


def test_large_records_and_long_archives(spark):
    r = random.Random(2)
    large = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(100_000)) * 60  # 18 MB: the length's last byte is not zero
    rows = [(1, "u", large), (2, "u", "small"), (3, "u", large), (4, "u", "x" * 1000), (5, "u", "x" * 1000), (6, "u", "x" * 999), (7, "u", "x" * 999)]
    at, index = round_trip(spark, rows, parts=1)
    found = warc.payloads_of(warc.read_archives(spark, f"{at}/out")).collect()
    got = {x.record_id: (x.record_type, x.payload_bytes, x.payload_digest, x.refers_to) for x in found}
    for i, _, text in rows:
        n, digest = len(text.encode()), hashlib.sha1(text.encode()).hexdigest()
        other = {1: 3, 4: 5}.get(i)
        assert got[f"<urn:key:{i}>"] == ("revisit" if other else "response", n, digest, f"<urn:key:{other}>" if other else None)
    wanted = index.where("record_id in ('<urn:key:2>', '<urn:key:3>')")
    some = {x.record_id: x.payload.decode() for x in warc.fetch(spark, f"{at}/out", wanted).collect()}
    assert some == {"<urn:key:2>": "small", "<urn:key:3>": large}


def test_hard_rows(spark):
    rows = [(None, "u", "y" * 1200), (1, None, None), (2, "http://a\r\nX: y/é", ""), (3, "u", "y" * 1200), (3, "u", "y" * 1200),
            (2, "u", "y" * 1200), (None, None, None), (9, "u", "z")]
    at, _ = round_trip(spark, [(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, body string")
    read = warc.read_archives(spark, f"{at}/out")
    found = warc.payloads_of(read).select(warc.key_of(F.col("record_id")).cast("long").alias("k"), "record_type", "payload_bytes",
                                          warc.key_of(F.col("refers_to")).cast("long").alias("r")).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, found), key=key) == sorted([
        (None, "revisit", 1200, 3), (1, "response", 0, None), (2, "response", 0, None), (3, "response", 1200, None),
        (3, "response", 1200, None), (2, "revisit", 1200, 3), (None, "response", 0, None), (9, "response", 1, None)], key=key)
    assert "http://a%0D%0AX: y/é" in [x.target_uri for x in read.collect()]


def test_keys_of_other_kinds(spark):
    at, _ = round_trip(spark, [("a b/é>", "u", "t"), ("+", "u", "s")], "page_id string, url string, html string")
    assert sorted(x[0] for x in warc.read_archives(spark, f"{at}/out").select(warc.key_of(F.col("record_id"))).collect()) == ["+", "a b/é>"]


def test_empty_table(spark):
    at, index = round_trip(spark, [])
    assert index.count() == 0


def test_base32(spark):
    digests = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(300)] + ["0" * 40, "f" * 40]
    df = spark.createDataFrame([(d,) for d in digests], "d string").select("d", warc.base32_of(F.col("d")).alias("b"))
    for x in df.select("d", "b", warc.hex_of(F.col("b")).alias("h")).collect():
        assert x.b == base64.b32encode(bytes.fromhex(x.d)).decode() and x.h == x.d


def other_record(kind, body):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\nX-Long: a\r\n  b\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_archives_of_others(spark):
    """A gzip stream made elsewhere, one with members already, and records of other kinds."""
    at = folder()
    os.mkdir(f"{at}/in")
    data = other_record("warcinfo", b"software: x\r\n") + other_record("resource", b"\r\n\r\n<html>") + other_record("metadata", b"")
    open(f"{at}/in/a.warc.gz", "wb").write(gzip.compress(data))
    open(f"{at}/in/b.warc.gz", "wb").write(b"".join(gzip.compress(other_record("resource", b"q" * n)) for n in (5, 50_000)))
    index = warc.normalise(spark, f"{at}/in", f"{at}/out")
    assert sorted((x.archive, x.at, x.record_type) for x in index.collect()) == [
        ("a.warc.gz-00000", 0, "warcinfo"), ("a.warc.gz-00000", 1, "resource"), ("a.warc.gz-00000", 2, "metadata"),
        ("b.warc.gz-00000", 0, "resource"), ("b.warc.gz-00000", 1, "resource")]
    (path,) = glob.glob(f"{at}/out/archives/archive=a.warc.gz-00000/part-*")
    assert gzip.decompress(open(path, "rb").read()) == data
    assert sorted(bytes(x.payload) for x in warc.read_archives(spark, f"{at}/out").collect()) == sorted(
        [b"software: x\r\n", b"\r\n\r\n<html>", b"", b"q" * 5, b"q" * 50_000])


@pytest.mark.parametrize("data", [other_record("resource", b"x" * 90)[:-40], b"HTTP/1.1 200 OK\r\n\r\n", other_record("resource", b"x") + b"more\r\n\r\n"])
def test_damaged_archives_raise(spark, data):
    at = folder()
    os.mkdir(f"{at}/in")
    open(f"{at}/in/a.warc.gz", "wb").write(gzip.compress(data))
    with pytest.raises(Exception, match="a.warc.gz"):
        warc.normalise(spark, f"{at}/in", f"{at}/out")


def test_changed_payload_raises(spark):
    at = folder()
    os.mkdir(f"{at}/in")
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:key:1>\r\nWARC-Payload-Digest: sha1:{'A' * 32}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    open(f"{at}/in/a.warc.gz", "wb").write(gzip.compress(head.encode() + block + b"\r\n\r\n"))
    warc.normalise(spark, f"{at}/in", f"{at}/out")
    with pytest.raises(Exception, match="digest of"):
        warc.payloads_of(warc.read_archives(spark, f"{at}/out")).collect()
