"""WARC archives: written as one gzip stream each, normalised to a gzip member per record with an index beside them.

`write_archives` is a plain text write: a record is a row, the blank lines that end a record are the line separator, and the
compression makes each file one gzip stream. `normalise` reads such files, or any other *.gz of WARC records, as a stream that
is inflated once and by nobody twice, and gives every record its own gzip member. Members are gathered into archives of
bounded size; index and archives are both written from one stored table. All of it goes through Spark's own readers and
writers, so it works in any store that Spark reaches, and lost tasks are repeated and committed as usual.

Layout of a normalised folder: `archives/archive=<name>/part-*` holds the bytes of one archive (gzip members, whatever the
suffix); `index` is Parquet with a row for each record: archive, at, offset, length and the record's main fields.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import stored

END = "\r\n\r\n"  # ends the head of a record, and the record
RECORDS = 50_000  # records of a file that write_archives writes, at most
ARCHIVE_BYTES = 64 << 20  # of a normalised archive; one longer record is an archive of its own
GIVEN_BYTES = 8 << 20  # of payloads that a reading task gathers before it gives them on
CHUNK = 1 << 14
_NO_BYTES = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)  # a member that holds nothing

FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
          "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_HEX, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of(digest: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal: five digits of one are four of the other."""
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX, _B32)


def hex_of(digest: Column) -> Column:
    """Lower-case hexadecimal of a SHA-1 in base 32."""
    digits = F.translate(digest, _B32, _HEX)
    return F.lower(F.concat(*[F.lpad(F.conv(F.substring(digits, 4 * i + 1, 4), 32, 16), 5, "0") for i in range(8)]))


def id_of(key: Column) -> Column:
    """Record id of a key."""
    return F.coalesce(F.concat(F.lit("<urn:key:"), F.url_encode(key.cast("string")), F.lit(">")), F.lit("<urn:null>"))


def key_of(record_id: Column) -> Column:
    """Key of a record id, as text; null for the id of a null key."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, "^<urn:key:(.*)>$", 1), F.lit("")))


def revisits(df: DataFrame, key: str, payload: str, least: int = 1000) -> DataFrame:
    """(key, digest, refers_to) of the rows whose payload, of `least` bytes or more, another row with a larger key has too.

    `refers_to` is the largest key. Rows that share the largest key, and rows of null keys only, are no revisits.
    """
    body = _bytes(payload)
    sized = stored(df.select(F.col(key).alias("key"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= least))
    largest = sized.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return sized.join(largest, "digest").where(~F.col("key").eqNullSafe(F.col("refers_to"))).select("key", "digest", "refers_to").distinct()


def _bytes(payload: str) -> Column:
    return F.coalesce(F.col(payload).cast("binary"), F.lit(b""))


def as_records(df: DataFrame, key: str, url: str, payload: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column `record`: a WARC record of every row, without the blank lines that end it.

    The payload (text, as UTF-8, or bytes; null: empty) is the body of an HTTP response. Of rows with equal payloads of at
    least `least` bytes the one with the largest key is a `response`, the others are `revisit` records that refer to it and
    hold no payload; smaller ones are all responses. Line ends inside a url are written as %0D and %0A, a null url has no
    header. Repeated rows give repeated records. Only the small table of revisits is joined; Spark broadcasts it if it is
    small enough for that.
    """
    body = _bytes(payload)
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    again = stored(revisits(df, key, payload, least)).select(
        F.col("key").alias("k"), F.col("digest").alias("d"), F.col("refers_to").alias("r"), F.lit(True).alias("again"))
    rows = rows.join(again, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    visit = F.coalesce("again", F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(END))
    block = F.when(visit, http).otherwise(F.concat(http, F.col("body").cast("string")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(visit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), id_of(F.col("key"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of(F.col("digest"))),
        F.when(visit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), id_of(F.col("r")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(END), block).alias("record"))


def write_archives(records: DataFrame, folder: str) -> None:
    """Write the records to a new folder, each file one gzip stream."""
    records.select("record").write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(folder)


def fields_of(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space continues the one before."""
    found, name = {}, None
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            found[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def records_of(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes, int]]:
    """(archive, fields, record's bytes, place of its block) of inflated archives, cut at END and given piece by piece.

    Only the record at hand is held. An archive that ends inside a record, or has something else where a record should begin,
    raises an error that names it.
    """
    end = END.encode()
    archive, held, block, size, looked = None, bytearray(), 0, None, 0
    for name, piece in pieces:
        if name != archive:
            if held.strip():
                raise ValueError(f"{archive} ends inside a record")
            archive, held, size, looked = name, bytearray(), None, 0
        held += piece
        held += end
        while True:
            if size is None:
                spare = len(held) - len(held.lstrip(b"\r\n")) if held[:1] in (b"\r", b"\n") else 0
                del held[:spare]
                at = held.find(end)
                if at < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError(f"{archive} has no record where one should begin: {bytes(held[:40])!r}")
                fields = fields_of(bytes(held[:at]))
                block, size = at + 4, at + 4 + int(fields["content-length"])
            if len(held) < size:
                break
            yield archive, fields, bytes(held[:size]), block
            del held[:size]
            size = None
    if held.strip():
        raise ValueError(f"{archive} ends inside a record")


def member(record: bytes, level: int = 6) -> bytes:
    """The bytes as a gzip member of their own, without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


_ENTRY = "at int, offset long, length long, record_bytes long, " + ", ".join(f"{name} string" for name in FIELDS)
_ENTRY_TYPE = pa.struct([("at", pa.int32()), *[(n, pa.int64()) for n in ("offset", "length", "record_bytes")], *[(n, pa.string()) for n in FIELDS]])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for name, value in zip(batch.column("name"), batch.column("value")):
            yield name.as_py(), value.as_py()


def _normalised(most: int):
    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, number, members, entries, total = None, 0, [], [], 0

        def given() -> pa.RecordBatch:
            if members[-1][-1]:  # the writer ends a file by a zero byte, which has to be the last one of the members
                members.append(_NO_BYTES)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([f"{source}-{number:05d}"]), pa.array([b"".join(members)[:-1]], pa.binary()), pa.array([entries], pa.list_(_ENTRY_TYPE))],
                ["archive", "body", "entries"])
            members.clear()
            entries.clear()
            return batch

        for name, fields, record, _ in records_of(_pieces(batches)):
            packed = member(record + END.encode())
            if members and (name != source or total + len(packed) > most):
                yield given()
                number, total = number + 1, 0
            if name != source:
                source, number, total = name, 0, 0
            entries.append({"at": len(entries), "offset": total, "length": len(packed), "record_bytes": len(record),
                            **{n: fields.get(f) for n, f in FIELDS.items()}})
            members.append(packed)
            total += len(packed)
        if members:
            yield given()

    return normalised


def _streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of a folder as inflated pieces between ENDs, in order, a file within one task."""
    read = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(folder)
    return read.select(F.col("_metadata.file_name").alias("name"), F.col("value").cast("binary").alias("value"))


def normalise(spark: SparkSession, source: str, target: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Rewrite the gzip archives (*.gz) of a folder with a member for each record, and return the index.

    Every archive is inflated once, as a stream; memory holds one record and the members of one new archive of at most `most`
    bytes. The new archive n of a source is named `<source>-n`. Archives that are truncated, or hold something else than WARC
    records, raise an error; empty ones give nothing. Archives whose records already have their own members may be given too.
    """
    held = stored(_streamed(spark, source).mapInArrow(_normalised(most), f"archive string, body binary, entries array<struct<{_ENTRY}>>"))
    held.select("archive", F.inline("entries")).write.parquet(f"{target}/index")
    held.select("archive", F.col("body").cast("string").alias("value")).write.option("lineSep", "\0").partitionBy("archive").text(f"{target}/archives")
    return index_of(spark, target)


def index_of(spark: SparkSession, target: str) -> DataFrame:
    """The index of a normalised folder."""
    return spark.read.schema(f"archive string, {_ENTRY}").parquet(f"{target}/index")


def _archives(spark: SparkSession, target: str) -> DataFrame:
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{target}/archives")
    return read.select(F.url_decode(F.regexp_extract(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")), "/archive=([^/]*)/", 1)).alias("archive"), "content")


def inflated(content: bytes) -> Iterator[bytes]:
    """What every member of a gzip file holds, one after another."""
    view, at = memoryview(content), 0
    while at < len(view):
        stream, out = zlib.decompressobj(31), []
        while not stream.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a member")
            chunk = view[at:at + CHUNK]
            out.append(stream.decompress(chunk))
            at += len(chunk) - len(stream.unused_data)
        yield b"".join(out)


_RECORD = "archive string, " + ", ".join(f"{name} string" for name in FIELDS) + ", payload binary"


def _records(parts: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Records of (archive, inflated member) as batches of bounded size."""
    rows, total = [], 0

    def given() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:-1]], pa.array(columns[-1], pa.binary())],
                                          ["archive", *FIELDS, "payload"])

    for archive, data in parts:
        if not data:
            continue
        head, _, block = data.partition(END.encode())
        fields = fields_of(head)
        payload = block[: int(fields["content-length"])]
        if fields.get("content-type", "").startswith("application/http"):
            payload = payload.partition(END.encode())[2]
        payload = None if fields.get("warc-type") == "revisit" else payload
        rows.append((archive, *[fields.get(f) for f in FIELDS.values()], payload))
        total += len(payload or b"") + 500
        if total >= GIVEN_BYTES:
            yield given()
            total = 0
    if rows:
        yield given()


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """All records of a normalised folder, with their payloads (null for revisits)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _records((name.as_py(), data) for batch in batches for name, content in zip(batch.column("archive"), batch.column("content"))
                            for data in inflated(content.as_buffer()))

    return _archives(spark, target).mapInArrow(read, _RECORD)


def fetch(spark: SparkSession, target: str, wanted: DataFrame) -> DataFrame:
    """Records of some rows of the index, inflating only their members.

    Offsets are gathered per archive, at most as many as it has records, and joined with the archives that hold any.
    """
    places = wanted.select("archive", "offset", "length").distinct().groupBy("archive").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _records(
            (name.as_py(), zlib.decompress(content.as_buffer()[p["offset"]:p["offset"] + p["length"]], 31))
            for batch in batches for name, content, places_ in zip(*[batch.column(c) for c in ("archive", "content", "places")])
            for p in places_.as_py())

    return _archives(spark, target).join(places, "archive").mapInArrow(cut, _RECORD)


def payloads_of(records: DataFrame) -> DataFrame:
    """(record_id, record_type, payload_bytes, payload_digest, refers_to) of records; a revisit's payload is that of what it refers to.

    Digests are computed from what was read, in hexadecimal. A response whose bytes differ from the digest in its header, and a
    revisit whose header differs from the response's bytes or that refers to no response, raise an error.
    """
    stated = hex_of(F.substring("payload_digest", 6, 32))
    rows = stored(records.select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"),
                                 F.sha1("payload").alias("read"), stated.alias("stated")))
    # stored, so that Spark can split a response that very many refer to
    answers = stored(rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("answer")).agg(
        F.first("n").alias("of_n"), F.first("read").alias("of_read")))
    alone = rows.where("record_type <> 'revisit'").select("*", F.lit(None).cast("long").alias("of_n"), F.lit(None).cast("string").alias("of_read"))
    referring = rows.where("record_type = 'revisit'").join(answers, F.col("refers_to") == F.col("answer"), "left").drop("answer")
    joined = alone.unionByName(referring)
    digest = F.coalesce("read", "of_read")
    sure = F.when(digest.isNull() | (digest != F.col("stated")), F.raise_error(F.concat(F.lit("digest of "), "record_id"))).otherwise(digest)
    return joined.select("record_id", "record_type", F.coalesce("n", "of_n").alias("payload_bytes"), sure.alias("payload_digest"), "refers_to")
