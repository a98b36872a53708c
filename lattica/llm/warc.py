"""WARC archives: writing captures as request, response and metadata records, and assembling them again.

Writing builds each record in built-in functions and uses Spark's text sink with the record end (two line ends) as line
separator, so files appear by Spark's own commit, wherever Spark can write. Reading streams the archives and walks the
records by their Content-Length. Records of one capture are joined through WARC-Concurrent-To: request and metadata name the
response or revisit record; revisits then take their payload's size from the response that they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_path, table

END = "\r\n\r\n"
#: Captures in a file at most, so that reading has tasks enough.
FILE_RECORDS = 1500
#: RFC 4648 digits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes: 32 digits, four for every five hexadecimal ones."""
    hexed = F.sha1(data)

    def part(i):
        n = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        digits = [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*digits)

    return F.concat(*[part(i) for i in range(8)])


def _record(kind: str, record: Column, url: Column, date: Column, mime: str, block: Column, *more: tuple[str, Column]) -> Column:
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind))]
    for name, value in (("WARC-Record-ID", record), ("WARC-Target-URI", url), ("WARC-Date", date), *more, ("Content-Type", F.lit(mime)), ("Content-Length", F.octet_length(block).cast("string"))):
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_captures(captures: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", dedup_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_records: int = FILE_RECORDS, compression: str = "gzip") -> None:
    """Writes three records for each row of captures under path, each file compressed as a whole ("none": not at all).

    Of rows with equal payloads of at least dedup_bytes bytes, the one with the least page_id is a response record, all others
    are revisit records without payload. A null payload is empty, a null url an empty one; a row with a null
    page_id is a response. Rows that repeat a page_id are captures of their own; of those with the same payload one is the response.
    Every record has an id of its own, from the row's place in captures: where that can change from one read to the next, write
    captures first. Other columns are ignored.
    """
    own = captures.select(F.col(page_id).cast("long").alias("id"), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " ").alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    own = own.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("nth", F.monotonically_increasing_id())
    # an equal digest is an equal payload; sizes below dedup_bytes take part with no other
    firsts = own.where(F.col("bytes") >= dedup_bytes).groupBy(F.sha1("payload").alias("sha")).agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "nth"))).alias("first"), F.count("*").alias("many")).where("many > 1").select("sha", "first")
    rows = own.withColumn("key", F.sha1("payload")).join(firsts, (F.col("key") == F.col("sha")) & (F.col("bytes") >= dedup_bytes), "left")
    rows = rows.withColumn("again", F.coalesce(F.col("first") < F.struct("id", "nth"), F.lit(False)) & F.col("id").isNotNull())
    # the id of a response that revisits name follows from its page and payload; all others are numbered as well
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    page = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    named = F.coalesce(F.col("first") == F.struct("id", "nth"), F.lit(False))
    key = F.concat_ws(".", page, "digest", F.when(~named, F.col("nth").cast("string")))
    name = lambda kind, key: F.concat(F.lit(f"<urn:{kind}:"), key, F.lit(">"))
    day = F.lit(date)
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    hub = name("capture", key)
    sha = F.concat(F.lit("sha1:"), F.col("digest"))
    response = _record("response", hub, F.col("url"), day, "application/http;msgtype=response", F.concat(http, F.col("payload")), ("WARC-Payload-Digest", sha))
    revisit = _record("revisit", hub, F.col("url"), day, "application/http;msgtype=response", http, ("WARC-Payload-Digest", sha), ("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To", name("capture", F.concat_ws(".", F.col("first.id").cast("string"), "digest"))))
    request = _record("request", name("request", key), F.col("url"), day, "application/http;msgtype=request", F.concat(F.lit("GET "), F.when(F.col("url") == "", "/").otherwise(F.col("url")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)), ("WARC-Concurrent-To", hub))
    metadata = _record("metadata", name("metadata", key), F.col("url"), day, "application/warc-fields", F.concat(F.lit("pageId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")), ("WARC-Concurrent-To", hub))
    records = rows.select(F.explode(F.array(F.when(F.col("again"), revisit).otherwise(response), request, metadata)).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", 3 * file_records).option("compression", compression).text(path)


_FIELDS = "type string, record_id string, concurrent_to string, refers_to string, url string, payload_digest string, page_id long, payload_bytes long, payload string"


def _record_at(data: bytes, at: int, with_payload: bool) -> tuple[dict | None, int]:
    """The record that starts at a byte, and the byte behind it; None and the bytes it needs if data end before (0: unknown)."""
    head_end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/1.", at) and not b"WARC/1.".startswith(data[at:]):
        raise ValueError(f"no WARC record at byte {at}")
    if head_end < 0:
        return None, 0
    fields = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    start = head_end + 4
    stop = start + int(fields[b"content-length"])
    if stop + 4 > len(data):
        return None, stop + 4
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"a record at byte {at} does not end as its length says")
    kind = fields[b"warc-type"].decode()
    out = {"type": kind, "page_id": None, "payload_bytes": None, "payload": None}
    for key, name in (("record_id", b"warc-record-id"), ("concurrent_to", b"warc-concurrent-to"), ("refers_to", b"warc-refers-to"), ("url", b"warc-target-uri"), ("payload_digest", b"warc-payload-digest")):
        value = fields.get(name)
        out[key] = None if value is None else value.decode()
    if kind == "metadata":
        found = re.search(rb"^pageId: (-?\d+)\r$", data[start:stop], re.M)
        out["page_id"] = int(found[1]) if found else None
    elif kind == "response":
        body = data.find(b"\r\n\r\n", start, stop) + 4
        out["payload_bytes"] = stop - body
        digest = "sha1:" + base64.b32encode(hashlib.sha1(memoryview(data)[body:stop]).digest()).decode()
        if digest != out["payload_digest"]:
            raise ValueError(f"the payload of {out['record_id']} does not have its digest")
        if with_payload:
            out["payload"] = data[body:stop].decode()
    return out, stop + 4


def parse_records(pieces: Iterable[bytes], with_payload: bool = True) -> Iterator[dict]:
    """The records of archives that come in pieces, one after the other; a broken record raises ValueError. One record is held at a time."""
    held, size, need = [], 0, 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size < need:
            continue
        data, at, need = b"".join(held), 0, 0
        while at < len(data):
            if data[at : at + 1] in b"\r\n":  # line ends behind a record's own: a stream that is cut at record ends has one more at its end
                at += 1
                continue
            record, upto = _record_at(data, at, with_payload)
            if record is None:
                need = max(0, upto - at)
                break
            yield record
            at = upto
        held, size = [data[at:]], len(data) - at
    if size:
        raise ValueError("the last record is not complete")


def read_records(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under path.

    Compressed archives (.gz, of one member or one for each record) are read as a stream that is cut at record ends and put
    together again, so a task holds a record at a time, whatever the archive's size. Other archives are held as a whole.
    """
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    types = dict(page_id=pa.int64(), payload_bytes=pa.int64())

    def rows(pieces):
        held = []
        for record in parse_records(pieces, with_payload):
            held.append(record)
            if len(held) == (200 if with_payload else 2000):
                yield pa.record_batch([pa.array([r[n] for r in held], types.get(n, pa.string())) for n in names], names=names)
                held = []
        if held:
            yield pa.record_batch([pa.array([r[n] for r in held], types.get(n, pa.string())) for n in names], names=names)

    def streamed(batches):
        end = END.encode()
        yield from rows(x.as_buffer().to_pybytes() + end for batch in batches for x in batch.column("value"))
        settled()

    def whole(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from rows([content.as_buffer().to_pybytes()])
        settled()

    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").option("recursiveFileLookup", "true").load(path).select("content")
    return lines.mapInArrow(streamed, _FIELDS).unionByName(files.mapInArrow(whole, _FIELDS))


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: page_id, url, capture, request, metadata (structs), payload and its size and digest.

    The capture is a response or revisit record; request and metadata are those that are concurrent to it, null if there is none.
    A revisit takes size and payload from the response that it refers to, null if that is missing.
    """
    def part(kind, *more):
        own = records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("hub"))
        return own.agg(F.first(F.struct("record_id", "url")).alias(kind), *(F.first(c).alias(c) for c in more))

    hubs = records.where(F.col("type").isin("response", "revisit")).drop("page_id", "concurrent_to")
    joined = hubs.join(part("request"), F.col("record_id") == F.col("hub"), "left").drop("hub").join(part("metadata", "page_id"), F.col("record_id") == F.col("hub"), "left").drop("hub")
    named = records.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    sources = records.where("type = 'response'").join(named, "record_id", "left_semi").groupBy(F.col("record_id").alias("source"))
    sources = sources.agg(F.first("payload_bytes").alias("source_bytes"), F.first("payload").alias("source_payload"))
    pages = part("metadata", "page_id").select(F.col("hub").alias("source"), F.col("page_id").alias("refers_to_page"))
    out = joined.join(sources.join(pages, "source", "left"), F.col("refers_to") == F.col("source"), "left")
    return out.select(
        "page_id", "url", F.struct("record_id", "type", "refers_to", "refers_to_page").alias("capture"), "request", "metadata",
        F.coalesce("payload_bytes", "source_bytes").alias("payload_bytes"), F.coalesce("payload", "source_payload").alias("payload"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
    )


def round_trip(captures: DataFrame, **options) -> DataFrame:
    """Writes captures as archives in the shared folder and assembles them again, without payloads."""
    spark = captures.sparkSession
    path = shared_path(spark, "warc")
    write_captures(captures, path, **options)
    return assemble(table(read_records(spark, path, with_payload=False), "records"))
