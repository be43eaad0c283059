"""WARC archives: a writer with revisit records and a salvage reader.

The writer composes records as strings of exact WARC 1.0 bytes and hands them to Spark's own text
writer, so archives reach any file system Spark can write and are committed like any other output.
Asked to, it leaves torn first attempts of some records before the whole ones, as a crawler that
breaks off and tries again does, so that a round trip meets damage.

The reader checks each record (version line, headers, Content-Length, end mark, payload digest). After
a failed check it searches for the next gzip member or version line at which a record passes all
checks, goes on there, and logs the bytes between as a quarantined gap.

Edge cases: a null payload is empty; a null url is written as `unknown:`; in urls, control characters
and the slash of a version line are escaped; rows that repeat a page_id are records each, and those of the response's id are responses; a
row without page_id is a response unless a row with an id has its payload; an empty table gives no
archives and no rows; of equal payloads, the smallest page_id is the response, and ties of it are all
responses; other columns are ignored. A record lies in one file, which is read as a whole, so a file
must be shorter than 2 GB; gzip members are inflated in parts, in time in proportion to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.tables import new_path, written

#: Bytes of an archive file, about, and bytes of a gzip member that are inflated at once.
FILE_BYTES, CHUNK = 8 << 20, 1 << 20
#: Payload groups up to which the table of first pages is broadcast; beyond, the join shuffles.
BROADCAST_GROUPS = 500_000
#: Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_CONTROL = [c for c in range(32) if c != 9]
VERSION, GZIP_MEMBER, BREAK = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"


def base32_of_hex(digest: Column) -> Column:
    """The base32 of a hex digest of 5 n bytes: each 5 hex digits are 4 characters."""
    name = "_hex"
    spelled = F.expr(
        f"array_join(transform(sequence(0, 31), i -> substr('{BASE32}', 1 + (shiftright("
        f"int(conv(substr({name}, 1 + 5 * (i div 4), 5), 16, 10)), 15 - 5 * (i % 4)) & 31), 1)), '')"
    )
    return spelled


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest and refers_to (null for responses)."""
    named = (
        pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("_hex", F.sha1(F.encode("payload", "UTF-8")))
    )
    groups = written(
        named.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("_hex").alias("_same"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n"),
        "payload-groups",
    )
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    return (
        named.join(groups, F.col("_hex") == F.col("_same"), "left")
        .withColumn("payload_digest", base32_of_hex(F.col("_hex")))
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")))
        .drop("_hex", "_same", "_first")
    )


def escaped_uri(url: Column) -> Column:
    """url without what the reader takes for damage in a header line."""
    safe = F.replace(url, F.lit("WARC/1."), F.lit("WARC%2F1."))
    for c in _CONTROL:
        safe = F.replace(safe, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x08\x0A-\x1F]|WARC/1\."), safe).otherwise(url)


def record_text(date: str = "1970-01-01T00:00:00Z") -> Column:
    """The bytes of a row's record, but for the last line feed, which the text writer adds."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    uri = escaped_uri(F.coalesce("url", F.lit("unknown:")))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(
            revisit,
            F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r"),
    )


def torn(one_in: int) -> Column:
    """Whether a torn attempt precedes the record: of responses about one in so many, by a hash of the page_id.

    A payload that may hold a record of its own is not torn: the reader would take that record for one that survived.
    """
    digest = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return F.col("refers_to").isNull() & ~F.col("payload").contains("WARC/1.") & (F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % one_in == 0)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, torn_one_in: int | None = None) -> None:
    """A WARC record for each of pages(page_id, url, html), in files of about FILE_BYTES under path.

    torn_one_in: of about one response in so many, two thirds stand before the whole record.
    """
    rows = with_revisits(pages, least_bytes)
    record = record_text()
    if torn_one_in:
        record = F.when(torn(torn_one_in), F.concat(F.left(record, (F.length(record) * 2 / 3).cast("int")), record)).otherwise(record)
    mean = pages.select(F.avg(F.octet_length("html")).alias("m")).first()["m"] or 0.0
    rows.select(record.alias("value")).write.option("lineSep", "\n").option(
        "maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 600)))
    ).text(path)


class Damage(Exception):
    """A check that a record failed."""


@dataclass
class Record:
    offset: int
    length: int
    kind: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        if not line:
            continue
        name, colon, value = line.partition(b":")
        # What a cut record runs into is no header: other bytes, or the next version line.
        if not colon or VERSION in line or min(line.replace(b"\t", b" ")) < 32:
            raise Damage("header line")
        try:
            out[name.decode().strip().lower()] = value.decode().strip()
        except UnicodeDecodeError:
            raise Damage("header line") from None
    return out


def _record(data: bytes, at: int) -> Record:
    """The record at `at`, or Damage."""
    if not data.startswith(VERSION, at):
        raise Damage("no version line")
    line = data.find(b"\r\n", at, at + 16)
    stop = data.find(BREAK, at)
    if line < 0 or stop < 0:
        raise Damage("headers without end")
    headers = _headers(data[line + 2 : stop])
    size = headers.get("content-length", "")
    if not size.isdigit() or "warc-type" not in headers:
        raise Damage("required header")
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end : end + 4] != BREAK:
        raise Damage("block without end mark")
    block, http = data[begin:end], {}
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        cut = block.find(BREAK)
        if cut < 0:
            raise Damage("http headers without end")
        http, payload = _headers(block[:cut].partition(b"\r\n")[2]), block[cut + 4 :]
    kind = headers["warc-type"].lower()
    method, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind != "revisit" and method == "sha1" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise Damage("payload digest")
    return Record(at, end + 4 - at, kind, headers, http, payload)


def _unit(data: bytes, at: int) -> tuple[list[Record], int]:
    """The records of the gzip member or the plain record at `at`, and where the next unit begins."""
    if data.startswith(GZIP_MEMBER, at):
        member, view, end, parts = zlib.decompressobj(31), memoryview(data), at, []
        try:
            while end < len(data) and not member.eof:
                fed = view[end : end + CHUNK]
                end += len(fed)
                parts.append(member.decompress(fed))
        except zlib.error as e:
            raise Damage(f"gzip member: {e}") from None
        if not member.eof:
            raise Damage("gzip member without end")
        end -= len(member.unused_data)
        plain = b"".join(parts)
        records, inner = [], 0
        while inner < len(plain):
            records.append(_record(plain, inner))
            inner += records[-1].length
        for r in records:
            r.offset, r.length = at, end - at
        return records, end
    record = _record(data, at)
    return [record], at + record.length


def _candidates(data: bytes, at: int) -> Iterator[int]:
    """Places from `at` on where a gzip member or a version line begins, in order."""
    member, line = data.find(GZIP_MEMBER, at), data.find(VERSION, at)
    while member >= 0 or line >= 0:
        if member >= 0 and (line < 0 or member < line):
            yield member
            member = data.find(GZIP_MEMBER, member + 1)
        else:
            # A cut record may end anywhere, so a version line need not follow a line end.
            yield line
            line = data.find(VERSION, line + 1)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of an archive, plain or in gzip members, in order."""
    at = 0
    while at < len(data):
        try:
            records, end = _unit(data, at)
        except Damage as e:
            reason, found = str(e), None
            for spot in _candidates(data, at + 1):
                try:
                    found = _unit(data, spot)
                except Damage:
                    continue
                break
            yield Gap(at, (spot if found else len(data)) - at, reason)
            if not found:
                return
            records, end = found
        yield from records
        at = end


_READ = (
    "path string, offset long, length long, record_type string, record_id string, refers_to string, uri string,"
    " payload_digest string, payload_bytes long, payload binary, gap string, gaps long"
)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record and, with `gap` set to the reason, for each quarantined stretch of bytes.

    gaps: of a record, the quarantined stretches since the record before it; of a stretch, 1 if no record follows
    it in its file and 0 otherwise.
    """

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, gaps = [], []
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        gaps.append((where, x.offset, x.length, None, None, None, None, None, None, None, x.reason))
                        continue
                    rows += [(*g, 0) for g in gaps]
                    size = x.http.get("content-length", "") if x.kind == "revisit" else str(len(x.payload))
                    ident = lambda k, h=x.headers: h[k].strip("<>") if k in h else None
                    rows.append(
                        (
                            where, x.offset, x.length, x.kind, ident("warc-record-id"), ident("warc-refers-to"), x.headers.get("warc-target-uri"),
                            x.headers.get("warc-payload-digest", "").rpartition(":")[2] or base64.b32encode(hashlib.sha1(x.payload).digest()).decode(),
                            int(size) if size.isdigit() else None, x.payload if with_payload and x.kind != "revisit" else None, None, len(gaps),
                        )
                    )
                    gaps = []
                rows += [(*g, 1) for g in gaps]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _READ)


_SCHEMA = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _READ.split(","))]
)
_NAMES = _SCHEMA.names


def round_trip(pages: DataFrame, torn_one_in: int | None = None) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: what the archives say of each.

    gaps: quarantined stretches that precede the record, none unless torn_one_in asks for damage: then a response may
    have its torn attempt before it. A gap in any other place fails the query.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, torn_one_in=torn_one_in)
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(.*)$", 1), F.lit("")).cast("long")
    rows = read_archives(pages.sparkSession, path, with_payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "gap", "gaps"
    )
    most = 1 if torn_one_in else 0
    lost = F.col("gaps") > F.when(F.col("gap").isNull() & F.col("refers_to").isNull(), F.lit(most)).otherwise(F.lit(0))
    said = F.raise_error(F.concat(F.lit("own archive is damaged: "), F.coalesce("gap", F.lit("page ")), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    # Not in the filter itself, which may be taken apart and evaluated for other rows.
    checked = rows.where("gap IS NULL OR gaps > 0").withColumn("page_id", F.when(lost, said.cast("long")).otherwise(F.col("page_id")))
    return checked.drop("gap")
