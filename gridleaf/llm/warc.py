"""WARC records: reading, writing, and resolving not-modified revisits.

A ``server-not-modified`` revisit stands for a page that an earlier capture holds in
full.  It is resolved by an as-of join: of the full responses (HTTP 200) to the same
canonical URL the latest strictly earlier one is taken; of several at one instant the
one with the greatest record id.  Then validators are compared:

* both have an ETag: it must agree (weak comparison), else ``mismatch``;
* otherwise both have Last-Modified: it must agree, else ``mismatch``;
* neither pair is there: ``unverified``;
* no earlier full response: ``missing``.

``resolved`` and ``unverified`` revisits get the response's headers, updated with those
header fields of the 304 that such an answer may carry (``PERMITTED``); others of its
fields, such as Content-Length, stay out.

One URL with a great share of all captures is not one task's work: captures of a URL at one
instant become one row, combined before any shuffle; the instants of a minute, the minutes of a day and the days
of a URL each have a window over one row apiece.  Only metadata and digests are shuffled, never bodies.

Header fields may repeat: all of a name in the 304 stand where the first of that name stood in the response.

Null and empty URLs have canonical URL null and find nothing (``missing``).  So do revisits without a date;
a response without a date is earlier than none.  Repeated
revisits are resolved each on its own; of repeated responses any one is taken, they are alike.  Dates may
have any precision from the year on.  Bytes that are not a WARC record, and a cut-off last record, do not stop a
job: they give a row with ``error`` and nothing else that counts, after the records before them.  A damaged gzip member gives one
such row (several in a row give one), and reading goes on where the next whole member begins.  ``parse`` itself raises ``BadRecord``.  Bodies of any length are hashed whole.  An empty table gives
an empty one.  Only the named columns are read.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridleaf.llm.shared import chunks

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Header fields that a 304 answer may carry to update a stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
MINUTE = 60
DAY = 86_400


class BadRecord(ValueError):
    """Bytes that are not a whole WARC record."""


@dataclass
class Record:
    """A record: named fields in order, and the content block."""

    fields: list[tuple[str, str]]
    block: bytes = b""
    version: str = "WARC/1.1"

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), default)

    def to_bytes(self, compressed: bool = False) -> bytes:
        named = [f for f in self.fields if f[0].lower() != "content-length"] + [("Content-Length", str(len(self.block)))]
        raw = "".join([f"{self.version}\r\n", *(f"{k}: {v}\r\n" for k, v in named), "\r\n"]).encode() + self.block + b"\r\n\r\n"
        return gzip.compress(raw, mtime=0) if compressed else raw


@dataclass
class Http:
    """An HTTP answer inside a record."""

    status: int
    headers: list[tuple[str, str]] = field(default_factory=list)
    body: bytes = b""

    def to_bytes(self, reason: str = "") -> bytes:
        return f"HTTP/1.1 {self.status} {reason}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in self.headers).encode() + b"\r\n" + self.body

    @classmethod
    def parse(cls, block: bytes) -> Http:
        head, _, body = block.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        parts = lines[0].split(" ", 2)
        if not parts[0].startswith("HTTP/") or len(parts) < 2 or not parts[1].isdigit():
            raise BadRecord("no HTTP status line")
        return cls(int(parts[1]), _fields(lines[1:]), body)


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:  # a folded line goes on
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line:
            name, colon, value = line.partition(":")
            if not colon:
                raise BadRecord(f"no field: {line[:40]!r}")
            out.append((name.strip(), value.strip()))
    return out


GZIP = b"\x1f\x8b\x08"
#: Compressed bytes that are unpacked at once.
STEP = 1 << 16


def _member(content: bytes, at: int) -> tuple[bytes, int] | None:
    """The gzip member that begins at a place, and where it ends; None if it is damaged or cut off."""
    unpacker, out = zlib.decompressobj(wbits=31), []
    try:
        while not unpacker.eof and at < len(content):
            out.append(unpacker.decompress(content[at : at + STEP]))
            at = min(at + STEP, len(content)) - len(unpacker.unused_data)
    except zlib.error:
        return None
    return (b"".join(out), at) if unpacker.eof else None


def members(content: bytes) -> Iterator[bytes | BadRecord]:
    """The gzip members of compressed content one by one, or plain content as it is.

    A damaged member gives an error in its place, and reading goes on at the next place where a whole member begins.
    """
    if content[:2] != GZIP[:2]:
        yield content
        return
    at = 0
    while at < len(content):
        found = _member(content, at)
        if found is None:
            yield BadRecord("a damaged or cut-off gzip member")
            while found is None and (at := content.find(GZIP, at + 1)) >= 0:
                found = _member(content, at)
            if found is None:
                return
        part, at = found
        yield part


def parse(content: bytes) -> Iterator[Record]:
    """The records of a WARC file, plain or with a gzip member per record."""
    for part in members(content):
        if isinstance(part, BadRecord):
            raise part
        stream = io.BytesIO(part)
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise BadRecord(f"no version line: {line[:40]!r}")
            head = []
            while (more := stream.readline()).strip():
                head.append(more.decode("utf-8", "replace").rstrip("\r\n"))
            record = Record(_fields(head), version=line.decode().strip())
            size = record.get("Content-Length", "")
            if not size.isdigit():
                raise BadRecord("no Content-Length")
            record.block = stream.read(int(size))
            if len(record.block) < int(size):
                raise BadRecord("a cut-off record")
            yield record


RECORDS = (
    "record_id string, type string, profile string, url string, date timestamp, status int, "
    "headers array<struct<name: string, value: string>>, body_bytes long, body_sha256 string, error string"
)
_DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?Z)?)?)?")


def parse_date(text: str) -> datetime.datetime:
    """A WARC date, UTC, of any precision from the year down to nanoseconds (cut to microseconds)."""
    found = _DATE.fullmatch(text.strip())
    if not found:
        raise BadRecord(f"no date: {text[:40]!r}")
    year, month, day, hour, minute, second = (int(x) if x else least for x, least in zip(found.groups(), (1, 1, 1, 0, 0, 0), strict=False))
    try:
        return datetime.datetime(year, month, day, hour, minute, second, int((found[7] or "0")[:6].ljust(6, "0")), datetime.UTC)
    except ValueError as e:
        raise BadRecord(str(e)) from e


def record_row(record: Record) -> tuple:
    """Fields of a record as in ``RECORDS``, and its body."""
    names = [record.get(n) for n in ("WARC-Record-ID", "WARC-Type", "WARC-Profile", "WARC-Target-URI")]
    try:
        http = Http.parse(record.block) if (record.get("Content-Type") or "").startswith("application/http") and record.block else Http(0)
        date = record.get("WARC-Date")
        when = parse_date(date) if date else None
    except BadRecord as e:
        return (names[0], *[None] * 8, str(e), None)
    headers = [{"name": k.lower(), "value": v} for k, v in http.headers]
    return (*names, when, http.status, headers, len(http.body), hashlib.sha256(http.body).hexdigest(), None, http.body)


def record_rows(content: bytes) -> Iterator[tuple]:
    """``record_row`` of all records of a file; one with ``error`` for each member that cannot be read on."""
    for part in members(content):
        try:
            if isinstance(part, BadRecord):
                raise part
            for record in parse(part):
                yield record_row(record)
        except BadRecord as e:
            yield (*[None] * 9, str(e), None)


def records(df: DataFrame, content: str = "content", bodies: bool = False) -> DataFrame:
    """One row per record of the WARC files in a binary column, such as ``binaryFile`` gives; bodies by size and digest, and whole if asked for."""
    return map_records(df.select(content), lambda row: row[0] or b"", bodies=bodies)


def map_records(df: DataFrame, archive: Callable[[tuple], bytes], largest: int = 0, bodies: bool = False) -> DataFrame:
    """The records of the archive that ``archive`` makes of the values of each row; column ``largest`` holds the long texts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(RECORDS + (", body binary" if bodies else ""))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, largest):
                rows = [r for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in record_rows(archive(row))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=False)], schema=arrow)

    return df.mapInArrow(run, schema)


#: Query parameters that do not select content.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid|sid|phpsessid|jsessionid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``/``m.``, default port, fragment, tracking parameters and final slash; other parameters sorted."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^(www[0-9]*|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _header(headers: str, name: str) -> Column:
    return F.expr(f"get(filter({headers}, h -> h.name = '{name}'), 0).value")


def resolve(found: DataFrame) -> DataFrame:
    """``found`` as ``records`` gives it: one row per not-modified revisit.

    record_id, url, canonical, date, verdict, refers_to, body_bytes, body_sha256 and
    headers (merged; null unless resolved or unverified).
    """
    names = ["record_id", "url", "date", "headers", "body_bytes", "body_sha256"]
    full = (F.col("type") == "response") & (F.col("status") == 200)
    revisit = (F.col("type") == "revisit") & (F.col("profile") == NOT_MODIFIED)
    kept = found.where(full | revisit).select(*names, revisit.alias("revisit"), canonical_url(F.col("url")).alias("canonical"))
    response = F.struct("date", "record_id", "headers", "body_bytes", "body_sha256")
    # One row for each instant of a URL: its response of the greatest record id, and whether a revisit asks for an earlier one.
    captures = kept.where("canonical is not null and date is not null")
    instants = captures.groupBy("canonical", "date").agg(
        F.max_by(response, F.when(~F.col("revisit"), F.struct("record_id"))).alias("last"), F.max("revisit").alias("asked")
    )
    seconds = F.unix_timestamp("date")
    instants = instants.withColumns({"minute": F.floor(seconds / MINUTE), "day": F.floor(seconds / DAY)})

    def earlier(part: list[str], order: str) -> Column:
        return F.last("last", ignorenulls=True).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))

    def latest(order: str) -> Column:
        return F.max_by("last", F.when(F.col("last").isNotNull(), F.col(order))).alias("last")

    minutes = instants.groupBy("canonical", "day", "minute").agg(latest("date"))
    days = minutes.groupBy("canonical", "day").agg(latest("minute")).withColumn("before_day", earlier(["canonical"], "day")).drop("last")
    minutes = minutes.withColumn("in_day", earlier(["canonical", "day"], "minute")).join(days.where("before_day is not null"), ["canonical", "day"], "left")
    minutes = minutes.select("canonical", "minute", F.coalesce("in_day", "before_day").alias("before_minute")).where("before_minute is not null")
    near = instants.withColumn("in_minute", earlier(["canonical", "minute"], "date")).where("asked")
    answers = near.join(minutes, ["canonical", "minute"], "left").select("canonical", "date", F.coalesce("in_minute", "before_minute").alias("full"))
    joined = kept.where("revisit and canonical is not null").join(answers, ["canonical", "date"], "left")
    alone = kept.where("revisit and canonical is null").withColumn("full", F.lit(None).cast(joined.schema["full"].dataType))
    joined = joined.select(*alone.columns).unionByName(alone)
    weak = [F.regexp_replace(_header(h, "etag"), "^W/", "") for h in ("headers", "full.headers")]
    dated = [_header(h, "last-modified") for h in ("headers", "full.headers")]
    pairs = [(a.isNotNull() & b.isNotNull(), a == b) for a, b in (weak, dated)]
    verdict = F.when(F.col("full").isNull(), "missing").when(pairs[0][0], F.when(pairs[0][1], "resolved").otherwise("mismatch")).when(pairs[1][0], F.when(pairs[1][1], "resolved").otherwise("mismatch")).otherwise("unverified")
    allowed = "(" + ", ".join(f"'{p}'" for p in PERMITTED) + ")"
    # All fields of a name that the 304 holds stand where the first of that name stood; names new to it follow.
    merged = F.expr(
        f"concat(flatten(transform(full.headers, (h, i) -> case"
        f" when h.name not in {allowed} or not exists(headers, r -> r.name = h.name) then array(h)"
        f" when exists(slice(full.headers, 1, i), p -> p.name = h.name) then array()"
        f" else filter(headers, r -> r.name = h.name) end)),"
        f" filter(headers, r -> r.name in {allowed} and not exists(full.headers, h -> h.name = r.name)))"
    )
    out = joined.withColumn("verdict", verdict)
    ok = F.col("verdict").isin("resolved", "unverified")
    return out.select("record_id", "url", "canonical", "date", "verdict", F.col("full.record_id").alias("refers_to"), *(F.when(ok, F.col(f"full.{c}")).alias(c) for c in ("body_bytes", "body_sha256")), F.when(ok, merged).alias("headers"))


def restored(resolved: DataFrame, found: DataFrame) -> DataFrame:
    """record_id, url, date, refers_to, merged headers and body of what ``resolve`` gave a body to.

    ``found`` are the records with bodies that it came from; bodies of other records are not shuffled.
    """
    wanted = resolved.where("body_sha256 is not null").select("record_id", "url", "date", "refers_to", "headers", "body_sha256")
    bodies = found.where("body is not null").select(F.col("record_id").alias("refers_to"), "body_sha256", "body").join(wanted.select("refers_to").distinct(), "refers_to", "left_semi")
    return wanted.join(bodies.groupBy("refers_to", "body_sha256").agg(F.first("body").alias("body")), ["refers_to", "body_sha256"]).select("record_id", "url", "date", "refers_to", "headers", "body")
