"""WARC archives: a writer that stores equal payloads once, and a reader that survives damage.

The writer makes each record a gzip member, so a reader can begin at any of them. Spark's own text writer commits the
files on any file system it knows: a line is the members of a whole file, and the separator of lines is an empty member.

The reader checks every record or gzip member. Where a check fails it searches for the next member or
version line that parses, goes on there, and reports the bytes between as a gap with the reason; no intact record
before or behind a damaged place is lost, nor are those that a broken gzip member gives before it breaks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
#: A gzip member that holds nothing, in the encoding that keeps every byte.
NO_MEMBER, BYTES = (b"\x1f\x8b\x08" + bytes(6) + b"\x03\x03" + bytes(9)).decode("latin-1"), "ISO-8859-1"
#: Records and bytes of one file at most, so that a file fits a task; a record that is larger is a file of its own.
FILE_RECORDS, FILE_BYTES = 20_000, 16 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def payload_digest(html: str) -> Column:
    """The digest of a text column, in Arrow batches."""

    def digests(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: sha1_base32(x.encode()))

    return F.pandas_udf(digests, "string")(html)


def gzip_members(values: DataFrame, file_records: int, file_bytes: int) -> DataFrame:
    """One row per archive file: the gzip members of records, as many as both bounds allow."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                member = gzip.compress(value.as_py().encode() + END.encode(), 6, mtime=0)
                if held and (len(held) >= file_records or size + len(member) > file_bytes):
                    yield file_of(held)
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield file_of(held)

    def file_of(members):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])

    return values.mapInArrow(run, "value binary")


# -- writing ----------------------------------------------------------------------------------------
def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Line breaks in values become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def records(
    pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit_bytes: int = 0
) -> DataFrame:
    """One row `value` per page: the text of its record without the blank lines that end it.

    Of equal payloads of at least `min_revisit_bytes` bytes the page with the largest id is the response and the
    others revisit it. A null payload is empty; a null url leaves its header line out. Pages without an
    id get their own responses. Rows that repeat the largest id are responses each.
    """
    p = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
    )
    p = p.withColumn("content", F.sha2("html", 256)).withColumn("digest", payload_digest("html"))
    size = F.octet_length("html")
    newest = (
        p.filter(size >= min_revisit_bytes).groupBy("content", "digest").agg(F.max("page").alias("response"))
    )
    p = p.join(newest, ["content", "digest"], "left")
    is_revisit = F.col("page") < F.col("response")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        size.cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(is_revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        _line("WARC-Record-ID", F.coalesce(urn(F.col("page")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\n"), _line("WARC-Refers-To", urn(F.col("response"))))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return p.select(F.concat(header, block).alias("value"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    file_records: int = FILE_RECORDS,
    file_bytes: int = FILE_BYTES,
    **options,
) -> None:
    """Archives of all pages below `path`; `options` as of `records`.

    A file holds at most `file_records` records and `file_bytes` bytes, or one record.
    """
    files = gzip_members(records(pages, id_col, url_col, html_col, **options), file_records, file_bytes)
    writer = files.select(F.col("value").cast("string")).write.option("encoding", BYTES).option("lineSep", NO_MEMBER)
    writer.option("maxRecordsPerFile", 1).text(path)


# -- reading ----------------------------------------------------------------------------------------
VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_HEAD_END = re.compile(rb"\r\n\r\n")
_INNER = re.compile(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)")


class Damaged(Exception):
    pass


def _headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        out.setdefault(name.strip().decode("latin-1").lower(), value.strip().decode("utf-8", "replace"))
    return out


def parse_record(data: bytes, at: int, inner: bool = False) -> tuple[dict, bytes, bytes, bool | None, int]:
    """Headers, block, payload, proof and end of the record at a place.

    The proof is true where the digest is right, none where there is no digest but a record or the end follows, and
    false where damage follows: such a record ends as it should. Only if its block holds a record may its length be wrong.
    """
    first = data.find(b"\r\n", at, at + 12)
    if data[at : at + 10] not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        raise Damaged("no version line")
    found = _HEAD_END.search(data, first)
    if not found:
        raise Damaged("header does not end")
    headers = _headers(data[first + 2 : found.start()])
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    begin, end = found.end(), found.end() + int(length)
    if end > len(data):
        raise Damaged("block is cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end after its block")
    after, block = end + 4, data[begin:end]
    payload, proved = _checked(headers, block)
    if not proved and after < len(data) and not data.startswith((VERSION, MEMBER), after):
        if not inner and any(_parses(data, m.end()) for m in _INNER.finditer(data, begin, end)):
            raise Damaged("a record begins in the block and none follows it")  # so the length may be wrong
        return headers, block, payload, False, after
    return headers, block, payload, proved or None, after


def _parses(data: bytes, at: int) -> bool:
    try:
        return bool(parse_record(data, at, inner=True))
    except Damaged:
        return False


def payload_of(headers: dict, block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        head, blank, body = block.partition(b"\r\n\r\n")
        return body if blank else b""
    return block


def _checked(headers: dict, block: bytes) -> tuple[bytes, bool]:
    """The payload, and whether its digest proves it; raises if the digest in the header is another."""
    payload = payload_of(headers, block)
    stated = headers.get("warc-payload-digest", "")
    if not stated.lower().startswith("sha1:") or headers.get("warc-type") == "revisit":
        return payload, False
    if stated[5:].upper() != sha1_base32(payload):
        raise Damaged("payload digest differs")
    return payload, True


def _member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """What a gzip member holds and where it ends. Fed in steps, so members cost their own size only."""
    gz, out, view = zlib.decompressobj(zlib.MAX_WBITS | 16), [], memoryview(data)
    while not gz.eof:
        if at >= len(data):
            raise Damaged("gzip member is cut off")
        try:
            out.append(gz.decompress(view[at : at + step]))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        at = min(at + step, len(data)) - len(gz.unused_data)
    return b"".join(out), at


def _inflated(data: bytes, at: int, most: int | None = None, step: int = 1 << 16) -> tuple[bytes, int]:
    """What a broken gzip member gives before it breaks, or until it has given `most` bytes, and where reading ended."""
    gz, out, size, view = zlib.decompressobj(zlib.MAX_WBITS | 16), [], 0, memoryview(data)
    while at < len(data) and not gz.eof and (most is None or size < most):
        saved = gz.copy() if step > 1 else None
        try:
            piece = gz.decompress(view[at : at + step])
        except zlib.error:
            piece = None
        if step > 1 and (piece is None or most is not None and size + len(piece) >= most):
            gz, step = saved, 1  # the place is in this step: go on byte by byte
            continue
        if piece is None:
            break
        out.append(piece)
        size, at = size + len(piece), min(at + step, len(data))
    return b"".join(out), at


def _within(inner: bytes) -> tuple[list[tuple], int, str]:
    """The records of a member, where the last of them ends, and why others are missing."""
    found, at, last, reason = [], 0, 0, ""
    while at < len(inner):
        try:
            *record, at = parse_record(inner, at)
            found.append(record)
            last = at
        except Damaged as e:
            reason = reason or str(e)
            nxt = _NEXT.search(inner, at + 1)
            at = nxt.start() if nxt else len(inner)
    return found, last, reason


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in order; together they cover all its bytes.

    A record has `offset`, `length`, `headers`, `block`, `payload` and `proved`; a gap has `offset`, `length` and
    `reason`. `proved` is false for a record without a right digest that damage follows or whose member is broken.
    A member may hold several records; damage inside a member that decompresses is reported as a gap of the
    member. Of a member that does not, the records before the damage are given, and the gap begins behind the
    last of them; a member that holds one record only stands or falls with it. An empty archive gives nothing.
    """
    at, lost, reason = 0, None, ""
    while at < len(data):
        try:
            rest = None
            if data.startswith(MEMBER, at):
                try:
                    inner, end = _member(data, at)
                    found, _, damage = _within(inner)
                except Damaged as e:
                    inner, stop = _inflated(data, at)
                    found, last, damage = _within(inner)
                    if not found or len(found) == 1 and last == len(inner):
                        raise  # of a member of one record the check sum stands for the record
                    end = _inflated(data, at, last)[1]
                    if end == stop == len(data) and damage:
                        end -= 1  # what is cut off came with the last byte of the last record
                    found = [(*record, proved or False) for *record, proved in found]
                    rest, damage = str(e), ""
                if lost is not None and lost < at:
                    yield {"offset": lost, "length": at - lost, "reason": reason}
                if damage:
                    yield {"offset": at, "length": end - at, "reason": damage}
            else:
                *record, end = parse_record(data, at)
                found = [record]
                if lost is not None:
                    yield {"offset": lost, "length": at - lost, "reason": reason}
            lost, reason = None, ""
            for headers, block, payload, proved in found:
                yield {
                    "offset": at, "length": end - at, "headers": headers, "block": block, "payload": payload, "proved": proved is not False,
                }
            if rest and end < len(data):
                lost, reason = end, rest
                nxt = _NEXT.search(data, at + 1)
                while nxt and nxt.start() < end:
                    nxt = _NEXT.search(data, nxt.start() + 1)
                end = nxt.start() if nxt else len(data)
            at = end
        except Damaged as e:
            if lost is None:
                lost, reason = at, str(e)
            nxt = _NEXT.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
    if lost is not None:
        yield {"offset": lost, "length": len(data) - lost, "reason": reason}


FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to")
SCHEMA = (
    "file string, offset long, length long, gap_reason string, record_type string, record_id string, target_uri string, "
    "payload_digest string, refers_to string, http_length long, payload binary, proved boolean"
)


def _http_length(headers: dict, block: bytes) -> int | None:
    found = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", block.partition(b"\r\n\r\n")[0], re.I)
    return int(found[1]) if found and headers.get("content-type", "").startswith("application/http") else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records below a path, and a row with `gap_reason` for every quarantined byte range.

    Files with and without gzip members are read; one file is one task's work. `proved` is as in `salvage`.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for r in salvage(data):
                    if "reason" in r:
                        rows.append((name, r["offset"], r["length"], r["reason"], *[None] * 8))
                    else:
                        h = r["headers"]
                        rows.append(
                            (name, r["offset"], r["length"], None, *map(h.get, FIELDS), _http_length(h, r["block"]), r["payload"], r["proved"])
                        )
                        held += len(r["payload"])
                    if held > 4_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.bool_()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def page_records(archive: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type and refers_to.

    The payload of a response is measured; a revisit carries its length in the HTTP header.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return archive.filter("gap_reason IS NULL").select(
        page(F.col("record_id")).alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("http_length"))
        .otherwise(F.octet_length("payload"))
        .cast("long")
        .alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )
