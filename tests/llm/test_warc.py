"""Archives: round trip, revisits, and salvage of damaged files."""

import gzip
import hashlib
import base64
import random

import odd
import pytest
from pyspark.sql import types as T

from frameglass.llm import warc

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/\r\nX: y", "é WARC/1.1\r\n\r\n"), (4, "u", None),
         (5, "u", ""), (6, "u", "y" * 200_000), (7, "u", "<p>x</p>"), (8, "u", "z\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nq\r\n\r\n")]
SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def expected(pages, least=0):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        newest = max(j for j, _, h in pages if (h or "") == (html or ""))
        revisit = len(data) >= least and i < newest
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", newest if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    path = str(tmp_path / "w")
    pages = odd.clashing(spark.createDataFrame(PAGES, SCHEMA).repartition(3))
    warc.write_warc(pages, path, min_revisit_bytes=least, file_records=2)
    archive = warc.read_warc(spark, path)
    assert archive.filter("gap_reason IS NOT NULL").count() == 0
    assert [tuple(r) for r in warc.page_records(archive).orderBy("page_id").collect()] == expected(PAGES, least)
    by_id = {r.record_id: r for r in archive.collect()}
    assert bytes(by_id["<urn:page:8>"].payload).decode() == PAGES[7][2] and by_id["<urn:page:3>"].target_uri == "http://a/ X: y"


def test_nothing_and_null_ids(spark, tmp_path):
    empty, nulls = str(tmp_path / "e"), str(tmp_path / "n")
    warc.write_warc(spark.createDataFrame([], SCHEMA), empty)
    assert warc.read_warc(spark, empty).count() == 0
    warc.write_warc(spark.createDataFrame([(None, "u", "a"), (None, "u", "a"), (5, "u", "a"), (5, "u", "a")], SCHEMA), nulls)
    got = warc.page_records(warc.read_warc(spark, nulls)).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "response"), (0, "response"), (5, "response"), (5, "response")]


def record(i: int, body: bytes = b"") -> bytes:
    body = body or f"body {i}".encode()
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{warc.sha1_base32(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def seen(data: bytes):
    found = list(warc.salvage(data))
    at = 0
    for f in found:
        assert f["offset"] == at
        at = f["offset"] + f["length"]
    assert at == len(data)
    return [f["headers"].get("warc-record-id", "")[10:-1] for f in found if "headers" in f], [(f["offset"], f["length"], f["reason"]) for f in found if "reason" in f]


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_salvage(pack):
    parts = [pack(record(i)) for i in range(5)]
    assert seen(b"".join(parts)) == (list("01234"), [])
    ids, gaps = seen(b"".join([*parts[:2], parts[2][: len(parts[2]) // 2], *parts[3:]]))
    assert ids == list("0134") and len(gaps) == 1 and gaps[0][:2] == (len(b"".join(parts[:2])), len(parts[2]) // 2)
    ids, gaps = seen(b"junk" + b"".join(parts) + b"more junk")
    assert ids == list("01234") and [g[1] for g in gaps] == [4, 9]
    ids, gaps = seen(b"".join(parts)[:-3])
    assert ids == list("0123") and len(gaps) == 1


def test_salvage_of_wrong_lengths_and_digests():
    short, long = record(2).replace(b"Content-Length: 6", b"Content-Length: 3"), record(2).replace(b"Content-Length: 6", b"Content-Length: 9999")
    other = record(2).replace(b"body 2", b"bodY 2")
    for bad, reason in ((short, "does not end"), (long, "cut off"), (other, "digest")):
        ids, gaps = seen(record(1) + bad + record(3))
        assert ids == ["1", "3"] and len(gaps) == 1 and gaps[0][:2] == (len(record(1)), len(bad)) and reason in gaps[0][2]
    assert list(warc.salvage(b"")) == []


def test_salvage_survives_any_flipped_byte():
    random.seed(5)
    for pack in (lambda x: x, gzip.compress):
        parts = [pack(record(i, bytes(random.choices(b"abc \r\n", k=80)))) for i in range(6)]
        for _ in range(150):
            k = random.randrange(6)
            at = random.randrange(len(parts[k]))
            bad = bytearray(parts[k])
            bad[at] ^= 1 << random.randrange(8)
            ids, _ = seen(b"".join([*parts[:k], bytes(bad), *parts[k + 1 :]]))
            assert {str(i) for i in range(6) if i not in (k, k - 1)} <= set(ids)


def revisit(i: int) -> bytes:
    """A record without a digest that can be checked."""
    block = f"HTTP/1.1 200 OK\r\nX-Number: {i}\r\n\r\n"
    head = f"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return (head + block + "\r\n\r\n").encode()


def records_of(data: bytes):
    return {r["headers"].get("warc-record-id", "")[10:-1]: r["proved"] for r in warc.salvage(data) if "headers" in r}


@pytest.mark.parametrize("make", [record, revisit])
def test_a_flipped_byte_loses_its_own_record_only(make):
    random.seed(6)
    for pack in (lambda x: x, gzip.compress):
        parts = [pack(make(i)) for i in range(6)]
        for _ in range(300):
            k = random.randrange(6)
            bad = bytearray(parts[k])
            bad[random.randrange(len(bad))] ^= 1 << random.randrange(8)
            ids, _ = seen(b"".join([*parts[:k], bytes(bad), *parts[k + 1 :]]))
            assert {str(i) for i in range(6) if i != k} <= set(ids)


def test_an_intact_record_before_damage_stays():
    for junk in (b"\0" * 9, revisit(2).replace(b"WARC/1.0", b"WERC/1.0")):
        data = revisit(1) + junk + revisit(3)
        assert records_of(data) == {"1": False, "3": True}
        assert seen(data)[1] == [(len(revisit(1)), len(junk), "no version line")]
        assert records_of(gzip.compress(data)) == {"1": False, "3": True}
    # A length that reaches into the next record does not swallow it.
    far = len(revisit(1)) + revisit(2).index(b"\r\n\r\n") - revisit(1).index(b"\r\n\r\n") - 4
    data = revisit(1).replace(b"Content-Length: 32", b"Content-Length: %d" % far) + revisit(2) + revisit(3)
    assert set(records_of(data)) == {"2", "3"}


def test_records_of_a_broken_member_stay():
    several = b"".join(make(i) for i, make in enumerate([record, revisit] * 300))
    packed = gzip.compress(several, 0)
    found = list(warc.salvage(packed[: len(packed) * 3 // 4]))
    whole = len(records_of(several[: len(several) * 3 // 4 - 100]))
    assert [r["headers"]["warc-record-id"] for r in found[:-1]] == [f"<urn:page:{i}>" for i in range(len(found) - 1)]
    assert len(found) >= whole and found[-1]["reason"] == "gzip member is cut off"
    assert found[-1]["offset"] == found[0]["length"] and found[-1]["offset"] + found[-1]["length"] == len(packed) * 3 // 4
    assert [r["proved"] for r in found[:4]] == [True, False, True, False]
    # A wrong check sum at the end, and a member behind it.
    packed = gzip.compress(record(1) + revisit(2))
    bad = packed[:-8] + bytes(x ^ 1 for x in packed[-8:])
    assert records_of(bad + gzip.compress(record(3))) == {"1": True, "2": False, "3": True}


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Files hold no more bytes than they may, but for records that are larger."""
    random.seed(7)
    pages = [(i, "u", random.randbytes(500 if i % 10 else 8000).hex()) for i in range(60)]
    path = tmp_path / "b"
    warc.write_warc(spark.createDataFrame(pages, SCHEMA).coalesce(1), str(path), file_bytes=5000)
    sizes = [len(f.read_bytes()) - 20 for f in path.glob("part-*")]
    assert sum(n > 5000 for n in sizes) == 6 and len(sizes) < 40
    archive = warc.read_warc(spark, str(path))
    assert archive.filter("gap_reason IS NOT NULL").count() == 0
    assert sorted((r.page_id, r.payload_bytes) for r in warc.page_records(archive).collect()) == [(i, len(h)) for i, _, h in pages]
