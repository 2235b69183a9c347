import base64
import gzip
import hashlib
import io

import pytest

from readloom.llm import warc


def archive(*payloads):
    return b"".join(warc.record_bytes(f"urn:uuid:{i}", f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads))


def test_reader_returns_payloads_and_rejects_damage():
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n" * 9, bytes(range(256)) * 9000, "é".encode()]
    raw = archive(*payloads)
    assert [r["payload"] for r in warc.read_records(io.BytesIO(raw))] == payloads
    one = gzip.decompress(raw)  # several records in a member, and a record in several
    cut = gzip.compress(one[:60]) + gzip.compress(one[60:])
    for bad in (raw[:-30], raw[:200], gzip.compress(one), cut, gzip.compress(b"") + raw, raw + b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
    plain = gzip.decompress(archive(b"payload here"))
    for a, b in ((b"payload here", b"payload hare"), (b"Content-Length: 86", b"Content-Length: 85"), (b"WARC/1.1", b"WORC/1.1")):
        broken = plain.replace(a, b)
        if broken != plain:
            with pytest.raises(warc.WarcError):
                list(warc.read_records(io.BytesIO(gzip.compress(broken))))


def test_round_trip(spark, monkeypatch):
    long = "<p>" + "long page é " * 50
    rows = [(5, "http://a/b c", long), (2, None, long), (9, "u", long), (2, "again", long), (None, "n", long), (7, "é", "short"), (8, "k", "short"), (11, "z", None), (12, "z", ""), (13, "big", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload string")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    got = warc.warc_round_trip(pages, payloads=True).collect()
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        later = i is not None and len(body) >= 100 and min(j for j, _, h in rows if j is not None and h == html) < i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if later else "response", 2 if later else None, None if later else body))
    key = lambda x: repr(x[:5])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    manifest = warc.write_archives(pages, warc.shared_path(spark, "warc"))
    records = warc.read_archives(manifest).collect()
    assert len({r.record_id for r in records}) == len(records) == len(rows)


def test_revisits_refer_to_records(spark):
    body = "x" * 200
    pages = spark.createDataFrame([(i, f"u{i}", body) for i in range(-2, 300)], "page_id bigint, url string, html string")
    got = warc.warc_round_trip(pages).collect()
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(i, -2) for i in range(-1, 300)]
    records = warc.read_archives(warc.write_archives(pages, warc.shared_path(spark, "warc"))).collect()
    assert {r.refers_to for r in records if r.record_type == "revisit"} == {r.record_id for r in records if r.record_type == "response"}


def record(kind, block, **fields):
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1b9a4f2c-0000-4000-8000-000000000001>", "WARC-Date: 2020-01-01T00:00:00Z"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()] + [f"Content-Length: {len(block)}"]
    return gzip.compress(b"\r\n".join(["WARC/1.0".encode(), *[h.encode() for h in head]]) + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers():
    read = lambda *records: list(warc.read_records(io.BytesIO(b"".join(records))))
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    page, chunked = b"hello page", b"5\r\nhello\r\n5;x=y\r\n page\r\n0\r\n\r\n"
    kind = {"Content_Type": "application/http; msgtype=response"}
    got = read(
        record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="<http://a/>"),
        record("response", http + chunked, WARC_Payload_Digest=sha1(page), WARC_Block_Digest=sha1(http + chunked), **kind),
        record("response", http + chunked, WARC_Payload_Digest=sha1(chunked), **kind),
        record("response", http + page, WARC_Payload_Digest="sha256:" + hashlib.sha256(page).hexdigest().upper(), WARC_Block_Digest="crc9:zz", **kind),
        record("response", b"HTTP/1.1 304 Not Modified\r\n\r\n", **kind),
        record("metadata", b"a: b"),
        record("resource", page, WARC_Block_Digest="md5:" + hashlib.md5(page).hexdigest()),
        record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Payload_Digest=sha1(page), WARC_Refers_To="<urn:uuid:2>", **kind),
        record("conversion", "é".encode(), WARC_Target_URI="http://a/\r\n\t?folded"),
    )
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "response", "response", "metadata", "resource", "revisit", "conversion"]
    assert [r["payload"] for r in got] == [b"software: x\r\n", b"", page, chunked, page, b"", b"a: b", page, None, "é".encode()]
    assert {r["record_id"] for r in got} == {"urn:uuid:1b9a4f2c-0000-4000-8000-000000000001"} and (got[1]["url"], got[9]["url"]) == ("http://a/", "http://a/ ?folded")
    assert all(r["payload_digest"] == hashlib.sha256(r["payload"]).hexdigest() and r["payload_bytes"] == len(r["payload"]) for r in got if r["payload"] is not None)
    assert (got[8]["payload_digest"], got[8]["payload_bytes"], got[8]["refers_to"]) == ("sha1:" + hashlib.sha1(page).hexdigest(), None, "urn:uuid:2")
    for bad in ({"WARC_Payload_Digest": sha1(b"other")}, {"WARC_Block_Digest": sha1(page)}, {"WARC_Block_Digest": "sha1:AAAA"}, {"WARC_Block_Digest": "sha1:!!!"}):
        with pytest.raises(warc.WarcError):
            read(record("response", http + page, **bad, **kind))
    with pytest.raises(warc.WarcError):
        read(gzip.compress(b"WARC/1.0\r\nno field\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
