import base64
import gzip
import hashlib
import io
import os
import re
import zlib

import duckdb
import pytest
from nearfield.llm.queries import OP13_SQL, all_queries
from nearfield.llm.warc import archive_and_read, member, page_record, plan_records, read_archives, read_members, write_archives

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    rel = con.sql(OP13_SQL)
    df = all_queries()["op13_warc"](spark, SF)
    assert df.columns == rel.columns and sorted(map(tuple, df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def brute(rows, least=0):
    top = {}
    for k, _, html in rows:
        t = html or ""
        top[t] = max((top.get(t, None), k), key=lambda x: (x is not None, x or 0))
    seen, out = set(), []
    for k, _, html in rows:
        data = (html or "").encode()
        first = k == top[html or ""] and (k, html or "") not in seen
        seen.add((k, html or ""))
        response = first or len(data) < least
        out.append((k, len(data), b32(data), "response" if response else "revisit", None if response else top[html or ""]))
    return sorted(out, key=repr)


ODD = [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (9, "", "same"), (3, "http://é/ü", "x" * 400_000), (4, "u", None), (5, "u", ""),
       (None, "u", "only null"), (None, "u", "only null"), (None, "u", "same"), (7, "u", "twice"), (7, "u", "twice"), (8, "u", "\r\n\r\nWARC/1.1\r\n"),
       (10, "u", "é" * 50)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_of_odd_rows(spark, scratch_dir, least):
    pages = spark.createDataFrame(ODD, PAGES).selectExpr("*", "'x' as id", "'x' as key", "'x' as kind", "'x' as turn", "'x' as payload", "'x' as file")
    got = archive_and_read(pages, f"{scratch_dir}/w", least, file_bytes=300).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ODD, least)
    empty = archive_and_read(pages.limit(0), f"{scratch_dir}/none")
    assert empty.collect() == [] and empty.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_text_ids(spark, scratch_dir):
    rows = [("a:b/é%", "u", "same"), ("", "u", "same"), (None, "u", "z"), ("b", "u", "same")]
    got = archive_and_read(spark.createDataFrame(rows, "page_id string, url string, html string"), f"{scratch_dir}/w").collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        ("a:b/é%", "revisit", "b"), ("", "revisit", "b"), (None, "response", None), ("b", "response", None)}


def test_archives_are_plain_warc(spark, scratch_dir):
    """Files read with gzip and a regular expression alone; every task's file is listed with its records."""
    files = write_archives(plan_records(spark.createDataFrame(ODD, PAGES)), scratch_dir).collect()
    seen = {}
    for f in files:
        path = f"{scratch_dir}/archives/{f.file}"
        assert f.bytes < os.path.getsize(path)
        text = gzip.open(path).read()
        at, n = 0, 0
        while at < len(text):
            head, _, rest = text[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            block = rest[:size]
            assert rest[size : size + 4] == b"\r\n\r\n"
            at += len(head) + 4 + size + 4
            n += 1
            if fields[b"WARC-Type"] != b"warcinfo":
                assert fields[b"WARC-Block-Digest"].decode() == "sha1:" + b32(block)
                seen[fields[b"WARC-Record-ID"]] = (fields, block)
        assert n == f.records + 1
    assert len(seen) == len(ODD)
    for fields, block in seen.values():
        if fields[b"WARC-Type"] == b"revisit":
            target, held = seen[fields[b"WARC-Refers-To"]]
            assert target[b"WARC-Type"] == b"response" and target[b"WARC-Payload-Digest"] == fields[b"WARC-Payload-Digest"]
            assert held.startswith(block)  # the repeated head
        else:
            assert fields[b"WARC-Payload-Digest"].decode() == "sha1:" + b32(block.partition(b"\r\n\r\n")[2])


def test_payloads_come_back(spark, scratch_dir):
    files = write_archives(plan_records(spark.createDataFrame(ODD, PAGES)), scratch_dir)
    rows = read_archives(files, scratch_dir, payloads=True).where("record_type = 'response'").collect()
    assert sorted(r.payload.decode() for r in rows) == sorted({h or "" for *_, h in ODD})
    assert all(r.block_ok and r.payload_ok and r.payload_bytes == len(r.payload) for r in rows)


def record(payload=b"payload", **kw):
    return page_record(1, "u", payload, "response", None, 1, "2000-01-01T00:00:00Z", **kw)


@pytest.mark.parametrize("chunk", [1, 7, 64 << 10])
def test_chunks_of_any_size(chunk):
    data = record() + record(b"") + record(b"z" * 5000)
    rows = list(read_members(io.BytesIO(data), True, chunk))
    assert [r[-1] for _, r in rows] == [b"payload", b"", b"z" * 5000]
    assert [o for o, _ in rows] == [0, len(record()), len(record()) + len(record(b""))]


def test_a_bomb_is_read_in_chunks():
    data = record(b"\0" * 50_000_000)
    assert len(data) < 100_000
    (_, row), = read_members(io.BytesIO(data))
    assert row[6] == 50_000_000 and row[9] is None


def repack(change, payload=b"payload"):
    return zlib.compressobj(6, zlib.DEFLATED, 31), change(gzip.decompress(record(payload)))


@pytest.mark.parametrize("change, message", [
    (lambda t: t[:-1], "before its content length"),
    (lambda t: t[:-8], "before its content length"),
    (lambda t: t + b"more", "more data than the content length"),
    (lambda t: t + t, "more data than the content length"),
    (lambda t: b"HTTP/1.1" + t[8:], "record starts with"),
    (lambda t: re.sub(rb"Content-Length: \d+", b"Content-Length: -3", t), "content length"),
    (lambda t: t.replace(b"WARC-Type: ", b"WARC-Type "), "without a colon"),
    (lambda t: b"WARC/1.1\r\n" + b"x" * 2_000_000, "without an end"),
])
def test_damaged_records_are_named(change, message):
    pack, text = repack(change)
    good = record()
    with pytest.raises(ValueError, match=f"at byte {len(good)}: .*{message}"):
        list(read_members(io.BytesIO(good + pack.compress(text) + pack.flush())))


def test_damaged_archives(spark, scratch_dir):
    data = record()
    with pytest.raises(ValueError, match="ends inside"):
        list(read_members(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError, match="at byte 0"):
        list(read_members(io.BytesIO(b"not gzip")))
    assert list(read_members(io.BytesIO(b""))) == []
    pack, text = repack(lambda t: t.replace(b"\r\n\r\npayload", b"\r\n\r\npaylaod"))
    path = f"{scratch_dir}/odd.warc.gz"
    with open(path, "wb") as f:
        f.write(data + pack.compress(text) + pack.flush())
    files = spark.createDataFrame([(path,)], "file string")
    rows = read_archives(files, "", strict=False).collect()
    assert [(r.block_ok, r.payload_ok) for r in rows] == [(True, True), (False, False)]
    with pytest.raises(Exception, match=rf"odd.warc.gz at byte {len(data)}: a digest differs"):
        read_archives(files, "").collect()


def test_a_block_without_an_end_of_its_head():
    heads = [("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response")]
    with pytest.raises(ValueError, match="HTTP head without an end"):
        list(read_members(io.BytesIO(member(heads, [b"x" * 3_000_000]))))


def test_foreign_records():
    """Digests in hex or by other algorithms, and records that are no HTTP."""
    body = b"plain"
    heads = [("WARC-Type", "resource"), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(body).hexdigest()),
             ("WARC-Payload-Digest", "md5:" + hashlib.md5(body).hexdigest())]
    unknown = [("WARC-Type", "metadata"), ("WARC-Block-Digest", "blake3:abc")]
    rows = [r for _, r in read_members(io.BytesIO(member(heads, [body]) + member(unknown, [body])), True)]
    assert [(r[1], r[6], r[7], r[8], r[9]) for r in rows] == [("resource", 5, True, True, body), ("metadata", 5, None, None, body)]
