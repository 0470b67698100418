import gzip
import hashlib

import pytest

from shelfwise.llm import warc

SCHEMA = "page_id long, url string, html string, path string, digest int"


def pages(spark):
    big, other = "b" * 1000, "é" * 700 + "x"
    rows = [
        (1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (3, "u", big), (None, "http://n/", big),
        (4, "http://a/ü\nx", "small"), (5, "v", "small"), (6, "w", None), (7, "w", ""), (8, "x", other), (9, "x", other),
        (10, "y", "z" * 999), (11, "y", "z" * 999), (12, "long", "0123456789" * 300_000),
    ]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)


def want(rows):
    best = {}
    for r in rows:
        p = (r.html or "").encode()
        if len(p) >= 1000 and r.page_id is not None:
            best[p] = max(best.get(p, -1), r.page_id)
    out = []
    for r in rows:
        p = (r.html or "").encode()
        to = best.get(p)
        again = to is not None and to != r.page_id
        out.append((str(r.page_id), len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [97, 1000, 8 << 20])
def test_round_trip(spark, split):
    rows = pages(spark)
    files = warc.write_archives(rows.repartition(3))
    assert files.groupBy().sum("records").first()[0] == 14
    back = warc.read_archives(files, split).collect()
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
    assert got == want(rows.collect())
    html = {r.page_id: (r.html or "").encode() for r in rows.collect()}
    assert all(bytes(r.payload) == html[r.page_id] for r in back if r.record_type == "response" and r.page_id != 3)


def test_real_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    back = warc.read_archives(warc.write_archives(rows), 4096, payload=False).collect()
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
    assert got == want(rows.collect())
    assert warc.read_archives(warc.write_archives(rows.limit(0))).count() == 0


def test_members_are_standard_and_magic_inside_is_no_record(tmp_path):
    fake = gzip.compress(b"not a record")
    sha = hashlib.sha1(b"hello").hexdigest()
    first, second = warc.record(1, "u", b"hello", sha), warc.record(2, "u", b"hello", sha, 1, True)
    assert gzip.decompress(first + second).count(b"WARC/1.1") == 2
    blob = fake + b"\x1f\x8b\x08junk" + first + second + b"\x1f\x8b"
    path = tmp_path / "x.gz"
    path.write_bytes(blob)
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        for step in (1, 7, 50, len(blob)):
            found = [x for a in range(0, len(blob), step) for x in warc.scan_range(f, a, min(a + step, len(blob)), len(blob))]
            assert [(a, r["page_id"], r["record_type"]) for a, r in found] == [
                (len(blob) - 2 - len(first) - len(second), 1, "response"), (len(blob) - 2 - len(second), 2, "revisit")
            ]


def foreign(kind, name, block, content="application/http; msgtype=response", **more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<html>" + b"x" * 40 + b"</html>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(
        b"%x;a=b\r\n%s\r\n" % (len(p), p) for p in (body[:10], body[10:])) + b"0\r\n\r\n"
    blob = b"".join([
        foreign("warcinfo", "a", b"software: other\r\n", "application/warc-fields"),
        foreign("request", "b", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "application/http; msgtype=request", WARC_Target_URI="http://h/"),
        foreign("response", "c", chunked, WARC_Target_URI="http://h/", WARC_Payload_Digest="sha1:notbase32"),
        foreign("response", "d", b"HTTP/1.1 200 OK\r\n\r\n" + body, WARC_Target_URI="http://h/2", WARC_Payload_Digest="sha256:00"),
        foreign("revisit", "e", b"HTTP/1.1 304\r\n\r\n", WARC_Target_URI="http://h/", WARC_Refers_To="<urn:uuid:c>"),
        warc.record(7, "u", b"hello", hashlib.sha1(b"hello").hexdigest()),
    ])
    path = tmp_path / "other.warc.gz"
    path.write_bytes(blob)
    files = spark.createDataFrame([(str(path), len(blob))], "path string, length long")
    for split in (50, 1 << 20):
        rows = sorted(warc.read_archives(files, split).collect(), key=lambda r: r.offset)
        assert [(r.record_type, r.record_id, r.page_id) for r in rows[:5]] == [
            (k, f"<urn:uuid:{n}>", None) for k, n in zip(["warcinfo", "request", "response", "response", "revisit"], "abcde", strict=True)
        ]
        assert rows[5].page_id == 7 and rows[0].target_uri is None and bytes(rows[0].payload) == b"software: other\r\n"
        sha = hashlib.sha1(body).hexdigest()
        assert all(bytes(r.payload) == body and r.payload_bytes == len(body) and r.payload_digest == sha for r in rows[2:4])
        assert rows[4].payload is None and rows[4].payload_bytes is None and rows[4].payload_digest is None


def test_ranges_are_read_by_tasks_of_their_own(spark):
    rows = spark.range(400).selectExpr("id page_id", "'u' url", "repeat(uuid(), 40) html")
    files = warc.write_archives(rows.repartition(4))
    read = warc.read_archives(files, 4096, payload=False)
    n = sum(-(-r.length // 4096) for r in files.collect())
    assert n > 30 and read.rdd.getNumPartitions() == n and read.count() == 400
    assert sum(1 for p in read.rdd.glom().collect() if p) > n / 3


def test_chunks():
    assert warc.joined_chunks(b"") == b"" and warc.joined_chunks(b"plain") == b"plain"
    assert warc.joined_chunks(b"3\r\nabc\r\nff\r\nde") == b"abcde"
    assert warc.stated_digest("sha1:" + "0" * 40) == "0" * 40 and warc.stated_digest("md5:00") is None and warc.stated_digest("") is None
