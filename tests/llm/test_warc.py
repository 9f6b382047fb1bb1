"""WARC archives: exact round trips, foreign archives, odd input."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lapse.llm.warc import assemble, classify, read_records, sha1_base32, write_warc

END = b"\r\n\r\n"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"d": F.lit(1), "payload": F.lit("x"), "refers_to": F.lit(2)})


ROWS = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (7, "http://c/ü?x=%0A%250d", "<p>same</p>"), (4, None, None),
    (5, "http://e/\r\nX-Page-Id: 99", ""), (6, "http://f/", "line\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"),
    (8, "http://g/", "WARC/1.0\r\n"), (9, "http://h/", "é😀" * 50000), (10, "http://i/", "\r\n\r\n"), (None, "http://n/", "no id"),
    (11, "http://j/", "twice"), (11, "http://j/", "twice"), (12, "http://k/", "x\r\n" * 3),
]


def expected(rows, least=0):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(i if i is not None else -1, top.get(h or "", -1))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        other = top[h or ""] != (i if i is not None else -1) and len(data) >= least
        out.append((i, len(data), digest(data), "revisit" if other else "response", top[h or ""] if other else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression", ["none", "gzip"])
@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, tmp_dir, compression, least):
    path = f"{tmp_dir}/w"
    write_warc(classify(pages_of(spark, ROWS).repartition(2), min_bytes=least), path, compression)
    got = assemble(read_records(spark, path)).collect()
    assert sorted(((r.response.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.record_type,
                    r.response.refers_to) for r in got), key=str) == expected(ROWS, least)
    urls = {(i, u) for i, u, _ in ROWS}
    texts = {i: (h or "").encode() for i, _, h in ROWS}
    for r in got:
        assert (r.response.page_id, r.response.uri) in urls
        assert r.request.page_id == r.metadata.page_id == r.response.page_id and (r.n_requests, r.n_metadata) == (1, 1)
        if r.response.record_type == "response":
            assert bytes(r.response.payload) == texts[r.response.page_id]
        assert bytes(r.metadata.body) == b"payloadBytes: %d\r\n" % r.response.payload_bytes


def test_archives_are_valid_records(spark, tmp_dir):
    """Walk the bytes by Content-Length alone, as any WARC reader does."""
    path = f"{tmp_dir}/w"
    write_warc(classify(pages_of(spark, ROWS)), path)
    n = 0
    for name in os.listdir(path):
        if name.startswith("part-"):
            data = gzip.open(f"{path}/{name}").read()
            while data:
                assert data.startswith(b"WARC/1.0\r\n")
                head, rest = data.split(END, 1)
                length = int(head.lower().split(b"content-length: ")[1].split(b"\r\n")[0])
                assert rest[length:length + 4] == END
                data = rest[length + 4:]
                n += 1
    assert n == 3 * len(ROWS)


def record(kind, rid, block=b"", **headers):
    lines = [b"WARC/1.0", b"warc-type: " + kind, b"WARC-Record-ID: " + rid, *(
        k.replace("_", "-").encode() + b": " + v for k, vs in headers.items() for v in (vs if isinstance(vs, list) else [vs])),
        b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block + END


def test_foreign_archives(spark, tmp_dir):
    """Links in either direction and over another record; orphans; split files."""
    http = b"HTTP/1.1 200 OK\r\nA: b" + END
    body = (record(b"warcinfo", b"<i>", b"junk") + record(b"request", b"<q1>", b"GET", WARC_Concurrent_To=b"<r1>")
            + record(b"response", b"<r1>", http + b"one", WARC_Target_URI=b"http://one/")
            + record(b"metadata", b"<m1>", b"m", WARC_Concurrent_To=[b"<q1>", b"<gone>"])
            + record(b"response", b"<r2>", http + b"two", WARC_Concurrent_To=b"<q2>") + record(b"request", b"<q2>", b"GET")
            + record(b"metadata", b"<m9>", b"orphan", WARC_Concurrent_To=b"<nowhere>")
            + record(b"response", b"<r3>", http + b"x" * 200000 + b"WARC/1.0\r\n" + b"y" * 100)
            + record(b"request", b"<q0>", b"POST", WARC_Concurrent_To=b"<r1>"))
    os.makedirs(f"{tmp_dir}/w")
    with open(f"{tmp_dir}/w/a.warc", "wb") as f:
        f.write(body)
    with open(f"{tmp_dir}/w/b.warc", "wb") as f:
        f.write(b"no archive")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = {r.capture_id: r for r in assemble(read_records(spark, f"{tmp_dir}/w")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == {"<r1>", "<r2>", "<r3>", "<m9>"}
    assert got["<r1>"].request.record_id == "<q0>" and got["<r1>"].n_requests == 2 and got["<r1>"].metadata.record_id == "<m1>"
    assert bytes(got["<r1>"].response.payload) == b"one" and got["<r1>"].response.payload_digest == digest(b"one")
    assert got["<r2>"].request.record_id == "<q2>" and got["<r2>"].metadata is None
    assert got["<r3>"].response.payload_bytes == 200110 and got["<r3>"].request is None
    assert got["<m9>"].response is None and bytes(got["<m9>"].metadata.body) == b"orphan"


def test_no_rows(spark, tmp_dir):
    write_warc(classify(pages_of(spark, ROWS).limit(0)), f"{tmp_dir}/w")
    assert assemble(read_records(spark, f"{tmp_dir}/w")).count() == 0


def test_base32(spark):
    data = [bytes([i]) * i for i in range(40)]
    df = spark.createDataFrame([(bytearray(x),) for x in data], "b binary")
    assert {r.s for r in df.select(sha1_base32(F.col("b")).alias("s")).collect()} == {digest(x) for x in data}


def test_query(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = E.queries()["op1_warc_captures"](spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    assert all((r.n_requests, r.n_metadata) == (1, 1) for r in got)
