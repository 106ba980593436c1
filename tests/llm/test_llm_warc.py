import base64
import gzip
import hashlib
import io
from collections import Counter, defaultdict

import pytest

from tessera.llm import warc

ROWS = [(1, "http://a/", "same"), (2, None, "same"), (9, "http://b/\r\nX: y", "same"),
        (3, "http://c/", ""), (4, "http://d/", None), (5, "http://e/", "long é\r\n\r\n" * 9000),
        (6, "http://f/", "long é\r\n\r\n" * 9000), (7, "http://g/", "0\r\n\r\nWARC/1.1\r\n\r\n"),
        (8, "http://h/", "x" * 70_000), (8, "http://h/", "x" * 70_000), (None, "http://n/", "null key")]


def pages(spark, rows=ROWS):
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("key", "payload", "digest", "length", "sha1", "n", "holder")})


def expected(rows, least):
    best = defaultdict(lambda: -1)
    for key, _, html in rows:
        best[html or ""] = max(best[html or ""], -1 if key is None else key)
    out = Counter()
    for key, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= least and best[html or ""] != (-1 if key is None else key)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[key, len(data), digest, "revisit" if again else "response",
            best[html or ""] if again else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    files = warc.write(pages(spark).repartition(2), revisit_bytes=least, segment_bytes=1000,
                       file_bytes=2000)
    got = warc.read(files).collect()
    assert Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in got) == expected(ROWS, least)
    html = {key: (h or "").encode() for key, _, h in ROWS}
    for r in got:
        assert r.payload is None if r.record_type == "revisit" else r.payload == html[r.key]


def test_empty_table(spark):
    assert warc.read(warc.write(pages(spark, []))).count() == 0


def test_chunked_framing():
    for size in (1, 3, 8192):
        for data in (b"", b"a", b"0\r\n\r\n" * 50):
            assert warc.from_chunked(warc.to_chunked(data, size)) == data
    assert warc.from_chunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"5\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.from_chunked(broken)
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi") == b"hi"


def segments():
    payload = b"payload " * 100
    block = warc.HTTP_HEAD + warc.to_chunked(payload, 64)
    fields = {"WARC-Record-ID": "<urn:uuid:1>", "WARC-Payload-Digest": "sha1:x"}
    out = []
    for raw in warc.response_records(fields, block, 100):
        f, b = warc.parse_record(raw)
        out.append({"number": int(f["WARC-Segment-Number"]), "block": b,
                    "total": int(f["WARC-Segment-Total-Length"])
                    if "WARC-Segment-Total-Length" in f else None,
                    "head": "WARC-Record-ID: <urn:uuid:1>" if f["WARC-Type"] == "response" else None})
        assert f["WARC-Type"] == "response" or f["WARC-Segment-Origin-ID"] == "<urn:uuid:1>"
    return payload, out


def test_segments_in_any_order_and_damage():
    payload, parts = segments()
    assert len(parts) > 5
    assert warc.assembled(parts[::-1])[1] == payload
    for broken in (parts[:-1], parts[1:], [*parts[:2], *parts[3:]], [*parts, parts[2]],
                   [*parts[:-1], parts[-1] | {"block": parts[-1]["block"][:-1]}]):
        with pytest.raises(ValueError):
            warc.assembled(broken)


def test_members_across_reads(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    data = [b"one", b"", b"two" * 1000]
    file = io.BytesIO(b"".join(map(warc.gzipped, data)))
    assert list(warc.members_of(file)) == data
    assert gzip.decompress(file.getvalue()) == b"".join(data)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members_of(io.BytesIO(warc.gzipped(b"x" * 5000)[:-9])))


# The digest in SQL. It is a test and no registered twin: clients read a column of whole
# numbers that is null in every row in different types.
DIGEST_SQL = r"""
WITH raw AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hex AS (SELECT *, sha1(body) AS h, strlen(body) AS n, max(page_id) OVER (PARTITION BY body) AS holder FROM raw),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111',
           4 * (instr('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), '') AS b FROM hex)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    list_sum(list_transform(range(1, 6), lambda j:
      CAST(substr(b, 5 * i + j, 1) AS INTEGER) * CAST(2 ** (5 - j) AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM bits"""


def test_query_matches_sql(spark, tmp_path):
    import duckdb

    from tessera.llm.queries import QUERIES
    rows = [r for r in ROWS[:9] if r[0] is not None]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet")
    told = QUERIES["op10_warc_segments"](spark, str(tmp_path))
    cols = sorted(told.columns)
    con = duckdb.connect()
    for folder in (f"{tmp_path}/pages.parquet/*.parquet", "/root/testdata/sf0.01/pages.parquet"):
        con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{folder}'")
        if "testdata" in folder:
            told = QUERIES["op10_warc_segments"](spark, "/root/testdata/sf0.01")
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({DIGEST_SQL})").fetchall()
        assert sorted((tuple(r[c] for c in cols) for r in told.collect()), key=repr) == sorted(
            want, key=repr)
