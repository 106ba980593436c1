"""WARC archives with segmented records, written and read by Spark tasks.

Writing: a page is an HTTP response with chunked transfer framing. A response
block longer than ``segment_bytes`` is cut into a first record (segment number 1)
and ``continuation`` records that name the first as their origin; the last one
carries the total length. Records are gzip members of their own. Of pages with
equal payloads (at least ``revisit_bytes`` long) the one with the largest key is
written as response and the others as ``revisit`` records without a block.

Reading: tasks stream through the files, member by member. A record that is whole
is decoded on the spot; segments go to one group per origin identifier (one
record's segments, never more), are ordered by number, checked for gaps and
against the total length, and only then de-framed.

Null payloads are empty. Rows with equal key and payload each get a record of the
same kind. A null key sorts before all others. Damaged archives (a missing
segment, a wrong length, a broken chunk frame or digest) raise ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import (
    arrow_schema,
    new_folder,
    open_file,
    probable_set,
    texts_in,
    with_probable,
    write_file,
)
from tessera.session import materialize

SEGMENT_BYTES = 8 << 10
CHUNK_BYTES = 8 << 10
FILE_BYTES = 32 << 20
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
HTTP_HEAD = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             b"Transfer-Encoding: chunked\r\n\r\n")
END = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- framing ---------------------------------------------------------------------

def to_chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def from_chunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body ends inside a frame")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)  # trailers, if any, are not payload
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter or longer than its frame says")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("response block without an HTTP head")
    chunked = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked"
                  for line in head.split(b"\r\n")[1:])
    return from_chunked(body) if chunked else body


def record(fields: dict[str, str | int | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None),
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def gzipped(data: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def response_records(fields: dict, block: bytes, segment_bytes: int) -> Iterator[bytes]:
    """One record, or a first segment and its continuations."""
    if len(block) <= segment_bytes:
        yield record({"WARC-Type": "response", **fields}, block)
        return
    origin = fields["WARC-Record-ID"]
    for number, at in enumerate(range(0, len(block), segment_bytes), start=1):
        part = block[at:at + segment_bytes]
        last = at + segment_bytes >= len(block)
        if number == 1:
            head = {"WARC-Type": "response", **fields, "WARC-Segment-Number": 1}
        else:
            own = uuid.uuid5(uuid.NAMESPACE_URL, f"{origin}/{number}")
            head = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{own}>",
                    "WARC-Date": DATE, "WARC-Segment-Origin-ID": origin,
                    "WARC-Segment-Number": number,
                    "WARC-Segment-Total-Length": len(block) if last else None}
        yield record(head, part)


# -- writing ---------------------------------------------------------------------

def plan_records(pages: DataFrame, key: str = "page_id", payload: str = "html",
                 url: str | None = "url", revisit_bytes: int = 0) -> DataFrame:
    """key, url, payload (null for a revisit), length, sha1, refers_to, revisit.

    Only digests are exchanged to find equal payloads. The digests that occur more than
    once are a written table; a page whose digest is certainly not among them, by a
    bounded set of hashes, stays in its partition, the others meet the table."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("key"),
        (F.col(url) if url else F.lit(None)).cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumns({"length": F.octet_length("payload").cast("long"),
                             "digest": F.sha2("payload", 256)})
    equal = materialize(
        rows.where(F.col("length") >= revisit_bytes).groupBy("digest")
            .agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("holder"))
            .where("n > 1").select("digest", "holder"), "warc-equal")
    marked = with_probable(rows, probable_set(equal, "digest"), "digest")
    sure = marked.where("NOT _probable").withColumns(
        {"holder": F.col("key"), "shared": F.lit(False)})
    doubtful = marked.where("_probable").join(
        equal.withColumn("shared", F.lit(True)), "digest", "left")
    again = F.coalesce("shared", F.lit(False)) & ~F.col("key").eqNullSafe(F.col("holder"))
    return sure.unionByName(doubtful).withColumn("revisit", again).select(
        "key", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "length",
        F.when(F.col("revisit"), F.sha1("payload")).alias("sha1"),
        F.when(F.col("revisit"), F.col("holder")).alias("refers_to"), "revisit")


def write(pages: DataFrame, key: str = "page_id", payload: str = "html",
          url: str | None = "url", revisit_bytes: int = 0, folder: str | None = None,
          segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one WARC record per page; returns the files: folder, name, records, bytes."""
    folder = folder or new_folder(pages.sparkSession, "warc")

    def save(batches):
        part = TaskContext.get().partitionId()
        rows = texts_in(batches, "key", "url", "payload", "length", "sha1", "refers_to", "revisit")
        number, row, ahead = 0, 0, next(rows, None)
        while ahead is not None:
            count = 0

            def members():
                nonlocal ahead, row, count
                size = 0
                yield gzipped(record({"WARC-Type": "warcinfo", "WARC-Date": DATE,
                                      "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                                      "Content-Type": "application/warc-fields"},
                                     b"format: WARC File Format 1.1\r\n"))
                while ahead is not None and size < file_bytes:
                    for raw in page_records(*ahead, f"{folder}/{part}/{row}", segment_bytes):
                        data = gzipped(raw)
                        size += len(data)
                        yield data
                    row, count, ahead = row + 1, count + 1, next(rows, None)

            name = f"{part:08d}-{number:06d}.warc.gz"
            size = write_file(folder, name, members())
            yield pa.RecordBatch.from_pylist([{"folder": folder, "name": name,
                                               "records": count, "bytes": size}])
            number += 1

    plan = plan_records(pages, key, payload, url, revisit_bytes)
    return materialize(plan.mapInArrow(
        save, "folder string, name string, records long, bytes long"), "warc-files")


def page_records(key, url, payload, length, sha1, refers_to, revisit, place,
                 segment_bytes) -> Iterator[bytes]:
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"
    uri = "".join(c for c in url or "" if c.isprintable()) or None
    digest = (base64.b32encode(bytes.fromhex(sha1)).decode() if revisit
              else base32_sha1(payload))
    fields = {"WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": uri,
              "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Key": key,
              "X-Payload-Length": length}
    if revisit:
        yield record({"WARC-Type": "revisit", **fields, "X-Refers-To-Key": refers_to,
                      "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/"
                                      "identical-payload-digest"}, b"")
    else:
        fields["Content-Type"] = "application/http; msgtype=response"
        yield from response_records(fields, HTTP_HEAD + to_chunked(payload), segment_bytes)


# -- reading ---------------------------------------------------------------------

def members_of(file) -> Iterator[bytes]:
    """Decompressed gzip members of a file, one in memory at a time."""
    unpack, out = zlib.decompressobj(31), []
    while data := file.read(READ_BYTES):
        while data:
            out.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(out)
                unpack, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("archive ends inside a member")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = data.partition(END)
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + len(END) or rest[size:] != END:
        raise ValueError("record is shorter or longer than its Content-Length")
    return fields, rest[:size]


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _page(fields: dict[str, str], payload: bytes | None) -> dict:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base32_sha1(payload) != digest:
        raise ValueError("payload does not match its digest")
    return {"key": _number(fields.get("X-Page-Key")), "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"], "payload": payload,
            "payload_bytes": int(fields["X-Payload-Length"]) if payload is None else len(payload),
            "payload_digest": digest, "refers_to": _number(fields.get("X-Refers-To-Key"))}


RECORD = ("key long, url string, record_type string, payload binary, payload_bytes long, "
          "payload_digest string, refers_to long")
SEGMENT = "origin string, number long, total long, head string, block binary"


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every page of the archives: key, url, record_type, payload (null for a
    revisit), payload_bytes, payload_digest, refers_to."""
    schema = arrow_schema(RECORD)
    pieces = arrow_schema(SEGMENT)
    spread = files.select("folder", "name").repartition(
        max(1, min(files.count(), 10_000)), "name")

    def whole(batches):
        for rows in _parts(batches, lambda f: f["WARC-Type"] in ("response", "revisit")
                           and "WARC-Segment-Number" not in f):
            made = [_page(f, None if f["WARC-Type"] == "revisit" else payload_of(b))
                    for f, b in rows]
            yield pa.RecordBatch.from_pylist(
                made if with_payload else [m | {"payload": None} for m in made], schema=schema)

    def segments(batches):
        for rows in _parts(batches, lambda f: "WARC-Segment-Number" in f):
            yield pa.RecordBatch.from_pylist([{
                "origin": f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]),
                "number": int(f["WARC-Segment-Number"]),
                "total": _number(f.get("WARC-Segment-Total-Length")),
                "head": "\n".join(f"{k}: {v}" for k, v in f.items())
                if f["WARC-Type"] != "continuation" else None,
                "block": b} for f, b in rows], schema=pieces)

    def reassemble(rows):
        made = _page(*assembled(rows.to_pylist()))
        return pa.Table.from_pylist([made if with_payload else made | {"payload": None}],
                                    schema=schema)

    cut = spread.mapInArrow(segments, SEGMENT).groupBy("origin").applyInArrow(reassemble, RECORD)
    return spread.mapInArrow(whole, RECORD).unionByName(cut)


def assembled(segments: list[dict]) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one segmented record."""
    segments = sorted(segments, key=lambda s: s["number"])
    if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments of a record are missing or repeated")
    block = b"".join(s["block"] for s in segments)
    if segments[-1]["total"] != len(block) or segments[0]["head"] is None:
        raise ValueError("segments do not add up to the total length")
    fields = dict(line.split(": ", 1) for line in segments[0]["head"].split("\n"))
    return fields, payload_of(block)


def _parts(batches, wanted) -> Iterator[list[tuple[dict[str, str], bytes]]]:
    for folder, name in texts_in(batches, "folder", "name"):
        rows, size = [], 0
        with open_file(folder, name) as file:
            for member in members_of(file):
                fields, block = parse_record(member)
                if wanted(fields):
                    rows.append((fields, block))
                    size += len(block)
                    if size > READ_BYTES or len(rows) == 512:
                        yield rows
                        rows, size = [], 0
        if rows:
            yield rows
