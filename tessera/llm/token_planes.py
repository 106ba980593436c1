"""Token-id files of transposed bit planes.

A file holds the ids of whole documents, cut into blocks of a fixed number of ids.
A block is transposed into planes: plane k is bit k or byte k of every id, packed. Byte
planes are the default: on ids of a BPE they came out smaller and several times cheaper.
Each plane is compressed with zstandard on its own; planes that are all zero take
no space. Layout (little-endian):

    magic "TKPLANE1"
    planes of block 0, block 1, ...
    table, zstandard: per document its key (8 bytes), key-is-null flag (1 byte) and
        number of ids (8 bytes), column by column
    index, zstandard: per block its place (8), number of ids (4), number of planes (4)
        and the compressed size of each of 32 planes (4 each)
    trailer: place of table, its size, place of index, its size, documents, blocks,
        plane kind (8 bytes each), magic

The chunk index lets a reader fetch one block. Documents are written in ascending
key order: a range partitioning gives each task a key range, tasks write files of a
bounded size into the shared folder, and the list of files is a small table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import arrow_schema, new_folder, open_file, texts_in, write_file
from tessera.session import materialize

MAGIC = b"TKPLANE1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22
TRAILER = struct.Struct("<7Q8s")
INDEX = np.dtype([("at", "<u8"), ("ids", "<u4"), ("planes", "<u4"), ("sizes", "<u4", 32)])
BITS, BYTES = 0, 1


def _compressor():
    import zstandard
    return zstandard.ZstdCompressor(level=3, write_content_size=True)


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block; trailing planes that are all zero are left out."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    width = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    raw = raw[:, :width]
    if kind == BYTES:
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1,
                                             bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTES:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.view("<u4").reshape(-1)
    out = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        bit = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        out |= bit.astype(np.uint32) << np.uint32(k)
    return out


class FileParts:
    """Turns documents' ids into the parts of one file; holds one block and one document."""

    def __init__(self, block: int, kind: int) -> None:
        self.block, self.kind, self.zstd = block, kind, _compressor()
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.index: list[tuple] = []
        self.at = len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.ids = 0

    def _pack(self, ids: np.ndarray) -> Iterator[bytes]:
        sizes = np.zeros(32, np.uint32)
        planes = to_planes(ids, self.kind)
        at = self.at
        for k, plane in enumerate(planes):
            if any(plane):
                data = self.zstd.compress(plane)
                sizes[k] = len(data)
                self.at += len(data)
                yield data
        self.index.append((at, len(ids), len(planes), sizes))

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            joined = np.concatenate(self.waiting)
            whole = self.held // self.block * self.block
            for at in range(0, whole, self.block):
                yield from self._pack(joined[at:at + self.block])
            self.waiting, self.held = [joined[whole:].copy()], self.held - whole

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield from self._pack(np.concatenate(self.waiting))
        keys = np.array([0 if k is None else k for k in self.keys], "<i8").tobytes()
        null = np.array([k is None for k in self.keys], np.uint8).tobytes()
        table = self.zstd.compress(keys + null + np.array(self.counts, "<u8").tobytes())
        index = self.zstd.compress(np.array(self.index, INDEX).tobytes())
        yield table
        yield index
        yield TRAILER.pack(self.at, len(table), self.at + len(table), len(index),
                           len(self.keys), len(self.index), self.kind, MAGIC)


def read_index(file) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Keys, ids per document, chunk index and plane kind of an open file."""
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    size = file.size()
    file.seek(size - TRAILER.size)
    table_at, table_n, index_at, index_n, docs, blocks, kind, magic = TRAILER.unpack(
        file.read(TRAILER.size))
    file.seek(0)
    if magic != MAGIC or file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token plane file")
    file.seek(table_at)
    table = unpack.decompress(file.read(table_n)) if docs else b""
    file.seek(index_at)
    index = np.frombuffer(unpack.decompress(file.read(index_n)), INDEX) if blocks else \
        np.zeros(0, INDEX)
    keys = np.frombuffer(table, "<i8", docs).tolist()
    null = np.frombuffer(table, np.uint8, docs, 8 * docs)
    counts = np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)
    return [None if n else k for k, n in zip(keys, null, strict=True)], counts, index, kind


def read_block(file, entry: np.void, kind: int) -> np.ndarray:
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    file.seek(int(entry["at"]))
    n, planes = int(entry["ids"]), []
    length = n if kind == BYTES else (n + 7) // 8
    for size in entry["sizes"][:int(entry["planes"])].tolist():
        planes.append(unpack.decompress(file.read(size)) if size else bytes(length))
    return from_planes(planes, n, kind)


def documents_in(file) -> Iterator[tuple[int | None, np.ndarray]]:
    """Every document of a file with its ids, one block in memory beside it."""
    keys, counts, index, kind = read_index(file)
    held, have, block = [np.zeros(0, np.uint32)], 0, 0
    for key, n in zip(keys, counts.tolist(), strict=True):
        while have < n:
            held.append(read_block(file, index[block], kind))
            have += len(held[-1])
            block += 1
        joined = np.concatenate(held) if len(held) != 1 else held[0]
        yield key, joined[:n]
        held, have = [joined[n:]], have - n


def write(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
          end_id: int | None = 2, folder: str | None = None, block: int = BLOCK_IDS,
          file_ids: int = FILE_IDS, kind: int = BYTES) -> DataFrame:
    """Encode and write all documents; one row per file: folder, part, number, name,
    documents, ids, bytes. Rows with equal keys are ordered by a hash of their texts, so a
    key that many rows share is spread over ranges like any other."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-planes")
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def save(batches):
        part = TaskContext.get().partitionId()
        rows = tokens.encoder(tokenizer).rows(texts_in(batches, "key", "text"))
        number, ahead = 0, next(rows, None)
        while ahead is not None:
            made = FileParts(block, kind)

            def parts(made=made):
                nonlocal ahead
                yield MAGIC
                while ahead is not None and made.ids < file_ids:
                    yield from made.add(ahead[0], np.concatenate([ahead[1], tail]))
                    ahead = next(rows, None)
                yield from made.close()

            name = f"{part:08d}-{number:06d}.tkp"
            size = write_file(folder, name, parts())
            yield pa.RecordBatch.from_pylist([{
                "folder": folder, "part": part, "number": number, "name": name,
                "documents": len(made.keys), "ids": made.ids, "bytes": size}])
            number += 1

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "_tie").sortWithinPartitions("key", "_tie", "text")
    return materialize(ordered.mapInArrow(
        save, "folder string, part long, number long, name string, documents long, "
              "ids long, bytes long"), "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """Adds ``start``, the ids in all files before: totals of the parts first (as many
    rows as the range partitioning has partitions), then the files of each part."""
    totals = files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = (Window.partitionBy("part").orderBy("number")
              .rowsBetween(Window.unboundedPreceding, -1))
    return files.join(totals, "part").select(
        *files.columns,
        (F.col("base") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("start"))


def read(files: DataFrame, tell: Callable[[np.ndarray], dict] | None = None,
         schema: str = "ids array<long>") -> DataFrame:
    """Documents of the files: key, start, n_tokens and what ``tell`` makes of the ids
    (by default the ids themselves)."""
    tell = tell or (lambda ids: {"ids": ids.tolist()})

    def load(batches):
        for folder, name, start in texts_in(batches, "folder", "name", "start"):
            rows = []
            with open_file(folder, name) as file:
                for key, ids in documents_in(file):
                    rows.append({"key": key, "start": start, "n_tokens": len(ids)} | tell(ids))
                    start += len(ids)
                    if len(rows) == 512:
                        yield from _rows(rows, out)
                        rows = []
            yield from _rows(rows, out)

    out = arrow_schema(f"key long, start long, n_tokens long, {schema}")
    listed = with_starts(files).select("folder", "name", "start")
    # One task a file at most: the list is small, the files are not.
    spread = listed.repartition(max(1, min(files.count(), 10_000)), "name")
    return spread.mapInArrow(load, f"key long, start long, n_tokens long, {schema}")


def _rows(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def crc32_of(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())}
