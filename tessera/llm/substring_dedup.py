"""Removal of repeated passages: fixed-block anchors, extended to exact repeats.

A window is ``window`` consecutive words of one document; it is a repeat if the same word
sequence starts earlier (smaller key, or same document, earlier place). Every word
that a repeat covers is removed. Windows are judged on the input.

Every document is cut into non-overlapping blocks of ``window // 2`` words. Any window
holds a whole block of its own document, so two equal windows always meet in a block:

1. Chunks. Documents go in chunks of bounded size to a written table, words separated
   by one space. A chunk is what tasks work on and what answers are sent back to.
2. Index and probes. The anchors (blocks) and the probes (every rolling window of a
   block's length) of a chunk are hashed, sorted and made distinct inside the
   chunk, then dealt by hash range into buckets. A bucket holds the index of anchors
   and answers each chunk with one bit per probe: an anchor that occurs again.
3. Extension. A hit is extended to all full windows around it: a window can only be a
   repeat or be repeated if it holds a hit. These are the candidates; each chunk sends the distinct 96-bit
   fingerprints of its candidates with the first key that holds them. Buckets find the earliest
   and answer with one bit per fingerprint: it starts earlier in another chunk.
4. Consecutive repeats join into maximal repeated spans, which are cut out.

A passage that a third of all documents share is one entry per chunk in one bucket,
and no pairs of occurrences are ever formed. Hash widths follow the number of words, so
false meetings in step 2 stay rare (they cost a candidate, never a wrong result);
step 3 compares 96 bits of two independent hashes. A bucket's rows are bounded by
``bucket_entries`` on average.

Null texts have no words. Rows with equal keys are ordered by chunk and place in it; null
keys come first. A document is held by one task as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, mix64, powers, rolling, texts_in
from tessera.session import materialize

WINDOW = 20
CHUNK_BYTES = 1 << 20
BUCKET_ENTRIES = 2 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NULL_KEY = -(1 << 63)
CHUNK = "chunk long, words long, keys array<long>, blob binary"
ENTRY = "bucket long, chunk long, n long, data binary"
ANSWER = "chunk long, kind int, bucket long, n long, bits binary"


# -- chunks --------------------------------------------------------------------------

def chunks_of(docs: DataFrame, key: str, text: str, chunk_bytes: int) -> DataFrame:
    schema = arrow_schema(CHUNK)

    def run(batches):
        import zstandard
        squeeze, part, number = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        rows, size = [], 0

        def made():
            rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            blob = b"".join(line + b"\n" for _, line in rows)
            words = sum(line.count(b" ") + 1 for _, line in rows if line)
            return pa.RecordBatch.from_pylist([{
                "chunk": (part << 32) + number, "words": words, "keys": [k for k, _ in rows],
                "blob": squeeze.compress(blob)}], schema=schema)

        for k, t in texts_in(batches, "key", "text"):
            line = b" ".join(t.encode("utf-8", "surrogatepass").split()) if t else b""
            rows.append((k, line))
            size += len(line) + 1
            if size >= chunk_bytes:
                yield made()
                rows, size, number = [], 0, number + 1
        if rows:
            yield made()

    return materialize(docs.select(F.col(key).cast("long").alias("key"),
                                   F.col(text).alias("text")).mapInArrow(run, CHUNK), "chunks")


class Words:
    """The words of a chunk: places in the blob, document of each, hashes."""

    def __init__(self, blob: bytes) -> None:
        import zstandard
        self.blob = zstandard.ZstdDecompressor().decompress(blob)
        raw = np.frombuffer(self.blob, np.uint8)
        line = raw == 10
        cut = np.flatnonzero((raw == 32) | line)
        start = np.concatenate([[0], cut[:-1] + 1])
        doc = np.cumsum(line[cut]) - line[cut]
        self.docs = int(line.sum())
        held = cut > start
        self.start, self.end, self.doc = start[held], cut[held], doc[held]
        self.raw = raw
        # First word of each document, and one past its last.
        self.first = np.searchsorted(self.doc, np.arange(self.docs), "left")
        self.last = np.searchsorted(self.doc, np.arange(self.docs), "right")

    def hashes(self, which: int) -> np.ndarray:
        size = 1 << max(16, (len(self.raw) - 1).bit_length())
        power, back = powers(BASES[which], size)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[:len(self.raw)],
                  out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * back[self.start]
        return mix64(value + (self.end - self.start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Which places begin a window that stays inside its document."""
        n = len(self.doc) - size + 1
        return self.doc[:n] == self.doc[size - 1:] if n > 0 else np.zeros(0, bool)


@dataclass(frozen=True)
class Plan:
    window: int
    bits: int           # of a probe's hash
    buckets: int        # log2, for probes
    later: int          # log2, for fingerprints

    @property
    def block(self) -> int:
        return self.window // 2


def plan_for(words: int, window: int, bucket_entries: int) -> Plan:
    bits = min(60, max(32, words.bit_length() + 8))
    buckets = max(6, (-(-words // bucket_entries) - 1).bit_length())
    return Plan(window, bits, min(buckets, bits - 8), max(5, buckets - 1))


# -- probes ----------------------------------------------------------------------------

class Probes:
    """Distinct probes of a chunk, sorted; ``place`` maps each window to its probe."""

    def __init__(self, words: Words, plan: Plan) -> None:
        size = plan.block
        inside = words.windows(size)
        self.at = np.flatnonzero(inside)
        self.count = len(inside)
        value = mix64(rolling(words.hashes(0), size, BASES[0])[self.at])
        value >>= np.uint64(64 - plan.bits)
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.edge = np.flatnonzero(new)
        self.value = ranked[self.edge]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        aligned = (self.at - words.first[words.doc[self.at]]) % size == 0
        self.anchored = np.logical_or.reduceat(aligned[order], self.edge) if len(order) else \
            np.zeros(0, bool)
        self.several = np.diff(self.edge, append=len(order)) > 1
        self.limits = bucket_limits(self.value, plan.bits, plan.buckets)


def bucket_limits(value: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Places in a sorted array where each of 2**buckets hash ranges begins, and the end."""
    width = np.uint64(bits - buckets)
    begins = np.arange(1 << buckets, dtype=np.uint64) << width
    return np.append(np.searchsorted(value, begins), len(value))


def squeeze_sorted(value: np.ndarray, squeeze) -> bytes:
    """Sorted 64-bit numbers as differences, byte plane by byte plane."""
    step = np.diff(value, prepend=np.uint64(0))
    return squeeze.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def planes(value: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(value.view(np.uint8).reshape(-1, width).T).tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(
        kind).reshape(-1)


def _pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)


def probe_rows(chunk: int, blob: bytes, plan: Plan) -> Iterator[dict]:
    import zstandard
    squeeze = zstandard.ZstdCompressor(level=1)
    probes = Probes(Words(blob), plan)
    for b in np.flatnonzero(np.diff(probes.limits)).tolist():
        i, j = int(probes.limits[b]), int(probes.limits[b + 1])
        flags = _pack(np.concatenate([probes.anchored[i:j], probes.several[i:j]]))
        yield {"bucket": b, "chunk": chunk, "n": j - i,
               "data": flags + squeeze_sorted(probes.value[i:j], squeeze)}


def answer_probes(rows: list[dict]) -> Iterator[dict]:
    """A bit for each probe of each chunk: it meets an anchor and occurs more than once."""
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    value, anchored, several = [], [], []
    for r in rows:
        n = r["n"]
        head = (2 * n + 7) // 8
        flags = _unpack(r["data"][:head], 2 * n)
        anchored.append(flags[:n])
        several.append(flags[n:])
        value.append(np.cumsum(unplaned(unpack.decompress(r["data"][head:]), "<u8"),
                               dtype=np.uint64))
    sizes = [len(v) for v in value]
    value, anchored, several = map(np.concatenate, (value, anchored, several))
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    edge = np.flatnonzero(new)
    hit = np.logical_or.reduceat(anchored[order], edge) & (
        (np.diff(edge, append=len(order)) > 1) | np.logical_or.reduceat(several[order], edge))
    told = np.empty(len(order), bool)
    told[order] = hit[np.cumsum(new) - 1]
    at = 0
    for r, n in zip(rows, sizes, strict=True):
        if told[at:at + n].any():
            yield {"chunk": r["chunk"], "kind": 1, "bucket": r["bucket"], "n": n,
                   "bits": _pack(told[at:at + n])}
        at += n


# -- candidates ------------------------------------------------------------------------

class Candidates:
    """Windows around hits, and their distinct fingerprints."""

    def __init__(self, words: Words, plan: Plan, answers: list[dict]) -> None:
        probes = Probes(words, plan)
        hit = np.zeros(len(probes.value), bool)
        for a in answers:
            i = int(probes.limits[a["bucket"]])
            hit[i:i + a["n"]] = _unpack(a["bits"], a["n"])
        per_place = np.zeros(probes.count, bool)
        per_place[probes.at] = hit[probes.place]
        inside = words.windows(plan.window)
        span = plan.window - plan.block + 1
        sums = np.concatenate([[0], np.cumsum(per_place)])
        hits = sums[span:span + len(inside)] - sums[:len(inside)]
        self.at = np.flatnonzero(inside & (hits > 0))
        high = mix64(rolling(words.hashes(0), plan.window, BASES[1])[self.at])
        low = mix64(rolling(words.hashes(1), plan.window, BASES[0])[self.at])
        low = (low >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((self.at, low, high))
        high, low = high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        edge = np.flatnonzero(new)
        self.high, self.low = high[edge], low[edge]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.first = np.zeros(len(order), bool)
        self.first[order[edge]] = True
        self.first_doc = words.doc[self.at[order[edge]]]
        self.limits = bucket_limits(self.high, 64, plan.later)


def candidate_rows(chunk: int, keys: list, blob: bytes, plan: Plan,
                   answers: list[dict]) -> Iterator[dict]:
    import zstandard
    if not answers:
        return
    squeeze = zstandard.ZstdCompressor(level=1)
    found = Candidates(Words(blob), plan, answers)
    key = np.array([NULL_KEY if k is None else k for k in keys], "<i8")[found.first_doc]
    for b in np.flatnonzero(np.diff(found.limits)).tolist():
        i, j = int(found.limits[b]), int(found.limits[b + 1])
        parts = (squeeze_sorted(found.high[i:j], squeeze), found.low[i:j].tobytes(),
                 squeeze.compress(planes(key[i:j], 8)))
        yield {"bucket": b, "chunk": chunk, "n": j - i,
               "data": b"".join([len(parts[0]).to_bytes(4, "little"), *parts])}


def answer_candidates(rows: list[dict]) -> Iterator[dict]:
    """A bit for each fingerprint of each chunk: another chunk holds it earlier."""
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    high, low, key, chunk, sizes = [], [], [], [], []
    for r in rows:
        data, n = r["data"], r["n"]
        one = 4 + int.from_bytes(data[:4], "little")
        high.append(np.cumsum(unplaned(unpack.decompress(data[4:one]), "<u8"), dtype=np.uint64))
        low.append(np.frombuffer(data, "<u4", n, one))
        key.append(unplaned(unpack.decompress(data[one + 4 * n:]), "<i8"))
        chunk.append(np.full(n, r["chunk"]))
        sizes.append(n)
    high, low, key, chunk = map(np.concatenate, (high, low, key, chunk))
    order = np.lexsort((chunk, key, low, high))
    high, low = high[order], low[order]
    again = np.zeros(len(order), bool)
    again[1:] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    told = np.empty(len(order), bool)
    told[order] = again
    at = 0
    for r, n in zip(rows, sizes, strict=True):
        if told[at:at + n].any():
            yield {"chunk": r["chunk"], "kind": 2, "bucket": r["bucket"], "n": n,
                   "bits": _pack(told[at:at + n])}
        at += n


# -- result ----------------------------------------------------------------------------

def report_rows(keys: list, blob: bytes, plan: Plan, answers: list[dict],
                with_text: bool) -> Iterator[dict]:
    words = Words(blob)
    covered = np.zeros(len(words.doc) + 1, np.int64)
    if any(a["kind"] == 1 for a in answers):
        found = Candidates(words, plan, [a for a in answers if a["kind"] == 1])
        later = np.zeros(len(found.high), bool)
        for a in answers:
            if a["kind"] == 2:
                i = int(found.limits[a["bucket"]])
                later[i:i + a["n"]] = _unpack(a["bits"], a["n"])
        gone = found.at[~found.first | later[found.place]]
        np.add.at(covered, gone, 1)
        np.add.at(covered, gone + plan.window, -1)
    removed = np.cumsum(covered[:-1]) > 0
    for d, key in enumerate(keys):
        i, j = int(words.first[d]), int(words.last[d])
        gone = removed[i:j]
        lost = int(gone.sum())
        if not lost:
            kept = words.blob[int(words.start[i]):int(words.end[j - 1])] if j > i else b""
        else:
            stay = i + np.flatnonzero(~gone)
            kept = b" ".join([words.blob[a:b] for a, b in zip(
                words.start[stay].tolist(), words.end[stay].tolist(), strict=True)])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        yield {"key": key, "n_words": j - i, "n_removed": lost,
               "spans": [{"start": int(a), "words": int(b - a)}
                         for a, b in zip(edges[::2], edges[1::2], strict=True)],
               "kept_sha256": hashlib.sha256(kept).hexdigest(),
               "kept_text": kept.decode("utf-8", "surrogatepass") if with_text else None}


RESULT = ("key long, n_words long, n_removed long, spans array<struct<start: long, words: long>>, "
          "kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   window: int = WINDOW, with_text: bool = True,
                   chunk_bytes: int = CHUNK_BYTES,
                   bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per input row: key, n_words, n_removed, spans (start and number of words),
    kept_sha256 and, if asked for, kept_text (kept words joined by one space)."""
    if window < 2 or window % 2:
        raise ValueError("the window must be an even number of words")
    chunks = chunks_of(docs, key, text, chunk_bytes)
    plan = plan_for(chunks.agg(F.sum("words")).first()[0] or 0, window, bucket_entries)
    entry, answer, result = map(arrow_schema, (ENTRY, ANSWER, RESULT))

    def batched(rows: Iterator[dict], schema: pa.Schema):
        held = []
        for r in rows:
            held.append(r)
            if len(held) == 256:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    def probes(batches):
        for chunk, blob in texts_in(batches, "chunk", "blob"):
            yield from batched(probe_rows(chunk, blob, plan), entry)

    def meet(table):
        return pa.Table.from_pylist(list(answer_probes(table.to_pylist())), schema=answer)

    def extend(left, right):
        rows = [r for c in left.to_pylist()
                for r in candidate_rows(c["chunk"], c["keys"], c["blob"], plan, right.to_pylist())]
        return pa.Table.from_pylist(rows, schema=entry)

    def settle(table):
        return pa.Table.from_pylist(list(answer_candidates(table.to_pylist())), schema=answer)

    def report(left, right):
        rows = [r for c in left.to_pylist()
                for r in report_rows(c["keys"], c["blob"], plan, right.to_pylist(), with_text)]
        return pa.Table.from_pylist(rows, schema=result)

    by_chunk = chunks.groupBy("chunk")
    told = materialize(chunks.select("chunk", "blob").mapInArrow(probes, ENTRY)
                       .groupBy("bucket").applyInArrow(meet, ANSWER), "probe-answers")
    found = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(extend, ENTRY)
    settled = materialize(found.groupBy("bucket").applyInArrow(settle, ANSWER), "repeat-answers")
    both = told.unionByName(settled)
    out = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(report, RESULT)
    return out if with_text else out.drop("kept_text")
