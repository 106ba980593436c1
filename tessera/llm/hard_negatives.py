"""Hard negatives for contrastive training, by a secondary-sort shuffle.

Vectors are quantised to whole numbers (``floor(scale * x)``), so scores are exact integers.
Anchors are a stated set of query rows; they meet all rows in blocks:

1. the anchors are written once to the shared folder; every task reads them there a
   bounded batch at a time and multiplies them with a bounded block of its own rows;
2. first pass: of each block the best rows of the anchor's own label, reduced to the
   first ``positives`` of each anchor by (score, id);
3. second pass: with the positives known, each block yields for each open window
   ``[lower * s, upper * s]`` of a positive with score s its first ``negatives`` rows of
   another label. A row that is not among a block's first ones cannot be among the first of
   all, so nothing is lost, and what is shuffled is a few pairs for an anchor and block;
4. positives and candidates become packed keys (anchor, descending score, kind, id) and go
   through ``repartitionAndSortWithinPartitions``. A streaming iterator reads each partition in
   key order: a positive opens its window, a negative is emitted for every open window
   that holds it, until the window has enough. It keeps one anchor's windows, never its rows.

The order within an anchor puts positives before negatives of the same score (``kind``), so a
window is always open before a row of it comes: a window's upper end is at most the score
of its positive.

Defined cases: rows without a key, label or vector, or with a null or non-finite component,
take no part. Vectors of different lengths are as if filled up with zeros; an empty vector
scores 0. Ties go to the smaller key. Repeated rows are rows of their own, but rows with the
anchor's own key are no others to it, and of several rows with an anchor's key the one with
the least label, then least vector, is the anchor. Further columns are left out. No rows give
an empty result. A score beyond 64 bits is refused with an ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MASK64, filesystem_path
from tessera.session import materialize

SCALE = 256
ROW_BLOCK, ANCHOR_BATCH = 8192, 256
#: Windows as shares of a positive's score, in hundredths.
LOWER, UPPER, DEN = 50, 95, 100
PACKED = np.dtype([("anchor", ">u8"), ("falling", ">u8"), ("kind", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1
SIGN = np.uint64(1 << 63)
OUT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
       "negative_score long")


# -- vectors -------------------------------------------------------------------------

class Block:
    """Rows in key order: keys, labels and quantised vectors, filled up with zeros."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((labels, ids))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.peak = float(np.abs(vectors).max()) if vectors.size else 0.0

    def __len__(self) -> int:
        return len(self.ids)


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can take part, their vectors as doubles)."""
    if len(vectors) == 0:
        return np.zeros(0, bool), np.zeros((0, 0))
    start = vectors.offsets.to_numpy()
    values = vectors.values.cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)  # null components become NaN
    size = np.diff(start)
    here = ~np.asarray(vectors.is_null())
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    here &= bad[start[1:]] == bad[start[:-1]]
    size, first = size[here], start[:-1][here]
    width = int(size.max()) if len(size) else 0
    if len(size) and (size == width).all():
        return here, flat[first[:, None] + np.arange(width)]
    out = np.zeros((len(size), width))
    for k, (i, n) in enumerate(zip(first, size, strict=True)):
        out[k, :n] = flat[i:i + n]
    return here, out


def _blocks(batches: Iterable[pa.RecordBatch], scale: float, size: int) -> Iterator[Block]:
    """The rows that take part, a bounded block at a time."""
    def ready(parts):
        width = max(p[2].shape[1] for p in parts)
        wide = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, _, v in parts]
        return Block(np.concatenate([p[0] for p in parts]),
                     np.concatenate([p[1] for p in parts]), np.concatenate(wide))

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids, labels, vectors = (part.column(k) for k in range(3))
            here, matrix = _matrix(vectors)
            named = ~(np.asarray(ids.is_null()) | np.asarray(labels.is_null()))
            both = here & named
            if not both.any():
                continue
            held.append((ids.filter(pa.array(both)).to_numpy(), labels.filter(pa.array(both))
                         .to_numpy(), np.floor(scale * matrix[named[here]])))
            n += len(held[-1][0])
            if n >= size:
                yield ready(held)
                held, n = [], 0
    if held:
        yield ready(held)


def _scores(a: np.ndarray, b: np.ndarray, peaks: tuple[float, float], room: int) -> np.ndarray:
    """Integer inner products; exact in doubles if they are small, else in Python's integers.

    ``room`` is the factor by which the caller scales them."""
    width = min(a.shape[1], b.shape[1])
    bound = peaks[0] * peaks[1] * max(width, 1)
    if bound < 2.0 ** 53 and bound * room < 2.0 ** 62:
        return (a[:, :width] @ b[:, :width].T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m[:, :width]], object).reshape(
        len(m), width) for m in (a, b)]
    return whole[0] @ whole[1].T if width else np.zeros((len(a), len(b)), np.int64)


# -- packed keys -----------------------------------------------------------------------

def _pack(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose byte order is (anchor, descending score, kind, id)."""
    if score.dtype == object:
        if len(score) and max(abs(int(s)) for s in score) >= 1 << 63:
            raise OverflowError("a score exceeds 64 bits")
        score = score.astype(np.int64)
    out = np.zeros(len(score), PACKED)
    out["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ SIGN
    out["falling"] = ~(score.astype(np.int64).view(np.uint64) ^ SIGN)
    out["kind"] = kind
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ SIGN
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(PACKED.itemsize), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _unpack(key: bytes) -> tuple[int, int, int, int]:
    def signed(raw: bytes) -> int:
        return int.from_bytes(raw, "big") - (1 << 63)
    return (signed(key[:8]), signed((int.from_bytes(key[8:16], "big") ^ MASK64).to_bytes(8, "big")),
            key[16], signed(key[17:25]))


def _home(key: bytes) -> int:
    """Where an anchor's keys go."""
    x = (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15) & MASK64
    return x >> 33


def stream(keys: Iterable[bytes], lower: int = LOWER, upper: int = UPPER,
           negatives: int = 3) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Result rows of keys in order: one pass, holding one anchor's open windows."""
    now, windows = None, []
    for key in keys:
        anchor, score, kind, row = _unpack(key)
        if anchor != now:
            now, windows = anchor, []
        if kind == POSITIVE:
            windows.append([score, row, 0])
            continue
        for window in windows:
            if (window[2] < negatives
                    and lower * window[0] <= DEN * score <= upper * window[0]):
                window[2] += 1
                yield anchor, window[1], window[2], row, window[0], score


# -- the two passes ---------------------------------------------------------------------

def _anchor_batches(files: list[str], scale: float | None, extra: str | None):
    """Batches of anchors from the shared folder: (block, list column ``extra``)."""
    import pyarrow.parquet as pq
    columns = ["id", "label", "vector"] + ([extra] if extra else [])
    for uri in files:
        system, path = filesystem_path(uri)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(ANCHOR_BATCH, columns=columns):
                order = pa.compute.sort_indices(batch.column(0))
                batch = pa.RecordBatch.from_arrays(
                    [c.take(order) for c in batch.columns], names=columns)
                for block in _blocks([batch], scale, ANCHOR_BATCH):
                    yield block, batch.column(3).to_pylist() if extra else None


def _best_alike(files: list[str], scale: float, positives: int):
    """Of each block of rows the first rows of an anchor's own label."""
    def run(batches):
        for rows in _blocks(batches, scale, ROW_BLOCK):
            for anchors, _ in _anchor_batches(files, scale, None):
                for label in np.unique(anchors.labels):
                    own = np.flatnonzero(anchors.labels == label)
                    like = np.flatnonzero(rows.labels == label)
                    if not len(like):
                        continue
                    n = len(like)
                    s = _scores(anchors.vectors[own], rows.vectors[like],
                                (anchors.peak, rows.peak), n)
                    # Larger for a better score, then for an earlier row.
                    mark = s * n + (n - 1 - np.arange(n))
                    low = mark.min() - 1
                    mark[anchors.ids[own][:, None] == rows.ids[like][None, :]] = low
                    k = min(positives, n)
                    top = np.argpartition(mark, n - k, axis=1)[:, n - k:]
                    line, place = np.divmod(np.arange(top.size), k)
                    place = top[line, place]
                    there = mark[line, place] != low
                    line, place = line[there], place[there]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors.ids[own][line], pa.int64()),
                         pa.array(s[line, place].tolist(), pa.int64()),
                         pa.array(rows.ids[like][place], pa.int64())],
                        names=["anchor", "score", "id"])
    return run


def _candidates(files: list[str], scale: float, lower: int, upper: int, negatives: int):
    """Of each block of rows the first ones of another label in each window, as keys."""
    def run(batches):
        for rows in _blocks(batches, scale, ROW_BLOCK):
            n = len(rows)
            back = n - 1 - np.arange(n)
            for anchors, scores in _anchor_batches(files, scale, "scores"):
                s = _scores(anchors.vectors, rows.vectors, (anchors.peak, rows.peak), n)
                found, line = [], []
                for i, own in enumerate(scores):
                    # Whole scores in [lower, upper]; negative scores open no window.
                    spans = [(-(-lower * p // DEN) * n, (upper * p // DEN) * n + n - 1)
                             for p in own if p >= 0]
                    if not spans:
                        continue
                    mark = s[i] * n + back
                    mark = np.sort(mark[(mark >= min(a for a, _ in spans))
                                        & (mark <= max(b for _, b in spans))
                                        & (rows.labels != anchors.labels[i])])
                    picks = [mark[max(0, end - negatives):end] for end, low in zip(
                        np.searchsorted(mark, [b for _, b in spans], "right"),
                        [a for a, _ in spans], strict=True)]
                    picks = [p[p >= low] for p, (low, _) in zip(picks, spans, strict=True)]
                    some = np.unique(np.concatenate(picks))
                    found.append(some)
                    line.append(np.full(len(some), anchors.ids[i]))
                if not found:
                    continue
                mark, line = np.concatenate(found), np.concatenate(line)
                place = (n - 1 - mark % n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [_pack(line, mark // n, NEGATIVE, rows.ids[place])], names=["key"])
    return run


def _as_keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [_pack(b.column(0).to_numpy(), b.column(1).to_numpy(), POSITIVE,
                   b.column(2).to_numpy())], names=["key"])


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = 5, negatives: int = 3, lower: int = LOWER,
         upper: int = UPPER, scale: float = SCALE) -> DataFrame:
    """One row per anchor, positive and hard negative: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. ``is_anchor`` is a condition on ``rows``."""
    if not 0 <= lower <= upper <= DEN:
        raise ValueError("windows lie between 0 and the positive's score")
    spark = rows.sparkSession
    named = rows.select(F.col(f"`{key}`").cast("long").alias("id"),
                        F.col(f"`{label}`").cast("long").alias("label"),
                        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
                        is_anchor.alias("is_anchor"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    anchors = materialize(
        named.where(F.col("is_anchor") & usable & finite).groupBy("id").agg(
            F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector"),
        "mining-anchors")
    vectors = named.select("id", "label", "vector").where(usable)
    alike = vectors.mapInArrow(_best_alike(anchors.inputFiles(), scale, positives),
                               "anchor long, score long, id long")
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id"))
    best = materialize(alike.withColumn("nth", nth).where(F.col("nth") <= positives),
                       "mining-positives")
    told = best.groupBy("anchor").agg(F.collect_list("score").alias("scores"))
    opened = materialize(anchors.join(told, anchors.id == told.anchor).drop("anchor"),
                         "mining-windows")
    found = vectors.mapInArrow(
        _candidates(opened.inputFiles(), scale, lower, upper, negatives), "key binary")
    keys = best.select("anchor", "score", "id").mapInArrow(_as_keys, "key binary").unionByName(found)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (keys.rdd.map(lambda r: (bytes(r[0]), None))
               .repartitionAndSortWithinPartitions(parts, lambda k: _home(k) % parts))
    mined = ordered.mapPartitions(
        lambda pairs: stream((k for k, _ in pairs), lower, upper, negatives))
    return spark.createDataFrame(mined, OUT, verifySchema=False)
