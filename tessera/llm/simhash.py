"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: a text's A-Z are lower-cased, its words form k-word shingles (repeats
count), each shingle is hashed with XXH64 (seed 42), and a bit of the fingerprint is
set when it is set in more than half of the hashes. Fewer than k words: the whole
sequence is the one shingle. No word (or a null text): fingerprint zero.

Linking works on distinct fingerprints, so copies cost one row:

* Routing. Two fingerprints at distance t or less agree in one of t + 1 bit blocks.
  A group holds the fingerprints that agree in a block; the exact pattern of fixed
  bits is its key. A group over ``group_rows`` is dealt anew by blocks of its free
  bits, as often as needed: by then few bits are free, so groups stay small without
  a cap on anything.
* Index. A task sorts a group by Gray rank (neighbours in that order differ in few
  bits), and joins runs of ``FAN`` entries into nodes, level upon level. A node keeps the
  bits that all entries below it share (mask and pattern); what its parent already
  tells is left out of it.
* Search. All fingerprints of a group go down its index together. The differences
  met on the way add up; a node where they exceed t is pruned with everything below.
* The pairs found in a group are reduced to its spanning stars before they leave the task.

Component ids come from ``components``. Rows with equal keys are one document for
``representatives``: it stays if any of its rows is its group's first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_slices, without_keys
from tessera.llm.components import connected_components
from tessera.session import materialize

SEED = 42
FAN = 8
GROUP_ROWS = 4096
TASK_ROWS = 1 << 16
FRONT = 1 << 20
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# -- fingerprints ------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count, n = np.zeros(64, np.int64), len(words) - shingle + 1
    first, last = starts[:n].tolist(), ends[shingle - 1:].tolist()
    for at in range(0, n, 1 << 14):
        hashes = np.array([digest(joined[i:j], seed) for i, j in
                           zip(first[at:at + (1 << 14)], last[at:at + (1 << 14)], strict=True)],
                          "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(text: str | Column = "text", shingle: int = 3, seed: int = SEED) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        made = [fingerprint(t, shingle, seed) for part in text_slices(texts) for t in part]
        return pa.array(np.array(made, np.uint64).view(np.int64))

    return of(F.col(text) if isinstance(text, str) else text)


# -- the index -----------------------------------------------------------------------

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the reflected Gray sequence."""
    r = x.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """An index over several groups at once; ``prints`` lie group by group."""

    def __init__(self, prints: np.ndarray, group: np.ndarray) -> None:
        order = np.lexsort((gray_rank(prints), group))
        self.prints, self.group, self.order = prints[order], group[order], order
        mask = np.full(len(prints), FULL)
        # Per level, from the leaves: pattern, bits it adds to its parent, first child, children.
        self.levels = [(self.prints, None, None, None)]
        masks, pattern, owner = [mask], self.prints, self.group
        while True:
            edge = np.flatnonzero(np.diff(owner, prepend=-1))
            inside = np.arange(len(owner)) - np.repeat(edge, np.diff(edge, append=len(owner)))
            start = np.flatnonzero((inside % FAN == 0))
            if len(start) == len(owner) and len(edge) == len(owner):
                break
            both = np.bitwise_and.reduceat(pattern, start)
            some = np.bitwise_or.reduceat(pattern, start)
            shared = np.bitwise_and.reduceat(masks[-1], start) & ~(both ^ some)
            size = np.diff(start, append=len(owner))
            masks.append(shared)
            pattern, owner = both & shared, owner[start]
            self.levels.append((pattern, None, start, size))
        above = None
        for k in range(len(self.levels) - 1, -1, -1):
            p, _, start, size = self.levels[k]
            own = masks[k] if above is None else masks[k] & ~above
            self.levels[k] = (p, own, start, size)
            if size is not None:
                above = np.repeat(masks[k], size)
        self.root = np.searchsorted(owner, self.group)

    def pairs(self, limit: int):
        """Blocks of (a, b): places of fingerprints of one group within ``limit`` bits."""
        n = len(self.prints)
        todo = [(len(self.levels) - 1, np.arange(n), self.root, np.zeros(n, np.uint8))]
        while todo:
            level, query, node, far = todo.pop()
            if len(query) > FRONT:
                half = len(query) // 2
                todo += [(level, query[half:], node[half:], far[half:]),
                         (level, query[:half], node[:half], far[:half])]
                continue
            pattern, own, start, size = self.levels[level]
            far = far + np.bitwise_count((self.prints[query] ^ pattern[node]) & own[node])
            near = far <= limit
            query, node, far = query[near], node[near], far[near]
            if level == 0:
                once = query < node
                yield self.order[query[once]], self.order[node[once]]
                continue
            many = size[node]
            first = np.repeat(start[node] - np.cumsum(many) + many, many)
            child = first + np.arange(int(many.sum()))
            todo.append((level - 1, np.repeat(query, many), child, np.repeat(far, many)))


def spanning(n: int, pairs) -> np.ndarray:
    """The least place reachable from each place through blocks of pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(root, high, low)
            while True:  # pointer jumping
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


# -- linking --------------------------------------------------------------------------

def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bit positions."""
    cut = np.array_split(np.array(bits), parts)
    return [sum(1 << int(b) for b in c) for c in cut if len(c)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _dealt(rows: DataFrame, limit: int, frees: list[int]) -> DataFrame:
    """Each row once for each block of its free bits, with that block fixed."""
    after = []
    for free in frees:
        bits = [b for b in range(64) if free >> b & 1]
        after += [F.lit(_signed(free)).cast("long"),
                  F.array(*[F.lit(_signed(free & ~block)).cast("long")
                            for block in _blocks(bits, limit + 1)])]
    # One flat map: a chain of conditions would nest as deep as there are masks.
    out = F.try_element_at(F.create_map(*after), F.col("free"))
    return rows.select("print", F.explode(out).alias("free"))


def links(prints: DataFrame, limit: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``print``) at
    ``limit`` or fewer differing bits; each group's links are its spanning stars."""
    fixed = F.col("print").bitwiseAND(F.bitwise_not("free"))
    rows = _dealt(prints.select("print").distinct().withColumn("free", F.lit(-1).cast("long")),
                  limit, [(1 << 64) - 1])
    frees = _blocks(list(range(64)), limit + 1)
    frees = [((1 << 64) - 1) & ~b for b in frees]
    ready = None
    while True:
        rows = materialize(rows.withColumn("fixed", fixed), "simhash-groups")
        sizes = rows.groupBy("free", "fixed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = materialize(sizes, "simhash-sizes")
        deep = min(bin(f).count("1") for f in frees) <= limit + 1
        small = sizes if deep else sizes.where(F.col("n") <= group_rows)
        part = rows.join(small, ["free", "fixed"], "left_semi").select("print", "free", "fixed")
        ready = part if ready is None else ready.unionByName(part)
        large = sizes.where(F.col("n") > group_rows)
        if deep or large.isEmpty():
            break
        rows = _dealt(rows.join(large, ["free", "fixed"], "left_semi"), limit, frees)
        frees = sorted({f & ~b for f in frees
                        for b in _blocks([i for i in range(64) if f >> i & 1], limit + 1)})
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches):
        waiting, rows_held = [], 0

        def solved(t: pa.Table):
            value = t.column("print").to_numpy().view(np.uint64)
            key = np.stack([t.column("free").to_numpy(), t.column("fixed").to_numpy()])
            group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0).any(axis=0)]))
            root = spanning(len(value), GrayIndex(value, group).pairs(limit))
            told = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays(
                [pa.array(value[told].view(np.int64)), pa.array(value[root[told]].view(np.int64))],
                schema=schema)

        for batch in batches:
            waiting.append(batch)
            rows_held += batch.num_rows
            if rows_held >= TASK_ROWS:
                t = pa.Table.from_batches(waiting)
                key = np.stack([t.column("free").to_numpy(), t.column("fixed").to_numpy()])
                edge = np.flatnonzero((np.diff(key) != 0).any(axis=0))
                if len(edge):  # the last group may go on in the next batch
                    cut = int(edge[-1]) + 1
                    yield solved(t.slice(0, cut))
                    waiting, rows_held = t.slice(cut).to_batches(), t.num_rows - cut
        if rows_held:
            yield solved(pa.Table.from_batches(waiting))

    together = ready.repartition("free", "fixed").sortWithinPartitions("free", "fixed")
    return together.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    shingle: int = 3, limit: int = 2, seed: int = SEED,
                    group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per input row: key, print (signed), component (least key reachable)."""
    rows = materialize(docs.select(F.col(key).alias("key"),
                                   fingerprints(text, shingle, seed).alias("print")),
                       "simhash-prints")
    firsts = rows.groupBy("print").agg(F.min("key").alias("first"))
    roots = connected_components(links(rows, limit, group_rows), "a", "b")
    roots = materialize(roots.withColumnRenamed("node", "print"), "simhash-roots")
    linked = firsts.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component")),
                        "simhash-least")
    ids = linked.join(least, "root").select("print", "component")
    return rows.join(ids, "print").select("key", "print", "component")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    **settings) -> DataFrame:
    """The documents whose key is the least of their group, with all columns."""
    told = materialize(near_duplicates(docs, key, text, **settings), "simhash-told")
    gone = (told.groupBy("key").agg(F.bool_or(F.col("key").eqNullSafe(F.col("component")))
                                    .alias("stays")).where("NOT stays").select("key"))
    return without_keys(docs, key, materialize(gone, "simhash-gone"), "key")
