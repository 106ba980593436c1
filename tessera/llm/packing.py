"""Sequence packing by lexical retrieval.

Documents are encoded once (ids plus an end id) and dealt by content into shards of at
most about ``shard_ids`` ids: a binary tree of two-means splits over hashed sums of the ids'
squared idf, learned from a bounded sample of all documents, gives leaves in an order in which like
stands by like; small leaves next to each other share a shard, only a leaf that is too large
is dealt by hash over several. A seed does not meet the documents of other shards, so its
neighbours are those of all documents as far as the tree keeps them together (measured in
the README). A shard holds a BM25 inverted index of its documents: terms are token
ids, document frequencies and mean length are counted over **all** documents. A whole
window of a document is a sequence by itself. What is left of a document at its end is
placed by retrieval: the longest unplaced rest is a seed, all its terms (or its strongest
``query_terms``) query the index, and the unplaced neighbours fill the seed's
window in the order of their scores, ``candidates`` at a time and then twice as many: first
those that fit; the best one that does not fit is cut to close the window, and its rest
stays in the index. Only when no neighbour with a score is left does a window take the
next unplaced rest. So every sequence but the last of a
shard is full.

Each id lies in exactly one piece. Empty and null texts are the end id alone. Rows with
equal keys are documents of their own. Ties go by key, then by place in the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import arrow_schema, mix64, texts_in
from tessera.session import materialize

SIZE, SHARD_IDS, QUERY_TERMS, CANDIDATES = 1024, 1 << 20, None, 32
K1, B = 1.2, 0.75
#: Width of a document's sketch; sampled documents per shard, at least and at most.
SKETCH, SAMPLE_EACH, SAMPLE_MIN, SAMPLE_MAX = 256, 32, 4096, 1 << 17
#: Terms of at least one document in so many are a row of weights over all documents.
COMMON = 8


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
           end_id: int | None = 0) -> tuple[DataFrame, DataFrame]:
    """Documents, and document frequencies, written once by one pass.

    Documents: key, part, row (their place in the input), n (ids) and ids, two bytes wide
    where all of a document's ids fit, else four. Frequencies: term, docs, over all
    documents; as many rows as the tokenizer has ids at most. Tasks add their counts up
    and append them to the same table as rows of a term.
    """
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    ddl = "key long, part int, row long, n long, ids binary, term long"
    schema = arrow_schema(ddl)

    def run(batches):
        coder, part, row = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        rows, size, docs_with = [], 0, np.zeros(1 << 16, np.int64)
        for k, ids in coder.rows(texts_in(batches, "key", "text")):
            ids = np.concatenate([ids, tail])
            top = int(ids.max(initial=0))
            if top < 1 << 16:
                ids = ids.astype("<u2")
            if top >= len(docs_with):
                docs_with = np.concatenate([docs_with, np.zeros(top + 1, np.int64)])
            docs_with[ids] += 1  # an id that is repeated is added once
            rows.append({"key": k, "part": part, "row": row, "n": len(ids),
                         "ids": ids.tobytes()})
            row, size = row + 1, size + ids.nbytes
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
        hit = np.flatnonzero(docs_with)
        yield pa.RecordBatch.from_pylist([], schema=schema) if not len(hit) else \
            pa.RecordBatch.from_arrays(
                [pa.nulls(len(hit), f.type) for f in list(schema)[:3]]
                + [pa.array(docs_with[hit]), pa.nulls(len(hit), pa.binary()), pa.array(hit)],
                schema=schema)

    coded = materialize(docs.select(F.col(key).cast("long").alias("key"),
                                    F.col(text).alias("text")).mapInArrow(run, ddl), "pack-ids")
    frequencies = coded.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("docs"))
    return coded.where("term IS NULL").drop("term"), frequencies


def ids_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


class Sketcher:
    """Signed hashed sums of the squared idf of a document's ids, square-rooted, of length one."""

    def __init__(self, idf: np.ndarray) -> None:
        h = mix64(np.arange(1, len(idf) + 1))
        self.slot = (h % np.uint64(SKETCH)).astype(np.int64)
        self.weight = np.where(h >> np.uint64(63), idf, -idf) * idf

    def __call__(self, docs: list[np.ndarray]) -> np.ndarray:
        ids = np.concatenate(docs)
        at = np.repeat(np.arange(len(docs)) * SKETCH, [len(d) for d in docs]) + self.slot[ids]
        x = np.bincount(at, self.weight[ids], len(docs) * SKETCH).reshape(-1, SKETCH)
        x = (np.sign(x) * np.sqrt(np.abs(x))).astype(np.float32)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _split(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Axis, bound and the rows beyond it of two clusters; None if all rows are alike."""
    own = x - x.mean(axis=0)
    away = np.einsum("ij,ij->i", own, own)
    if len(x) < 2 or away.max() < 1e-6:
        return None
    axis = own[np.argmax(away)]
    for _ in range(6):
        axis = (own @ axis) @ own
        axis /= max(float(np.linalg.norm(axis)), 1e-12)
    bound = float(x.mean(axis=0) @ axis)
    beyond = x @ axis > bound
    for _ in range(6):
        if beyond.all() or not beyond.any():
            break
        one, two = x[~beyond].mean(axis=0), x[beyond].mean(axis=0)
        axis, bound = two - one, float(two @ two - one @ one) / 2
        beyond = x @ axis > bound
    # A few rows split from many would make a deep tree: half goes to each side then.
    if min(beyond.sum(), (~beyond).sum()) * 32 < len(x):
        bound = float(np.median(x @ axis))
        beyond = x @ axis > bound
    return None if beyond.all() or not beyond.any() else (axis, bound, beyond)


class Tree:
    """Two-means splits until a leaf stands for ``limit`` ids; leaves count from left to right."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, limit: float) -> None:
        axes, bounds, children, self.leaves = [], [], [], 0
        waiting = [(np.arange(len(x)), -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            cut = _split(x[rows]) if ids[rows].sum() > limit else None
            if cut is None:
                place, self.leaves = -1 - self.leaves, self.leaves + 1
            else:
                place = len(axes)
                axes.append(cut[0])
                bounds.append(cut[1])
                children.append([0, 0])
                waiting += [(rows[cut[2]], place, 1), (rows[~cut[2]], place, 0)]
            if parent >= 0:
                children[parent][side] = place
        self.axes = np.array(axes, np.float32).reshape(-1, x.shape[1])
        self.bounds = np.array(bounds, np.float32)
        self.children = np.array(children, np.int64).reshape(-1, 2)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if len(self.axes) else -1)
        while len(live := np.flatnonzero(at >= 0)):
            node = at[live]
            beyond = np.einsum("ij,ij->i", x[live], self.axes[node]) > self.bounds[node]
            at[live] = self.children[node, beyond.astype(np.int64)]
        return -1 - at


def _groups(ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each leaf: neighbours share one while it has room."""
    first, parts, shard, held = [], [], 0, 0
    for n in ids.tolist():
        if held and held + n > limit:
            shard, held = shard + 1, 0
        first.append(shard)
        parts.append(max(1, -(-n // limit)))
        held += n
        if parts[-1] > 1:
            shard, held = shard + parts[-1], 0
    return np.array(first, np.int64), np.array(parts, np.int64)


def deal(coded: DataFrame, idf: np.ndarray, rows: int, total: int, shard_ids: int) -> DataFrame:
    """The documents with their ``shard``: like documents share one."""
    shards = -(-total // shard_ids)
    if shards <= 1:
        return coded.withColumn("shard", F.lit(0).cast("long"))
    context = coded.sparkSession.sparkContext
    sketcher = context.broadcast(Sketcher(idf))

    def sketched(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield part, sketcher.value([ids_of(d, n) for d, n in zip(
                    part.column("ids").to_pylist(), part.column("n").to_pylist(), strict=True)])

    def sample(batches):
        for part, x in sketched(batches):
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("part", "row", "n")),
                 pa.array([r.tobytes() for r in x], pa.binary())], names=["part", "row", "n", "x"])

    every = max(1, rows // min(max(SAMPLE_EACH * shards, SAMPLE_MIN), SAMPLE_MAX))
    seen = coded.where(F.pmod(F.xxhash64("part", "row"), F.lit(every)) == 0).mapInArrow(
        sample, "part int, row long, n long, x binary").toArrow()
    seen = seen.sort_by([("part", "ascending"), ("row", "ascending")])
    x = np.frombuffer(b"".join(seen.column("x").to_pylist()), np.float32).reshape(-1, SKETCH)
    n = seen.column("n").to_numpy().astype(np.float64)
    tree = context.broadcast(Tree(x, n * (total / max(n.sum(), 1)), shard_ids / 2))

    def count(batches):
        ids = np.zeros(tree.value.leaves, np.int64)
        for part, x in sketched(batches):
            np.add.at(ids, tree.value.leaf(x), part.column("n").to_numpy())
        hit = np.flatnonzero(ids)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(ids[hit])], names=["leaf", "n"])

    counted = coded.mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    found, ids = counted.toArrow(), np.zeros(tree.value.leaves, np.int64)
    ids[found.column("leaf").to_numpy()] = found.column("n").to_numpy()
    first, parts = _groups(ids, shard_ids)

    def route(batches):
        for part, x in sketched(batches):
            leaf = tree.value.leaf(x)
            place = (part.column("part").to_numpy().astype(np.uint64) << np.uint64(40)) \
                + part.column("row").to_numpy().astype(np.uint64)
            shard = first[leaf] + (mix64(mix64(place)) % parts[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shard)],
                                             names=[*part.schema.names, "shard"])

    return coded.mapInArrow(route, "key long, part int, row long, n long, ids binary, shard long")


class Index:
    """BM25 postings of a shard's documents; scores are added up term by term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        parts = [np.unique(d, return_counts=True) for d in docs]
        size = np.array([len(d) for d in docs], np.float64)
        term = np.concatenate([t for t, _ in parts])
        owner = np.repeat(np.arange(len(docs)), [len(t) for t, _ in parts])
        count = np.concatenate([c for _, c in parts]).astype(np.float64)
        norm = K1 * (1 - B + B * size[owner] / max(mean, 1.0))
        weight = (idf[term] * count * (K1 + 1) / (count + norm)).astype(np.float32)
        # Query terms of each document: its own heaviest postings.
        self.edge = np.concatenate([[0], np.cumsum([len(t) for t, _ in parts])])
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.posted, self.post_weight = owner[order], weight[order]
        known, start = np.unique(term[order], return_index=True)
        stop = np.append(start[1:], len(term))
        place = np.searchsorted(known, term)
        self.start, self.stop = start[place], stop[place]
        wide = (stop - start) * COMMON >= len(docs)
        self.line = np.where(wide, np.cumsum(wide) - 1, -1)[place]
        self.lines = np.zeros((int(wide.sum()), len(docs)), np.float32)
        held = self.line >= 0
        self.lines[self.line[held], owner[held]] = weight[held]

    def scores(self, doc: int, query_terms: int | None = None) -> np.ndarray:
        a, b = int(self.edge[doc]), int(self.edge[doc + 1])
        weight = self.weight[a:b]
        if query_terms is not None and b - a > query_terms:
            own = a + np.argpartition(-weight, query_terms - 1)[:query_terms]
        else:
            own = np.arange(a, b)
        line = self.line[own]
        own = own[line < 0]
        n = self.stop[own] - self.start[own]
        at = np.repeat(self.start[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        rare = np.bincount(self.posted[at], self.post_weight[at], minlength=len(self.edge) - 1)
        asked = np.zeros(len(self.lines), np.float32)
        asked[line[line >= 0]] = 1
        return rare + asked @ self.lines


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, size: int,
               query_terms: int | None,
               candidates: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    pieces, sequence = [], 0
    start = np.zeros(len(docs), np.int64)
    rest = np.zeros(len(docs), np.int64)
    for d, ids in enumerate(docs):
        for at in range(0, len(ids) - size + 1, size):
            pieces.append((d, at, size, sequence, 0))
            sequence += 1
        start[d] = len(ids) // size * size
        rest[d] = len(ids) - start[d]
    if not rest.any():
        return pieces
    index = Index(docs, idf, mean)
    waiting = np.argsort(-rest, kind="stable").tolist()
    while waiting:
        seed, again = 0, []
        while seed < len(waiting):
            d = waiting[seed]
            seed += 1
            if not rest[d]:
                continue
            fill = 0

            def place(doc, n):
                nonlocal fill
                pieces.append((doc, int(start[doc]), int(n), sequence, fill))
                start[doc] += n
                rest[doc] -= n
                fill += int(n)

            place(d, rest[d])
            if fill < size:
                score = index.scores(d, query_terms)
                score[rest == 0] = 0
                block = candidates
                while fill < size:
                    k = min(block, len(score))
                    near = np.argpartition(-score, k - 1)[:k]
                    near = near[score[near] > 0]
                    if not len(near):
                        break
                    near = near[np.lexsort((near, -score[near]))]
                    score[near], block = 0, 2 * block
                    near = near.tolist()
                    for other in near:
                        if rest[other] <= size - fill:
                            place(other, rest[other])
                            if fill == size:
                                break
                    over = next((o for o in near if rest[o]), None)
                    if fill < size and over is not None:
                        place(over, size - fill)
                        again.append(over)
                ahead = seed
                while fill < size and ahead < len(waiting):
                    other = waiting[ahead]
                    ahead += 1
                    if rest[other]:
                        place(other, min(rest[other], size - fill))
                        again.append(other)
                for other in again:
                    if fill < size and rest[other]:
                        place(other, min(rest[other], size - fill))
            sequence += 1
        waiting = [d for d in dict.fromkeys(again) if rest[d]]
    return pieces


def crc32_of(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
         end_id: int | None = 0, size: int = SIZE, shard_ids: int = SHARD_IDS,
         query_terms: int | None = QUERY_TERMS, candidates: int = CANDIDATES,
         tell: Callable[[np.ndarray], dict] | None = None,
         schema: str = "ids array<long>") -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset, and what
    ``tell`` makes of the piece's ids (by default the ids)."""
    tell = tell or (lambda ids: {"ids": ids.tolist()})
    coded, frequencies = encode(docs, tokenizer, key, text, end_id)
    rows, total = coded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = frequencies.toArrow()
    term, many = found.column("term").to_numpy(), found.column("docs").to_numpy()
    idf = np.zeros(int(term.max(initial=0)) + 1, np.float32)
    idf[term] = np.log(1 + (rows - many + 0.5) / (many + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    mean = total / max(rows, 1)
    ddl = ("key long, start long, length long, doc_tokens long, sequence_id long, "
           f"offset long, {schema}")
    out = arrow_schema(ddl)

    def run(group):
        group = group.sort_by([("key", "ascending"), ("part", "ascending"), ("row", "ascending")])
        shard = group.column("shard")[0].as_py()
        keys, counts = group.column("key").to_pylist(), group.column("n").to_pylist()
        ids = [ids_of(d.as_buffer().to_pybytes(), n)
               for d, n in zip(group.column("ids"), counts, strict=True)]
        made = []
        for d, start, n, sequence, offset in pack_shard(ids, shared.value, mean, size,
                                                        query_terms, candidates):
            made.append({"key": keys[d], "start": start, "length": n, "doc_tokens": counts[d],
                         "sequence_id": (shard << 32) + sequence, "offset": offset}
                        | tell(ids[d][start:start + n]))
        return pa.Table.from_pylist(made, schema=out)

    dealt = deal(coded, idf, rows, total, shard_ids)
    return dealt.groupBy("shard").applyInArrow(run, ddl)
