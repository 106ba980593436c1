"""Prefix trie of conversations: every distinct sequence of first turns is one node.

1. Turns become two 64-bit hashes each and are numbered inside their conversation. Rows are
   range-partitioned by (conversation, turn), numbered in one stream over each partition,
   and the few conversations that cross a border of ranges (at most one a border) get the
   counts of earlier ranges added. A conversation of any length is spread over many tasks.
2. ``width`` consecutive turns become one row of positional columns; a longer conversation
   goes on in further column blocks, keyed by the node it had reached: the exclusive-or
   of hashes of (position, turn), 128 bits, which a set of positions fixes whatever their order.
   So no loop over blocks is needed.
3. Spark SQL's ROLLUP over the positional columns counts all prefixes of all blocks at
   once; ``grouping_id`` tells how many columns a row is about. Map-side sums fold a first
   turn that a third of all conversations share into one row a task.
4. Sums over subtrees need no walk over depths. A conversation owns the nodes whose least member
   it is. A leaf is owned by a conversation that ends in it, so leaves under a node are counted by
   its members. With D(c) the words of the nodes on c's path that c does not own, the
   words saved under a node v with least member m and path words P above it are
   ``sum of D over its members - D(m) - (members - 1) * P``. A second ROLLUP sums both.
5. The members that end in a node are range-partitioned by (node, id); a run inside a partition
   is hashed there, runs that touch a border leave as bounded pieces of text and one stream
   over a node's pieces hashes them in order.

Defined cases: rows without a conversation key belong to none and are left out. A null turn
comes first; turns of one number are ordered by role, then by the hash of role and text; repeated
rows are turns of their own. Null role or text is the empty one. Words are ``[^\\x20\\x09-\\x0D]+``.
Further columns are left out. Without conversations there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

WIDTH = 8
#: Keys of a node's members that one piece of text holds.
PIECE = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def _ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _earlier(rows: DataFrame, sums: dict[str, Column], joined: dict[str, Column]) -> DataFrame:
    """What earlier ranges hold of a conversation that goes on in a range: one row a border
    of ranges at most, so its size is bounded by their number."""
    parts = rows.groupBy("range", "conv_id").agg(*[c.alias(k) for k, c in sums.items()])
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    return (parts.withColumns({k: c.over(before) for k, c in joined.items()})
            .where(F.col(next(iter(joined))).isNotNull()).select("range", "conv_id", *joined))


# -- turns ---------------------------------------------------------------------------

def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a sorted partition with their place among its turns of the conversation."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        place = np.arange(len(conv)) - np.repeat(begin, np.diff(np.append(begin, len(conv)))) + 1
        if conv[0] == last:
            place[:begin[1] if len(begin) > 1 else len(conv)] += seen
        last, seen = conv[-1], place[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(conv), part, np.int32)), batch.column(0),
             pa.array(place.astype(np.int64)), *batch.columns[1:4]],
            names=["range", "conv_id", "place", "a", "b", "words"])


def positions(conversations: DataFrame, key: str = "conv_id", turn: str = "turn",
              role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, pos (from 1), a and b (its hashes), words."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    # Written before the ranges are sampled, so texts are read and hashed once.
    rows = materialize(conversations.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        said[0].alias("role"), F.xxhash64(*said).alias("a"),
        F.xxhash64(said[1], said[0], F.lit(1)).alias("b"),
        F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words")), "trie-hashes")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "a", "b"]
    numbered = materialize(
        rows.repartitionByRange(_ranges(rows), *order).sortWithinPartitions(*order)
        .select("conv_id", "a", "b", "words").mapInArrow(
            _number, "range int, conv_id long, place long, a long, b long, words long"),
        "trie-turns")
    before = _earlier(numbered, {"n": F.max("place")}, {"before": F.sum("n")})
    return numbered.join(F.broadcast(before), ["range", "conv_id"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"),
        "a", "b", "words")


# -- column blocks -------------------------------------------------------------------

def _columns(width: int) -> list[str]:
    return [f"{c}{k}" for k in range(width) for c in "abw"]


def _assemble(width: int):
    """Rows of a sorted partition → one row of positional columns per conversation and block,
    with the hashes and words of the conversation's earlier blocks in the partition."""
    names = ["range", "conv_id", "block", "p1", "p2", "pw", "x1", "x2", "xw", *_columns(width)]

    def run(batches):
        part, rest, last, carry = TaskContext.get().partitionId(), None, None, [0, 0, 0]

        def blocks(conv, pos, cols):
            nonlocal last, carry
            block = np.maximum(pos - 1, 0) // width
            new = np.concatenate([[True], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])])
            at = np.flatnonzero(new)
            group, slot = np.cumsum(new) - 1, np.maximum(pos - 1, 0) % width
            a, b, w, x1, x2 = cols
            told = pos > 0  # position 0 only says that the conversation is there
            out = []
            for col in (a, b, w):
                grid = np.zeros((len(at), width), np.int64)
                grid[group[told], slot[told]] = col[told]
                out.append(grid)
            there = np.zeros((len(at), width), bool)
            there[group[told], slot[told]] = True
            owner = conv[at]
            sums = [np.bitwise_xor.reduceat(x1, at), np.bitwise_xor.reduceat(x2, at),
                    np.add.reduceat(w, at)]
            # Running values inside a conversation: those of all blocks, less its first's.
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            since = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            prior = []
            for k, (s, op) in enumerate(zip(sums, (np.bitwise_xor, np.bitwise_xor, np.add),
                                            strict=True)):
                upto = np.concatenate([[0], op.accumulate(s)])
                own = upto[:-1] ^ upto[since] if k < 2 else upto[:-1] - upto[since]
                if owner[0] == last:
                    head = since == 0
                    own = np.where(head, own ^ carry[k] if k < 2 else own + carry[k], own)
                prior.append(own)
            last = owner[-1]
            carry = [int(p[-1] ^ s[-1]) if k < 2 else int(p[-1] + s[-1])
                     for k, (p, s) in enumerate(zip(prior, sums, strict=True))]
            none = ~there
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), part, np.int32)), pa.array(owner),
                 pa.array(block[at]), *[pa.array(p) for p in (*prior, *sums)],
                 *[pa.array(g[:, k], mask=none[:, k]) for k in range(width) for g in out]],
                names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(7)]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            # The last block may go on in the next batch.
            conv, block = cols[0], np.maximum(cols[1] - 1, 0) // width
            end = len(conv) - 1
            while end and conv[end - 1] == conv[-1] and block[end - 1] == block[-1]:
                end -= 1
            if end:
                yield blocks(conv[:end], cols[1][:end], [c[:end] for c in cols[2:]])
            rest = [c[end:] for c in cols]
        if rest is not None:
            yield blocks(rest[0], rest[1], rest[2:])

    ddl = "range int, " + ", ".join(f"{n} long" for n in names[1:])
    return run, ddl


def column_blocks(members: DataFrame, turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, block, the prior block's node (p1, p2, path words pw), the block's own
    hashes and words (x1, x2, xw) and its positional columns. Every member has block 0."""
    rows = turns.select(
        "conv_id", "pos", "a", "b", "words", F.xxhash64("a", "b", "pos").alias("x1"),
        F.xxhash64("pos", "b", "a").alias("x2")).unionByName(members.select(
            "conv_id", *[F.lit(0).cast("long").alias(c)
                         for c in ("pos", "a", "b", "words", "x1", "x2")]))
    run, ddl = _assemble(width)
    block = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / width)
    dealt = (rows.repartitionByRange(_ranges(rows), "conv_id", block)
             .sortWithinPartitions("conv_id", "pos").mapInArrow(run, ddl))
    local = materialize(dealt, "trie-blocks")
    before = _earlier(
        local, {"s1": F.bit_xor("x1"), "s2": F.bit_xor("x2"), "sw": F.sum("xw")},
        {"e1": F.bit_xor("s1"), "e2": F.bit_xor("s2"), "ew": F.sum("sw")})
    none = F.lit(0).cast("long")
    return local.join(F.broadcast(before), ["range", "conv_id"], "left").withColumns({
        "p1": F.col("p1").bitwiseXOR(F.coalesce("e1", none)),
        "p2": F.col("p2").bitwiseXOR(F.coalesce("e2", none)),
        "pw": F.col("pw") + F.coalesce("ew", none)}).drop("range", "e1", "e2", "ew")


# -- nodes ---------------------------------------------------------------------------

def _rollup(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """All prefixes of all blocks at once, as rows of nodes: k1, k2 (its key), q1, q2 (its
    parent's), depth, words (of its last turn), above (words of the path above it), ``sums``."""
    levels = ", ".join(f"(a{k}, b{k}, w{k})" for k in range(width))
    spark = blocks.sparkSession
    grouped = spark.sql(
        f"SELECT block, p1, p2, pw, {', '.join(_columns(width))}, grouping_id() AS gid, {sums} "
        f"FROM {{blocks}} GROUP BY block, p1, p2, pw, ROLLUP({levels})", blocks=blocks)
    # A rolled-up level hides three columns.
    level = (F.lit(width) - F.floor(F.bit_count("gid") / 3)).cast("int")

    def chain(parts: list[Column], start: Column) -> Column:
        """The value at the row's level: start, then one part after the other."""
        out = start
        for k, part in enumerate(parts):
            out = F.when(F.col("level") > k, part).otherwise(F.lit(0).cast("long")).bitwiseXOR(out)
        return out

    def pos(k):
        return (F.col("block") * width + (k + 1)).cast("long")

    def at_level(col: str) -> Column:
        return F.coalesce(*[F.when(F.col("level") == k + 1, F.col(f"{col}{k}"))
                            for k in range(width)])

    x1 = [F.xxhash64(f"a{k}", f"b{k}", pos(k)) for k in range(width)]
    x2 = [F.xxhash64(pos(k), f"b{k}", f"a{k}") for k in range(width)]
    told = grouped.withColumn("level", level).where(
        ((F.col("level") == 0) & (F.col("block") == 0)) | at_level("a").isNotNull())
    last = F.coalesce(at_level("w"), F.lit(0).cast("long"))
    path = F.col("pw")
    for k in range(width):
        path = path + F.when(F.col("level") > k + 1, F.col(f"w{k}")).otherwise(0)
    own1, own2 = (F.coalesce(*[F.when(F.col("level") == k + 1, x[k]) for k in range(width)],
                             F.lit(0).cast("long")) for x in (x1, x2))
    names = [c.rsplit(" AS ", 1)[1].strip() for c in sums.split(", ")]
    keyed = told.select("level", "block", *names, last.alias("words"), path.alias("above"),
                        chain(x1, F.col("p1")).alias("k1"), chain(x2, F.col("p2")).alias("k2"),
                        own1.alias("o1"), own2.alias("o2"))
    return keyed.select(
        "k1", "k2", F.col("k1").bitwiseXOR(F.col("o1")).alias("q1"),
        F.col("k2").bitwiseXOR(F.col("o2")).alias("q2"),
        (F.col("block") * width + F.col("level")).cast("long").alias("depth"),
        "words", "above", *names)


# -- members that end in a node --------------------------------------------------------

def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the runs inside a sorted partition; runs at its borders as pieces."""
    part, number = TaskContext.get().partitionId(), 0
    now, held, border = None, [], True

    def row(piece, digest):
        nonlocal number
        number += 1
        return {"k1": now[0], "k2": now[1], "range": part, "number": number, "piece": piece,
                "digest": digest}

    def close(at_border):
        text = ",".join(map(str, held))
        if at_border or pieces:
            return row(text, None)
        return row(None, hashlib.sha256(text.encode()).hexdigest())

    pieces, schema = False, pa.schema(
        [("k1", pa.int64()), ("k2", pa.int64()), ("range", pa.int32()), ("number", pa.int64()),
         ("piece", pa.string()), ("digest", pa.string())])
    for batch in batches:
        out = []
        k1, k2, ids = (batch.column(k).to_pylist() for k in range(3))
        for one, two, member in zip(k1, k2, ids, strict=True):
            if (one, two) != now:
                if now is not None:
                    out.append(close(border))
                    border = False
                now, held, pieces = (one, two), [], False
            elif len(held) >= PIECE:
                out.append(row(",".join(map(str, held)), None))
                held, pieces = [], True
            held.append(member)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([close(True)], schema=schema)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes whose pieces come in order: one hash state at a time."""
    now, state = None, None
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.string())])

    def done():
        return {"k1": now[0], "k2": now[1], "digest": state.hexdigest()}

    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            key, piece = (batch.column(0)[at].as_py(), batch.column(1)[at].as_py()), \
                batch.column(2)[at].as_py().encode()
            if key != now:
                if now is not None:
                    out.append(done())
                now, state = key, hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([done()], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """k1, k2, digest: SHA-256 of the comma-joined ascending ids that end in a node."""
    n = _ranges(ends)
    order = ["k1", "k2", "conv_id"]
    runs = materialize(
        ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
            _runs, "k1 long, k2 long, range int, number long, piece string, digest string"),
        "trie-ends")
    pieces = runs.where("piece IS NOT NULL").repartition(n, "k1", "k2").sortWithinPartitions(
        "k1", "k2", "range", "number").select("k1", "k2", "piece")
    return runs.where("digest IS NOT NULL").select("k1", "k2", "digest").unionByName(
        pieces.mapInArrow(_joined, "k1 long, k2 long, digest string"))


def trie(members: DataFrame, turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``members`` has one row per conversation (conv_id), also those without a turn; ``turns``
    is as ``positions`` gives it."""
    blocks = materialize(column_blocks(members, turns, width), "trie-columns")
    ends = materialize(blocks.groupBy("conv_id").agg(
        F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"),
        F.sum("xw").alias("total")), "trie-members")
    first = materialize(_rollup(blocks, width, "count(*) AS n_convs, min(conv_id) AS conv_id"),
                        "trie-nodes")
    children = first.where("depth > 0").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(
        first.join(children, ["k1", "k2"], "left")
        .join(end_digests(ends), ["k1", "k2"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    owned = nodes.groupBy("conv_id").agg(
        F.sum("words").alias("owned"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    # Words on a conversation's path that it does not own, and whether it owns a leaf.
    shares = materialize(ends.join(owned, "conv_id", "left").select(
        "conv_id", (F.col("total") - F.coalesce("owned", F.lit(0))).alias("other"),
        F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")), "trie-shares")
    under = _rollup(blocks.join(shares, "conv_id"), width,
                    "sum(other) AS other, sum(leaf) AS n_leaves")
    least = shares.select("conv_id", F.col("other").alias("least_other"))
    told = materialize(nodes.join(under.select("k1", "k2", "other", "n_leaves"), ["k1", "k2"])
                       .join(least, "conv_id"), "trie-sums")
    parents = nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"),
                           F.col("conv_id").alias("parent_conv_id"))
    # Children of the root meet one known row; only deeper nodes look their parent up.
    root = nodes.where("depth = 0").select("conv_id").first()
    top = told.where("depth <= 1").withColumn("parent_conv_id", F.when(
        F.col("depth") == 1, F.lit(None if root is None else root[0]).cast("long")))
    deep = told.where("depth > 1").join(parents, ["q1", "q2"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
               (F.col("other") - F.col("least_other")
                - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens"),
               F.coalesce("digest", F.lit(NO_ENDS)).alias("ends_sha256")]
    return top.select(*columns).unionByName(deep.select(*columns))
