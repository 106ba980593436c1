"""The trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_trie as T
from tessera.llm.queries import QUERIES, SQL, shared_openings

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def own_turns(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def opened(convs):
    """The rebuilt conversations of the contract."""
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in nodes:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    for node, members in nodes.items():
        words = len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] = saved.get(node[:d], 0) + (len(members) - 1) * words
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in kids)
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids.get(k, 0), leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)).encode()).hexdigest())
        for k, m in nodes.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs,
                   r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def awkward(seed):
    rng = random.Random(seed)
    say = ["yes", "no way", "", "a b\tc\n d", "\x0b", "ünï 中文", None]
    rows = []
    for c in [*range(-45, 130, 3), *range(200, 260)]:
        rows += [(c, k, rng.choice(["user", "bot", None]), rng.choice(say))
                 for k in range(rng.choice([1, 1, 2, 3, 5, 8, 9, 17]))]
    rows += [(c, k, "user", f"turn {k}") for c in range(300, 340) for k in range(3)]  # copies
    rows += [(400, k, "user", f"t{k} w") for k in range(90)] + [(401, k, "user", f"t{k} w") for k in range(57)]
    rows += [(402, None, "z", "null first"), (402, 0, "a", "x"), (402, 0, "a", "x"), (402, None, "b", "y"),
             (None, 0, "user", "nobody's"), (419, 1, "user", "alone"), (439, 0, "u", "q")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
def test_against_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 4)
    rows = awkward(width)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(
        {c: F.lit("x") for c in ("a", "b", "words", "pos", "range", "block", "k1", "depth")})
    turns = T.positions(df)
    own = own_turns(rows)
    plain = T.trie(turns.select("conv_id").distinct(), turns, width)
    assert rows_of(plain) == brute(own)
    members, rebuilt = shared_openings(turns)
    want = brute(opened(own))
    assert any(r[1] == 0 and r[7] != T.NO_ENDS for r in want)  # some have no turn left
    assert rows_of(T.trie(members, rebuilt, width)) == want


def test_a_common_conversation(spark):
    """Many copies of one conversation and one very long one."""
    rows = [(c, k, "u", "same words here") for c in range(600) for k in range(2)]
    rows += [(1000, k, "u", "on and on") for k in range(900)]
    turns = T.positions(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(T.trie(turns.select("conv_id").distinct(), turns)) == brute(own_turns(rows))


def test_no_conversations(spark):
    turns = T.positions(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA))
    members, rebuilt = shared_openings(turns)
    assert T.trie(members, rebuilt).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    res = con.execute(SQL["op12_conversation_trie"])
    names = [d[0] for d in res.description]
    got = QUERIES["op12_conversation_trie"](spark, SF)
    assert got.columns == names
    assert rows_of(got) == sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in res.fetchall())
