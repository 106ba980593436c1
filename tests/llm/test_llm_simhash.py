import numpy as np
import xxhash
from llm_util import awkward, awkward_rows, empty, words

from tessera.llm import simhash
from tessera.llm.components import connected_components


def plain_print(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            count[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * count[k] > len(shingles))


def least_reachable(prints, limit):
    """Brute force over all pairs: least key of each print's component."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = list(prints)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= limit:
                root[find(a)] = find(b)
    out = {}
    for p in values:
        out.setdefault(find(p), []).append(prints[p])
    return {p: min(out[find(p)]) for p in values}


def clustered(rng, centres=30, around=25, most=5):
    x = set()
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64).tolist():
        x.add(c)
        for _ in range(around):
            y = c
            for k in rng.integers(0, 64, rng.integers(1, most)):
                y ^= 1 << int(k)
            x.add(y)
    return np.array(sorted(x), np.uint64)


def test_fingerprints():
    for _, text, *_ in awkward_rows()[:24]:
        assert simhash.fingerprint(text) == plain_print(text)
    assert simhash.fingerprint("Ab cD") == plain_print("ab cd") != 0
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_gray_rank_inverts_the_gray_sequence():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    for limit in (0, 1, 2, 3):
        x = clustered(rng)
        rng.shuffle(x)
        group = np.sort(rng.integers(0, 4, len(x)))
        got = set()
        for a, b in simhash.GrayIndex(x, group).pairs(limit):
            got |= {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= limit
        same = group[:, None] == group[None, :]
        assert got == {(i, j) for i, j in zip(*np.nonzero(near & same), strict=True) if i < j}


def test_links_with_dealt_groups(spark):
    """A tiny group size makes every level of dealing happen; nothing may be lost."""
    x = clustered(np.random.default_rng(5), centres=6, around=40, most=3)
    prints = {int(p): k for k, p in enumerate(x)}
    df = spark.createDataFrame([(int(p),) for p in x.view(np.int64)], "print long")
    for rows in (4, 4096):
        edges = connected_components(simhash.links(df, 2, group_rows=rows), "a", "b").collect()
        root = {r.node % (1 << 64): r.root % (1 << 64) for r in edges}
        want = least_reachable(prints, 2)
        got = {}
        for p in prints:
            got.setdefault(root.get(p, p), []).append(p)
        assert {p: min(prints[q] for q in g) for g in got.values() for p in g} == want


def test_near_duplicates_match_brute_force(spark):
    rows = [r for r in awkward_rows() if r[0] is not None]
    rows += [(100 + k, rows[0][1] + f" w{k}", "en", "a", 1) for k in range(5)]
    told = simhash.near_duplicates(awkward(spark, rows)).collect()
    first = {}
    for doc, text, *_ in rows:
        p = plain_print(text)
        first[p] = min(first.get(p, doc), doc)
    want = least_reachable(first, 2)
    assert len(told) == len(rows)
    texts = {}
    for doc, text, *_ in rows:
        texts.setdefault(doc, set()).add(plain_print(text))
    for r in told:
        p = r.print % (1 << 64)
        assert p in texts[r.key] and r.component == want[p]


def test_representatives_and_empty_table(spark):
    docs = awkward(spark)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 20 not in ids and 24 not in ids and 23 in ids
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.representatives(empty(spark)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1300)]
    edges = spark.createDataFrame([*path, (5, 5), (None, 3)], "x long, y long")
    root = {r.node: r.root for r in connected_components(edges, "x", "y").collect()}
    assert root == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1300)}
