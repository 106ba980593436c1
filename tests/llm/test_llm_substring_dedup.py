import hashlib
import random
from collections import Counter

from llm_util import awkward, awkward_rows, empty, prose, words

from tessera.llm import substring_dedup


def brute(rows, window):
    """Rows in key order (nulls first); repeated keys by the bytes of their words."""
    seen, out = set(), Counter()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, b" ".join(words(r[1]))))
    for doc, text, *_ in order:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if x in seen:
                gone[k:k + window] = [True] * window
            seen.add(x)
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
    return out


def told(df):
    return Counter((r.key, r.n_words, r.n_removed, r.kept_sha256, r.kept_text)
                   for r in df.collect())


def test_awkward_rows_match_brute_force(spark):
    rows = awkward_rows()
    got = told(substring_dedup.remove_repeats(awkward(spark).coalesce(1), window=20))
    assert got == brute(rows, 20)


def test_shared_passages_over_many_chunks_and_buckets(spark):
    rng = random.Random(7)
    shared = [prose(rng, n) for n in (9, 19, 20, 21, 37, 80)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), prose(rng, rng.randint(0, 15))]
        rows.append((i * 7 % 120, " ".join(parts), "en", "a", 1))
    rows += [(200 + i, "same word " * rng.randint(5, 40), "en", "a", 1) for i in range(6)]
    docs = awkward(spark, rows).repartition(5)
    for window in (20, 6):
        got = told(substring_dedup.remove_repeats(docs, window=window, chunk_bytes=600,
                                                  bucket_entries=50))
        assert got == brute(rows, window)


def test_spans_are_maximal(spark):
    a, b = prose(random.Random(1), 50), prose(random.Random(2), 30)
    rows = [(1, a, None, None, None), (2, f"{b} {a} {b} tail", None, None, None)]
    got = {r.key: r for r in substring_dedup.remove_repeats(awkward(spark, rows)).collect()}
    assert [(s.start, s.words) for s in got[2].spans] == [(30, 80)]  # the two repeats touch
    assert got[1].spans == [] and got[2].kept_text == b + " tail"


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
