"""Host reputation, decontamination and quality scores."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from llm_util import awkward, awkward_rows, empty, prose

from tessera.llm import decontaminate, quality_knn, url_reputation
from tessera.llm.queries import QUERIES, SQL, URL_RULES

SF = "/root/testdata/sf0.01"


# -- urls ----------------------------------------------------------------------------

URLS = [
    ("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com?u=http://y.org/", "x.com", "", None, None),
    ("http://org", "org", "", None, None),
    ("x://u:p@h.co.uk:80#/a", "u:p@h.co.uk:80", "", None, None),
    ("no scheme.org/es/", "", "", None, None), ("", "", "", None, None),
    (None, "", "", None, None), ("http://ÄÖ.ORG/\nz", "ÄÖ.org", "/\nz", "org/", "allow"),
]


def test_hosts_paths_and_rules(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    pages = pages.withColumns({c: F.lit("x") for c in ("host", "path", "key", "lower", "mean")})
    none = spark.createDataFrame([], "doc_id long, bad int")
    told = url_reputation.judge(pages, none, URL_RULES).orderBy("key").collect()
    for r, (_, host, path, rule, verdict) in zip(told, URLS, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")


def beta_binomial(hosts):
    """The posterior bad rate of each host, in plain Python."""
    def level(name):
        out = defaultdict(lambda: [0, 0])
        for h, (n, y) in hosts.items():
            out[name(h)][0] += n
            out[name(h)][1] += y
        return out

    def strength(groups):
        g = [(n, y) for n, y in groups if n]
        t, y = sum(n for n, _ in g), sum(y for _, y in g)
        if not t:
            return url_reputation.STRENGTH[1]
        p = y / t
        room = p * (1 - p) * (t - sum(n * n for n, _ in g) / t - (len(g) - 1))
        spread = sum(b * b / n for n, b in g) - t * p * p
        rho = (spread - p * (1 - p) * (len(g) - 1)) / room if room > 0 else 0
        return min(max((1 - rho) / rho if rho > 0 else 1e9, url_reputation.STRENGTH[0]),
                   url_reputation.STRENGTH[1])

    suffix, domain = level(lambda h: h.split(".")[-1]), level(lambda h: ".".join(h.split(".")[-2:]))
    base = (sum(y for _, y in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    ms, md, mh = (strength(x.values()) for x in (suffix, domain, hosts))
    s = {k: (y + ms * base) / (n + ms) for k, (n, y) in suffix.items()}
    d = {k: (y + md * s[k.split(".")[-1]]) / (n + md) for k, (n, y) in domain.items()}
    return {h: ((y + mh * d[".".join(h.split(".")[-2:])]) / (n + mh), n + mh)
            for h, (n, y) in hosts.items()}


def test_reputation_matches_plain_python(spark):
    rng = random.Random(3)
    rate = {"a.x.org": 0.9, "b.x.org": 0.7, "c.y.org": 0.1, "d.z.com": 0.2, "e.w.com": 0.0, "f.w.com": 0.5}
    pages, outcomes, hosts = [], [], {h: [0, 0] for h in rate}
    for i in range(900):
        h = rng.choice([*rate] + ["a.x.org"] * 6)
        pages.append((i, f"http://{h}/p"))
        if rng.random() < 0.7:
            bad = int(rng.random() < rate[h])
            outcomes += [(i, bad)] * (2 if i == 0 else 1)
            hosts[h][0] += 2 if i == 0 else 1
            hosts[h][1] += bad * (2 if i == 0 else 1)
    outcomes += [(3, None), (None, 1), (5000, 1)]
    known = url_reputation.reputation(spark.createDataFrame(pages, "page_id long, url string"),
                                      spark.createDataFrame(outcomes, "doc_id long, bad int"))
    want = beta_binomial(hosts)
    for r in known.collect():
        mean, size = want[r.host]
        assert (r.n, r.bad) == tuple(hosts[r.host])
        assert math.isclose(r.mean, mean, rel_tol=1e-9)
        sd = math.sqrt(mean * (1 - mean) / (size + 1))
        assert math.isclose(r.lower, max(0, mean - url_reputation.Z * sd), abs_tol=1e-9)
    told = url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"),
                                spark.createDataFrame(outcomes, "doc_id long, bad int")).collect()
    assert {r.host for r in told if r.verdict == "block"} == {"a.x.org", "b.x.org"}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, bad int")
    assert url_reputation.judge(pages, none, URL_RULES).count() == 0


# -- benchmark ---------------------------------------------------------------------

ITEMS = [
    (1, "Alice walked 12 km from Paris to Lyon and then rode another 30 km to the old harbour "
        "before resting for 2 hours near the river"),
    (2, "What is the sum of the first 25 odd numbers that are not divisible by 3 or by 7"),
    (3, "Short item only"), (4, None), (5, ""), (6, "seven little words make one tiny item"),
    (None, "an item without an id still makes its documents contaminated when it is found in full"),
]


def found(spark, texts, **settings):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("key", F.lit("x"))
    rows = decontaminate.mark(docs, items, **settings).orderBy("doc_id").collect()
    return [(r.contaminated, r["items"]) for r in rows]


def test_verbatim_reparameterised_and_inconsistent(spark):
    one, two = ITEMS[0][1], ITEMS[1][1]
    rng = random.Random(1)
    pad = [prose(rng, 50) + ". " for _ in range(12)]
    told = found(spark, [
        pad[0] + one + ". " + pad[1],
        pad[2] + one.upper() + "! " + pad[3],
        pad[4] + two.replace("25", "41").replace(" 3 ", " 5 ").replace(" 7", " 9"),
        # Other numbers, names and units; each value stands for one other value.
        one.replace("12", "15").replace("30", "44").replace(" km", " miles").replace("Paris", "Rome")
        .replace("Lyon", "Milan").replace("hours", "days").replace(" 2 ", " 3 "),
        # One half of the item, in reach of a run of 12.
        pad[5] + " ".join(one.split()[:13]) + " " + pad[6],
        # Six words of it are not enough.
        pad[7] + " ".join(one.split()[:6]) + " " + pad[8],
        pad[9], None, "", ITEMS[5][1], "Short item only", ITEMS[6][1]])
    assert [c for c, _ in told] == [True, True, True, True, True, False, False, False, False, True,
                                    True, True]
    assert [i for _, i in told] == [[1], [1], [2], [1], [1], [], [], [], [], [6], [3], []]


def told_of(item, text, settings=decontaminate.Settings(), before=("some other text. ",)):
    """Run and cover of an item in the last of some texts: windows joined by a dictionary."""
    v = decontaminate.Vocabulary()
    rows = [r for b in decontaminate.item_windows(v, 1, 2, item, settings) for r in b.to_pylist()]
    if not rows:
        return None
    every = decontaminate.Bits(3, np.full(1, 255, np.uint8))
    hits = [r for b in decontaminate.document_windows(
        v, [0] * len(before) + [1], [0] * len(before) + [1], [*before, text], [rows[0]["size"]],
        every, settings) for r in b.to_pylist() if r["d1"] == 1]
    both = [a | b for a in rows for b in hits if a["h"] == b["h"]]
    if not both:
        return None
    array = {n: np.array([r[n] for r in both]) for n in ("form", "place", "at")}
    wide = {n: np.stack([np.frombuffer(r[n], k) for r in both]) for n, k in (
        ("own", np.uint64), ("there", np.uint64), ("plain", np.int8), ("named", np.int8))}
    return decontaminate.judge(rows[0]["total"], rows[0]["size"], **array, **wide, settings=settings)


SHORT = ["Who wrote Hamlet?", "Define photosynthesis.", "Warum?", "Short item only.", "What is 7?"]


@pytest.mark.parametrize("item", SHORT)
def test_short_items_count_where_they_stand_alone(item):
    for text in (item, item.lower(), f"It began. {item} Then it ended.", f"Asked: {item}",
                 f"One said ... {item} And so on"):
        assert told_of(item, text) == (len(item.split()), 1.0)
    stem = item.rstrip("?.")
    for text in (f"he asked {stem} and left", f"{stem} by chance, and so on", f"and then {item}"):
        assert told_of(item, text) is None
    assert told_of(item, "", before=(item,)) is None


NUMBERED = {
    "five apples and three pears cost twenty-five dollars so how many days until nothing is left":
        "seven apples and four pears cost thirty-two dollars so how many days until nothing is left",
    "wie lange braucht er für fünf lange wege wenn er für drei kurze wege zwanzig minuten braucht":
        "wie lange braucht er für sieben lange wege wenn er für vier kurze wege dreißig minuten braucht",
    "combien de temps faut il pour cinq tours si trois tours prennent vingt-deux minutes en tout":
        "combien de temps faut il pour sept tours si quatre tours prennent trente heures en tout",
    "cuánto tiempo necesita para cinco vueltas si tres vueltas cuestan veinte minutos en total":
        "cuánto tiempo necesita para siete vueltas si cuatro vueltas cuestan treinta horas en total",
}


@pytest.mark.parametrize("item", NUMBERED)
def test_spelled_numbers_and_units_of_four_languages(item):
    run, cover = told_of(item, "a text. " + NUMBERED[item])
    assert run >= 12 and cover > 0.9


def test_compound_numbers():
    for word in ("twenty-five", "fünfundzwanzig", "einundzwanzig", "vingt-et-un", "veintidós"):
        assert decontaminate._is_number(word)
    for word in ("hund", "undertow", "veint", "co-op", "grundig", "und"):
        assert not decontaminate._is_number(word)


def test_windows_stay_in_their_text():
    item = ITEMS[0][1]
    words = item.split()
    assert told_of(item, " ".join(words[7:14]), before=(" ".join(words[:7]),)) is None
    assert told_of(item, item, before=(None, "", item)) == (len(words), 1.0)


def plain_cover(item, text):
    """Longest run and cover of raw windows of eight tokens on one diagonal, by brute force."""
    a, b, best = item.split(), text.split(), (0, 0.0)
    size = min(8, len(a))
    for shift in range(-len(a), len(b) + 1):
        held = [False] * len(a)
        for p in range(len(a) - size + 1):
            if 0 <= p + shift <= len(b) - size and a[p:p + size] == b[p + shift:p + shift + size]:
                held[p:p + size] = [True] * size
        run = longest = 0
        for h in held:
            run = run + 1 if h else 0
            longest = max(longest, run)
        best = max(best, (longest, sum(held) / len(a)))
    return best


def test_random_edits_match_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        item = prose(rng, rng.randint(5, 30))
        words = item.split()
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(words) + 1)
            words[k:k + rng.randint(0, 1)] = [rng.choice(["xx", "yy", "zz"])] * rng.randint(0, 2)
        text = prose(rng, 5) + " " + " ".join(words) + " " + prose(rng, 5)
        run, cover = plain_cover(item, text)
        enough = run and (run >= min(12, len(item.split())) or cover >= 0.6)
        told = told_of(item, text)
        assert (told is not None) == bool(enough)
        if told:
            assert told == (run, pytest.approx(cover))


def test_slots_must_be_consistent():
    own = ("the red train left town at 5 and the blue train left town at 5 while the green train "
           "left town at 5 again")
    settings = decontaminate.Settings(min_cover=0.9, min_run=20)
    assert told_of(own, own.replace("5", "9"), settings)
    assert not told_of(own, own.replace("5", "9", 1).replace("at 5 while", "at 7 while"), settings)


def test_names_alone_match_nothing():
    assert not told_of("we met Ann Bob Cid Dan Eve Fay Gus Hal Ike and Jo at 5 km",
                       "they saw Kim Lou Max Ned Oli Pat Quin Rob Sam and Tom at 7 km")


DENSE = [
    "Compute 3 + 4 * 5 - 6 / 2 + 8 * 9 - 1 when x = 7 and y = 2",
    "On 12 May 1998 Anna Berg paid 340 dollars to Carl Holm in Oslo and on 3 June 1999 Carl Holm "
    "paid 120 dollars to Anna Berg",
    "What is 7 times 8?",
]


@pytest.mark.parametrize("item", DENSE)
def test_verbatim_copies_of_dense_items(item):
    for copy in (item, item.lower(), item.upper()):
        assert told_of(item, f"some words of another text. {copy} and more of it")
    assert not told_of(item, "On 3 July 2001 Kim Lund paid 77 cents. Compute 1 + 2. What is 6 plus 9?")


TOM = ("Tom has 5 red apples. Mary has 3 green pears. Tom buys 2 more apples. How many apples does "
       "Tom have now?")


def test_names_that_open_sentences():
    other = TOM.replace("Tom", "Ben").replace("Mary", "Ann").replace("5", "7").replace("3", "4")
    assert told_of(TOM, f"it was so. {other} Nothing else was said.")
    assert not told_of(TOM, "Tom has a car. Mary likes green tea. Now the pears are sold out again.")
    german = ("Der Bauer fährt am Morgen mit dem Wagen in die Stadt und verkauft auf dem Markt "
              "Äpfel, Birnen und Kartoffeln aus seinem Garten")
    assert told_of(german, "und dann: " + german.lower())


def test_set_of_hash_bits_changes_no_result(spark):
    texts = [t for _, t in ITEMS if t] + ["clean words that nobody asked about, not even once here"]
    one = found(spark, texts)
    assert found(spark, texts, filter_bits=8) == one  # lets all windows through
    assert [c for c, _ in one] == [True] * 5 + [False]


def test_set_of_hash_bits_holds_every_key(spark):
    keys = [k * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(5000)]
    frame = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "h long")
    bits = decontaminate.bits_of(frame, 1 << 29)
    assert len(bits.may_hold(np.array(keys, np.uint64))) == len(keys)
    others = np.array([k ^ 0x5555555555555555 for k in keys], np.uint64)
    assert bits.width == 18 and len(bits.may_hold(others)) < 100


def test_equal_items_and_equal_documents(spark):
    item = ITEMS[0][1]
    docs = spark.createDataFrame([(k, f"x. {item}. y") for k in range(300)] + [(900, "z")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (4, item), (4, item), (None, item)],
                                  "item_id long, text string")
    rows = decontaminate.mark(docs, items).collect()
    assert len(rows) == 301
    assert {(r.doc_id == 900, tuple(r["items"])) for r in rows} == {(False, (4, 9)), (True, ())}


def test_awkward_rows_and_columns(spark):
    items = spark.createDataFrame([(7, awkward_rows()[0][1]), (8, awkward_rows()[2][1])],
                                  "item_id long, text string")
    docs = awkward(spark)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert {0, 20, 21, 2, 28}.isdisjoint(got) and len(got) == len(awkward_rows()) - 5
    assert decontaminate.clean(docs, items.limit(0)).count() == len(awkward_rows())
    assert decontaminate.mark(empty(spark), items).count() == 0


def test_planted_benchmark_passages(spark):
    """Documents with an item verbatim (plain search) are told, others are not."""
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = [t for (t,) in con.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    flat = [" ".join(t.split()) for t in items]
    want = {d for d, t in docs if any(i in " ".join((t or "").split()) for i in flat)}
    told = QUERIES["op9_decontamination"](spark, SF).where("contaminated").collect()
    assert len(want) > 10 and {r.doc_id for r in told} == want


# -- quality -----------------------------------------------------------------------

def test_shapes():
    assert [quality_knn.shape(w) for w in ("abc", "Abc", "ABC", "ABC!!", "a1b2", "***", "É'x")] == [
        "a", "Aa", "A", "A!", "a0a0", "*", "A'a"]


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(1)
    vectors = quality_knn._unit(rng.normal(size=(200, 8)).astype(np.float32))
    labels = (rng.random(200) > 0.5).astype(float)
    eye = np.zeros((quality_knn.FEATURES, 8), np.float32)
    eye[:8, :8] = np.eye(8)
    model = quality_knn.Model(np.ones(quality_knn.FEATURES, np.float32), eye, vectors.T.copy(), labels,
                              0.3, 5, 4.0)
    rows = np.zeros((50, quality_knn.FEATURES), np.float32)
    rows[:40, :8] = rng.normal(size=(40, 8))
    got = model.score(rows)
    assert (got[40:] == 0.3).all()
    for x, s in zip(rows[:40, :8], got, strict=False):
        near = vectors @ (x / np.linalg.norm(x))
        best = np.argsort(-near)[:5]
        w = np.clip(near[best], 0, 1).astype(float) ** 4
        assert abs(s - ((w * labels[best]).sum() + 1e-3 * 0.3) / (w.sum() + 1e-3)) < 1e-4


def test_awkward_rows_no_labels_and_bound(spark):
    from pyspark.sql import functions as F
    docs = awkward(spark).withColumn("quality", F.col("doc_id") % 2)
    model = quality_knn.fit(docs, label="quality", max_labelled=10)
    assert len(model.labels) == 10
    told = {r.doc_id: r for r in quality_knn.score(docs, model).collect()}
    assert told[23].score_2 == told[24].score_2 == told[25].score_2 == model.prior
    assert all(0 <= r.score_2 <= 1 and r.score == "x" for r in told.values())
    none = quality_knn.fit(docs.withColumn("quality", F.lit(None).cast("int")), label="quality")
    assert {r.score_2 for r in quality_knn.score(docs, none).collect()} == {0.5}
    assert quality_knn.score(empty(spark), model).count() == 0


def test_held_out_quality(spark):
    told = QUERIES["op2_quality_knn"](spark, SF).join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = told[told.quality == 1].score, told[told.quality == 0].score
    auc = (good.values[:, None] > bad.values[None, :]).mean()
    assert len(bad) > 10 and auc > 0.95 and (told.predicted == told.quality).mean() > 0.95


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    told = QUERIES[name](spark, SF)
    cols = sorted(told.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    got = [tuple(r[c] for c in cols) for r in told.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
