"""The automaton against plain edit distances; learning, context and held-out rows."""

import random

import numpy as np
import pytest
from llm_util import awkward, awkward_rows, empty, prose

from tessera.llm import toxicity as T
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
INSULTS = ["blorgface", "snarp", "vexil", "grumbletop", "krunt"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_match(word, terms, weights, stem):
    """Best (edits, term) by comparing with every term, or with every prefix for stems."""
    found = []
    for at, t in enumerate(terms):
        if stem[at]:
            room = int(len(t) >= 7)
            e = min(distance(word[:n], t) for n in range(len(word) + 1))
        else:
            room, e = T.allowed_edits(len(t)), distance(word, t)
        if e <= room:
            found.append((e, -weights[at], t, at))
    return (min(found)[0], min(found)[3]) if found else None


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_edit_distances(seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(T, "MAX_MOVES", 50)
    rng = random.Random(seed)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(40)})
    weights = [rng.choice([1.0, 2.0]) for _ in terms]
    stem = [rng.random() < 0.2 for _ in terms]
    automaton = T.Automaton(terms, weights, stem)
    for _ in range(1500):
        word = rng.choice(terms) if rng.random() < 0.7 else "".join(
            rng.choice("abcz") for _ in range(rng.randint(0, 12)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(word))
            word = rng.choice([word[:i] + rng.choice("abcdé") + word[i:], word[:i] + word[i + 1:],
                               word[:i] + rng.choice("abc") + word[i + 1:]])
        assert automaton.match(word) == plain_match(word, terms, weights, stem), word


def corpus(seed=5, n=700):
    """Documents, labels: every toxic one holds insults or words of one stem."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, 40).split(), rng.random() < 0.25
        if toxic:
            for _ in range(3):
                ill = rng.choice(INSULTS) if rng.random() < 0.7 else "drolm" + prose(rng, 1)
                words.insert(rng.randrange(len(words)), ill)
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(toxic)))
    # A clean neighbour of a term, and a passage copied into many toxic rows.
    docs += [(n + i, prose(rng, 20) + " snark " + prose(rng, 20), "en", "s", 1) for i in range(30)]
    labels += [(n + i, 0) for i in range(30)]
    docs += [(n + 100 + i, "quite harmless wording copied often krunt", "en", "s", 1) for i in range(60)]
    labels += [(n + 100 + i, 1) for i in range(60)]
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    labels += [(1, None), (None, 1), (99_999, 1)]
    return T.fit(awkward(spark, docs), spark.createDataFrame(labels, "doc_id long, label int"))


def test_lexicon_is_learned(model):
    exact = {t for t, s in zip(model.lexicon.terms, model.lexicon.stem, strict=True) if not s}
    assert set(INSULTS) <= exact
    assert [t for t, s in zip(model.lexicon.terms, model.lexicon.stem, strict=True) if s] == ["drol"]
    assert not exact & {"quite", "harmless", "wording", "copied", "often"}  # one context only
    assert "snark" in model.lexicon.spared


def scores(spark, model, texts):
    rows = T.judge(awkward(spark, [(i, t, None, None, 1) for i, t in enumerate(texts)]), model)
    return {r.key: r for r in rows.collect()}


def test_misspellings_context_and_clean_texts(spark, model):
    filler = prose(random.Random(9), 30)
    texts = [f"{filler} you grumbletop ! {filler}", f"{filler} grumbeltop {filler} snrap grmbletop blorgfaze",
             f"{filler} BLORGFACE!!! {filler}", f"{filler} bl0rgf@ce {filler}", f"{filler} drolmxyz {filler}",
             f'{filler} the word "grumbletop" was quoted {filler}', f"{filler} snark {filler}", filler, "", None]
    told = scores(spark, model, texts)
    clean = told[7].score
    assert clean < 0.1 and told[6].score == told[8].score == told[9].score == clean
    assert told[8].found == told[6].found == []
    for i in (0, 1, 2, 3, 4):
        assert told[i].score > 0.3, i
    assert [(f.term, f.edits) for f in told[1].found if f.term != "snarp"][:1] == [("grumbletop", 2)]
    assert told[3].found[0].term == "blorgface"
    assert told[5].found[0].quoted == 1.0 and clean < told[5].score < told[0].score
    assert told[0].found[0].place == 31


def test_awkward_rows_and_no_labels(spark, model):
    df = awkward(spark)
    told = T.judge(df, model)
    assert told.columns == ["key", "score", "found"]
    rows = told.collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert T.judge(empty(spark), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, label int")
    for labels in (none, spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, label int")):
        bare = T.fit(df, labels)
        assert bare.lexicon.terms == ()
        assert all(r.score <= T.BASE + 1e-9 and not r.found for r in T.judge(df, bare).collect())


def test_same_model_whatever_the_order(spark, model):
    docs, labels = corpus()
    rng = random.Random(2)
    rng.shuffle(docs)
    rng.shuffle(labels)
    again = T.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, "
                                              "n_chars long").repartition(7),
                  spark.createDataFrame(labels, "doc_id long, label int"))
    assert again.lexicon == model.lexicon and np.allclose(again.weights, model.weights)


def test_held_out_rows(spark):
    told = QUERIES["op11_toxicity"](spark, SF)
    assert told.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = told.where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").toPandas()
    assert ((held.predicted == 1) == (held.score >= 0.3)).all()
    assert (held.predicted == held.toxic).mean() > 0.93
    assert held[held.toxic == 0].predicted.mean() < 0.03
