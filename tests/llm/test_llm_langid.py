import numpy as np
import pytest
from llm_util import awkward, awkward_rows, empty

from tessera.llm import langid

TEXTS = [("en", "the cat and the dog were with this thing"), ("fr", "le chien et la maison avec une"),
         ("de", "der hund und die katze nicht ein"), ("es", "el perro y la casa con una de los")]


def model_of(spark, rows=None):
    rows = rows if rows is not None else [
        (i, t, lang, "s", 1) for i, (lang, t) in enumerate(TEXTS * 3)]
    return langid.train(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = "The quick, brown  fox! ähm 123 jumps" * 40
    whole = np.sort(np.concatenate(list(langid.ngram_buckets(text, 1 << 12))))
    code = [c for c in "".join(x if x.isalpha() else " " for x in text.lower())]
    runs = (" " + " ".join("".join(code).split()) + " ") if code else ""
    assert len(whole) == sum(max(0, len(runs) - k) for k in range(3))
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (np.sort(np.concatenate(list(langid.ngram_buckets(text, 1 << 12)))) == whole).all()


def test_counts_match_a_plain_count(spark):
    model = model_of(spark)
    assert model.labels == ("de", "en", "es", "fr")
    counts = np.zeros((langid.BUCKETS, 4))
    for lang, t in TEXTS * 3:
        for grams in langid.ngram_buckets(t, langid.BUCKETS):
            np.add.at(counts[:, model.labels.index(lang)], grams, 1)
    want = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * langid.BUCKETS)
    assert np.allclose(model.log_prob, want, atol=1e-4)


def test_predictions_and_awkward_rows(spark):
    model = model_of(spark)
    for lang, t in TEXTS:
        assert model.predict(t)[0] == lang
    told = {r.doc_id: r for r in langid.identify(awkward(spark), model).collect()}
    for doc in (23, 24, 25, 26):
        assert (told[doc].lang_pred_2, told[doc].score_2) == ("und", 0.0)
        assert (told[doc].lang_pred, told[doc].score) == ("x", "x")
    assert told[30].lang_pred_2 != "und" and 0 < told[27].score_2 <= 1
    kept = langid.keep_identified(awkward(spark), model, min_score=0.0)
    assert kept.columns == awkward(spark).columns
    assert {23, 24, 25, 26}.isdisjoint({r.doc_id for r in kept.collect()})


def test_no_training_rows_and_too_many_labels(spark):
    model = model_of(spark, [])
    told = langid.identify(awkward(spark), model).collect()
    assert {r.lang_pred_2 for r in told} == {"und"}
    assert langid.identify(empty(spark), model_of(spark)).count() == 0
    kept = langid.keep_identified(awkward(spark), model)
    assert kept.count() == len([t for _, t, *_ in awkward_rows() if any(c.isalpha() for c in t or "")])
    with pytest.raises(ValueError, match="bounded"):
        langid.train(awkward(spark, [(i, "ab", f"l{i}", "s", 1) for i in range(5)]), max_labels=4)


def test_held_out_accuracy(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    told = QUERIES["op7_language_id"](spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = told.where("held_out").toPandas()
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.99
