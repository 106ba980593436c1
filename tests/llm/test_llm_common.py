import random

import numpy as np
import pytest
from llm_util import CLASHING, awkward, awkward_rows
from pyspark.sql import functions as F

from tessera.llm import common


def test_probable_set_has_no_false_negative(spark, monkeypatch):
    rng = random.Random(1)
    keys = [rng.randint(-10**12, 10**12) for _ in range(3000)] + [None]
    gone = spark.createDataFrame([(k, f"t{k}") for k in keys], "k long, t string")
    rows = spark.createDataFrame([(k, f"t{k}") for k in keys] + [(i, f"u{i}") for i in range(3000)],
                                 "k long, t string")
    told = common.with_probable(rows, common.probable_set(gone, "k", "t"), "k", "t")
    assert told.columns == ["k", "t", "_probable"]
    got = [(r.t, r._probable) for r in told.collect()]
    assert all(p for t, p in got if t.startswith("t")) and len(got) == 6001
    assert sum(p for t, p in got if t.startswith("u")) < 30
    # A set that is far too small still gives the exact rows.
    monkeypatch.setattr(common, "SET_BITS", 64)
    monkeypatch.setattr(common, "ROW_BITS", 32)
    left = common.without_keys(rows, "k", gone, "k")
    known = {k for k in keys if k is not None}
    assert sorted(r.k for r in left.collect()) == [i for i in range(3000) if i not in known]


def test_without_keys_keeps_columns_and_rows(spark):
    docs = awkward(spark)
    gone = spark.createDataFrame([(3,), (None,)], "doc_id long")
    left = common.without_keys(docs, "doc_id", gone, "doc_id")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(
        r[0] for r in awkward_rows() if r[0] not in (3, None))
    assert common.without_keys(docs, "doc_id", gone.limit(0), "doc_id").count() == len(awkward_rows())


def test_words_are_the_contract_s(spark):
    text = "a\tb\nc\x0bd\x0ce\rf g\x1ch\x85i\xa0j  k"
    assert [w.decode() for w in common.words_of(text)] == [
        "a", "b", "c", "d", "e", "f", "g\x1ch\x85i\xa0j", "k"]
    assert common.words_of(None) == []
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.translate("t", common.SEPARATORS, "")).first()[0] == "".join(
        w.decode() for w in common.words_of(text))


def test_rolling_equals_plain_evaluation():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    got = common.rolling(x, 7, 12345)
    for i, h in enumerate(got.tolist()):
        want = 0
        for v in x[i:i + 7].tolist():
            want = (want * (12345 | 1) + v) % (1 << 64)
        assert h == want
    assert len(common.rolling(x, 51, 3)) == 0


def test_id_crc(spark):
    import zlib
    df = spark.createDataFrame([(17,), (-3,), (None,)], "doc_id long")
    assert [r[0] for r in df.select(common.id_crc()).collect()] == [
        zlib.crc32(b"17"), zlib.crc32(b"-3"), 0]


def test_written_files(tmp_path):
    folder = f"file://{tmp_path}/a/b"
    assert common.write_file(folder, "x.bin", [b"12", b"", b"345"]) == 5
    assert common.write_file(folder, "x.bin", [b"678"]) == 3  # a second attempt replaces
    with common.open_file(folder, "x.bin") as f:
        assert f.read() == b"678"

    def broken():
        yield b"1"
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        common.write_file(folder, "y.bin", broken())
    assert not (tmp_path / "a/b/y.bin").exists()


def test_rows_keep_every_column(spark):
    """Columns named like the operators' own come through with their values."""
    from tessera.llm import decontaminate, exact_dedup, simhash
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "no document holds this one item of ten words here")],
                                  "item_id long, text string")
    for kept in (exact_dedup.deduplicate(docs), simhash.representatives(docs),
                 decontaminate.clean(docs, items)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[c] == "x" for r in rows for c in CLASHING)
    told = decontaminate.mark(docs, items)
    assert told.columns == [*docs.columns, "items_2", "longest_run_2", "cover_2", "contaminated_2"]
    assert {(r.items, r.contaminated_2) for r in told.collect()} == {("x", False)}
