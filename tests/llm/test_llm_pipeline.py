"""The pipeline against brute force on a small folder of tables."""

import re
from collections import Counter, defaultdict

import pytest
from llm_util import SCHEMA, awkward_rows
from test_llm_simhash import least_reachable, plain_print

import corpus_pipeline
from tessera.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [r for i, r in enumerate(awkward_rows()) if r[0] is not None and i < 24]
    rows += [(60 + k, rows[0][1] + f" w{k}", "en", "a", 1) for k in range(3)]
    rows += [(70, rows[5][1] + " the end of it", "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[7][1]), (2, None)], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path, rows


def brute(rows):
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = defaultdict(list)
    for r in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    kept = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    first = {}
    for r in kept:
        p = plain_print(r[1])
        first[p] = min(first.get(p, r[0]), r[0])
    least = least_reachable(first, 2)
    kept = [r for r in kept if least[plain_print(r[1])] == r[0]]
    item = " ".join(rows[7][1].split())
    return {r[0]: r[1] for r in kept if item not in " ".join(r[1].split())}


def test_run_matches_brute_force(spark, folder):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    path, rows = folder
    want = brute(rows)
    pieces = corpus_pipeline.run(spark, path).collect()
    size = Counter()
    for p in pieces:
        size[p.doc_id] += p.length
    assert size == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in want.items()}


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and set(QUERIES) <= names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
