"""The state of the incremental ingest: bounded reads, replays, late pulls, compaction."""

import os
from datetime import timedelta

import pytest

from tessera.sources.store import Store
from tessera.streaming import ingest as SI
from test_sources import A_HEAD, B_HEAD
from xlsx_util import write_xlsx

X = "Personal Residential - X"


def sheet(pif, quarter="2024q1"):
    return [[f"Report {quarter}"], None, None, B_HEAD, [1, "Acme", X, None, pif, 10.0, 1.0]]


def batch_of(spark, d, files):
    """(path, modificationTime, length, content) of files written to d."""
    os.makedirs(d, exist_ok=True)
    paths = []
    for name, rows in files.items():
        paths.append(os.path.join(d, name))
        if isinstance(rows, bytes):
            open(paths[-1], "wb").write(rows)
        else:
            write_xlsx(paths[-1], rows)
    return spark.read.format("binaryFile").load(paths)


def name(quarter, day, token="policy_type"):
    return f"filing_by_company_and_{token}_{quarter}_202405{day:02d}t080000.xlsx"


def facts(spark, out):
    return sorted((r.period, r.pif) for r in SI.load_stream(spark, out)["facts_b"].collect())


def opened(spark, out):
    ds = SI.load_stream(spark, out)
    return len(ds["facts_b"].inputFiles()), len({e["folder"] for e in SI._newest_state(
        Store(spark, out))["entries"]})


def test_reads_stay_constant_over_twenty_batches(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    seen = []
    for k in range(20):
        # Every batch pulls the first quarter again; every fourth brings a new quarter's pull.
        files = {name("2024q1", k + 1): sheet(k + 1)}
        if k % 4 == 0:
            files[name(f"2023q{k // 4 % 4 + 1}", k + 1)] = sheet(100 + k, "x")
        SI.process_batch(batch_of(spark, src, files), k, out, compact_every=3)
        seen.append(opened(spark, out))
        assert ("2024Q1", k + 1) in facts(spark, out)
    quarters = 5
    assert all(n <= quarters and folders <= 3 for n, folders in seen)
    assert seen[-1][0] == seen[16][0] == quarters
    assert facts(spark, out) == [("2023Q1", 116.0), ("2023Q2", 104.0), ("2023Q3", 108.0),
                                 ("2023Q4", 112.0), ("2024Q1", 20.0)]
    # Any batch again, and pulls that come late, change nothing.
    before = [e.name for e in Store(spark, out).list("state")]
    SI.process_batch(batch_of(spark, src, {name("2024q1", 6): sheet(6)}), 5, out)
    assert [e.name for e in Store(spark, out).list("state")] == before
    SI.process_batch(batch_of(spark, src, {name("2024q1", 3): sheet(3), name("2023q2", 2): sheet(2)}), 20, out)
    assert ("2024Q1", 20.0) in facts(spark, out) and ("2023Q2", 104.0) in facts(spark, out)
    # Cleaning keeps what is current, and what a reader may just be using.
    assert SI.clean(spark, out) == 0
    assert SI.clean(spark, out, timedelta(0)) > 10
    assert len(facts(spark, out)) == quarters
    assert len(os.listdir(os.path.join(out, "batches"))) <= 4
    SI.process_batch(batch_of(spark, src, {name("2024q1", 3): sheet(3)}), 20, out)  # a replay still
    assert ("2024Q1", 20.0) in facts(spark, out)


def test_a_batch_that_died_is_not_seen(spark, tmpdir_path, monkeypatch):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    SI.process_batch(batch_of(spark, src, {name("2024q1", 1): sheet(1)}), 0, out)
    put = Store.put_if_absent

    def dies(self, *a):
        raise RuntimeError("died")

    monkeypatch.setattr(Store, "put_if_absent", dies)
    batch = batch_of(spark, src, {name("2024q1", 2): sheet(2)})
    with pytest.raises(RuntimeError, match="died"):
        SI.process_batch(batch, 1, out)
    assert facts(spark, out) == [("2024Q1", 1.0)]
    monkeypatch.setattr(Store, "put_if_absent", put)
    SI.process_batch(batch, 1, out)
    assert facts(spark, out) == [("2024Q1", 2.0)]


def test_compaction_beside_a_batch(spark, tmpdir_path, monkeypatch):
    """A batch commits between the compaction's reading and its commit."""
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    for k in range(3):
        SI.process_batch(batch_of(spark, src, {name(f"2024q{k + 1}", 1): sheet(k)}), k, out, None)
    write = SI._write_parts

    def batch_meanwhile(tables, folder):
        monkeypatch.setattr(SI, "_write_parts", write)
        write(tables, folder)
        SI.process_batch(batch_of(spark, src, {name("2024q1", 2): sheet(50)}), 3, out, None)

    monkeypatch.setattr(SI, "_write_parts", batch_meanwhile)
    SI.compact(spark, out)
    want = [("2024Q1", 50.0), ("2024Q2", 1.0), ("2024Q3", 2.0)]
    assert facts(spark, out) == want
    assert SI.compact(spark, out) and facts(spark, out) == want
    assert not SI.compact(spark, out) and opened(spark, out) == (3, 1)


def test_content_decides_and_damage_is_a_warning(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    a = [["4/1/2024-6/30/2024"], None, A_HEAD, [1, "Acme", 7, 5, 2, 3, 9.0, 4.0, 5.0]]
    SI.process_batch(batch_of(spark, src, {name("2024q1", 1): sheet(1), name("2020q1", 2): a}), 0, out)
    ds = SI.load_stream(spark, out)
    assert sorted((r.layout, r.period) for r in ds["files"].collect()) == [("A", "2024Q2"), ("B", "2024Q1")]
    assert ds["facts_a"].first().a_pif == 5.0
    SI.process_batch(batch_of(spark, src, {name("2024q1", 3): b"damaged"}), 1, out)
    ds = SI.load_stream(spark, out)
    assert ds["facts_b"].count() == 0 and ds["facts_a"].count() == 1
    assert [(r.layout, r.code) for r in ds["warnings"].collect()] == [("B", "unreadable")]
    assert {r.key for r in ds["metrics_a"].collect()} >= {"a_pif", "a_dpw"}
    assert SI.load_stream(spark, os.path.join(tmpdir_path, "nothing"))["files"].count() == 0
