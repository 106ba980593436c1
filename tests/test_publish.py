"""Commits of concurrent writers, time travel, leases and expiry."""

import os
import threading
from datetime import datetime, timedelta, timezone

import pytest

from tessera.sources import sinks as SK
from tessera.sources.store import Store

NONE = timedelta(0)


def dataset(spark, value):
    facts = spark.createDataFrame([("2024Q1", value), ("2024Q2", value)], "period string, v int")
    return {"facts_b": facts, "periods": facts.select("period")}


def values(ds):
    return sorted({r.v for r in ds["facts_b"].collect()})


TABLES = ("facts_b", "periods")


def test_put_if_absent_has_one_winner(spark, tmpdir_path):
    store, won = Store(spark, tmpdir_path), []
    start = threading.Barrier(8)

    def run(k):
        start.wait()
        if store.put_if_absent("versions/x.json", {"by": k}):
            won.append(k)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.get("versions/x.json") == {"by": won[0]}
    assert [e.name for e in store.list("versions")] == ["x.json"]
    assert store.get("versions/none.json") is None and store.list("nothing") == []


def test_interleaved_writers(spark, tmpdir_path, monkeypatch):
    """Both write their tables before either commits."""
    put, inside = Store.put_if_absent, []

    def second_writer_first(self, name, content):
        if name.startswith("versions/") and not inside:
            inside.append(1)
            SK.publish(dataset(spark, 2), tmpdir_path)  # takes the number just chosen
        return put(self, name, content)

    monkeypatch.setattr(Store, "put_if_absent", second_writer_first)
    SK.publish(dataset(spark, 1), tmpdir_path)
    told = SK.history(spark, tmpdir_path).orderBy("version").collect()
    assert [(r.version, r.parent) for r in told] == [(1, 0), (2, 1)]
    assert len({r.folder for r in told}) == 2
    assert values(SK.load_dataset(spark, tmpdir_path, TABLES)) == [1]
    assert values(SK.load_dataset(spark, tmpdir_path, TABLES, version=1)) == [2]
    # A writer that says what it builds on is refused, whenever the other one comes.
    inside.clear()
    with pytest.raises(SK.PublishConflictError, match="after 2"):
        SK.publish(dataset(spark, 3), tmpdir_path, expected=2)
    assert values(SK.load_dataset(spark, tmpdir_path, TABLES)) == [2]
    with pytest.raises(SK.PublishConflictError):
        SK.publish(dataset(spark, 3), tmpdir_path, expected=2)
    SK.publish(dataset(spark, 4), tmpdir_path, expected=3)
    assert values(SK.load_dataset(spark, tmpdir_path, TABLES)) == [4]


def test_many_writers_at_once(spark, tmpdir_path):
    threads = [threading.Thread(target=SK.publish, args=(dataset(spark, k), tmpdir_path))
               for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    told = SK.history(spark, tmpdir_path).collect()
    assert sorted(r.version for r in told) == [1, 2, 3, 4, 5]
    seen = [values(SK.load_dataset(spark, tmpdir_path, TABLES, version=n))[0] for n in range(1, 6)]
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_time_travel_and_broken_commits(spark, tmpdir_path):
    SK.publish(dataset(spark, 1), tmpdir_path)
    between = datetime.now(timezone.utc)
    SK.publish(dataset(spark, 2), tmpdir_path)
    assert values(SK.load_dataset(spark, tmpdir_path, TABLES, as_of=between)) == [1]
    with pytest.raises(SK.DatasetNotFoundError, match="version 9"):
        SK.load_dataset(spark, tmpdir_path, TABLES, version=9)
    with pytest.raises(SK.DatasetNotFoundError):
        SK.load_dataset(spark, tmpdir_path, TABLES, as_of=between - timedelta(days=1))
    # A commit that is not whole is no version, but its number is taken.
    open(os.path.join(tmpdir_path, "versions", "0000000003.json"), "w").write('{"version": 3, ')
    assert values(SK.load_dataset(spark, tmpdir_path, TABLES)) == [2]
    SK.publish(dataset(spark, 4), tmpdir_path)
    assert [r.version for r in SK.history(spark, tmpdir_path).orderBy("version").collect()] == [1, 2, 4]


def folders(out):
    return sorted(os.listdir(os.path.join(out, "data")))


def test_expiry_spares_readers(spark, tmpdir_path):
    for k in range(1, 6):
        SK.publish(dataset(spark, k), tmpdir_path)
    assert SK.expire(spark, tmpdir_path) == []  # nothing was replaced a week ago
    with SK.reading(spark, tmpdir_path, TABLES, version=2) as ds:
        assert SK.expire(spark, tmpdir_path, keep_last=2, replaced_before=NONE) == [1, 3]
        assert values(ds) == [2]
        assert values(SK.load_dataset(spark, tmpdir_path, TABLES, version=2)) == [2]
    with pytest.raises(SK.DatasetNotFoundError):
        SK.load_dataset(spark, tmpdir_path, TABLES, version=1)
    assert len(folders(tmpdir_path)) == 3
    assert SK.expire(spark, tmpdir_path, keep_last=2, replaced_before=NONE) == [2]
    # The newest stays whatever is asked; a lease that ran out holds nothing.
    with SK.reading(spark, tmpdir_path, TABLES, version=4, lease=-timedelta(seconds=1)):
        assert SK.expire(spark, tmpdir_path, keep_last=0, replaced_before=NONE) == [4]
    assert values(SK.load_dataset(spark, tmpdir_path, TABLES)) == [5]
    assert len(folders(tmpdir_path)) == 1 and SK.newest_version(spark, tmpdir_path)[0] == 5
    SK.publish(dataset(spark, 6), tmpdir_path)
    assert SK.newest_version(spark, tmpdir_path)[0] == 6  # numbers are not used again


def test_a_reader_that_comes_during_expiry(spark, tmpdir_path, monkeypatch):
    """The version goes between a reader's choice and its lease: it chooses again."""
    for k in (1, 2):
        SK.publish(dataset(spark, k), tmpdir_path)
    put, once = Store.put, []

    def expire_first(self, name, content):
        if name.startswith("leases/") and not once:
            once.append(SK.expire(spark, tmpdir_path, keep_last=1, replaced_before=NONE))
        return put(self, name, content)

    now = datetime.now(timezone.utc)
    first = SK.history(spark, tmpdir_path).where("version = 1").first().published
    monkeypatch.setattr(Store, "put", expire_first)
    with pytest.raises(SK.DatasetNotFoundError):
        with SK.reading(spark, tmpdir_path, TABLES, version=1):
            pass
    assert once == [[1]] and first is not None
    with SK.reading(spark, tmpdir_path, TABLES, as_of=now) as ds:
        assert values(ds) == [2]
    assert Store(spark, tmpdir_path).list("leases") == []


def test_folders_of_dead_publishes_go(spark, tmpdir_path):
    SK.publish(dataset(spark, 1), tmpdir_path)
    dead = os.path.join(tmpdir_path, "data", "dead")
    os.makedirs(os.path.join(dead, "facts_b"))
    SK.expire(spark, tmpdir_path)
    assert "dead" in folders(tmpdir_path)
    SK.expire(spark, tmpdir_path, died_before=NONE)
    assert "dead" not in folders(tmpdir_path) and len(folders(tmpdir_path)) == 1


def test_rename_refuses_an_existing_target(spark, tmpdir_path):
    """The way of stores without hard links."""
    store = Store(spark, tmpdir_path)
    store.local = False
    assert store.put_if_absent("versions/a.json", {"by": 1})
    assert not store.put_if_absent("versions/a.json", {"by": 2})
    assert store.get("versions/a.json") == {"by": 1}
    assert [e.name for e in store.list("versions")] == ["a.json"]
