"""Sinks (SNK1-SNK3) and the published dataset (SRC8).

* SNK1: a dataset is published as a new version beside the old ones. Its tables go to a
  folder of their own under ``out/data``, facts and totals partitioned by period; then one small
  file ``out/versions/<number>.json`` is created, if it is absent, and names the folder. So a
  publish that dies is never seen, and of two writers one takes a number and the other
  learns of it: it takes the next one, or, if it said which version it builds on, is refused
  (``PublishConflictError``).
* Readers take the newest version, or one by number or time (``load_dataset``). ``reading`` also
  leaves a lease, so that ``expire`` spares what is being read.
* ``expire`` drops versions that are neither among the last ones, nor replaced lately, nor
  leased, and the folders of publishes that died. A version's tombstone comes first and its
  leases are looked at after that; a reader leaves its lease first and looks for a
  tombstone after that. Whatever the interleaving, one of the two sees the other.
* SNK2: CSV export with a header of labels, RFC-4180 quoting, null → empty;
* SNK3: report tables are part of the dataset; ``quality.render_report`` writes them as text.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

PARTITIONED = {"facts_b", "facts_a", "totals_b", "totals_a"}
VERSIONS = "version long, folder string, published double, parent long, tables array<string>"


class DatasetNotFoundError(FileNotFoundError):
    """SRC8: the published dataset is missing; run the ingest first."""


class PublishConflictError(RuntimeError):
    """Another writer published since the version that this one builds on."""


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet table, or None if there is none at the path. Other errors are raised."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrite a table; with ``partition_by`` only the partitions present are replaced."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = (w.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by))
    w.parquet(path)


# -- versions ---------------------------------------------------------------------------

def _commit_name(number: int) -> str:
    return f"versions/{number:010d}.json"


def _numbers(store: Store) -> list[int]:
    """Numbers taken, also by a commit that is not whole."""
    return sorted(int(e.name[:-5]) for e in store.list("versions") if e.name.endswith(".json"))


def _expired(store: Store) -> set[int]:
    return {int(e.name) for e in store.list("expired")}


def _versions(store: Store) -> list[dict]:
    """Versions that can be read, oldest first."""
    gone = _expired(store)
    found = [store.get(_commit_name(n)) for n in _numbers(store) if n not in gone]
    return [v for v in found if v is not None]


def history(spark: SparkSession, out: str) -> DataFrame:
    """The versions that can be read: version, folder, published (time), parent, tables."""
    rows = [tuple(v[k] for k in ("version", "folder", "published", "parent", "tables"))
            for v in _versions(Store(spark, out))]
    return spark.createDataFrame(rows, VERSIONS).withColumn(
        "published", F.timestamp_seconds("published"))


def newest_version(spark: SparkSession, out: str) -> tuple[int, str | None]:
    """(number, folder) of the newest published version; (0, None) without any."""
    found = _versions(Store(spark, out))
    return (found[-1]["version"], found[-1]["folder"]) if found else (0, None)


def publish(dataset: dict[str, DataFrame], out: str, tables=None,
            expected: int | None = None) -> str:
    """SNK1: write the tables of an ingest as a new version; returns its folder.

    ``expected``: the version that this one was built on (0: none). If another one has been
    published meanwhile, nothing is published and ``PublishConflictError`` is raised. Without
    it the dataset simply becomes the newest version, whoever else publishes."""
    out = out.rstrip("/")
    chosen = {n: df for n, df in dataset.items()
              if (tables is None and n != "grid") or (tables is not None and n in tables)}
    spark = next(iter(chosen.values())).sparkSession
    store = Store(spark, out)

    def refuse():
        raise PublishConflictError(
            f"{out}: version {max(_numbers(store), default=0)} was published after {expected}")

    if expected is not None and max(_numbers(store), default=0) != expected:
        refuse()
    folder = f"data/{uuid.uuid4().hex}"
    for name, df in chosen.items():
        write_table(df, f"{out}/{folder}/{name}", "period" if name in PARTITIONED else None)
        # A partitioned table without rows has no file to tell its columns.
        write_table(df.limit(0), f"{out}/{folder}/schemas/{name}")
    while True:
        number = max(_numbers(store), default=0) + 1
        if expected is not None and number != expected + 1:
            refuse()
        if store.put_if_absent(_commit_name(number), {
                "version": number, "folder": folder, "published": time.time(),
                "parent": number - 1, "tables": sorted(chosen)}):
            return folder
        if expected is not None:
            refuse()


DEFAULT_TABLES = ("periods", "companies", "policy_types", "metrics_b", "facts_b", "facts_a")


def _choose(store: Store, out: str, version: int | None, as_of: datetime | None) -> dict:
    found = _versions(store)
    if version is not None:
        found = [v for v in found if v["version"] == version]
    if as_of is not None:
        found = [v for v in found if v["published"] <= as_of.timestamp()]
    if not found:
        told = "" if version is None and as_of is None else f" of version {version or as_of}"
        raise DatasetNotFoundError(f"no published dataset{told} under {out}; run the ingest first")
    return found[-1]


def _tables(spark: SparkSession, out: str, chosen: dict, tables) -> dict[str, DataFrame]:
    found = {}
    for name in tables:
        columns = read_or_none(spark, f"{out}/{chosen['folder']}/schemas/{name}")
        if columns is None:
            raise DatasetNotFoundError(
                f"published table {name!r} not found under {out}; run the ingest first")
        found[name] = spark.read.schema(columns.schema).parquet(
            f"{out}/{chosen['folder']}/{name}").select(*columns.columns)
    return found


def load_dataset(spark: SparkSession, out: str, tables=DEFAULT_TABLES, version: int | None = None,
                 as_of: datetime | None = None) -> dict[str, DataFrame]:
    """SRC8: the newest published version, or the one of a number, or the newest one at a
    time (with its zone); a typed error names what is missing."""
    out = out.rstrip("/")
    return _tables(spark, out, _choose(Store(spark, out), out, version, as_of), tables)


@contextlib.contextmanager
def reading(spark: SparkSession, out: str, tables=DEFAULT_TABLES, version: int | None = None,
            as_of: datetime | None = None, lease: timedelta = timedelta(hours=12)):
    """``load_dataset`` with a lease: ``expire`` leaves the version alone until the block ends,
    or until the lease does (a reader that died holds nothing for ever)."""
    out = out.rstrip("/")
    store = Store(spark, out)
    while True:
        chosen = _choose(store, out, version, as_of)
        name = f"leases/{chosen['version']:010d}-{uuid.uuid4().hex}"
        store.put(name, {"until": time.time() + lease.total_seconds()})
        if chosen["version"] not in _expired(store):
            break
        store.delete(name)  # it went between the choice and the lease: choose again
    try:
        yield _tables(spark, out, chosen, tables)
    finally:
        store.delete(name)


def _leased(store: Store, now: float) -> set[int]:
    held = set()
    for e in store.list("leases"):
        told = store.get(f"leases/{e.name}")
        if told is None or told["until"] > now:
            held.add(int(e.name.split("-")[0]))
        else:
            store.delete(f"leases/{e.name}")
    return held


def expire(spark: SparkSession, out: str, keep_last: int = 3,
           replaced_before: timedelta = timedelta(days=7),
           died_before: timedelta = timedelta(days=1)) -> list[int]:
    """Drop old versions and the folders of publishes that died; returns the numbers dropped.

    A version stays if it is one of the ``keep_last`` newest (one at least), was replaced less
    than ``replaced_before`` ago, or is leased. A folder without a commit goes when nothing
    was written to it for ``died_before``."""
    store, now = Store(spark, out), time.time()
    found = _versions(store)
    old = [v for v, after in zip(found, found[1:], strict=False)
           if after["published"] <= now - replaced_before.total_seconds()]
    newest = {v["version"] for v in found[-max(1, keep_last):]}
    old = [v for v in old if v["version"] not in newest]
    dropped = []
    for v in old:
        mark = f"expired/{v['version']:010d}"
        store.put(mark, {"at": now})
        if v["version"] in _leased(store, now):
            store.delete(mark)
            continue
        store.delete(v["folder"])
        dropped.append(v["version"])
    # What an earlier run marked and did not delete, and what never was committed.
    used = {v["folder"] for v in _versions(store)}
    gone = _expired(store)
    committed = {c["folder"]: n for n in _numbers(store)
                 if (c := store.get(_commit_name(n))) is not None}
    for e in store.list("data"):
        folder = f"data/{e.name}"
        if folder in used:
            continue
        if committed.get(folder) in gone:
            if committed[folder] not in _leased(store, now):
                store.delete(folder)
        elif _last_write(store, folder, e.modified) < now - died_before.total_seconds():
            store.delete(folder)
    return dropped


def _last_write(store: Store, folder: str, known: float) -> float:
    """When something was last written to a folder or to one of its tables."""
    return max([known, *(e.modified for e in store.list(folder)),
                *(e.modified for e in store.list(f"{folder}/schemas"))])


def _plain(df: DataFrame, name: str):
    """Plain decimal text of a floating-point column: full precision, no exponent."""
    c = F.col(f"`{name}`")
    exact = c.try_cast("decimal(38,15)")
    text = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    # Beyond 23 integer digits or 15 decimals the shortest exact text is the double's own.
    return F.when(exact.cast("double") == c, text).otherwise(c.cast("string")).alias(name)


def export_csv(df: DataFrame, path: str, labels: dict[str, str] | None = None,
               single_file: bool = False) -> None:
    """SNK2: CSV with label headers, quotes doubled (``A"b,c`` → ``"A""b,c"``), null → empty.

    Numbers are plain decimals of full precision, text is written as it is, and rows keep
    the order of an ordered view. ``single_file`` writes one file: only for views already
    cut to a report size (top-N tables, series tables).
    """
    out = df.select(*[_plain(df, n) if t in ("double", "float") else F.col(f"`{n}`")
                      for n, t in df.dtypes])
    if labels:
        out = out.select(*[F.col(f"`{c}`").alias(labels.get(c, c)) for c in out.columns])
    if single_file:
        out = out.coalesce(1)
    (out.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path))
