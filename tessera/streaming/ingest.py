"""Incremental ingest of new workbook drops with Structured Streaming (SNK4).

A file-stream source sees only new workbooks. A micro-batch tells what they are by their
content, keeps those that are newer pulls of their (layout, period) than the **state** knows, and
writes their rows to a folder of its own, one sub-folder per table and period. Then one small file
``state/<batch>-<step>.json`` is created, if it is absent: the state after the batch. It has one
entry per (layout, period): the newest pull, and the folder that has its rows. The calendar
bounds its size, however long the stream has run.

* ``load_stream`` reads the newest state and the folders that it names: what is current, never
  the history of replaced pulls.
* A replayed batch finds its state and does nothing; a batch that died halfway left a folder
  that no state names. No file is ever changed in place.
* Every ``compact_every`` folders, the current rows are written to one folder and a further step
  of the state points there, so a load opens a bounded number of folders. ``clean`` deletes
  the folders that no state names any more, after a time that spares running readers.

The newest pull decides also when it was rejected: its quarter then has no facts and a
warning, as in the batch ingest. A workbook that cannot be read has no layout from its content;
if its name tells both, it is such a rejected pull.
"""

from __future__ import annotations

import time
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import dims as D
from ..operators import grid as G
from ..session import materialize
from ..sources import files as FS
from ..sources.identify import identify
from ..sources.store import Store
from ..sources.workbooks import SHEETS_SCHEMA, rows_batches

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
ENTRY = ("layout string, period string, pull_ts string, path string, title string, "
         "pulled string, batch long, folder string, tables array<string>")
TABLES = ("facts_b", "facts_a", "totals_b", "totals_a", "warnings", "metrics_b", "metrics_a")
WARNINGS = "path string, layout string, code string, detail string"
COMPACT_EVERY = 10


# -- state -----------------------------------------------------------------------------

def _state_name(batch: int, step: int) -> str:
    return f"state/{batch:012d}-{step:04d}.json"


def _newest_state(store: Store, before: int | None = None) -> dict:
    """The newest whole state, of the batches before one or of all: batch, step, entries."""
    for e in reversed(store.list("state")):
        batch = int(e.name[:12])
        if before is None or batch < before:
            told = store.get(f"state/{e.name}")
            if told is not None:
                return told
    return {"batch": -1, "step": 0, "entries": []}


def read_state(spark: SparkSession, out: str) -> DataFrame:
    """The newest state as a table: one row per (layout, period)."""
    return _frame(spark, _newest_state(Store(spark, out))["entries"])


def _frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    return spark.createDataFrame([tuple(e.get(c) for c in columns) for e in entries], ENTRY)


# -- batches ---------------------------------------------------------------------------

def _write_parts(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables with a sub-folder per period. The period also stays a column of the rows."""
    for name, df in tables.items():
        df.withColumn("p", F.col("period")).write.mode("overwrite").partitionBy("p").parquet(
            f"{folder}/{name}")


def _tables_of(store: Store, folder: str, layout: str, period: str) -> list[str]:
    """The tables that hold rows of a (layout, period): a few listings a folder."""
    return [t for t in TABLES if any(
        e.name == f"p={period}" for e in store.list(f"{folder}/{t}"))
        and (t == "warnings" or t.endswith(f"_{layout.lower()}"))]


def _parsed(grid: DataFrame, files: DataFrame, layouts: set[str]) -> dict[str, DataFrame]:
    """The tables of the workbooks in ``files``, each with its period."""
    at = files.select("path", "period")
    parsed = {x: G.parse_grid(grid, files, x) for x in sorted(layouts)}
    broken = files.where("error IS NOT NULL").select(
        "path", "layout", F.lit("unreadable").alias("code"), F.col("error").alias("detail"))
    warnings = broken
    for told in parsed.values():
        warnings = warnings.unionByName(told["warnings"].join(broken.select("path"), "path", "left_anti"))
    tables = {"warnings": warnings.join(at, "path")}
    for x in parsed:
        low = x.lower()
        metrics = parsed[x]["headers"].where("role = 'metric'").select("path", "key").distinct()
        tables |= {f"facts_{low}": parsed[x]["facts"], f"totals_{low}": parsed[x]["totals"],
                   f"metrics_{low}": metrics.join(at, "path")}
    return tables


def process_batch(batch: DataFrame, number: int, out: str,
                  compact_every: int | None = COMPACT_EVERY) -> None:
    """Take a batch of (path, modificationTime, length, content)."""
    spark = batch.sparkSession
    store, out = Store(spark, out), out.rstrip("/")
    if any(int(e.name[:12]) == number and store.get(f"state/{e.name}") for e in store.list("state")):
        return  # a replay of a batch that counts
    # Only earlier batches: a repeated attempt must choose what the first one chose.
    entries = _newest_state(store, before=number)["entries"]
    grid = materialize(batch.select("path", "content").mapInArrow(rows_batches, SHEETS_SCHEMA),
                       "stream-grid")
    heads = grid.where(F.col("row_no") <= C.HEADER_SCAN_ROWS)
    chosen = FS.newest_pulls(identify(heads))
    known = _frame(spark, entries).select("layout", "period", F.col("pull_ts").alias("_known"))
    newer = materialize(
        chosen.join(known, ["layout", "period"], "left")
              .where(F.col("_known").isNull() | (F.col("pull_ts") > F.col("_known")))
              .drop("_known"), "stream-files")
    # At most one row for each layout and quarter.
    taken = newer.select("layout", "period", "pull_ts", "path", "title", "pulled").collect()
    folder = f"batches/{number:012d}-{uuid.uuid4().hex[:12]}"
    if taken:
        rows = grid.where("row_no > 0").select("path", "row_no", "cells")
        _write_parts(_parsed(rows, newer, {r.layout for r in taken}), f"{out}/{folder}")
    fresh = [r.asDict() | {"batch": number, "folder": folder,
                           "tables": _tables_of(store, folder, r.layout, r.period)} for r in taken]
    replaced = {(e["layout"], e["period"]) for e in fresh}
    entries = [e for e in entries if (e["layout"], e["period"]) not in replaced] + fresh
    store.put_if_absent(_state_name(number, 0), {
        "batch": number, "step": 0, "at": time.time(),
        "entries": sorted(entries, key=lambda e: (e["layout"], e["period"]))})
    if compact_every and len({e["folder"] for e in entries}) > compact_every:
        compact(spark, out)


# -- reading ---------------------------------------------------------------------------

def _current(spark: SparkSession, out: str, entries: list[dict]) -> dict[str, DataFrame]:
    """Every table's current rows, from just the sub-folders that entries name."""
    found = {}
    for name in TABLES:
        parts = sorted(f"{out}/{e['folder']}/{name}/p={e['period']}" for e in entries
                       if name in e["tables"])
        if parts:
            df = spark.read.parquet(*parts)
            # Warnings of both layouts share a table: only those of the entry's own file.
            if name == "warnings":
                own = _frame(spark, entries).select("path", F.col("layout").alias("_l"))
                df = df.join(own, (df.path == own.path) & (df.layout == own._l), "left_semi")
            found[name] = df
    return found


def load_stream(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The current dataset of a stream, in the tables of the batch ingest (for ``publish``)."""
    out = out.rstrip("/")
    entries = _newest_state(Store(spark, out))["entries"]
    files = _frame(spark, entries)
    found = _current(spark, out, entries)
    if not entries:
        return {"files": files}
    for x in "BA":
        for table in ("facts", "totals"):
            found.setdefault(f"{table}_{x.lower()}",
                             spark.createDataFrame([], G.table_schema(table, x)))
    found.setdefault("warnings", spark.createDataFrame([], WARNINGS))
    found["warnings"] = found["warnings"].select("path", "layout", "code", "detail")
    for name in ("metrics_b", "metrics_a"):
        found[name] = (found[name].select("key").distinct() if name in found
                       else spark.createDataFrame([], "key string"))
    found |= {"files": files, "periods": D.periods(found["facts_b"], found["facts_a"], files),
              "companies": D.companies(found["facts_b"], found["facts_a"]),
              "policy_types": D.segments(found["facts_b"])}
    return found


# -- upkeep ----------------------------------------------------------------------------

def compact(spark: SparkSession, out: str) -> bool:
    """Write the current rows to one folder and let a further step of the state name it. Safe
    beside a running stream: a batch that commits meanwhile builds on the state it read, and
    nothing that it names is deleted. False if there was nothing to do."""
    out, store = out.rstrip("/"), Store(spark, out)
    state = _newest_state(store)
    entries = state["entries"]
    if len({e["folder"] for e in entries}) <= 1:
        return False
    folder = f"batches/compact-{state['batch']:012d}-{uuid.uuid4().hex[:12]}"
    _write_parts(_current(spark, out, entries), f"{out}/{folder}")
    moved = [e | {"folder": folder} for e in entries]
    return store.put_if_absent(_state_name(state["batch"], state["step"] + 1), {
        "batch": state["batch"], "step": state["step"] + 1, "at": time.time(), "entries": moved})


def clean(spark: SparkSession, out: str, unused_for: timedelta = timedelta(days=1)) -> int:
    """Delete states that were replaced, and folders that no remaining state names, both for
    at least ``unused_for`` (longer than a load, or a batch, takes); returns how many folders."""
    store, edge = Store(spark, out), time.time() - unused_for.total_seconds()
    states = store.list("state")
    whole = [(e, told) for e in states if (told := store.get(f"state/{e.name}")) is not None]
    # A state was replaced when the next one came.
    kept = [told for (_, told), after in zip(whole, [*whole[1:], None], strict=True)
            if after is None or after[0].modified > edge]
    used = {e["folder"] for told in kept for e in told["entries"]}
    dropped = 0
    for e in store.list("batches"):
        inside = [x.modified for x in store.list(f"batches/{e.name}")]
        if f"batches/{e.name}" not in used and max([e.modified, *inside]) <= edge:
            store.delete(f"batches/{e.name}")
            dropped += 1
    last = max((told["batch"] for _, told in whole), default=-1)
    for e, told in whole:
        # The states of the newest batch stay: a replay of it must find them.
        if told not in kept and told["batch"] < last:
            store.delete(f"state/{e.name}")
    return dropped


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str,
                  available_now: bool = True, glob: str = "*.xlsx",
                  compact_every: int | None = COMPACT_EVERY, max_files: int | None = None):
    """Start the incremental ingest; returns the StreamingQuery.

    ``available_now`` processes what is in the folder and stops (a scheduled
    job); otherwise it keeps watching the folder. ``max_files`` bounds a micro-batch.
    """
    stream = (spark.readStream.format("binaryFile")
                   .schema(BINARY_SCHEMA)
                   .option("pathGlobFilter", glob))
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    stream = stream.load(folder)
    w = (stream.writeStream
         .foreachBatch(lambda df, number: process_batch(df, number, out, compact_every))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
