"""Workbooks as a Spark data source: ``spark.read.format("workbooks")`` (SRC1, SRC6).

    register(spark)
    spark.read.format("workbooks").load(folder)                       # every sheet row
    spark.read.format("workbooks").option("rows", 10).load(folder)    # the heads only
    spark.readStream.format("workbooks").load(folder)                 # new files as they come

One row per sheet row of the first sheet: ``path, name, length, modified, row_no, cells,
error``. Each file also has a row 0 without cells, so an empty workbook is listed too; a file
that cannot be read has its error there (``mode`` ``failfast`` raises instead); damage that
shows only later comes as a second row 0 after the rows before it.

Planning lists the folder once (names, sizes and times; no contents) and packs files into
partitions by size, as Spark does for its own file formats: ``partitionBytes`` each at most, and
less where the ``cores`` of the session would not all have some; a workbook is never split. A task opens its files through the folder's file system and reads only the
parts of the zip archive that it needs, so heads cost a small read each.

Options: ``glob`` (``*.xlsx``), ``rows`` (rows of each sheet, all by default), ``partitionBytes``
(32 MB), ``openBytes`` (what opening a file counts as, 1 MB), ``cores`` (1, by ``read_workbooks``
those of the session), ``maxFilesPerBatch`` (streams),
``mode`` (``permissive`` or ``failfast``), ``pushdown`` (``true`` if the session has
``spark.sql.python.filterPushdown.enabled``: filters on path or name then choose the files).

A stream's offset is the newest modification time taken and the names that have it, so files
of one time that arrive apart are each taken once. A file that appears with an older time
than one already taken is not seen: move files in, or touch them.
"""

from __future__ import annotations

import datetime
import fnmatch
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo,
                                    In, InputPartition, StringContains, StringEndsWith,
                                    StringStartsWith)

NAME = "workbooks"
SCHEMA = ("path string, name string, length long, modified timestamp, row_no int, "
          "cells map<int, struct<kind: string, raw: string>>, error string")
CELLS = pa.map_(pa.int32(), pa.struct([("kind", pa.string()), ("raw", pa.string())]))
ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("length", pa.int64()),
                   ("modified", pa.timestamp("us", tz="UTC")), ("row_no", pa.int32()),
                   ("cells", CELLS), ("error", pa.string())])
#: A row 0 without cells.
NO_CELLS = pa.array([0], pa.int32()), pa.array([[]], CELLS)


@dataclass(frozen=True)
class File:
    path: str
    name: str
    length: int
    modified: int  # microseconds


class Files(InputPartition):
    """The files of one task."""

    def __init__(self, files: list[File]) -> None:
        super().__init__(None)
        self.files = files


def open_system(uri: str):
    """(file system, path in it) of a URI or an absolute path."""
    from urllib.parse import unquote

    from pyarrow import fs
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(unquote(uri) if uri.startswith("file:") else uri)


def list_folder(folder: str, glob: str = "*.xlsx") -> list[File]:
    """The files of one folder (not recursive) whose name matches, in order of their name."""
    from pyarrow import fs
    system, root = open_system(folder)
    prefix = folder.split("://", 1)[0] + "://" if "://" in folder else ""
    host = folder[len(prefix):].split("/", 1)[0] if prefix and not prefix.startswith("file") and \
        not prefix.startswith(("s3", "gs")) else ""
    found = [File(f"{prefix}{host}{i.path}", i.base_name, i.size or 0,
                  (i.mtime_ns or 0) // 1000)
             for i in system.get_file_info(fs.FileSelector(root))
             if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, glob)
             and not i.base_name.startswith((".", "_"))]
    return sorted(found, key=lambda f: f.name)


def partitions_of(total: int, partition_bytes: int, open_bytes: int, cores: int) -> int:
    """How many partitions ``total`` bytes make: Spark's rule for its file formats."""
    return max(1, -(-total // min(partition_bytes, max(open_bytes, -(-total // cores), 1))))


def pack(files: list[File], partition_bytes: int, open_bytes: int, cores: int = 1) -> list[Files]:
    """Files in partitions of about ``partition_bytes``, largest first into the emptiest."""
    if not files:
        return []
    total = sum(f.length + open_bytes for f in files)
    bins = [[0, k, []] for k in range(min(len(files), partitions_of(
        total, partition_bytes, open_bytes, cores)))]
    import heapq
    heapq.heapify(bins)
    for f in sorted(files, key=lambda f: (-f.length, f.name)):
        least = bins[0]
        least[2].append(f)
        heapq.heapreplace(bins, [least[0] + f.length + open_bytes, least[1], least[2]])
    return [Files(sorted(b[2], key=lambda f: f.name)) for b in sorted(bins, key=lambda b: b[1])]


class _Settings:
    def __init__(self, options) -> None:
        self.folder = options.get("path")
        if not self.folder:
            raise ValueError("give the folder: load(folder)")
        self.glob = options.get("glob", "*.xlsx")
        rows = options.get("rows")
        self.rows = None if rows is None else int(rows)
        self.partition_bytes = int(options.get("partitionBytes", 32 << 20))
        self.open_bytes = int(options.get("openBytes", 1 << 20))
        self.cores = int(options.get("cores", 1))
        self.most_files = int(options.get("maxFilesPerBatch", 0))
        self.fail_fast = options.get("mode", "permissive").lower() == "failfast"
        self.pushdown = options.get("pushdown", "false").lower() == "true"


def read_files(files: list[File], rows: int | None, fail_fast: bool) -> Iterator[pa.RecordBatch]:
    """Sheet rows of workbooks, one workbook at a time, after a row 0 for each."""
    from .workbooks import row_columns
    for f in files:
        modified = datetime.datetime.fromtimestamp(f.modified / 1e6, datetime.timezone.utc)
        own = [f.path, f.name, f.length, modified]

        def batch(row_nos, cells, error=None, own=own):
            n = len(row_nos)
            return pa.RecordBatch.from_arrays(
                [pa.array([v] * n, field.type) for v, field in zip(own, ARROW)]
                + [row_nos, cells, pa.array([error] * n, pa.string())], schema=ARROW)

        try:
            system, path = open_system(f.path)
            with system.open_input_file(path) as source:
                sheet = row_columns(source, rows)
                # The first rows are read before the file counts as readable.
                part = next(sheet, None)
                yield batch(*NO_CELLS)
                while part:
                    yield batch(*part)
                    part = next(sheet, None)
        except Exception as e:  # any damage of an archive
            if fail_fast:
                raise
            yield batch(*NO_CELLS, f"{type(e).__name__}: {e}"[:500])


class WorkbookReader(DataSourceReader):
    def __init__(self, settings: _Settings) -> None:
        self.settings = settings
        self.keep = []

    def _files(self) -> list[File]:
        return [f for f in list_folder(self.settings.folder, self.settings.glob)
                if all(k(f) for k in self.keep)]

    def partitions(self) -> list[Files]:
        packed = pack(self._files(), self.settings.partition_bytes, self.settings.open_bytes,
                      self.settings.cores)
        return packed or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(partition.files, self.settings.rows, self.settings.fail_fast)


class PruningReader(WorkbookReader):
    """With filters on path or name: only the files that pass are opened. The filters are
    left to Spark as well."""

    TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v,
             StringStartsWith: str.startswith, StringEndsWith: str.endswith,
             StringContains: lambda x, v: v in x}

    def pushFilters(self, filters):
        for f in filters:
            test = self.TESTS.get(type(f))
            if test is not None and f.attribute in (("path",), ("name",)):
                self.keep.append(_Keep(f.attribute[0], type(f), f.value))
            yield f


@dataclass(frozen=True)
class _Keep:
    field: str
    kind: type
    value: object

    def __call__(self, f: File) -> bool:
        return PruningReader.TESTS[self.kind](getattr(f, self.field), self.value)


class WorkbookStreamReader(DataSourceStreamReader):
    """Files by modification time; an offset names the files of its newest time."""

    def __init__(self, settings: _Settings) -> None:
        self.settings = settings
        self.taken = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"modified": -1, "names": ""}

    @staticmethod
    def _after(f: File, offset: dict) -> bool:
        return f.modified > offset["modified"] or (
            f.modified == offset["modified"] and f.name not in offset["names"].split("/"))

    def latestOffset(self) -> dict:
        files = sorted((f for f in list_folder(self.settings.folder, self.settings.glob)
                        if self._after(f, self.taken)), key=lambda f: (f.modified, f.name))
        if self.settings.most_files:
            files = files[:self.settings.most_files]
        if not files:
            return self.taken
        newest = files[-1].modified
        names = {f.name for f in files if f.modified == newest}
        if newest == self.taken["modified"]:
            names |= set(self.taken["names"].split("/"))
        # A file name holds no slash, so it can part the names.
        self.taken = {"modified": newest, "names": "/".join(sorted(names))}
        return self.taken

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.taken = max(self.taken, end, key=lambda o: (o["modified"], len(o["names"])))
        files = [f for f in list_folder(self.settings.folder, self.settings.glob)
                 if self._after(f, start) and not self._after(f, end)]
        return pack(files, self.settings.partition_bytes, self.settings.open_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(partition.files, self.settings.rows, self.settings.fail_fast)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        settings = _Settings(self.options)
        return (PruningReader if settings.pushdown else WorkbookReader)(settings)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WorkbookStreamReader(_Settings(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session (once is enough, again does no harm)."""
    spark.dataSource.register(WorkbookSource)


def read_workbooks(spark: SparkSession, folder: str, rows: int | None = None, **options) -> DataFrame:
    """Sheet rows of a folder's workbooks; ``rows`` reads only the first rows of each sheet."""
    register(spark)
    reader = spark.read.format(NAME)
    cores = spark.sparkContext.defaultParallelism
    for name, value in ({"rows": rows, "cores": cores} | options).items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(folder)


def read_listed(files: DataFrame, partition_bytes: int = 32 << 20) -> DataFrame:
    """Sheet rows (path, row_no, cells) of the workbooks that a table (path, length) names.

    The paths stay rows: they are dealt to as many tasks as their sizes call for, and each
    task opens its own. So a choice among files (the newest pulls) never visits the driver."""
    from pyspark.sql import functions as F
    total = files.agg(F.sum(F.col("length") + (1 << 20))).first()[0] or 0
    dealt = files.select("path", "length").repartition(partitions_of(
        total, partition_bytes, 1 << 20, files.sparkSession.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for rows in read_files([File(path, "", length, 0)], None, True):
                    yield rows.select(["path", "row_no", "cells"]).filter(
                        pa.compute.greater(rows.column(4), 0))

    return dealt.mapInArrow(run, "path string, row_no int, "
                                 "cells map<int, struct<kind: string, raw: string>>")
