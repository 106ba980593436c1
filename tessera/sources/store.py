"""Small files that decide things: commits, tombstones, leases (SNK1, SNK4).

Driver-side, through Hadoop's file systems, so any store that Spark reads will do. The one
operation that matters is ``put_if_absent``: of several writers of one name exactly one
succeeds, and nobody sees half of its content. On a local or mounted file system it is a hard
link of a finished file, elsewhere Hadoop's rename that refuses an existing target (atomic on
HDFS). Tables themselves are never read or written here.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    modified: float  # seconds
    is_folder: bool


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _here(self, name: str) -> str:
        return self._path(name).toUri().getPath()

    def put(self, name: str, content: dict) -> None:
        """Write or replace a file."""
        text = json.dumps(content, sort_keys=True).encode()
        out = self.fs.create(self._path(name), True)
        try:
            out.write(bytearray(text))
        finally:
            out.close()

    def put_if_absent(self, name: str, content: dict) -> bool:
        """Write a file unless there is one; tells whether this call wrote it."""
        folder, _, base = name.rpartition("/")
        part = f"{folder}/.{base}.{uuid.uuid4().hex}"
        self.put(part, content)
        try:
            if self.local:
                try:
                    os.link(self._here(part), self._here(name))
                except FileExistsError:
                    return False
                return True
            return self._rename_new(part, name)
        finally:
            self.fs.delete(self._path(part), False)

    def _rename_new(self, part: str, name: str) -> bool:
        from py4j.protocol import Py4JJavaError
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.fs.getUri(), self.conf)
        array = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        array[0] = options.NONE
        try:
            context.rename(self._path(part), self._path(name), array)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def get(self, name: str) -> dict | None:
        """A file's content; None if there is none, or it is not whole."""
        if not self.fs.exists(self._path(name)):
            return None
        source = self.fs.open(self._path(name))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def list(self, folder: str) -> list[Entry]:
        """What a folder holds, by name; hidden names are left out."""
        path = self._path(folder)
        if not self.fs.exists(path):
            return []
        found = [Entry(s.getPath().getName(), s.getModificationTime() / 1000.0, s.isDirectory())
                 for s in self.fs.listStatus(path)]
        return sorted((e for e in found if not e.name.startswith((".", "_"))), key=lambda e: e.name)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
