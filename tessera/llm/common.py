"""Helpers shared by the text operators: table access, tokens, hashes, files.

Rules that hold for all operators of this subpackage:

* a null text counts as an empty one; a null key is a key of its own;
* only the named columns are read, so further columns, whatever their names,
  pass by (row-wise operators) or are left out (operators with own output); where an
  operator adds a column whose name is taken, the input's column stays and the new one
  gets a number (``score_2``);
* intermediates that a later step reads twice are written under the folder of
  ``spark.checkpoint.dir`` (``tessera.session.materialize``).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path

#: Separators of words: space, tab, line feed, vertical tab, form feed, return.
SEPARATORS = " \t\n\x0b\x0c\r"

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """CRC-32 of a key written as text (null key: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split() parts at just these)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), wrapping on purpose."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, kind) -> None:
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, values: list | np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            wider = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            wider[:self.n] = self.data[:self.n]
            self.data = wider
        self.data[self.n:need] = values
        self.n = need


@functools.cache
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    def up(b):
        steps = np.full(size + 1, b & MASK64, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)
    return up(base | 1), up(pow(base | 1, -1, 1 << 64))


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every window of ``size`` consecutive 64-bit values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = np.uint64(base | 1)
    for k in range(size):
        out *= step
        out += values[k:k + n]
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def texts_in(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist()
                             for c in columns), strict=True)


def text_slices(texts: pa.Array, size: int = 128) -> Iterator[list[str | None]]:
    """The values of an Arrow array, a few at a time."""
    for at in range(0, len(texts), size):
        yield texts.slice(at, size).to_pylist()


# -- a bounded set of keys ------------------------------------------------------

#: Bits of the whole set, and of one row of it: 2048 rows of 4 KB, 8 MB at most.
SET_BITS, ROW_BITS = 1 << 26, 1 << 15


def _bit_of(columns: Iterable[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(SET_BITS))


def probable_set(keys: DataFrame, *columns: str) -> DataFrame:
    """A set of keys as hash bits, of a fixed size whatever the number of keys."""
    bit = keys.select(_bit_of(columns).alias("_bit"))
    return bit.groupBy(F.floor(F.col("_bit") / ROW_BITS).alias("_set_row")).agg(
        F.bitmap_construct_agg(F.col("_bit") % ROW_BITS).alias("_set_bits"))


def with_probable(rows: DataFrame, key_set: DataFrame, *columns: str,
                  name: str = "_probable") -> DataFrame:
    """Adds whether a row's key may be in the set: false is certain, true is not.

    The set is broadcast: its size is bounded by ``SET_BITS``. Nothing is shuffled."""
    row, bit = F.floor(F.col("_bit") / ROW_BITS), F.col("_bit") % ROW_BITS
    byte = F.conv(F.hex(F.substring("_set_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))),
                  16, 10).cast("long")
    held = rows.withColumn("_bit", _bit_of(columns)).withColumn("_set_row", row)
    return (held.join(F.broadcast(key_set), "_set_row", "left")
            .withColumn(name, F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False)))
            .drop("_bit", "_set_row", "_set_bits"))


def without_keys(docs: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """The rows whose key (nulls are equal) is not in ``gone``, with all their columns.

    Rows that are certainly not in it, by the bounded set of hashes, stay where they
    are; only the others meet the exact keys in a join."""
    named = gone.select(F.col(gone_key).alias("_gone"))
    # A row travels as one value, so its columns meet no name of this function.
    own = docs.select(F.struct("*").alias("_row"), F.col(f"`{key}`").alias("_key"))
    marked = with_probable(own, probable_set(named, "_gone"), "_key")
    sure = marked.where("NOT _probable")
    doubtful = marked.where("_probable").join(
        named, F.col("_key").eqNullSafe(F.col("_gone")), "left_anti")
    return sure.unionByName(doubtful).select("_row.*")


def free_name(docs: DataFrame, name: str) -> str:
    """A name for a new column: ``name``, or with the first number from 2 that is not taken."""
    taken = {c.lower() for c in docs.columns}
    number = 2
    out = name
    while out.lower() in taken:
        out, number = f"{name}_{number}", number + 1
    return out


# -- files in the shared folder ------------------------------------------------

def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder under the shared folder of the session."""
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _filesystem(uri: str):
    from pyarrow import fs
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def filesystem_path(uri: str):
    """(file system, path in it) of a file's URI, as Spark names its input files."""
    from urllib.parse import unquote
    return _filesystem(unquote(uri))


def write_file(folder: str, name: str, parts: Iterable[bytes]) -> int:
    """Write one file under the folder's URI, called inside a task.

    The bytes go to a name of their own and are moved into place at the end:
    a repeated or speculative attempt replaces the file by an equal one.
    """
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    part, size = f"{root}/.{name}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(part, compression=None) as out:
        for data in parts:
            out.write(data)
            size += len(data)
    system.move(part, f"{root}/{name}")
    return size


def open_file(folder: str, name: str):
    """A seekable input file under the folder's URI, opened inside a task."""
    system, root = _filesystem(folder)
    return system.open_input_file(f"{root}/{name}")
