"""Sheet rows → .xlsx files, written by tasks (the other direction of ``workbook_source``).

Rows of a workbook meet in one task in row order and stream into the sheet's part of the
archive; memory holds the compressed archive of one workbook. A finished file is moved into
its place, so a repeated task replaces it by an equal one and no reader sees half a file.
"""

from __future__ import annotations

import bisect
import functools
import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workbook_source import open_system

# The parts that every workbook needs (public OOXML packaging).
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
PARTS = {
    "[Content_Types].xml":
        f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" '
        'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/>'
        "</Types>",
    "_rels/.rels":
        f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" '
        f'Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml":
        f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>'
        '<sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels":
        f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" '
        f'Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Rows that a sheet may have.
MAX_ROWS = 1_048_576
#: Rows that become text at once.
ROWS_AT_ONCE = 2000


@functools.cache
def column_letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


#: By kind of a cell (the last for text): what stands before its value, and after it.
KINDS = pa.array(["n", "d", "e", "b"])
OPEN = pa.array(['"><v>', '" t="d"><v>', '" t="e"><v>', '" t="b"><v>',
                 '" t="inlineStr"><is><t xml:space="preserve">'])
CLOSE = pa.array(["</v></c>"] * 4 + ["</t></is></c>"])


def rows_xml(numbers: pa.Array, maps: pa.Array) -> pa.Array:
    """The XML of sheet rows, from their numbers and their maps of cells (null: none)."""
    numbers = numbers.cast(pa.int64())
    if (pc.max(numbers).as_py() or 0) > MAX_ROWS:
        raise ValueError(f"a sheet has at most {MAX_ROWS} rows; write further files")
    if maps.null_count:
        maps = maps.fill_null([])
    edges = maps.offsets.to_numpy()
    keys, items = (x.slice(edges[0], edges[-1] - edges[0]) for x in (maps.keys, maps.items))
    edges = edges - edges[0]
    columns, row = keys.to_numpy(), np.repeat(np.arange(len(numbers)), np.diff(edges))
    order = pa.array(np.lexsort((columns, row)))
    columns, known = np.unique(columns[order], return_inverse=True)
    letters = pa.array([column_letters(c) for c in columns.tolist()], pa.string()).take(
        pa.array(known))
    kind, raw = (items.field(f).take(order) for f in ("kind", "raw"))
    if raw.null_count:
        raise ValueError("a cell without a value")
    at = pc.fill_null(pc.index_in(kind, KINDS), len(KINDS))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        raw = pc.replace_substring(raw, sign, name)
    raw = pc.if_else(pc.equal(at, 3), pc.if_else(pc.equal(raw, "TRUE"), "1", "0"), raw)
    shown = numbers.cast(pa.string())
    cells = pc.binary_join_element_wise('<c r="', letters, shown.take(pa.array(row)),
                                        OPEN.take(at), raw, CLOSE.take(at), "")
    held = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), cells), "")
    return pc.binary_join_element_wise('<row r="', shown, '">', held, "</row>", "")


class _Workbook:
    """One archive being written."""

    def __init__(self) -> None:
        self.data = io.BytesIO()
        self.archive = zipfile.ZipFile(self.data, "w", zipfile.ZIP_DEFLATED)
        stamp = (1980, 1, 1, 0, 0, 0)  # equal rows make equal files
        for name, text in PARTS.items():
            self.archive.writestr(zipfile.ZipInfo(name, stamp), text)
        # Sheets are so repetitive that the fastest level makes them small as well.
        member = zipfile.ZipInfo("xl/worksheets/sheet1.xml", stamp)
        member.compress_type, member.compress_level = zipfile.ZIP_DEFLATED, 1
        self.sheet = self.archive.open(member, "w", force_zip64=True)
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())

    def rows(self, xml: pa.Array) -> None:
        self.sheet.write("".join(xml.to_pylist()).encode())

    def close(self) -> bytes:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.archive.close()
        return self.data.getvalue()


def _save(uri: str, data: bytes) -> None:
    system, path = open_system(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, book, rows = None, None, 0

    def done():
        data = book.close()
        _save(now, data)
        return pa.RecordBatch.from_pylist([{"path": now, "length": len(data), "rows": rows}],
                                          schema=pa.schema([("path", pa.string()),
                                                            ("length", pa.int64()),
                                                            ("rows", pa.int64())]))

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            paths, numbers, maps = batch.slice(at, ROWS_AT_ONCE).columns
            paths = paths.to_pylist()
            xml = rows_xml(numbers, maps)
            a = 0
            while a < len(paths):
                b = bisect.bisect_right(paths, paths[a], a)
                if paths[a] != now:
                    if now is not None:
                        yield done()
                    now, book, rows = paths[a], _Workbook(), 0
                book.rows(xml.slice(a, b - a))
                rows, a = rows + b - a, b
    if now is not None:
        yield done()


def write_workbooks(rows: DataFrame, folder: str) -> DataFrame:
    """Write sheet rows (``path`` is the file's name, row_no, cells) as workbooks of a folder.
    Returns path, length and rows of each file; the files are written when it is acted on."""
    named = rows.select(F.concat(F.lit(folder.rstrip("/") + "/"), F.col("path")).alias("path"),
                        "row_no", "cells")
    return (named.repartition("path").sortWithinPartitions("path", "row_no")
            .mapInArrow(_write, "path string, length long, rows long"))
