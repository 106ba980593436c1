"""Workbooks → sheet rows (SRC6) and the whole ingest (§3.1).

A workbook is not splittable, so the scan is parallel over files (``workbook_source``):
the heads of all files tell layout and period, the newest pull per (layout, period) is
chosen, and tasks open and read the chosen files. Only the first sheet is read, with cached
values (no formulas are evaluated).

The OOXML reading is a small per-file helper (standard library ``zipfile`` + ``expat``):
shared and inline strings, numbers, booleans, formula results, physical row / column numbers
from the cell references or, without them, from the cells' order. Plain rows are cut by one
regular expression, all else goes through the parser. Cells become Arrow columns.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..operators.grid import ROWS_SCHEMA
from ..session import materialize
from . import files as FS
from .identify import conflicts, identify
from .workbook_source import CELLS, NO_CELLS, read_listed, read_workbooks

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
# Names as expat gives them: name space, a closing brace, the tag.
_ROW, _CELL, _VALUE, _TEXT, _DATA = (f"{_NS['m']}}}{x}" for x in ("row", "c", "v", "t", "sheetData"))
# A plain row and its cells: what most writers make. The text has no character that
# XML forbids or changes, and no reference but the three that are turned back here.
_PLAIN_TEXT = "((?:[^<>&\x00-\x08\x0b-\x1f\ufffe\uffff]++|&(?:amp|lt|gt);)*+)"
_PLAIN_CELL = ('<c r="([A-Z]++)(ROW)"(?: s="[0-9]++")?(?:(?: t="(n|d|e|b|s|str)")?><v>TEXT</v>'
               '| t="inlineStr"><is><t(?: xml:space="preserve")?>TEXT</t></is>)</c>'
               ).replace("TEXT", _PLAIN_TEXT)
_PLAIN_CELLS = re.compile(_PLAIN_CELL.replace("ROW", "[0-9]++"))
_PLAIN_ROWS = re.compile('(?:<row r="([0-9]{1,9})"(?: spans="[0-9: ]*+")?>(?:'
                         + _PLAIN_CELL.replace("(ROW)", "\\1") + ")*+</row>)*+")
_UTF8 = re.compile(rb"""<\?xml[^>]*encoding=["'](?!utf-8["'])""", re.IGNORECASE)
_REF = re.compile(r"^([A-Z]+)(\d+)$")
ROWS_PER_BATCH = 1000
#: Bytes of a sheet that are parsed at once: few at first, for heads.
FIRST_BYTES, NEXT_BYTES = 1 << 14, 1 << 19


def _col_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def _text_of(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


def _first_sheet_member(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall("pr:Relationship", _NS):
        if rel.get("Id") == rid:
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise ValueError("first sheet not found")


class _Sheet:
    """Handlers that gather (row_no, col_no, kind, raw) of every non-empty cell in ``cells``."""

    KINDS = {"str": "s", "inlineStr": "s", "s": "s", "b": "b", "e": "e", "d": "d"}

    def __init__(self, shared: list[str]) -> None:
        self.shared, self.cells, self.columns = shared, [], {}
        self.row_no = self.col_no = self.at = 0
        self.row_text = "0"
        self.type = self.value = self.text = self.held = None
        self.depth, self.data_depth, self.ready = 0, None, False  # ready: a row may begin here
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        if hasattr(self.parser, "SetReparseDeferralEnabled"):
            self.parser.SetReparseDeferralEnabled(False)  # what was given has been parsed
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.characters

    def start(self, name: str, attributes: dict) -> None:
        self.held = None  # only the text before an element's first child counts
        self.depth += 1
        self.ready = name == _DATA
        if name == _CELL:
            ref, self.at, n = attributes.get("r", ""), self.row_no, len(self.row_text)
            known = self.columns.get(ref[:-n]) if ref[-n:] == self.row_text else None
            if known is not None:
                self.col_no = known
            elif m := _REF.match(ref):
                self.col_no, self.at = _col_number(m.group(1)), int(m.group(2))
                if m.group(2) == self.row_text:
                    self.columns[m.group(1)] = self.col_no
            else:
                self.col_no += 1
            self.type, self.value, self.text = attributes.get("t", "n"), None, []
        elif name == _DATA:
            self.data_depth = self.depth
        elif name == _ROW:
            # References are optional: without one, a row or cell follows the last.
            self.row_no, self.col_no = int(attributes.get("r") or self.row_no + 1), 0
            self.row_text = str(self.row_no)
        elif self.text is not None:
            if name == _TEXT:
                self.held = self.text
            elif name == _VALUE and self.value is None:
                self.held = self.value = []

    def characters(self, data: str) -> None:
        if self.held is not None:
            self.held.append(data)

    def end(self, name: str) -> None:
        self.held = None
        self.depth -= 1
        self.ready = name == _ROW and self.depth == self.data_depth
        if name != _CELL:
            return
        self.take(self.at, self.col_no, self.type,
                  "".join(self.text if self.type == "inlineStr" else self.value or ()))
        self.text = None

    def take(self, row_no: int, col_no: int, kind: str, raw: str) -> None:
        if raw and kind == "s":
            raw = self.shared[int(raw)]
        elif raw and kind == "b":
            raw = "TRUE" if raw.strip() == "1" else "FALSE"
        if raw:
            self.cells.append((row_no, col_no, self.KINDS.get(kind, "n"), raw))

    def feed(self, data: bytes, last: bool = False) -> None:
        self.parser.Parse(data, last)

    def rows(self, data: bytes) -> bool:
        """Whole rows, each plain one by one expression, others by the parser. False once
        something else came: what follows is then for the parser alone."""
        try:
            text = data.decode()
        except UnicodeDecodeError:
            self.feed(data)
            return False
        at = 0
        while at < len(text):
            plain = _PLAIN_ROWS.match(text, at)
            if plain.end() > at:
                self.plain(text[at:plain.end()])
                self.row_no, self.row_text = int(plain.group(1)), plain.group(1)
                at = plain.end()
                continue
            to = text.index("</row>", at) + len("</row>")
            self.ready = False
            self.feed(text[at:to].encode())
            at = to
            if not self.ready:
                self.feed(text[at:].encode())
                return False
        return True

    def plain(self, text: str) -> None:
        columns, kinds, add = self.columns, self.KINDS, self.cells.append
        for letters, row, kind, value, inline in _PLAIN_CELLS.findall(text):
            col_no = columns.get(letters)
            if col_no is None:
                col_no = columns[letters] = _col_number(letters)
            raw = value or inline
            if "&" in raw:
                raw = raw.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
            if kind == "s" or kind == "b":
                self.take(int(row), col_no, kind, raw)
            elif raw:
                add((int(row), col_no, "s" if inline else kinds.get(kind, "n"), raw))


def _cell_lists(content) -> Iterator[list[tuple]]:
    """Lists of the (row_no, col_no, kind, raw) of the first sheet's non-empty cells."""
    z = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        shared = [_text_of(si) for si in root.findall("m:si", _NS)]
    sheet, size, waiting, in_rows, tried = _Sheet(shared), FIRST_BYTES, b"", False, False
    with z.open(_first_sheet_member(z)) as fh:
        while True:
            failed = None
            try:
                data = fh.read(size)
                waiting += data
                begin = waiting.find(b"<sheetData>") if not tried else -1
                if begin >= 0:
                    # Rows may be plain if all before them was parsed, and only that.
                    tried, begin = True, begin + len(b"<sheetData>")
                    sheet.feed(waiting[:begin])
                    in_rows = sheet.ready and not _UTF8.match(waiting)
                    waiting = waiting[begin:]
                if in_rows:
                    upto = waiting.rfind(b"</row>") + 1
                    if upto:
                        upto += len(b"</row>") - 1
                        part, waiting = waiting[:upto], waiting[upto:]
                        in_rows = sheet.rows(part)
                if not data:
                    sheet.feed(waiting, True)
                elif not in_rows and (tried or len(waiting) > NEXT_BYTES):
                    part, waiting, tried = waiting, b"", True
                    sheet.feed(part)
            except expat.ExpatError as e:
                failed = ET.ParseError(str(e))
            except Exception as e:
                failed = e
            # What stands before the damage counts.
            done, sheet.cells = sheet.cells, []
            yield done
            if failed is not None:
                raise failed
            if not data:
                return
            size = NEXT_BYTES


def workbook_cells(content):
    """Yield (row_no, col_no, kind, raw) for every non-empty cell of the first sheet.

    ``content``: the bytes of a workbook, or an open file of it (parts that are not needed
    are then not read)."""
    return itertools.chain.from_iterable(_cell_lists(content))


def workbook_rows(content):
    """Yield (row_no, [(col_no, cell), ...]) for every sheet row that has a cell."""
    for row_no, cells in itertools.groupby(workbook_cells(content), key=lambda c: c[0]):
        yield row_no, [(c, {"kind": k, "raw": raw}) for _, c, k, raw in cells]


def row_columns(content, most: int | None = None) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(row numbers, maps of cells) of the sheet rows that have a cell, ``ROWS_PER_BATCH`` at
    a time; ``most``: only the rows before the first one with a larger number."""
    held = []
    lists = itertools.chain(_cell_lists(content), [None])
    while True:
        failed = None
        try:
            new = next(lists)
        except Exception as e:
            new, failed = [], e
        held += new or []
        rows = np.fromiter((c[0] for c in held), np.int64, len(held))
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        last = new is None
        if most is not None and (rows > most).any():
            stop, last, failed = int(np.argmax(rows > most)), True, None
            held, starts = held[:stop], starts[starts < stop]
        whole = len(starts) if last else max(0, len(starts) - 1)
        at = 0
        while whole - at >= ROWS_PER_BATCH or (last and at < whole):
            upto = min(at + ROWS_PER_BATCH, whole)
            edges = np.append(starts, len(held))[at:upto + 1]
            row_nos, columns, kinds, raws = zip(*held[edges[0]:edges[-1]], strict=True)
            edges = edges - edges[0]
            cells = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(raws, pa.string())], ["kind", "raw"])
            yield (pa.array(np.array(row_nos, np.int32)[edges[:-1]]),
                   pa.MapArray.from_arrays(pa.array(edges, pa.int32()),
                                           pa.array(columns, pa.int32()), cells).cast(CELLS))
            at = upto
        if failed is not None:
            raise failed
        if last:
            return
        held = held[int(starts[at]):] if at < len(starts) else []


#: Sheet rows with a row 0 per workbook, which has the error of one that cannot be read.
SHEETS_SCHEMA = ROWS_SCHEMA + ", error string"


def rows_batches(batches):
    """Arrow batches of (path, content) → batches of sheet rows, one workbook at a time."""
    schema = pa.schema([("path", pa.string()), ("row_no", pa.int32()), ("cells", CELLS),
                        ("error", pa.string())])

    def rows_of(path, row_nos, cells, error=None):
        n = len(row_nos)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n, pa.string()), row_nos, cells,
             pa.array([error] * n, pa.string())], schema=schema)

    for batch in batches:
        for at in range(batch.num_rows):
            path, content = batch.column(0)[at].as_py(), batch.column(1)[at]
            try:
                rows = row_columns(content.as_buffer().to_pybytes())
                part = next(rows, None)
                yield rows_of(path, *NO_CELLS)
                while part:
                    yield rows_of(path, *part)
                    part = next(rows, None)
            except Exception as e:  # any damage of an archive
                yield rows_of(path, *NO_CELLS, f"{type(e).__name__}: {e}"[:500])


def choose_workbooks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SRC1-SRC5, SRC9, SRC10: (the newest pull per (layout, period) of a folder, all files
    as ``identify`` tells them). Layout and period come from the heads, then from the names."""
    heads = materialize(read_workbooks(spark, folder, rows=C.HEADER_SCAN_ROWS), "heads")
    found = materialize(identify(heads), "identified")
    chosen = FS.newest_pulls(found.where("error IS NULL"))
    return FS.require_files(materialize(chosen, "files")), found


def ingest_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The whole ingest (§3.1): files → sheet rows → facts, totals, dimensions, checks.

    The heads of all files, the sheet rows of the chosen ones, facts and totals are written
    once; every table below reads those. The file list stays a table.
    Returns DataFrames: files (with title and pull date), identified (every file of the
    folder), conflicts (names and contents that do not agree), grid, facts_b, facts_a,
    totals_b, totals_a, warnings, collisions, metrics_b, periods, companies,
    policy_types, and the report tables (``quality.REPORT``).
    """
    from ..operators import dims as D
    from ..operators import grid as G
    from ..operators import quality as Q
    from ..operators import reshape as RS
    from ..operators import series as S

    files, found = choose_workbooks(spark, folder)
    grid = materialize(read_listed(files), "grid")
    b = G.parse_grid(grid, files, "B")
    a = G.parse_grid(grid, files, "A")
    facts_b, facts_a = materialize(b["facts"], "facts"), materialize(a["facts"], "facts")
    totals_b, totals_a = materialize(b["totals"], "totals"), materialize(a["totals"], "totals")

    def checks(facts, totals, layout, metrics):
        # Every chosen workbook of the layout, also one that was rejected.
        return Q.checksum(facts.withColumnRenamed("source_file", "path"), totals, metrics,
                          keys=("path", "period"),
                          files=files.where(F.col("layout") == layout)).withColumn(
            "layout", F.lit(layout))

    b_keys = [r.key for r in b["metrics_seen"].orderBy("key").collect()]  # ≤ 23 keys
    a_keys = [r.key for r in a["metrics_seen"].orderBy("key").collect()]  # ≤ 6 keys
    checksums = checks(facts_b, totals_b, "B", b_keys or ["pif"]).unionByName(
        checks(facts_a, totals_a, "A", a_keys or ["a_pif"]))
    periods = D.periods(facts_b, facts_a, files)
    segments = D.segments(facts_b)
    changes = S.new_and_dropped(facts_b, files.where("layout = 'B'").select("period"))
    return {"files": files, "identified": found, "conflicts": conflicts(found), "grid": grid, "facts_b": facts_b, "facts_a": facts_a,
            "totals_b": totals_b, "totals_a": totals_a,
            "warnings": b["warnings"].unionByName(a["warnings"]),
            "collisions": b["collisions"].unionByName(a["collisions"]),
            "metrics_b": b["metrics_seen"], "periods": periods,
            "companies": D.companies(facts_b, facts_a), "policy_types": segments,
            "checksums": checksums, "coverage": Q.coverage(facts_b, facts_a, files),
            "totals": Q.summary_counts(facts_b, facts_a, files),
            "suppressed": Q.suppressed_counts(RS.observations(facts_b).unionByName(
                RS.observations_a(facts_a))),
            "unknown_segments": Q.unknown_segments(facts_b), "segments": segments,
            "entity_changes": changes.groupBy("period", "change").agg(
                F.count(F.lit(1)).alias("entities"))}
