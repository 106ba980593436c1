"""What a workbook is: date ranges of titles, header signatures, the data source."""

import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import identify as I
from tessera.sources import sheet_fixtures as SF
from tessera.sources import workbook_sink as SK
from tessera.sources import workbook_source as WS
from xlsx_util import write_xlsx

TITLES = [
    ("Market share (4/1/2022-6/30/2022)", "2022Q2", "quarter"),
    ("from 04/01/2022 - 06/30/2022, all lines", "2022Q2", "quarter"),
    ("2022-04-01 to 2022-06-30", "2022Q2", "quarter"),
    ("Share, April 1, 2022 through June 30, 2022", "2022Q2", "quarter"),
    ("Share  Apr 1 2022\n\u2013 Jun 30, 2022", "2022Q2", "quarter"),
    ("1 October 2021 until 31 December 2021", "2021Q4", "quarter"),
    ("JANUARY 1, 2024 TO MARCH 31, 2024", "2024Q1", "quarter"),
    ("1/1/2024\u00a0-\u00a03/31/2024 (revised)", "2024Q1", "quarter"),
    ("1/1/2022-6/30/2022", None, "not_a_quarter"),
    ("6/30/2022-4/1/2022", None, "not_a_quarter"),
    ("4/2/2022-6/30/2022", None, "not_a_quarter"),
    ("4/1/2022-6/30/2023", None, "not_a_quarter"),
    ("4/31/2022-6/30/2022", None, "none"),
    ("(Data pulled on 7/20/2022)", None, "none"), ("2nd quarter 2022", None, "none"), ("", None, "none"),
    (None, None, "none"),
]


def test_title_periods(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TITLES)], "i int, title string")
    told = I.with_title_period(df).orderBy("i").collect()
    for r, (title, period, status) in zip(told, TITLES, strict=True):
        assert (r.title_period, r.title_status) == (period, status), title


def folder_of(d, b_head, a_head):
    os.makedirs(d, exist_ok=True)

    def put(name, title, head, body):
        write_xlsx(os.path.join(d, name), [[title], ["(Data pulled on 7/1/2022)"], None, head, body])

    b = [1, "Acme", "Personal Residential - X", None, 5, 10.0, 1.0]
    put("filing_by_company_and_commercial_personal_2022q1_20220701t000000.xlsx",
        "4/1/2022-6/30/2022", b_head, b)                          # both hints are wrong
    put("anything at all.xlsx", "1/1/2022 to 3/31/2022", b_head, b)  # no hint
    put("filing_by_company_and_policy_type_2022q3.xlsx", "no range", a_head,
        [1, "Acme", 1, 5, 2, 3, 9.0, 4.0, 5.0])
    put("filing_by_company_and_policy_type_2022q4.xlsx", "", ["Company Name", "x", "y"], ["A", 1, 2])
    with open(os.path.join(d, "filing_by_company_and_policy_type_2021q4.xlsx"), "wb") as f:
        f.write(b"PK no archive")


def test_content_decides_and_conflicts_are_told(spark, tmpdir_path):
    from test_sources import A_HEAD, B_HEAD

    from tessera.sources import workbooks as WB
    folder_of(tmpdir_path, B_HEAD, A_HEAD)
    ds = WB.ingest_folder(spark, tmpdir_path)
    found = {r.name[:24]: r for r in ds["identified"].collect()}
    wrong = found["filing_by_company_and_co"]
    assert (wrong.layout, wrong.layout_by, wrong.period, wrong.period_by) == ("B", "headers", "2022Q2", "title")
    free = found["anything at all.xlsx"]
    assert (free.layout, free.period, free.name_layout, free.name_period) == ("B", "2022Q1", None, None)
    codes = sorted((os.path.basename(r.path)[-16:], r.code) for r in ds["conflicts"].collect())
    assert codes == [("0701t000000.xlsx", "layout_conflict"), ("0701t000000.xlsx", "period_conflict"),
                     ("type_2021q4.xlsx", "unreadable"), ("type_2022q3.xlsx", "layout_conflict"),
                     ("type_2022q4.xlsx", "layout_unclear")]
    assert sorted((r.layout, r.period) for r in ds["files"].collect()) == [
        ("A", "2022Q3"), ("B", "2022Q1"), ("B", "2022Q2"), ("B", "2022Q4")]
    assert {(r.period, r.naic, r.pif) for r in ds["facts_b"].collect()} == {
        ("2022Q1", "1", 5.0), ("2022Q2", "1", 5.0)}
    assert ds["facts_a"].first().a_dpw == 9.0


def test_packing_by_size():
    files = [WS.File(f"/d/{i}", str(i), size, 0) for i, size in enumerate([90, 5, 5, 5, 5, 40, 40])]
    packed = WS.pack(files, 100, 1)
    assert sorted(f.name for p in packed for f in p.files) == [str(i) for i in range(7)]
    sizes = [sum(f.length for f in p.files) for p in packed]
    assert len(packed) == 2 and max(sizes) <= 100
    assert len(WS.pack(files, 10**9, 0)) == 1 and WS.pack([], 10, 1) == []
    assert len(WS.pack(files, 1, 1)) == 7


CELLS = [(1, [(1, "s", "Title & <more>"), (3, "b", "TRUE")]), (4, [(2, "n", "1.5"), (27, "s", "  ä\n")])]


def rows_df(spark, path="w.xlsx", rows=CELLS):
    data = [(path, n, {c: (k, raw) for c, k, raw in cells}) for n, cells in rows]
    return spark.createDataFrame(data, "path string, row_no int, cells map<int, struct<kind: string, raw: string>>")


def read(df):
    return {(r.name, r.row_no): {k: tuple(v) for k, v in r.cells.items()} for r in df.collect()}


def test_round_trip_heads_and_damaged_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "wb")
    two = rows_df(spark, "a.xlsx").unionByName(rows_df(spark, "b.xlsx", [(2, [(1, "s", "x")])]))
    told = {os.path.basename(r.path): r.rows for r in SK.write_workbooks(two, d).collect()}
    assert told == {"a.xlsx": 2, "b.xlsx": 1}
    SK.write_workbooks(two, d).collect()  # again: the same files
    with open(os.path.join(d, "c.xlsx"), "wb") as f:
        f.write(b"nothing")
    open(os.path.join(d, "notes.txt"), "w").write("not listed")
    whole = WS.read_workbooks(spark, d)
    assert read(whole) == {("a.xlsx", 0): {}, ("a.xlsx", 1): {1: ("s", "Title & <more>"), 3: ("b", "TRUE")},
                           ("a.xlsx", 4): {2: ("n", "1.5"), 27: ("s", "  ä\n")}, ("b.xlsx", 0): {},
                           ("b.xlsx", 2): {1: ("s", "x")}, ("c.xlsx", 0): {}}
    assert [r.name for r in whole.where("error IS NOT NULL").collect()] == ["c.xlsx"]
    assert whole.where("row_no = 0").agg(F.min("length")).first()[0] > 0
    heads = WS.read_workbooks(spark, d, rows=2)
    assert {k for k in read(heads)} == {("a.xlsx", 0), ("a.xlsx", 1), ("b.xlsx", 0), ("b.xlsx", 2), ("c.xlsx", 0)}
    with pytest.raises(Exception, match="not a zip"):
        WS.read_workbooks(spark, d, mode="failfast").collect()
    listed = WS.read_listed(whole.where("row_no = 0 AND name < 'c'").select("path", "length"))
    assert listed.count() == 3 and listed.columns == ["path", "row_no", "cells"]
    assert WS.read_listed(whole.where("false").select("path", "length")).count() == 0
    empty = os.path.join(tmpdir_path, "none")
    os.makedirs(empty)
    assert WS.read_workbooks(spark, empty).count() == 0


def sheet_file(rows, head="", shared=()):
    from xml.sax.saxutils import escape
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in SK.PARTS.items():
            z.writestr(name, text)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SK._MAIN}">' + "".join(
            f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SK._MAIN}">{head}<sheetData>'
                   f"{rows}</sheetData><mergeCells/></worksheet>")
    return data.getvalue()


def test_plain_and_other_rows_read_alike():
    from tessera.sources import workbooks as W
    odd = {2: '<row r="2"><c r="A2" s="1"/><c r="B2" t="str"><f>1&lt;2</f><v>x</v></c></row>',
           4: '<row><c><v>7</v></c><c r="D4" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>',
           6: '<!-- </row> --><row r="6"><c r="A6"><v>6</v></c></row>',
           8: '<row r="8"><c r="A8" t="inlineStr"><v>no text</v></c><c r="B8" t="b"><v>1</v></c></row>'}
    plain = ('<row r="{0}" spans="1:28"><c r="A{0}" t="s"><v>0</v></c><c r="AB{0}" s="3"><v>{0}</v></c><c r="AC{0}" '
             't="inlineStr"><is><t xml:space="preserve"> &amp;lt; &lt;é\n</t></is></c></row>')
    texts = [odd.get(n) or plain.format(n) for n in range(1, 2500)]
    got = list(W.workbook_cells(sheet_file("".join(texts), shared=["one & two"])))
    whole = list(W.workbook_cells(sheet_file("".join(t.replace("</c>", "</c> ") for t in texts), shared=["one & two"])))
    assert got == whole
    by_row = {}
    for r, c, k, raw in got:
        by_row.setdefault(r, []).append((c, k, raw))
    assert by_row[1] == [(1, "s", "one & two"), (28, "n", "1"), (29, "s", " &lt; <é\n")]
    assert by_row[2] == [(2, "s", "x")] and by_row[4] == [(1, "n", "7"), (4, "s", "ab")]
    assert by_row[6] == [(1, "n", "6")] and by_row[8] == [(2, "b", "TRUE")] and len(by_row) == 2499
    batches = list(W.row_columns(sheet_file("".join(texts), shared=["one & two"])))
    assert [len(n) for n, _ in batches] == [1000, 1000, 499]
    assert [[(c, v["kind"], v["raw"]) for c, v in m] for _, ms in batches for m in ms.to_pylist()] == list(by_row.values())
    assert sum(len(n) for n, _ in W.row_columns(sheet_file("".join(texts), shared=["one & two"]), 5)) == 5


def test_sheets_are_packed_and_damage_shows_after_the_rows_before_it(spark, tmpdir_path):
    from tessera.sources import workbooks as W
    d = os.path.join(tmpdir_path, "wb")
    rows = rows_df(spark, "a.xlsx", [(n, [(2, "s", f"a <{n}>"), (1, "n", str(n))]) for n in range(1, 4001)])
    told = SK.write_workbooks(rows, d).first()
    assert told.rows == 4000 and told.length < 100_000  # 500 KB as XML
    cells = list(W.workbook_cells(open(os.path.join(d, "a.xlsx"), "rb").read()))
    assert cells[:3] == [(1, 1, "n", "1"), (1, 2, "s", "a <1>"), (2, 1, "n", "2")] and len(cells) == 8000
    plain = "".join(f'<row r="{n}"><c r="A{n}"><v>1</v></c></row>' for n in range(1, 2500))
    with open(os.path.join(d, "a.xlsx"), "wb") as f:
        f.write(sheet_file(plain + "<row><oops></row>"))
    got = WS.read_workbooks(spark, d).select("row_no", "error").collect()
    assert len(got) == 2002 and "mismatched" in [r.error for r in got if r.error][0]


def test_files_are_dealt_to_the_cores_of_the_session():
    files = [WS.File(f"/w/{k}", f"{k}", 1 << 20, 0) for k in range(24)]
    assert len(WS.pack(files, 32 << 20, 1 << 20)) == 2  # by size alone
    assert len(WS.pack(files, 32 << 20, 1 << 20, 12)) == 12


def test_filters_choose_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "wb")
    SK.write_workbooks(rows_df(spark, "a.xlsx").unionByName(rows_df(spark, "b.xlsx")), d).collect()
    with open(os.path.join(d, "c.xlsx"), "wb") as f:
        f.write(b"nothing")  # opening it would fail
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = WS.read_workbooks(spark, d, mode="failfast", pushdown="true")
        assert {k[0] for k in read(df.where(F.col("name").isin("a.xlsx", "zz")))} == {"a.xlsx"}
        assert {k[0] for k in read(df.where(F.col("name").startswith("b")))} == {"b.xlsx"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_sheet_is_bounded(spark, tmpdir_path):
    with pytest.raises(Exception, match="at most"):
        SK.write_workbooks(rows_df(spark, "a.xlsx", [(SK.MAX_ROWS + 1, [(1, "s", "x")])]), tmpdir_path).collect()


def test_stream_takes_each_file_once(spark, tmpdir_path):
    d, ck = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "ck")
    os.makedirs(d)
    WS.register(spark)

    def put(name, when):
        write_xlsx(os.path.join(d, name), [["x"], ["y"]])
        os.utime(os.path.join(d, name), (when, when))

    def run():
        got = []

        def keep(df, n):
            got.extend((r.name, r.row_no) for r in df.select("name", "row_no").collect())
        q = (spark.readStream.format("workbooks").option("maxFilesPerBatch", "2").load(d).writeStream
             .foreachBatch(keep).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted(n for n, row in got if row == 0), len(got)

    now = int(time.time()) - 1000
    for k in range(3):
        put(f"f{k}.xlsx", now + k // 2)
    assert run()[0][:2] == ["f0.xlsx", "f1.xlsx"]
    rest = run()[0]
    assert rest in (["f2.xlsx"], [])
    put("same_time.xlsx", now + 1)
    put("later.xlsx", now + 5)
    seen = run()[0] + run()[0]
    assert sorted(seen) == ["later.xlsx", "same_time.xlsx"]
    assert run() == ([], 0)
