"""Folders of files, end to end."""

import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewright.operators.folder import load_declared, load_files
from tidewright.operators.load import VersionedTable
from tidewright.operators.names import detect_file_type, missing_extra_columns
from tidewright.plans.spec import FileTypeSpec, spec_rows
from tidewright.sources.files import csv_profiles, decode, discover_files, headers_of, peek_headers, read_csv_strings, read_excel_strings
from tidewright.streaming.ingest import auto_ingest


def workbook(path, rows):
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else "" for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "sales_utf8.csv").write_text('id,name,amount\n1,"say ""hi""",NA\n2,b,3\n', encoding="utf-8")
    (d / "sales_bom.csv").write_text("amount,id,name\n9,3,c\n", encoding="utf-8-sig")
    (d / "sales_cp874.csv").write_bytes("รหัส,ชื่อ\n7,สมชาย\n".encode("cp874"))
    (d / "sales_header_row2.csv").write_text("My report\nid,name,amount\n4,d,5\n")
    (d / "UPPER.CSV").write_text("id,name,amount\n5,e,6\n")
    (d / "notes.txt").write_text("ignored")
    workbook(d / "book.xlsx", [["id", "name", "amount"], ["8", None, "1,5"], ["9", "z", "2"]])
    return d


def test_discovery_and_headers(spark, folder):
    found = {r.filename: r.extension for r in discover_files(spark, f"file://{folder}").collect()}
    assert set(found) == {"sales_utf8.csv", "sales_bom.csv", "sales_cp874.csv", "sales_header_row2.csv", "UPPER.CSV", "book.xlsx"} and found["UPPER.CSV"] == ".csv"
    heads = peek_headers(spark, f"file://{folder}")
    spec = FileTypeSpec("sales", {"id": "id", "name": "name", "amount": "amount"})
    types = {os.path.basename(r.path): r.header_row for r in detect_file_type(heads, spec_rows(spark, [spec])).collect()}
    assert types == {"sales_utf8.csv": 0, "sales_bom.csv": 0, "UPPER.CSV": 0, "book.xlsx": 0, "sales_header_row2.csv": 1}
    one = heads.where("path like '%cp874%' and header_row = 0")
    problems = missing_extra_columns(one, spec_rows(spark, [spec]), one.select("path").distinct().withColumn("file_type", F.lit("sales")))
    assert problems.where("problem = 'missing'").count() == 3 and problems.where("problem = 'extra'").count() == 2


def test_csv_groups_by_header_and_encoding(spark, folder):
    paths = [f"file://{folder}/{n}" for n in ("sales_utf8.csv", "sales_bom.csv", "sales_cp874.csv")]
    got = {r["_source_file"]: [] for r in read_csv_strings(spark, paths).collect()}
    for r in read_csv_strings(spark, paths).collect():
        got[r["_source_file"]].append((r.id, r["name"], r.amount, r["ชื่อ"]))
    assert sorted(got["sales_utf8.csv"]) == [("1", 'say "hi"', None, None), ("2", "b", "3", None)]
    assert got["sales_bom.csv"] == [("3", "c", "9", None)] and got["sales_cp874.csv"] == [(None, None, None, "สมชาย")]
    with pytest.raises(ValueError):
        (folder / "empty.csv").write_text("")
        read_csv_strings(spark, [f"file://{folder}/empty.csv"])


def test_csv_with_a_title_line(spark, folder):
    got = read_csv_strings(spark, [f"file://{folder}/sales_header_row2.csv"], skip_rows=1).collect()
    assert [(r.id, r["name"], r.amount) for r in got] == [("4", "d", "5")]


def test_workbooks(spark, folder):
    got = read_excel_strings(spark, [f"file://{folder}/book.xlsx"]).collect()
    assert sorted((r.id, r["name"], r.amount, r["_source_file"]) for r in got if r.id == "9") == [("9", "z", "2", "book.xlsx")]
    assert [(r["name"], r.amount) for r in got if r.id == "8"] == [(None, "1,5")]


def test_decoding():
    assert decode("é".encode()) == ("é", "utf-8") and decode("ก".encode("cp874")) == ("ก", "cp874") and decode(b"\xff")[1] == "latin1"


def test_stream_takes_each_file_once_and_the_newest_wins(spark, tmp_path):
    d = tmp_path / "drop"
    d.mkdir()
    spec = FileTypeSpec("t", {"id": "id", "v": "v"}, {"id": "INT"}, strategy="upsert", keys=("id",))
    table = VersionedTable(spark, f"file://{tmp_path}/table")
    run = lambda: auto_ingest(spark, f"file://{d}", spec, table, f"file://{tmp_path}/checkpoint")
    (d / "a.csv").write_text("id,v\n1,a\n2,a\n")
    (d / "bad.csv").write_text("id,v\nx,b\ny,b\n")
    time.sleep(1.1)
    (d / "b.csv").write_text("id,v\n2,b\n3,b\n")
    run()
    want = [(1, "a"), (2, "b"), (3, "b")]
    assert sorted((r.id, r.v) for r in table.read().collect()) == want
    version = table.version()
    run()
    assert table.version() == version
    (d / "c.csv").write_text("id,v\n1,c\n")
    run()
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, "c"), (2, "b"), (3, "b")]


def test_a_folder_is_loaded_and_bad_files_are_reported(spark, folder):
    (folder / "empty.csv").write_text("")
    (folder / "broken.xlsx").write_bytes(b"no workbook")
    (folder / "old.xls").write_bytes(b"x")
    (folder / "header only.csv").write_text("id,name,amount\n")
    (folder / "lacking.csv").write_text("ID,Name\n1,x\n")
    (folder / "twice.csv").write_text("id, ID ,name,amount\n1,1,x,1\n")
    (folder / "bad [1] ไทย.csv").write_text("id,name,amount\nx,b,c\n")
    (folder / "spelled.csv").write_text("Amount , extra,NAME,Id\n7,z,s,11\n")
    spec = FileTypeSpec("sales", {"id": "id", "name": "name", "amount": "amount"}, {"id": "INT", "amount": "FLOAT"}, strategy="upsert", keys=("id",))
    table = VersionedTable(spark, f"file://{folder.parent}/table")
    run = lambda batch: load_files(spark, f"file://{folder}", [spec], {"sales": table}, batch, multi_line=True)
    report = {r.filename: (r.status, r.problem, r["rows"]) for r in run("one").collect()}
    bad = {
        "empty.csv": "empty", "broken.xlsx": "unreadable:BadZipFile: File is not a zip file", "old.xls": "unsupported", "header only.csv": "no_rows", "lacking.csv": "missing_column:amount",
        "twice.csv": "duplicate_column:id", "sales_cp874.csv": "undetected",
    }
    assert {k: v[1] for k, v in report.items() if k in bad} == bad
    assert report.pop("bad [1] ไทย.csv") == ("failed", "validation", 1)
    assert {k: v[2] for k, v in report.items() if v[0] == "success"} == {"sales_utf8.csv": 2, "sales_bom.csv": 1, "sales_header_row2.csv": 1, "UPPER.CSV": 1, "book.xlsx": 2, "spelled.csv": 1}
    want = [(1, 'say "hi"', None), (2, "b", 3.0), (3, "c", 9.0), (4, "d", 5.0), (5, "e", 6.0), (8, None, 15.0), (9, "z", 2.0), (11, "s", 7.0)]
    assert sorted((r.id, r["name"], r.amount) for r in table.read().collect()) == want
    version = table.version()
    run("one")
    assert table.version() == version  # sent again


def test_a_table_keeps_its_rows_when_its_type_changes(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    old = FileTypeSpec("t", {"a": "a"}, {"a": "INT"}, strategy="append")
    wider = FileTypeSpec("t", {"a": "a"}, {"a": "FLOAT"}, strategy="append")
    other = FileTypeSpec("t", {"a": "a", "b": "b"}, {"a": "FLOAT"}, strategy="upsert", keys=("a",))
    load_declared(table, spark.createDataFrame([(1,)], "a int"), old, "1")
    load_declared(table, spark.createDataFrame([(2.5,)], "a double"), wider, "2")
    load_declared(table, spark.createDataFrame([(2.5,)], "a double"), wider, "2")
    assert sorted(r.a for r in table.read().collect()) == [1.0, 2.5]
    row = "a double, b string, _upsert_hash binary"
    load_declared(table, spark.createDataFrame([(3.0, "x", b"k")], row), other, "3")
    assert sorted(((r.a, r.b) for r in table.read().collect()), key=str) == [(1.0, None), (2.5, None), (3.0, "x")]
    load_declared(table, spark.createDataFrame([(4.0, "z", b"k")], row), other, "4")
    assert sorted(((r.a, r.b) for r in table.read().collect()), key=str) == [(1.0, None), (2.5, None), (4.0, "z")]
    text = FileTypeSpec("t", {"a": "a"}, strategy="append")
    load_declared(table, spark.createDataFrame([("word",)], "a string"), text, "5")
    assert sorted(r.a for r in table.read().collect()) == ["1", "2.5", "4.0", "word"] and table.schema()["b"].dataType.simpleString() == "string"
    load_declared(table, spark.createDataFrame([(4.0, "y", b"l")], row), other, "6", force_recreate=True)
    assert [(r.a, r.b) for r in table.read().collect()] == [(4.0, "y")]


def damaged(path, rows, how):
    """A workbook that breaks off in the sheet, points outside its shared strings, or names no sheet."""
    workbook(path, rows)
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    if how == "sheet":
        parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"][:-60]
    elif how == "strings":
        parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b"</sheetData>", b'<row r="9"><c r="A9" t="s"><v>7</v></c></row></sheetData>')
        parts["xl/sharedStrings.xml"] = b'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>one</t></si></sst>'
    else:
        parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace(b'<sheet name="S" sheetId="1" r:id="rId1"/>', b"")
    with zipfile.ZipFile(path, "w") as z:
        for n, content in parts.items():
            z.writestr(n, content)


@pytest.mark.parametrize("stream", [False, True])
def test_damaged_workbooks_and_null_keys_stop_no_other_file(spark, tmp_path, stream):
    d = tmp_path / "in"
    d.mkdir()
    rows = [["id", "v"], *[[str(i), f"v{i}"] for i in range(5)]]
    workbook(d / "good.xlsx", rows)
    for how in ("sheet", "strings", "workbook"):
        damaged(d / f"{how}.xlsx", [rows[0], *[[str(i + 100), how] for i in range(5)]], how)
    whole = (d / "good.xlsx").read_bytes()
    (d / "cut.xlsx").write_bytes(whole[: len(whole) // 2])
    (d / "good.csv").write_text("id,v\n7,csv\n")
    (d / "keys.csv").write_text("id,v\n8,a\nNA,b\n,c\n")
    (d / "title.csv").write_text("a title\nid,v\n9,t\n")
    spec = FileTypeSpec("t", {"id": "id", "v": "v"}, {"id": "INT"}, strategy="upsert", keys=("id",))
    table = VersionedTable(spark, f"file://{tmp_path}/table", buckets=4)
    if stream:
        auto_ingest(spark, f"file://{d}", spec, table, f"file://{tmp_path}/checkpoint", report=f"file://{tmp_path}/report")
        report = spark.read.parquet(f"file://{tmp_path}/report")
    else:
        report = load_files(spark, f"file://{d}", [spec], {"t": table}, "1")
    got = {r.filename: (r.status, (r.problem or "").split(":")[0], (r.problem or ":").split(":")[1]) for r in report.collect()}
    assert {k for k, v in got.items() if v[0] == "success"} == {"good.xlsx", "good.csv", "title.csv"}
    assert {k: v[1:] for k, v in got.items() if v[0] == "failed"} == {
        "sheet.xlsx": ("unreadable", "ParseError"), "strings.xlsx": ("unreadable", "IndexError"), "workbook.xlsx": ("unreadable", "ValueError"), "cut.xlsx": ("unreadable", "BadZipFile"), "keys.csv": ("null_keys", "2"),
    }
    assert sorted((r.id, r.v) for r in table.read().collect()) == [*[(i, f"v{i}") for i in range(5)], (7, "csv"), (9, "t")]


def test_encodings_and_headers_from_ranges_of_any_size(spark, tmp_path):
    """Files larger than a range: a character that isn't UTF-8 in the last range decides for the whole file."""
    d = tmp_path / "in"
    d.mkdir()
    filler = "x,y\n" * 60_000
    (d / "utf8.csv").write_bytes(("a,b\n" + filler + "é,ไทย\n").encode())
    (d / "thai late.csv").write_bytes(b"a,b\n" + filler.encode() + "ไทย,y\n".encode("cp874"))
    (d / "latin+1.csv").write_bytes("é;\n".encode("latin1") + filler.encode() + b"\xff\xfe,z\n")
    (d / "quoted.csv").write_text('"a\nb",c\n1,2\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        profiles = csv_profiles(spark, f"file://{d}")
        got = {os.path.basename(r["path"]): (r["encoding"], r["cell"]) for r in peek_headers(spark, f"file://{d}").where("header_row = 0 and position = 0").collect()}
        ranges = spark.read.text(f"file://{d}").selectExpr("_metadata.file_path as f", "_metadata.file_block_start as s").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ranges > 12 and profiles.count() == 4
    assert got == {"utf8.csv": ("utf-8", "a"), "thai late.csv": ("cp874", "a"), "latin+1.csv": ("latin1", "é;"), "quoted.csv": ("utf-8", "a\nb")}


def test_a_file_of_over_two_gigabytes_has_a_header(spark, tmp_path):
    """A sparse file: its lines are mostly zeros, so only sizes matter here."""
    path = tmp_path / "large.csv"
    with open(path, "wb") as f:
        f.write(b"id,v\n1,a\n")
        for _ in range(440):
            f.seek(5_000_000, 1)
            f.write(b"\n2,b\n")
    assert os.path.getsize(path) > 2**31
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    try:
        heads = headers_of(peek_headers(spark, f"file://{path}", 1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["encoding"], r["header"]) for r in heads] == [("utf-8", ["id", "v"])]


def test_many_headers_are_one_scan(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(200):
        names = [f"c{j}" for j in range(i % 7, i % 7 + 1 + i % 5)] + ["id", f"own{i}"]
        (d / f"{i}.csv").write_text(",".join(names) + "\n" + ",".join([f"{i}.{n}" for n in names[:-2]] + [str(i), "z"]) + "\n")
    rename = lambda names: [n if n == "id" or n.startswith("c") else None for n in names]
    rows = read_csv_strings(spark, [f"file://{d}"], rename=rename)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan
    got = {r["id"]: r.asDict() for r in rows.collect()}
    assert len(got) == 200
    for i in range(200):
        want = {f"c{j}": f"{i}.c{j}" if i % 7 <= j < i % 7 + 1 + i % 5 else None for j in range(11)}
        assert {k: v for k, v in got[str(i)].items() if k.startswith("c")} == want and got[str(i)]["_source_file"] == f"{i}.csv"


def test_the_stream_skips_files_with_other_headers(spark, tmp_path):
    d = tmp_path / "drop"
    d.mkdir()
    spec = FileTypeSpec("t", {"Id": "id", "V": "v"}, {"id": "INT"}, strategy="append")
    table = VersionedTable(spark, f"file://{tmp_path}/table")
    (d / "a.csv").write_text("ID,v\n1,a\n")
    (d / "lacking.csv").write_text("id\n2\n")
    (d / "other.csv").write_text("x,y\n2,b\n")
    (d / "thai.csv").write_bytes("V,id\nไทย,3\n".encode("cp874"))
    auto_ingest(spark, f"file://{d}", spec, table, f"file://{tmp_path}/checkpoint", report=f"file://{tmp_path}/report")
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, "a"), (3, "ไทย")]
    report = {r.filename: r.problem for r in spark.read.parquet(f"file://{tmp_path}/report").collect()}
    assert report == {"a.csv": None, "thai.csv": None, "lacking.csv": "missing_column:v", "other.csv": "undetected"}
