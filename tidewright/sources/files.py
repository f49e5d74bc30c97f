"""Files into text tables: discovery, headers, CSV in several encodings, workbooks (SRC-*)."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".xlsx", ".xls", ".csv")
#: Encodings in the order in which they are tried; the last takes any bytes (fixed values).
ENCODINGS = ("utf-8", "cp874", "latin1")
#: Cells that mean no value (fixed values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: What is kept of a CSV file to find its header.
HEAD_LINES, HEAD_BYTES = 50, 65_536
#: Files whose positions are broadcast with one scan; more make a scan of their own.
FILES_IN_ONE = 50_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def discover_files(spark: SparkSession, folder: str | Sequence[str]) -> DataFrame:
    """``path, filename, extension, size_bytes, mtime`` of the folder's tables; contents aren't read.  Not recursive."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder if isinstance(folder, str) else list(folder)).select("path", "modificationTime", "length")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    return found.where(extension.isin(*EXTENSIONS)).select("path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("filename"), extension.alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def literal_path(path: str) -> str:
    """One file's path for a reader that takes patterns: their marks stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def source_file() -> Column:
    """Base name of the file that a row was read from; Spark's own column has it encoded as in a URL."""
    return spelled(F.col("_metadata.file_name"))


def decode(content: bytes) -> tuple[str, str]:
    """The text and the first encoding that reads it; a byte-order mark goes."""
    for e in ENCODINGS:
        try:
            return content.decode("utf-8-sig" if e == "utf-8" else e), e
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin1 reads any bytes")


def workbook_rows(content: bytes, most: int | None = None) -> Iterator[list[str]]:
    """Rows of the first sheet of an .xlsx file as text; blank cells are ''.  A damaged file is a ValueError, at the row where it shows."""
    try:
        yield from _sheet_rows(content, most)
    except (zipfile.BadZipFile, zlib.error, KeyError, IndexError, TypeError, ValueError, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError) as e:
        raise ValueError(f"{type(e).__name__}: {e}"[:200]) from e


def _sheet_rows(content: bytes, most: int | None) -> Iterator[list[str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheet = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"), None)
        if sheet is None:
            raise ValueError("no sheet")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheet.get(f"{_REL}id")]
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with z.open(name) as file:
            n = 0
            for _, row in ElementTree.iterparse(file):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = i
                    if letters := re.match(r"[A-Z]+", cell.get("r") or ""):
                        at = reduce(lambda x, ch: x * 26 + ord(ch) - 64, letters[0], 0) - 1
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "s" and value is not None:
                        cells[at] = shared[int(value.text)]
                    elif kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    else:
                        cells[at] = "" if value is None else value.text or ""
                yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                row.clear()
                n += 1
                if most is not None and n >= most:
                    return


def workbook_bytes(rows: Sequence[Sequence[str]], broken_string: bool = False) -> bytes:
    """A workbook of one sheet of text; with ``broken_string`` a last cell points at a shared string that isn't there."""
    main = f'xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"'
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    lines = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in rows) + '<row><c t="s"><v>0</v></c></row>' * broken_string
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{lines}</sheetData></worksheet>")
    return out.getvalue()


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each run of lines of a range: what all its lines can be, and the first lines of a file's first range."""
    known: dict[tuple[str, int], list] = {}
    row = lambda: pd.DataFrame([(*k, v[0], v[1], b"\n".join(v[2])) for k, v in known.items()], columns=["file", "start", "utf8", "thai", "head"])
    for batch in batches:
        for key, part in batch.groupby(["file", "start"], sort=False):
            at = known.setdefault(key, [True, True, [], 0])
            at[0], at[1] = at[0] and bool(part["utf8"].all()), at[1] and bool(part["thai"].all())
            for line in part["line"] if key[1] == 0 and at[3] < HEAD_BYTES else ():
                if len(at[2]) >= HEAD_LINES or at[3] >= HEAD_BYTES:
                    break
                at[2].append(bytes(line))
                at[3] += len(line)
        if len(known) > 1000:  # the last range may go on
            last = next(reversed(known))
            rest = {last: known.pop(last)}
            yield row()
            known = rest
    yield row()


def csv_profiles(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``file, encoding, head`` of each CSV file that has a line: one distributed scan of byte ranges, whatever a file's size.

    A range ends at a line's end, and a byte of a line's end is never part of a longer
    character, so a file can be in an encoding if each of its lines can.  Lines are
    judged by functions of Spark; Python gets two flags a line, and text only of a file's
    first range.  ``file`` is the path as a scan's metadata spell it; ``head`` has the
    first lines, up to HEAD_LINES and about HEAD_BYTES.
    """
    lines = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").text([paths] if isinstance(paths, str) else list(paths))
    start = F.col("_metadata.file_block_start")
    thai = ~F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(f"[{''.join(map(chr, cp874_gaps()))}]")
    line = F.when(start == 0, F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), start.alias("start"), F.is_valid_utf8("value").alias("utf8"), thai.alias("thai"), line.alias("line"))
    ranges = lines.mapInPandas(_heads, "file string, start long, utf8 boolean, thai boolean, head binary")
    encoding = F.when(F.bool_and("utf8"), ENCODINGS[0]).when(F.bool_and("thai"), ENCODINGS[1]).otherwise(ENCODINGS[2])
    return ranges.groupBy("file").agg(encoding.alias("encoding"), F.min_by("head", "start").alias("head"))


def spelled(file: Column) -> Column:
    """A path as files are listed, of one as a scan's metadata spell it (encoded as in a URL)."""
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


HEADS = "path string, file string, encoding string, header_row int, position int, cell string, error string"


def peek_headers(spark: SparkSession, paths: Sequence[str] | str, rows: int = 2) -> DataFrame:
    """``path, file, encoding, header_row, position, cell, error`` of the first rows of each file, read without a header.

    A file whose first rows can't be read has one row with an ``error`` and no cell.
    Workbooks are read one at a time, CSV files by ranges (``csv_profiles``).
    """

    def cells(path, file, encoding, first):
        try:
            return [(path, file, encoding, i, j, cell, None) for i, row in zip(range(rows), first(), strict=False) for j, cell in enumerate(row)]
        except (ValueError, csv.Error) as e:
            return [(path, file, encoding, None, None, None, str(e))]

    def csv_heads(batches):
        for batch in batches:
            out = []
            for path, file, encoding, head in zip(batch["path"], batch["file"], batch["encoding"], batch["head"], strict=True):
                # a character may be cut where the head ends
                text = bytes(head).decode("utf-8-sig" if encoding == "utf-8" else encoding, "ignore")
                out += cells(path, file, encoding, lambda text=text: csv.reader(io.StringIO(text)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEADS.split(", ")])

    def book_heads(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out += cells(path, path, None, lambda content=content: workbook_rows(bytes(content), rows))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEADS.split(", ")])

    heads = csv_profiles(spark, paths).withColumn("path", spelled(F.col("file"))).select("path", "file", "encoding", "head")
    return heads.mapInPandas(csv_heads, HEADS).unionByName(workbooks(spark, paths).mapInPandas(book_heads, HEADS))


def workbooks(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``path, content`` of the .xlsx files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load([paths] if isinstance(paths, str) else list(paths)).select("path", "content")


def headers_of(heads: DataFrame) -> DataFrame:
    """``path, file, header_row, encoding, header``: the cells of each peeked row in order, as distinct names are made of them."""
    return heads.where("error is null").groupBy("path", "file", "header_row", "encoding").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "cell"))), lambda x: x["cell"]).alias("header"))


def nulls(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Cells that mean no value become NULL."""
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if t == "string" and not c.startswith("_") else F.col(f"`{c}`") for c, t in df.dtypes])


def cp874_gaps() -> list[int]:
    """Bytes that the Thai code page leaves undefined."""
    return sorted(set(range(0x80, 0x100)) - {ord(c) for c in cp874_pairs()[0]})


def cp874_pairs() -> tuple[str, str]:
    """Characters of bytes 0x80-0xFF in latin1, and what the Thai code page makes of them."""
    pairs = []
    for b in range(0x80, 0x100):
        try:
            pairs.append((bytes([b]).decode("latin1"), bytes([b]).decode("cp874")))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def read_csv_strings(
    spark: SparkSession, paths: Sequence[str], multi_line: bool = False, na_tokens: Sequence[str] = NA_TOKENS, skip_rows: int = 0, rename: Rename | None = None, heads: Sequence[Row] | None = None, errors: bool = False,
) -> DataFrame:
    """All rows of all files as text with ``_source_file``.

    One scan reads all files of an encoding, whatever their headers: cells are taken by
    position, and a broadcast table has each file's positions.  Thai files are read as
    single bytes, which split and stay line by line, and translated.  A file without a
    header is an error.  ``skip_rows``: rows above the header; a file that has them is
    read whole by one task, since Spark's reader can't leave them out.  ``rename`` names
    a file's columns before files are joined; columns without a name are not read.
    ``heads``: rows of ``headers_of`` for these files, else they are peeked at.  With
    ``errors`` a file that breaks off has a row with ``_read_error``, without it fails.
    """
    heads = heads if heads is not None else headers_of(peek_headers(spark, paths, skip_rows + 1).where(F.col("header_row") == skip_rows)).collect()  # one row per file
    if not heads:
        raise ValueError("no file has a header")
    names = _names(heads, rename)
    parts = []
    for encoding in [None] if skip_rows else ENCODINGS:
        own = sorted((r for r in heads if encoding is None or r["encoding"] == encoding), key=lambda r: r["path"])
        for at in range(0, len(own), FILES_IN_ONE):
            group = own[at : at + FILES_IN_ONE]
            files = [literal_path(r["path"]) for r in group]
            if skip_rows:
                rows = spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(_after(skip_rows + 1), CELLS).withColumn("file", F.col("path"))
                place = "path"
            else:
                width = max(len(r["header"]) for r in group)
                reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("enforceSchema", True)
                reader = reader.option("encoding", "UTF-8" if encoding == "utf-8" else "ISO-8859-1")
                rows = reader.schema(", ".join(f"`c{i}` string" for i in range(width))).csv(files)
                rows = rows.select(F.array(*[F.col(f"c{i}") for i in range(width)]).alias("cells"), F.col("_metadata.file_path").alias("file"), source_file().alias("_source_file"), F.lit(None).cast("string").alias("_read_error"))
                place = "file"
            parts.append(_placed(rows, group, place, names, rename, (lambda c: F.translate(c, *cp874_pairs())) if encoding == "cp874" else lambda c: c))
    return _checked(nulls(reduce(DataFrame.unionByName, parts), na_tokens), errors)


Rename = Callable[[list[str]], "list[str | None]"]
CELLS = "path string, cells array<string>, _source_file string, _read_error string"


def _names(heads: Sequence[Row], rename: Rename | None) -> list[str]:
    """The columns of all files together, in order of first appearance; headers that many files share are named once."""
    names: dict[str, None] = {}
    for header in dict.fromkeys(tuple(r["header"]) for r in sorted(heads, key=lambda r: r["path"])):
        own = _distinct(header)
        names.update(dict.fromkeys(n for n in (rename(own) if rename else own) if n is not None))
    return list(names)


def _placed(rows: DataFrame, heads: Sequence[Row], place: str, names: Sequence[str], rename: Rename | None, cell: Callable[[Column], Column]) -> DataFrame:
    """``cells`` as named columns by the positions that each file's header gives; at most FILES_IN_ONE files, whose positions are broadcast."""
    known: dict[tuple, list[int | None]] = {}
    for header in {tuple(r["header"]) for r in heads}:
        own = _distinct(header)
        at = {n: i for i, n in reversed(list(enumerate(rename(own) if rename else own))) if n is not None}
        known[header] = [at.get(n) for n in names]
    where = rows.sparkSession.createDataFrame([(r[place], known[tuple(r["header"])]) for r in heads], "file string, _at array<int>")
    found = rows.join(F.broadcast(where), "file")
    return found.select(*[cell(F.get("cells", F.get("_at", F.lit(i)))).alias(n) for i, n in enumerate(names)], "_source_file", "_read_error")


def _checked(rows: DataFrame, errors: bool) -> DataFrame:
    if errors:
        return rows
    fine = F.when(F.col("_read_error").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "_source_file", "_read_error")).cast("boolean"))
    return rows.where(fine).drop("_read_error")


def _cells_of(batches: Iterator[pd.DataFrame], rows_of: Callable[[bytes], Iterator[list[str]]], skip: int) -> Iterator[pd.DataFrame]:
    """Rows of each file after the first ``skip``, and for one that breaks off a row with the error."""
    columns = [c.split()[0] for c in CELLS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            name, found = re.search(r"[^/\\]*$", path)[0], []
            try:
                for i, row in enumerate(rows_of(bytes(content))):
                    if i >= skip and row:
                        found.append((path, row, name, None))
                    if len(found) == 10_000:
                        yield pd.DataFrame(found, columns=columns)
                        found = []
            except (ValueError, csv.Error) as e:
                found.append((path, None, name, str(e)))
            yield pd.DataFrame(found, columns=columns)


def _after(rows: int):
    """Rows of decoded CSV files after the first ``rows``."""
    return lambda batches: _cells_of(batches, lambda content: csv.reader(io.StringIO(decode(content)[0])), rows)


def _distinct(header: Sequence[str]) -> list[str]:
    """Names as they are; a second 'a' is 'a.1', and so on, an empty one says its place."""
    out: list[str] = []
    for i, name in enumerate(header):
        name, n = name or f"Unnamed: {i}", 0
        base = name
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


def workbook_cells(files: DataFrame, skip: int = 0) -> DataFrame:
    """``path, cells, _source_file, _read_error`` of the first sheets of ``(path, content)``; one task reads a workbook.

    A workbook that breaks off, at whatever row, has the rows before and one more with the
    error: it is for the caller to leave all its rows out.
    """
    return files.select("path", "content").mapInPandas(lambda batches: _cells_of(batches, workbook_rows, skip), CELLS)


def read_excel_strings(
    spark: SparkSession, paths: Sequence[str], na_tokens: Sequence[str] = NA_TOKENS, skip_rows: int = 0, rename: Rename | None = None, heads: Sequence[Row] | None = None, errors: bool = False,
) -> DataFrame:
    """All rows of the first sheets as text with ``_source_file``, in one scan.  The parameters act as for CSV."""
    heads = heads if heads is not None else headers_of(peek_headers(spark, paths, skip_rows + 1).where(F.col("header_row") == skip_rows)).collect()  # one row per workbook
    if not heads:
        raise ValueError("no workbook has a header")
    names, parts = _names(heads, rename), []
    for at in range(0, len(heads), FILES_IN_ONE):
        group = heads[at : at + FILES_IN_ONE]
        rows = workbook_cells(workbooks(spark, [literal_path(r["path"]) for r in group]), skip_rows + 1).withColumn("file", F.col("path"))
        parts.append(_placed(rows, group, "path", names, rename, lambda c: c))
    return _checked(nulls(reduce(DataFrame.unionByName, parts), na_tokens), errors)
