"""Workbooks as tables of cells: a reader of xlsx bytes, and a Spark data source with one partition a sheet.

One decoder serves every path. Cells come out as read; a shared formula's members carry their master's formula moved to
their place, cached results of formulas are kept apart.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree as ET

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridspark import grammar as g
from gridspark.functions.text_format import built_in, format_class
from gridspark.model import BLANK, DAY, GridError, error_of, from_serial

ESCAPE = re.compile("_x([0-9A-Fa-f]{4})_")
SPACE = " \t\r\n"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def unescape(text: str) -> str:
    """`_xHHHH_` as the character; surrogates stay as they are."""

    def one(m: re.Match) -> str:
        code = int(m[1], 16)
        return m[0] if 0xD800 <= code <= 0xDFFF else chr(code)

    return ESCAPE.sub(one, text)


def text_of(si: ET.Element) -> str:
    """A string item: its runs joined, without phonetic ones; trimmed unless space is preserved."""
    out = []

    def walk(e: ET.Element) -> None:
        for c in e:
            name = local(c.tag)
            if name == "t":
                t = c.text or ""
                keep = c.get("{http://www.w3.org/XML/1998/namespace}space") == "preserve"
                out.append(unescape(t if keep else t.strip(SPACE)))
            elif name != "rPh":
                walk(c)

    walk(si)
    return "".join(out)


@dataclass
class Cell:
    row: int
    col: int
    value: Any = None  # as decoded; None without a value
    formula: str | None = None
    declared: bool = True


@dataclass
class Sheet:
    name: str
    part: str | None
    cells: list[Cell] = field(default_factory=list)
    max_row: int = 0
    max_col: int = 0
    ascending: bool = True
    xml_formulas: int = 0

    @property
    def data_row(self) -> int:
        return max((c.row for c in self.cells if c.formula is not None or c.value is not None), default=0)

    @property
    def data_col(self) -> int:
        return max((c.col for c in self.cells if c.formula is not None or c.value is not None), default=0)


@dataclass
class Package:
    """Metadata of a workbook; sheets are read one by one."""

    data: bytes
    sheets: list[tuple[str, str | None]] = field(default_factory=list)
    strings: list[str] = field(default_factory=list)
    formats: list[str | None] = field(default_factory=list)
    names: list[tuple[str, str | None, str]] = field(default_factory=list)  # name, sheet scope, formula
    iterate: bool = False
    steps: int = 100
    change: float = 0.001

    @classmethod
    def open(cls, data: bytes) -> Package:
        p = cls(data)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            have = set(z.namelist())
            book = ET.fromstring(z.read("xl/workbook.xml"))
            targets: dict[str, str] = {}
            if "xl/_rels/workbook.xml.rels" in have:
                for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                    t = r.get("Target", "")
                    targets[r.get("Id", "")] = t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t))
            for e in book.iter():
                kind = local(e.tag)
                if kind == "sheet" and e.tag.startswith(MAIN):
                    part = targets.get(e.get(REL, ""))
                    p.sheets.append((e.get("name", ""), part if part in have else None))
                elif kind == "definedName" and e.tag.startswith(MAIN):
                    scope, text = e.get("localSheetId"), (e.text or "").strip()
                    p.names.append((e.get("name", ""), scope, text))
                elif kind == "calcPr" and e.tag.startswith(MAIN):
                    p.iterate = e.get("iterate", "0") in ("1", "true")
                    p.steps = int(e.get("iterateCount", "100"))
                    p.change = float(e.get("iterateDelta", "0.001"))
            at = lambda s: None if s is None else p.sheets[int(s)][0] if s.isdigit() and int(s) < len(p.sheets) else "\0"
            p.names = [(n, at(s), t) for n, s, t in p.names]
            if "xl/sharedStrings.xml" in have:
                p.strings = [text_of(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if local(si.tag) == "si"]
            if "xl/styles.xml" in have:
                p.formats = read_formats(ET.fromstring(z.read("xl/styles.xml")))
        return p

    def sheet(self, index: int) -> Sheet:
        name, part = self.sheets[index]
        out = Sheet(name, part)
        if part is None:
            return out
        masters: dict[str, tuple[g.Node | None, int, int]] = {}
        with zipfile.ZipFile(io.BytesIO(self.data)) as z, z.open(part) as f:
            row = last = 0
            col = 0
            for event, e in ET.iterparse(f, events=("start", "end")):
                kind = local(e.tag)
                if event == "start":
                    if kind == "row":
                        row = int(e.get("r") or row + 1)
                        out.ascending &= row > last
                        last, col = row, 0
                    continue
                if kind == "dimension":
                    corner = (e.get("ref") or "").rpartition(":")[2].replace("$", "")
                    try:
                        r, c = g.parse_a1(corner)
                        out.max_row, out.max_col = max(out.max_row, r), max(out.max_col, c)
                    except ValueError:
                        pass
                elif kind == "c":
                    try:
                        r, c = g.parse_a1(e.get("r", ""))
                    except ValueError:
                        r, c = row, col + 1
                    col = c
                    out.cells.append(self.cell(e, r, c, masters, out))
                    out.max_row, out.max_col = max(out.max_row, r), max(out.max_col, c)
                elif kind == "row":
                    e.clear()
        return out

    def cell(self, e: ET.Element, r: int, c: int, masters: dict, sheet: Sheet) -> Cell:
        raw, inline, formula = None, None, None
        for x in e:
            kind = local(x.tag)
            if kind == "v":
                raw = x.text or ""
            elif kind == "is":
                inline = text_of(x)
            elif kind == "f":
                sheet.xml_formulas += 1
                text, si = (x.text or "").strip(), x.get("si")
                if x.get("t") == "shared" and si is not None:
                    if text:
                        try:
                            masters[si] = (g.parse(text), r, c)
                        except g.ParseError:
                            masters[si] = (None, r, c)
                    elif si in masters and masters[si][0] is not None:
                        tree, mr, mc = masters[si]
                        text = g.printed(g.shifted(tree, r - mr, c - mc))
                if text:
                    formula = text if text.startswith("=") else "=" + text
        return Cell(r, c, self.decode(e.get("t"), e.get("s"), raw, inline), formula)

    def decode(self, kind: str | None, style: str | None, raw: str | None, inline: str | None) -> Any:
        if kind == "inlineStr" and inline is not None:
            return inline or None
        if raw is None or raw == "" and kind != "s":
            return None
        if kind == "s":
            try:
                return self.strings[int(raw)]
            except (ValueError, IndexError):
                return None
        if kind == "b":
            return raw != "0"
        if kind == "e":
            return error_of(raw)
        if kind in ("str", "d"):
            return unescape(raw)
        try:
            x = float(raw)
        except ValueError:
            return raw
        temporal = self.formats[int(style)] if style and style.isdigit() and int(style) < len(self.formats) else None
        if temporal == "elapsed":
            return dt.timedelta(microseconds=round(x * DAY * 1e6))
        if temporal == "date":
            if 0 <= x < 1:
                s = round(x * DAY) % DAY
                return dt.time(s // 3600, s // 60 % 60, s % 60)
            try:
                return from_serial(x)
            except OverflowError:
                return x
        return x


def read_formats(root: ET.Element) -> list[str | None]:
    """Per cell format (cellXfs): date, elapsed or None."""
    codes = {n.get("numFmtId", ""): n.get("formatCode", "") for n in root.iter(f"{MAIN}numFmt")}
    xfs = root.find(f"{MAIN}cellXfs")
    out = []
    for xf in xfs if xfs is not None else []:
        n = xf.get("numFmtId", "0")
        out.append(format_class(codes[n]) if n in codes else built_in(n))
    return out


def kept_blanks(sheet: Sheet, ranges: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], Any]:
    """Values of cells without formulas; declared cells without a value only inside (top, left, bottom, right) ranges."""
    out: dict[tuple[int, int], Any] = {}
    for c in sheet.cells:
        if c.formula is not None:
            continue
        if c.value is not None:
            out[c.row, c.col] = c.value
        elif any(t <= c.row <= b and l <= c.col <= r for t, l, b, r in ranges):
            out[c.row, c.col] = BLANK
    return out


# as a Spark source

CELL_SCHEMA = "path string, sheet int, sheet_name string, row int, col int, kind string, number double, text string, bool boolean, error string, formula string"


def cell_row(path: str, index: int, name: str, c: Cell) -> tuple:
    v = c.value
    kind, number, text, flag, err = "blank", None, None, None, None
    if isinstance(v, bool):
        kind, flag = "bool", v
    elif isinstance(v, (int, float)):
        kind, number = "number", float(v)
    elif isinstance(v, str):
        kind, text = "text", v
    elif isinstance(v, GridError):
        kind, err = "error", v.kind
    elif v is not None:
        kind, text = type(v).__name__, v.isoformat() if not isinstance(v, dt.timedelta) else str(v.total_seconds())
    return path, index, name, c.row, c.col, kind, number, text, flag, err, c.formula


def read_bytes(path: str) -> bytes:
    """A file's bytes, through pyarrow's file systems for a URI."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        with system.open_input_stream(at) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def source_class(root: str) -> type[DataSource]:
    """The data source. Its classes travel by value, and find this package below root where it is not installed."""

    schema_text = CELL_SCHEMA

    def module():
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return importlib.import_module("gridspark.sources.xlsx")

    class Reader(DataSourceReader):
        def __init__(self, path: str, sheet: str | None):
            self.path, self.only = path, sheet

        def partitions(self) -> list[InputPartition]:
            x = module()
            p = x.Package.open(x.read_bytes(self.path))
            return [InputPartition(i) for i, (n, _) in enumerate(p.sheets) if self.only is None or n.lower() == self.only.lower()]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            x = module()
            sheet = x.Package.open(x.read_bytes(self.path)).sheet(partition.value)
            for c in sheet.cells:
                yield x.cell_row(self.path, partition.value, sheet.name, c)

    class XlsxSource(DataSource):
        """spark.read.format("gridspark_xlsx").option("sheet", name).load(path): the cells of a workbook, a partition a sheet."""

        @classmethod
        def name(cls) -> str:
            return "gridspark_xlsx"

        def schema(self) -> str:
            return schema_text

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"], self.options.get("sheet"))

    return XlsxSource


def read_cells(spark, path: str, sheet: str | None = None):
    """Cells of one workbook, a partition a sheet."""
    source = source_class(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    spark.dataSource.register(source)
    r = spark.read.format(source.name())
    return (r.option("sheet", sheet) if sheet else r).load(path)


def read_many(spark, pattern: str):
    """Cells of all workbooks that match, a workbook at a time on the executors; Spark's own reader finds and reads the files."""
    import pandas as pd

    def cells(frames):
        names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                p = Package.open(bytes(content))
                for i in range(len(p.sheets)):
                    s = p.sheet(i)
                    for k in range(0, len(s.cells), 50_000):
                        yield pd.DataFrame([cell_row(path, i, s.name, c) for c in s.cells[k : k + 50_000]], columns=names)

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(cells, CELL_SCHEMA)


def wide(cells, letters: dict[str, str]):
    """Cells of one sheet as rows: `_row` and a column for each letter, of the given kind (number, text or bool)."""
    from pyspark.sql import functions as F

    at = {l: g.col_number(l) for l in letters}
    pick = {"number": "number", "text": "text", "bool": "bool"}
    cols = [F.first(F.when(F.col("col") == n, F.col(pick[letters[l]])), True).alias(l) for l, n in at.items()]
    return cells.groupBy(F.col("row").cast("long").alias("_row")).agg(*cols)
