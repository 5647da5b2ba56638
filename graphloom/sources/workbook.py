"""Excel workbooks as tables: .xlsx by its own parts (a zip of XML), .xls where pandas finds an engine for it."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"  # fixed value: the namespace of sheets
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"  # fixed value
#: Number formats, by their built-in ids, that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def column_number(place: str) -> int:
    """0 for "A1", 26 for "AA7"."""
    n = 0
    for c in re.match(r"[A-Z]*", place)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def date_of(days: float) -> datetime:
    """A workbook's day number as a date; the calendar has a day too many in 1900."""
    return datetime(1899, 12, 30) + timedelta(days=days) if days >= 60 else datetime(1899, 12, 31) + timedelta(days=days)


class Workbook:
    """The sheets of an .xlsx file: lists of rows, a row a list of None, text, number, truth value or date."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        book = self._xml("xl/workbook.xml")
        self.sheets = {s.get("name"): self._path(targets[s.get(LINK)]) for s in book.iter(MAIN + "sheet")}
        self.texts = ["".join(t.text or "" for t in item.iter(MAIN + "t")) for item in self._xml("xl/sharedStrings.xml").iter(MAIN + "si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, path: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(path))

    def _path(self, target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _date_styles(self) -> set[int]:
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(MAIN + "numFmt")}
        shows = lambda i: i in DATE_FORMATS or bool(re.search("[dmyhs]", own.get(i, ""), re.I))
        formats = styles.find(MAIN + "cellXfs")
        return {k for k, x in enumerate(formats if formats is not None else []) if shows(int(x.get("numFmtId", "0")))}

    def _value(self, cell: ElementTree.Element):
        kind, v = cell.get("t", "n"), cell.find(MAIN + "v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(MAIN + "t"))
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind in ("str", "d"):
            return v.text
        number = float(v.text)
        if int(cell.get("s", "0")) in self.dates:
            return date_of(number)
        return int(number) if number.is_integer() and "." not in v.text and abs(number) < 1 << 53 else number

    def rows(self, sheet: str | int = 0) -> list[list]:
        path = list(self.sheets.values())[sheet] if isinstance(sheet, int) else self.sheets[sheet]
        out: list[list] = []
        for row in self._xml(path).iter(MAIN + "row"):
            while len(out) < int(row.get("r", len(out) + 1)) - 1:  # rows that are left out are empty
                out.append([])
            cells: list = []
            for cell in row.iter(MAIN + "c"):
                at = column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                cells += [None] * (at - len(cells)) + [self._value(cell)]
            out.append(cells)
        return out


def column_type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType()
    if kinds and kinds <= {int, float}:
        return T.DoubleType()
    return T.TimestampType() if kinds == {datetime} else T.StringType()


def read_workbook(spark: SparkSession, path: str, ending: str = "xlsx", sheet_name: str | int = 0, header: int = 0, skiprows: int = 0, **more) -> DataFrame:
    """A sheet as a table: the names are in row ``header`` after skiprows rows; rows without a value go. A workbook is
    one file that an office program holds in memory, and so does the driver."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    if ending == "xls":
        import pandas as pd

        try:
            return spark.createDataFrame(pd.read_excel(io.BytesIO(content), sheet_name=sheet_name, header=header, skiprows=skiprows, **more))
        except ImportError as e:
            raise ValueError("files of the old format (.xls) need an engine that pandas knows; .xlsx needs none") from e
    if more:
        raise ValueError(f"unknown options: {', '.join(more)}")
    rows = Workbook(content).rows(sheet_name)[skiprows:]
    if len(rows) <= header:
        raise ValueError(f"{path} has no row of names")
    names: list[str] = []
    for i, name in enumerate(rows[header]):
        name = str(name) if name is not None else f"Unnamed: {i}"
        names.append(name if name not in names else f"{name}.{sum(n == name or n.startswith(name + '.') for n in names)}")
    body = [(r + [None] * len(names))[: len(names)] for r in rows[header + 1 :] if any(v is not None for v in r)]
    kinds = [column_type([r[i] for r in body]) for i in range(len(names))]
    fit = lambda v, k: None if v is None else str(v) if isinstance(k, T.StringType) else float(v) if isinstance(k, T.DoubleType) else v
    return spark.createDataFrame([tuple(fit(v, k) for v, k in zip(r, kinds)) for r in body], T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
