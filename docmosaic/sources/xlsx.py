"""Workbook source: rows of the first sheet that is not a read-me, as a Spark data source.

Each workbook is one input partition. The first row names the columns; a blank
name becomes ``col_<n>``. Values are strings; rows without a value are skipped.
"""

from __future__ import annotations

import glob
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(path: str) -> Iterator[list[str | None]]:
    """Rows of the first sheet whose name is not ReadMe."""
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_texts(si) for si in root.iter(f"{_MAIN}si")]
        targets = {
            r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        }
        sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        sheet = next((s for s in sheets if s.get("name", "").lower() != "readme"), sheets[0])
        target = targets[sheet.get(_REL)].lstrip("/")
        name = target if target.startswith("xl/") else f"xl/{target}"
        with book.open(name) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for i, c in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    cells.extend([None] * (at + 1 - len(cells)))
                    value = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = _texts(c)
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                row.clear()
                yield cells


def _header(path: str) -> list[str]:
    first = next(sheet_rows(path), [])
    return [str(h) if h is not None else f"col_{i}" for i, h in enumerate(first)]


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str]) -> None:
        self.paths, self.columns = paths, columns

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        rows = sheet_rows(partition.path)
        header = [str(h) if h is not None else f"col_{i}" for i, h in enumerate(next(rows, []))]
        place = {name: i for i, name in enumerate(header)}
        for row in rows:
            if any(v is not None for v in row):
                yield tuple(
                    row[place[c]] if c in place and place[c] < len(row) else None for c in self.columns
                )


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load("/shared/*.xlsx")``"""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _paths(self) -> list[str]:
        return sorted(glob.glob(self.options["path"].removeprefix("file:")))

    def schema(self) -> StructType:
        paths = self._paths()
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return StructType([StructField(c, StringType()) for c in _header(paths[0])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._paths(), schema.fieldNames())


def register(spark) -> None:
    spark.dataSource.register(WorkbookSource)
