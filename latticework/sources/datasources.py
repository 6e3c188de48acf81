"""Python data sources: SQLite tables and XLSX sheets, with the standard library alone.

Register with register(spark). Each names one local file that the tasks can open (on a cluster, a shared mount); a
table or sheet is one partition, as both formats are read from front to back.
"""

from __future__ import annotations

import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(path: str) -> str:
    return re.sub("^file:/+", "/", path)


class SqliteSource(DataSource):
    """Options: path, table. All columns are read as strings."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{_local(self.options['path'])}?mode=ro", uri=True) as db:
            names = [r[1] for r in db.execute(f'PRAGMA table_info("{self.options["table"]}")')]
        if not names:
            raise ValueError(f"no table {self.options['table']!r}")
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"])


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{_local(self.path)}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT * FROM "{self.table}"'):
                yield tuple(None if v is None else str(v) for v in row)


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{_local(path)}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(_local(path)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS)]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet (the first by default) as strings; inline and shared strings, numbers as they are written."""
    with zipfile.ZipFile(_local(path)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = {s.get("name"): s.get(_REL) for s in book.iterfind(".//m:sheet", _NS)}
        name = sheet or next(iter(sheets))
        if name not in sheets:
            raise ValueError(f"no sheet {name!r}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        target = links[sheets[name]].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as body:
            for _, row in ElementTree.iterparse(body):
                if not row.tag.endswith("}row"):
                    continue
                cells: dict[int, str | None] = {}
                for k, c in enumerate(row.iterfind("m:c", _NS)):
                    v, kind = c.find("m:v", _NS), c.get("t")
                    text = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS)) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                    cells[_column(c.get("r")) if c.get("r") else k] = text
                yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]
                row.clear()


def header_row(path: str, sheet: str | None, pattern: str) -> int:
    """The first row with a cell that matches."""
    for k, row in enumerate(sheet_rows(path, sheet)):
        if any(v is not None and re.search(pattern, v) for v in row):
            return k
    raise ValueError(f"no row of {path} matches {pattern!r}")


class XlsxSource(DataSource):
    """Options: path, sheet (the first by default), header (a pattern that a cell of the header row matches; the first row by default;
    "none" if there is no such row: columns are then x1, x2, ... and all rows are data)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_sheet"

    def _start(self) -> int:
        pattern = self.options.get("header")
        if pattern == "none":
            return -1
        return header_row(self.options["path"], self.options.get("sheet"), pattern) if pattern else 0

    def schema(self) -> str:
        from ..functions.text import snake_names

        start = self._start()
        if start < 0:
            width = max((len(r) for r in sheet_rows(self.options["path"], self.options.get("sheet"))), default=0)
            return ", ".join(f"x{k} string" for k in range(1, max(width, 1) + 1))
        head = next((r for k, r in enumerate(sheet_rows(self.options["path"], self.options.get("sheet"))) if k == start), [])
        return ", ".join(f"`{n}` string" for n in snake_names([h or "" for h in head])) or "x string"

    def reader(self, schema) -> DataSourceReader:
        return _XlsxReader(self.options["path"], self.options.get("sheet"), self._start(), len(schema.fields))


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, start: int, width: int):
        self.path, self.sheet, self.start, self.width = path, sheet, start, width

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k, row in enumerate(sheet_rows(self.path, self.sheet)):
            if k > self.start:
                yield tuple((row + [None] * self.width)[: self.width])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(XlsxSource)


#: The tables of the skills database.
SKILL_TABLES = [
    "Skill", "SkillLevel", "Level", "Attribute", "AttributeType", "AttributeLevel", "RelatedSkill", "SkillsProfile", "SkillsProfileFamily",
    "SkillsProfileJobTitle", "SkillsProfileSkill",
]


def skill_tables(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The database's tables by name, all columns as strings; one that is missing is an error."""
    register(spark)
    return {t: spark.read.format("sqlite_table").options(path=path, table=t).load() for t in tables or SKILL_TABLES}


def role_rows(spark: SparkSession, path: str, pattern: str = r"\(([A-Z]{2}-\d{3})\)") -> DataFrame:
    """role_code, role_sheet and all rows, as they are, of every sheet whose name has a role's code; ragged sheets have nulls."""
    register(spark)
    from pyspark.sql import functions as F

    found = None
    for sheet in sheet_names(path):
        m = re.search(pattern, sheet)
        if m:
            df = spark.read.format("xlsx_sheet").options(path=path, sheet=sheet, header="none").load()
            df = df.select(F.lit(m[1]).alias("role_code"), F.lit(sheet).alias("role_sheet"), "*")
            found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    if found is None:
        raise ValueError(f"no sheet of {path} matches {pattern!r}")
    return found


def sheets_union(spark: SparkSession, path: str, pattern: str, header: str, name: str = "sheet_code") -> DataFrame:
    """All sheets whose name matches, with ragged columns, and the pattern's first group in a column."""
    register(spark)
    from pyspark.sql import functions as F

    found = None
    for sheet in sheet_names(path):
        m = re.search(pattern, sheet)
        if not m:
            continue
        df = spark.read.format("xlsx_sheet").options(path=path, sheet=sheet, header=header).load().withColumn(name, F.lit(m[1] if m.groups() else m[0]))
        found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    if found is None:
        raise ValueError(f"no sheet of {path} matches {pattern!r}")
    return found
