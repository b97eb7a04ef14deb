"""Workbooks (xlsx) as a Spark data source, over zip and XML of the standard library.

Reading: a task takes a range of rows of one sheet and streams through its XML; every cell is text, as the review stages want it. Sheets
that are read together have the union of their columns, and a column `sheet`.

    spark.read.format("workbook").option("sheets", '["review_all", "top500"]').load("/shared/review.xlsx")

Writing: tasks write the rows of their partitions as compressed XML beside the target; the driver joins these in the partitions' order,
which a sheet's own limit bounds (1,048,576 rows), and puts the workbook in place at once. A sheet has a frozen head, filters, and
columns as wide as their first 200 cells (8 to 58 characters, and two). More rows than fit, or cells of over 32,767 characters, are
refused, not cut. With mode append a sheet is added to a workbook that this source wrote.

    df.write.format("workbook").mode("overwrite").option("sheet", "review_all").save("/shared/review.xlsx")

The path is one that the driver and all executors see as a file. Defined results: a cell that is absent, an error or empty is the empty string;
numbers are written as Python writes them, whole ones without a point; columns without a name are _c and their place, and names that
occur again have their place at the end; rows without any cell are left out.
"""

from __future__ import annotations

import gzip
import json
import math
import os
import re
import shutil
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

#: Limits of the format, and of the widths of columns.
MOST_ROWS, MOST_CHARACTERS, SAMPLED, LEAST_WIDTH, MARGIN, MOST_WIDTH = 1_048_576, 32_767, 200, 8, 2, 60
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def local(path: str) -> str:
    """A path as the file system has it."""
    found = re.match(r"(?:file:/*(?=/))?(/.*|[^:]*)$", path)
    if not found:
        raise ValueError(f"a workbook is read and written by a file's path, not by {path}")
    return found[1]


# Reading ----------------------------------------------------------------------------------------


def members(book: zipfile.ZipFile) -> dict[str, str]:
    """The part of each sheet, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {s.get("name", ""): place(targets[s.get(f"{_REL}id")]) for s in sheets}


def _plain(text: str) -> str:
    """Characters that XML can't hold are written _xHHHH_."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _text(element: ElementTree.Element) -> str:
    """What a string says, its runs joined; how it is pronounced is left out."""
    runs = [e for e in element if e.tag in (f"{_MAIN}t", f"{_MAIN}r")]
    return _plain("".join((e.text or "") if e.tag == f"{_MAIN}t" else "".join(t.text or "" for t in e.iter(f"{_MAIN}t")) for e in runs))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, element in ElementTree.iterparse(part):
            if element.tag == f"{_MAIN}si":
                out.append(_text(element))
                element.clear()
    return out


def _column(reference: str) -> int:
    """Place, from 0, of a cell such as BC12."""
    n = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _number(text: str) -> str:
    try:
        x = float(text)
    except ValueError:
        return text
    if re.fullmatch(r"-?\d+", text):
        return text
    return str(int(x)) if math.isfinite(x) and x == int(x) and abs(x) < 1e15 else repr(x)


def _value(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, inline, held = cell.get("t", "n"), cell.find(f"{_MAIN}is"), cell.find(f"{_MAIN}v")
    if inline is not None:
        return _text(inline)
    said = held.text or "" if held is not None else ""
    if kind == "s":
        return shared[int(said)]
    if kind == "b":
        return "True" if said == "1" else "False"
    return {"e": "", "str": _plain(said)}.get(kind, _number(said) if said else "")


def cells(book: zipfile.ZipFile, member: str, shared: list[str], first: int = 1, last: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of the rows first to last of a sheet; what comes after is not read."""
    at = 0
    with book.open(member) as part:
        parent = None
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                parent = element if element.tag == f"{_MAIN}sheetData" else parent
                continue
            if element.tag != f"{_MAIN}row":
                continue
            at = int(element.get("r") or at + 1)
            if last is not None and at > last:
                return
            if at >= first:
                out: list[str] = []
                for cell in element:
                    place = _column(cell.get("r", "")) if cell.get("r") else len(out)
                    out += [""] * (place + 1 - len(out))
                    out[place] = _value(cell, shared)
                if any(out):
                    yield at, out
            parent.clear()  # rows that were seen are let go


def size_of(book: zipfile.ZipFile, member: str) -> int | None:
    """Number of the last row by the sheet's own account, if it gives one."""
    with book.open(member) as part:
        found = re.search(rb'<dimension[^>]*ref="[A-Z]+\d+:[A-Z]+(\d+)"', part.read(4096))
    return int(found[1]) if found else None


def named(header: list[str]) -> list[str]:
    often = Counter(c.lower() for c in header)
    return [f"_c{k}" if not c else f"{c}{k}" if often[c.lower()] > 1 else c for k, c in enumerate(header)]


@dataclass
class Rows(InputPartition):
    sheet: str
    member: str
    first: int
    last: int | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str] | None, names: list[str], step: int) -> None:
        self.path, self.wanted, self.names, self.step = path, wanted, names, step

    def partitions(self) -> list[Rows]:
        out = []
        with zipfile.ZipFile(self.path) as book:
            for sheet, member in chosen(book, self.wanted).items():
                last = size_of(book, member) or 1
                starts = list(range(1, last + 1, self.step))
                # the last range has no end, so that rows that the sheet did not count are read too
                out += [Rows(sheet, member, a, b - 1 if b else None) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in self.names])
        with zipfile.ZipFile(self.path) as book:
            shared = shared_strings(book)
            head = next(cells(book, partition.member, shared), None)
            if head is None:
                return
            places = {n: k for k, n in enumerate(named(head[1]))}
            kept: list[list[str]] = []
            for at, row in cells(book, partition.member, shared, partition.first, partition.last):
                if at > head[0]:
                    kept.append([partition.sheet if n == "sheet" else row[places[n]] if places.get(n, len(row)) < len(row) else "" for n in self.names])
                if len(kept) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*kept, strict=True)], schema=schema)
                    kept = []
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*kept, strict=True)], schema=schema)


def chosen(book: zipfile.ZipFile, wanted: list[str] | None) -> dict[str, str]:
    there = members(book)
    missing = [s for s in wanted or [] if s not in there]
    if missing:
        raise ValueError(f"no sheet {missing[0]!r} among {list(there)}")
    return {s: there[s] for s in (wanted or there)}


# Writing ----------------------------------------------------------------------------------------


def _letters(n: int) -> str:
    """Name of the column at a place from 0."""
    out = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _xml_text(x: str) -> str:
    guarded = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", x)
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\r￾￿\ud800-\udfff]", lambda m: f"_x{ord(m[0]):04X}_", guarded))


def _cell(x: object) -> tuple[str, int]:
    """(XML, shown length) of a cell."""
    if x is None or x == "":
        return "<c/>", 0
    if isinstance(x, bool):
        return f'<c t="b"><v>{int(x)}</v></c>', 5
    if (isinstance(x, int) and abs(x) < 1 << 53) or (isinstance(x, float) and math.isfinite(x)):
        return f"<c><v>{x!r}</v></c>", len(repr(x))
    text = x if isinstance(x, str) else format(x, "f") if isinstance(x, Decimal) else str(x)
    if len(text) > MOST_CHARACTERS:
        raise ValueError(f"a cell has {len(text)} characters, more than the {MOST_CHARACTERS} that a sheet's cell holds")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_xml_text(text)}</t></is></c>', len(text)


def _row(values: list[object]) -> tuple[str, list[int]]:
    made = [_cell(x) for x in values]
    return "<row>" + "".join(x for x, _ in made) + "</row>", [n for _, n in made]


@dataclass
class Part(WriterCommitMessage):
    task: int
    file: str
    rows: int
    sizes: list[list[int]]  # shown lengths of the first rows' cells


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, sheet: str, names: list[str], overwrite: bool, most: int) -> None:
        self.path, self.sheet, self.names, self.overwrite, self.most = path, sheet, names, overwrite, most
        self.folder = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        file, rows, sizes = f"{self.folder}/{task.partitionId()}-{task.taskAttemptId()}.gz", 0, []
        with gzip.open(file, "wt", encoding="utf-8", compresslevel=3) as out:
            for batch in iterator:
                for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    line, shown = _row(list(values))
                    out.write(line)
                    rows += 1
                    if len(sizes) < SAMPLED - 1:
                        sizes.append(shown)
        return Part(task.partitionId(), file, rows, sizes)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        rows = sum(m.rows for m in parts)
        try:
            if rows > self.most:
                raise ValueError(f"{self.sheet} has {rows} rows, over {self.most} rows; write it as Parquet or CSV")
            shown = [[len(n) for n in self.names], *[s for m in parts for s in m.sizes][: SAMPLED - 1]]
            widths = [min(max([*column, LEAST_WIDTH]) + MARGIN, MOST_WIDTH) for column in zip(*shown, strict=True)]
            made = f"{self.folder}.xlsx"
            before = [] if self.overwrite or not os.path.exists(self.path) else self._before()
            with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as book:
                sheets = [n for n, _ in before] + [self.sheet]
                for k, (_, member) in enumerate(before, 1):
                    with zipfile.ZipFile(self.path) as old, old.open(member) as given, book.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as out:
                        shutil.copyfileobj(given, out, 1 << 20)
                with book.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True) as out:
                    self._sheet(out, parts, rows, widths)
                for name, text in _frame(sheets).items():
                    book.writestr(name, text)
            os.replace(made, self.path)
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def _before(self) -> list[tuple[str, str]]:
        with zipfile.ZipFile(self.path) as book:
            there = members(book)
            if any(n in book.namelist() for n in ("xl/sharedStrings.xml", "xl/styles.xml")):
                raise ValueError(f"{self.path} was written by another program; a sheet can't be added to it")
        if self.sheet in there:
            raise ValueError(f"{self.path} has a sheet {self.sheet!r} already")
        return list(there.items())

    def _sheet(self, out, parts: list[Part], rows: int, widths: list[int]) -> None:
        last = f"{_letters(len(self.names) - 1)}{rows + 1}"
        columns = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
        out.write(
            f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><dimension ref="A1:{last}"/><sheetViews><sheetView workbookViewId="0">'
            f'<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData>{_row(self.names)[0]}'.encode()
        )
        for part in parts:
            with gzip.open(part.file, "rb") as given:
                shutil.copyfileobj(given, out, 1 << 20)
        out.write(f'</sheetData><autoFilter ref="A1:{last}"/></worksheet>'.encode())


def _frame(sheets: list[str]) -> dict[str, str]:
    """The parts of a workbook beside its sheets."""
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    office, package = _REL[1:-1], _PACKAGE[1:-1]
    numbered = list(enumerate(sheets, 1))
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}.worksheet+xml"/>' for k, _ in numbered)
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in numbered)
    links = "".join(f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in numbered)
    types = "http://schemas.openxmlformats.org/package/2006/content-types"
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{overrides}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}">{links}</Relationships>',
    }


class Workbook(DataSource):
    """Options: sheets (a JSON list, all if absent) and rowsPerPartition to read; sheet and mostRows to write."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _wanted(self) -> list[str] | None:
        return json.loads(self.options["sheets"]) if self.options.get("sheets") else None

    def schema(self) -> StructType:
        found: dict[str, None] = {}
        with zipfile.ZipFile(local(self.options["path"])) as book:
            shared = shared_strings(book)
            for member in chosen(book, self._wanted()).values():
                head = next(cells(book, member, shared), (0, []))[1]
                found |= dict.fromkeys(named(head))
        out = StructType()
        for n in [*(n for n in found if n != "sheet"), "sheet"]:
            out = out.add(n, StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(local(self.options["path"]), self._wanted(), schema.names, int(self.options.get("rowsPerPartition", 50_000)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(local(self.options["path"]), self.options.get("sheet", "data"), schema.names, overwrite, min(int(self.options.get("mostRows", MOST_ROWS - 1)), MOST_ROWS - 1))


def read_excel(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """Named sheets of a workbook, or all, as strings with a sheet column."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    return (reader.option("sheets", json.dumps(sheets)) if sheets else reader).load(path)


def write_excel(sheets: dict[str, DataFrame], path: str, most_rows: int = MOST_ROWS - 1, review: tuple[str, ...] = ()) -> None:
    """Tables as sheets of one workbook, with empty columns for the reviewer; a table with more rows is refused, not cut."""
    for k, (name, df) in enumerate(sheets.items()):
        df.sparkSession.dataSource.register(Workbook)
        given = df.select("*", *[F.lit("").alias(c) for c in review if c not in df.columns])
        given.write.format("workbook").mode("append" if k else "overwrite").option("sheet", name).option("mostRows", most_rows).save(path)
