"""Many workbooks read in parallel: one task per group of files, rows as text arrays."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.functions.text import clean
from limitlens.sources.tables import ROW_NO, TableError, check_header

# Names of the workbook format.
MAIN_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORKSHEET = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
RAW_SCHEMA = "file string, sheet string, row_no long, cells array<string>, head array<string>, is_head boolean"


def read_workbooks(
    spark: SparkSession, path: str, sheet: str | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Non-empty rows of the chosen or first sheet of every workbook below ``path``.

    Each row carries the first row of its sheet as ``head``, so no join is needed to name
    its cells.
    ``max_bytes`` leaves out larger files; by default none is left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                found = list(sheet_rows(bytes(content), sheet))
                rows = [(name, *row, found[0][2], i == 0) for i, row in enumerate(found)]
                yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells", "head", "is_head"])

    return files.select("path", "content").mapInPandas(parse, RAW_SCHEMA)


def read_workbook_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows as a table; the first row of each workbook is its header.

    All workbooks must share one header; another one stops the job.
    """
    raw = read_workbooks(spark, path, sheet)
    first = raw.filter("is_head").select("head").first()
    if first is None:
        raise TableError("no workbook with a header")
    names = list(first["head"])
    while names and not names[-1].strip():
        names.pop()
    names = check_header(names)
    same = F.transform(F.slice("head", 1, len(names)), lambda c: clean(c)) == F.array(*[F.lit(n) for n in names])
    other = F.raise_error(F.concat(F.lit("other header in "), F.col("file"))).cast("boolean")
    rows = raw.filter(F.when(same, ~F.col("is_head")).otherwise(other))
    return rows.select(
        *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)],
        F.struct("file", "row_no").alias(ROW_NO),
    )


def sheet_rows(content: bytes, wanted: str | None) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of one workbook's rows that hold any text."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as error:
        raise TableError(f"not a workbook: {error}") from error
    with archive:
        title, target = _sheet_part(archive, wanted)
        strings = _shared_strings(archive)
        for row in _xml(archive, target).iter(MAIN_NS + "row"):
            cells: list[str] = []
            for cell in row.findall(MAIN_NS + "c"):
                column = _column_number(cell.get("r") or "")
                cells.extend([""] * (column - len(cells)))
                cells[column - 1] = _cell_text(cell, strings)
            if any(c.strip() for c in cells):
                yield title, int(row.get("r") or 0), cells


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        data = archive.read(name)
    except KeyError as error:
        raise TableError(f"workbook part missing: {name}") from error
    if b"<!DOCTYPE" in data:
        raise TableError(f"workbook part declares a document type: {name}")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as error:
        raise TableError(f"workbook part unreadable: {name}") from error


def _sheet_part(archive: zipfile.ZipFile, wanted: str | None) -> tuple[str, str]:
    sheets = _xml(archive, "xl/workbook.xml").findall(f"{MAIN_NS}sheets/{MAIN_NS}sheet")
    chosen = next((s for s in sheets if wanted in (None, s.get("name"))), None)
    if chosen is None:
        raise TableError(f"no sheet {wanted or ''}".rstrip())
    links = _xml(archive, "xl/_rels/workbook.xml.rels")
    target = next(
        (r.get("Target") or "" for r in links if r.get("Type") == WORKSHEET and r.get("Id") == chosen.get(REL_ID)),
        "",
    ).replace("\\", "/").lstrip("/")
    if not target.lower().startswith("xl/"):
        target = "xl/" + target
    if ".." in target or not target.lower().startswith("xl/worksheets/"):
        raise TableError("the sheet is not a worksheet part")
    return chosen.get("name") or "", target


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    return [_item_text(i) for i in _xml(archive, "xl/sharedStrings.xml").iter(MAIN_NS + "si")]


def _item_text(item: ElementTree.Element) -> str:
    direct = item.find(MAIN_NS + "t")
    if direct is not None:
        return direct.text or ""
    return "".join(t.text or "" for t in item.iter(MAIN_NS + "t"))


def _cell_text(cell: ElementTree.Element, strings: list[str]) -> str:
    kind = cell.get("t")
    value = cell.findtext(MAIN_NS + "v") or ""
    if kind == "inlineStr":
        inline = cell.find(MAIN_NS + "is")
        return "" if inline is None else _item_text(inline)
    if kind == "s":
        if not value.isdigit() or int(value) >= len(strings):
            raise TableError(f"shared string {value!r} does not exist")
        return strings[int(value)]
    return value


def _column_number(reference: str) -> int:
    number = 0
    for ch in reference:
        if not ch.isalpha():
            break
        number = number * 26 + ord(ch.upper()) - ord("A") + 1
    if number == 0:
        raise TableError(f"bad cell reference {reference!r}")
    return number
