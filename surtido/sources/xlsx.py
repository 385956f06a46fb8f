"""Rows of one sheet of an xlsx file, streamed out of its zip with the standard library.

A sheet holds at most 1,048,576 rows, so one file is a bounded unit of work.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that display a date or time.
_DATE_FORMAT_IDS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class MissingSheet(Exception):
    """The workbook has no sheet of the wanted name."""


def _sheet_part(book: zipfile.ZipFile, sheet: str) -> tuple[str, dt.datetime]:
    """Zip member of the sheet, and day 0 of its date serials."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    rel = next((s.get(_REL_ID) for s in root.iter(f"{_MAIN}sheet") if s.get("name") == sheet), None)
    if rel is None:
        raise MissingSheet(sheet)
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == rel)
    part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    setup = root.find(f"{_MAIN}workbookPr")
    mac = setup is not None and setup.get("date1904") in ("1", "true")
    return part, dt.datetime(1904, 1, 1) if mac else dt.datetime(1899, 12, 30)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == f"{_MAIN}si":
                runs = [t for c in node if c.tag != f"{_MAIN}rPh" for t in c.iter(f"{_MAIN}t")]
                strings.append("".join(t.text or "" for t in runs))
                node.clear()
    return strings


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell style numbers that display a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    date_ids = set(_DATE_FORMAT_IDS)
    for fmt in root.iter(f"{_MAIN}numFmt"):
        shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search(r"[dmyhs]", shown, re.IGNORECASE):
            date_ids.add(int(fmt.get("numFmtId")))
    formats = root.find(f"{_MAIN}cellXfs")
    styles = [] if formats is None else list(formats)
    return {i for i, xf in enumerate(styles) if int(xf.get("numFmtId", 0)) in date_ids}


def _column_index(ref: str) -> int:
    index = 0
    for letter in ref:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - 64
    return index - 1


def _cell_text(cell, strings: list[str], dates: set[int], day0: dt.datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.findtext(f"{_MAIN}v")
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind != "n":
        return value
    number = float(value)
    if int(cell.get("s", 0)) in dates:
        return (day0 + dt.timedelta(days=number)).strftime("%Y-%m-%d %H:%M:%S")
    return str(int(number)) if number.is_integer() else repr(number)


def sheet_rows(content: bytes | BinaryIO, sheet: str) -> Iterator[list[str | None]]:
    """Cell texts of every non-empty row, in order; dates as ISO texts. ``content``: the bytes, or a file to seek in."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        part, day0 = _sheet_part(book, sheet)
        strings, dates = _shared_strings(book), _date_styles(book)
        with book.open(part) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for place, cell in enumerate(node.iter(f"{_MAIN}c")):
                    at = _column_index(cell.get("r")) if cell.get("r") else place
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _cell_text(cell, strings, dates, day0)
                node.clear()
                if any(text not in (None, "") for text in row):
                    yield row
