"""Writes the raw sales of the given tables as real files: CSV, xlsx and an unsupported kind."""

from __future__ import annotations

import csv
import datetime as dt
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.uris import filesystem_of

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def _cell(text) -> str:
    if text is None or text != text:
        return "<c/>"
    try:
        serial = (dt.datetime.strptime(text, "%Y-%m-%d") - dt.datetime(1899, 12, 30)).days
        return f'<c s="1"><v>{serial}</v></c>'
    except ValueError:
        pass
    try:
        return f"<c><v>{float(text)!r}</v></c>"
    except ValueError:
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A minimal xlsx file; cells that look like a date or a number are stored as such."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)
        )
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(
            f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG}/relationships">{rels}</Relationships>')
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{_NS}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(_cell(v) for v in row)}</row>" for row in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_NS}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _csv(rows: list[list]) -> bytes:
    out = io.StringIO()
    csv.writer(out).writerows([["" if v is None or v != v else v for v in row] for row in rows])
    return out.getvalue().encode()


def write_named(rows: DataFrame, root: str, name: str) -> int:
    """One CSV file of the given name for each folder in ``carpeta``; returns how many. Spark's writer names files itself."""
    columns = [c for c in rows.columns if c != "carpeta"]

    def write(part: pd.DataFrame) -> pd.DataFrame:
        filesystem, folder = filesystem_of(f"{root}/{part['carpeta'].iloc[0]}")
        filesystem.create_dir(folder, recursive=True)
        with filesystem.open_output_stream(f"{folder}/{name}") as stream:
            stream.write(_csv([columns, *map(list, zip(*(part[c] for c in columns)))]))
        return pd.DataFrame({"n": [1]})

    texts = rows.select("carpeta", *(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
    return texts.groupBy("carpeta").applyInPandas(write, "n int").count()


def write_empty(rows: DataFrame, root: str, name: str) -> int:
    """One file without a single byte for each folder in ``carpeta``; returns how many."""

    def write(batches):
        for batch in batches:
            for inner in batch["carpeta"]:
                filesystem, folder = filesystem_of(f"{root}/{inner}")
                filesystem.create_dir(folder, recursive=True)
                with filesystem.open_output_stream(f"{folder}/{name}"):
                    pass
            yield pd.DataFrame({"n": [1] * len(batch)})

    return rows.select("carpeta").distinct().mapInPandas(write, "n int").count()


def write_inbox(raw: DataFrame, root: str) -> int:
    """One file per ``source_file``; returns how many.

    Suppliers differ in column order, and those divisible by 20 omit the quantity.
    """

    def write(part: pd.DataFrame) -> pd.DataFrame:
        name, supplier = part["source_file"].iloc[0], int(part["proveedor"].iloc[0])
        columns = {"SKU": "sku_raw", "Fecha Venta": "fecha_raw", "Cantidad": "cantidad_raw", "Nota": None}
        order = ["SKU", "Fecha Venta", "Cantidad", "Nota"]
        if supplier % 4 == 0:
            order = ["Nota", "Cantidad", "SKU", "Fecha Venta"]
        if supplier % 20 == 0:
            order.remove("Cantidad")
        values = [part[columns[c]] if columns[c] else pd.Series(['una "nota", larga'] * len(part)) for c in order]
        rows = [order, *map(list, zip(*values))]
        data = workbook({"Resumen": [["x"]], "Detalle": rows}) if name.endswith(".xlsx") else _csv(rows)
        filesystem, folder = filesystem_of(root)
        filesystem.create_dir(folder, recursive=True)
        with filesystem.open_output_stream(f"{folder}/{name}") as stream:
            stream.write(data)
        return pd.DataFrame({"n": [1]})

    return raw.groupBy("source_file").applyInPandas(write, "n int").count()
