"""Reading real files: orders of columns, damaged files, workbooks, repeated batches."""

import datetime as dt
import io
import os
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from surtido import schemas
from surtido.checks.inbox import workbook, write_named
from surtido.fixed_values import (
    DAY_FIRST_FORMATS,
    MSG_BAD_FORMAT,
    MSG_EMPTY_FILE,
    MSG_LONG_HEADER,
    MSG_MISSING_COLUMNS,
    MSG_NO_SHEET,
    MSG_NO_VALID_ROWS,
    MSG_SAVED,
    MSG_UNDECIDED,
    MSG_UNREADABLE,
)
from surtido.session import materialize, temporary_results
from surtido.plans.ingest import check_files, ingest_files
from surtido.sources import sales_files
from surtido.sources.snapshots import read_snapshot
from surtido.sources.tables import append_sales, read_sales
from surtido.sources.uris import filesystem_of
from surtido.sources.xlsx import sheet_rows
from surtido.streaming.sales_stream import start_ingest

NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HEADER = ["SKU", "Fecha Venta", "Cantidad"]


@pytest.fixture
def inbox(tmp_path):
    root = tmp_path / "entrada con espacio"
    (root / "sub").mkdir(parents=True)
    (root / "uno.csv").write_text("SKU,Fecha Venta,Cantidad\nA,2021-01-05,3\n,2021-01-05,3\n")
    (root / "dos ñ.csv").write_text('Cantidad,"Nota, larga",SKU,Fecha Venta\n4,"x ""y"", z",B,2021-01-06\n', "utf-8-sig")
    (root / "sub" / "TRES.CSV").write_text("\nSKU,Fecha Venta,Cantidad\r\nC,2021-01-07,5\r\nC,2021-01-08\r\n")
    (root / "sin_columna.csv").write_text("SKU,Fecha Venta\nA,2021-01-05\n")
    (root / "vacio.csv").write_text("\n\n")
    (root / "cero.csv").write_text("")
    (root / "solo_titulo.csv").write_text("SKU,Fecha Venta,Cantidad\n")
    (root / "sin_final.csv").write_text("SKU,Fecha Venta,Cantidad\nG,2021-01-09,1")
    (root / "todo_malo.csv").write_text("SKU,Fecha Venta,Cantidad\nA,abc,3\n")
    (root / "nota.txt").write_text("SKU,Fecha Venta,Cantidad\nA,2021-01-05,3\n")
    (root / "bien.xlsx").write_bytes(workbook({
        "Otra": [["x"]], "Detalle": [["Nota", *HEADER], [None, "D", "2021-01-05", "2.7"], ["n", "E", "abc", "1"]],
    }))
    (root / "sin_hoja.xlsx").write_bytes(workbook({"Otra": [HEADER, ["A", "2021-01-05", "1"]]}))
    (root / "hoja_vacia.xlsx").write_bytes(workbook({"Detalle": []}))
    (root / "roto.xlsx").write_bytes(b"no es un zip")
    (root / "viejo.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    return root


def test_mixed_inbox(spark, inbox):
    got = check_files(spark, str(inbox))
    def name(path):
        assert path.startswith("file:///")
        return path.rsplit("/", 1)[1]

    valid = {(name(r.source_file), r.id_producto, str(r.fecha), r.cantidad_vendida) for r in got.valid.collect()}
    assert valid == {
        ("uno.csv", "A", "2021-01-05", 3), ("dos ñ.csv", "B", "2021-01-06", 4),
        ("TRES.CSV", "C", "2021-01-07", 5), ("sin_final.csv", "G", "2021-01-09", 1),
        ("bien.xlsx", "D", "2021-01-05", 2),
    }
    outcomes = {r.nombre_archivo: r for r in got.outcomes.collect()}
    assert len(outcomes) == 15
    assert {n for n, r in outcomes.items() if r.estado == "valido"} == {r[0] for r in valid}
    messages = {n: r.mensaje for n, r in outcomes.items()}
    assert messages["cero.csv"] == messages["vacio.csv"] == messages["solo_titulo.csv"] == messages["hoja_vacia.xlsx"] == MSG_EMPTY_FILE
    assert messages["sin_columna.csv"] == MSG_MISSING_COLUMNS + "Cantidad"
    assert messages["todo_malo.csv"] == MSG_NO_VALID_ROWS
    assert messages["nota.txt"] == MSG_BAD_FORMAT
    assert messages["sin_hoja.xlsx"] == MSG_NO_SHEET
    assert messages["roto.xlsx"].startswith(MSG_UNREADABLE) and messages["viejo.xls"].startswith(MSG_UNREADABLE)
    reasons = {(name(r.source_file), r.motivo) for r in got.rejected.collect()}
    assert reasons == {
        ("uno.csv", "sku"), ("TRES.CSV", "cantidad"), ("todo_malo.csv", "fecha"), ("bien.xlsx", "fecha"),
    }


def test_only_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"Detalle": [HEADER, ["A", "2021-01-05", "1"]]}))
    assert check_files(spark, str(tmp_path)).valid.count() == 1


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Nota,SKU,Fecha Venta,Cantidad\n"dos\nlineas",A,2021-01-05,1\n')
    got = check_files(spark, str(tmp_path), multiline=True).valid.collect()
    assert [(r.id_producto, r.cantidad_vendida) for r in got] == [("A", 1)]


def test_sheet_cells():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><workbookPr date1904="1"/><sheets>'
                   '<sheet name="Detalle" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships><Relationship Id="r1" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><r><t>So</t></r><r><t>la</t></r><rPh><t>x</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/>'
                   '<numFmt numFmtId="165" formatCode="0.0 &quot;dia&quot;"/></numFmts><cellXfs><xf numFmtId="0"/>'
                   '<xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="B1" t="s"><v>0</v></c>'
                   '<c r="D1" t="b"><v>1</v></c></row><row/><row><c r="A3" s="1"><v>0.5</v></c>'
                   '<c r="B3" s="2"><v>3</v></c><c r="C3"><v>2.5</v></c><c r="D3" t="e"><v>#N/A</v></c>'
                   '<c r="AA3" t="str"><v>f</v></c></row></sheetData></worksheet>')
    rows = list(sheet_rows(out.getvalue(), "Detalle"))
    assert rows[0] == [None, "Sola", None, "True"]
    assert rows[1][:4] == ["1904-01-01 12:00:00", "3", "2.5", None] and rows[1][26] == "f"


def test_repeated_batch_replaces_itself(spark, inbox, tmp_path):
    sales_path, registry = str(tmp_path / "ventas"), str(tmp_path / "registro")
    for _ in range(2):
        ingest_files(spark, str(inbox), sales_path, registry, 7, NOW)
    ingest_files(spark, str(inbox), sales_path, registry, 8, NOW)
    stored = read_sales(spark, sales_path)
    assert stored.filter("batch_id = 7").count() == 5 and stored.count() == 10
    files = read_snapshot(spark, registry, schemas.FILES)
    assert files.count() == 30 and files.select("id").distinct().count() == 30
    assert {r.estado for r in files.collect()} == {"valido", "invalido"}


def test_a_batch_with_other_files_is_refused_and_sources_stay_apart(spark, inbox, tmp_path):
    sales_path, registry = str(tmp_path / "ventas"), str(tmp_path / "registro")
    ingest_files(spark, str(inbox / "uno.csv"), sales_path, registry, 1, NOW)
    with pytest.raises(ValueError, match="lote 1"):
        ingest_files(spark, str(inbox / "dos ñ.csv"), sales_path, registry, 1, NOW)
    rows = ingest_files(spark, str(inbox / "dos ñ.csv"), sales_path, registry, 1, NOW, origin="otro")
    assert [r.nombre_archivo for r in rows.collect()] == ["dos ñ.csv"]
    assert {r.id_producto for r in read_sales(spark, sales_path).collect()} == {"A", "B"}


def test_files_of_one_name_are_two_files(spark, tmp_path):
    for day, columns in (("d1", "SKU,Fecha Venta,Cantidad"), ("d2", "SKU,Fecha Venta")):
        (tmp_path / day).mkdir()
        (tmp_path / day / "part-0.csv").write_text(f"{columns}\nA,2021-01-05,3\nB,2021-01-05,3\n")
    got = check_files(spark, str(tmp_path))
    assert got.valid.count() == 2
    assert sorted((r.nombre_archivo, r.estado) for r in got.outcomes.collect()) == [
        ("part-0.csv", "invalido"), ("part-0.csv", "valido")]


def test_a_failing_store_raises(spark, inbox, monkeypatch):
    def broken(path, opened):
        raise OSError("almacén caído")

    monkeypatch.setattr(sales_files, "_first_line", broken)
    with pytest.raises(Exception, match="almacén caído"):
        check_files(spark, str(inbox)).valid.count()


def test_a_file_without_a_line_end_is_reported_after_its_first_bytes(spark, tmp_path, monkeypatch):
    (tmp_path / "bien.csv").write_text("SKU,Fecha Venta,Cantidad\nA,2021-01-05,3\n")
    with open(tmp_path / "larga.csv", "wb") as f:
        f.truncate(1 << 28)  # zero bytes, no line end
    with open(tmp_path / "titulo.csv", "w") as f:
        f.write("SKU,Fecha Venta,Cantidad\nB,2021-01-05,3\n" + "x" * (20 << 20) + "\nC,2021-01-05,3\n")
    read = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return b"x" * n

    class Store:
        def open_input_stream(self, _):
            return Counting()

    with pytest.raises(sales_files.LongHeader):
        monkeypatch.setattr(sales_files, "filesystem_of", lambda *_: (Store(), ""))
        sales_files._first_line("x", {})
    assert sum(read) == sales_files.HEADER_BYTES
    monkeypatch.undo()
    got = check_files(spark, str(tmp_path))
    assert {r.id_producto for r in got.valid.collect()} == {"A", "B", "C"}
    outcomes = {r.nombre_archivo: r.mensaje for r in got.outcomes.collect()}
    assert outcomes["larga.csv"] == MSG_LONG_HEADER % sales_files.HEADER_BYTES


def test_header_lines(tmp_path):
    def first(data):
        (tmp_path / "a.csv").write_bytes(data)
        return sales_files._first_line(f"file://{tmp_path}/a.csv", {})

    assert first(b"") == "" and first(b"\n\r\n  \n") == "" and first(b"\xef\xbb\xbf") == ""
    assert first(b"\n \r\na,b\r\nc") == "a,b" and first(b"a,b") == "a,b"
    assert first(b"\xef\xbb\xbfa\n") == "a" and first(b"\n" * 200_000 + b"z\n") == "z"
    assert first(b"q" * 100_000 + b"\n1") == "q" * 100_000


def test_listing_is_by_tasks_and_whole(spark, tmp_path):
    for name in ("a.csv", "x/y/b.CSV", "x/c.xlsx", "x/_SUCCESS", ".oculto/d.csv", "x/con espacio %41/e [1].csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name.endswith("xlsx") else "z")
    rows = {r.source_file.removeprefix(f"file://{tmp_path}/"): (r.ending, r.vacio) for r in sales_files.list_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.csv": ("csv", False), "x/y/b.CSV": ("csv", False), "x/c.xlsx": ("xlsx", True),
                    "x/con espacio %41/e [1].csv": ("csv", False)}
    some = sales_files.list_files(spark, [f"{tmp_path}/x/*.xlsx", f"{tmp_path}/a.csv"]).collect()
    assert len(some) == 2
    with pytest.raises(FileNotFoundError):
        sales_files.list_files(spark, str(tmp_path / "nada"))
    assert sales_files.hadoop_uri("file:///a b/ñ%[x].csv") == "file:/a%20b/ñ%25%5Bx%5D.csv"


def test_workbooks_are_read_by_ranges(spark, tmp_path):
    """A workbook with a large part that nobody needs; the binary reader would refuse it below its limit."""
    content = io.BytesIO(workbook({"Detalle": [HEADER, ["A", "2021-01-05", "1"]]}))
    with zipfile.ZipFile(content, "a") as z:
        z.writestr("xl/media/foto.bin", os.urandom(30 << 20))
    (tmp_path / "grande.xlsx").write_bytes(content.getvalue())
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1 << 20)
    try:
        got = check_files(spark, str(tmp_path))
        assert [r.id_producto for r in got.valid.collect()] == ["A"]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)

    seen = []

    class Ranged(io.BytesIO):
        def read(self, n=-1):
            data = super().read(n)
            seen.append(len(data))
            return data

    assert len(list(sheet_rows(Ranged(content.getvalue()), "Detalle"))) == 2
    assert sum(seen) < 1 << 20


def test_day_first_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SKU,Fecha Venta,Cantidad\nA,05/01/2021,1\nB,31/01/2021,1\n")
    got = check_files(spark, str(tmp_path), formats=DAY_FIRST_FORMATS).valid
    assert sorted(str(r.fecha) for r in got.collect()) == ["2021-01-05", "2021-01-31"]


def test_each_file_has_its_own_order_of_day_and_month(spark, tmp_path):
    head = "SKU,Fecha Venta,Cantidad\n"
    (tmp_path / "dia.csv").write_text(head + "A,05/01/2021,1\nB,31/01/2021 10:00,1\nC,2021-02-03,1\nD,28-02-2021,1\n")
    (tmp_path / "mes.csv").write_text(head + "A,05/01/2021,1\nB,01/31/2021,1\nC,7/7/2021,1\n")
    (tmp_path / "mezcla.csv").write_text(head + "A,05/01/2021,1\nB,13/01/2021,1\nC,14/01/2021,1\nD,01/15/2021,1\n")
    (tmp_path / "nada.csv").write_text(head + "A,05/01/2021,1\nB,06/01/2021 1:05 pm,1\nC,99/99/2021,1\nD,08/08/2021,1\n")
    (tmp_path / "libro.xlsx").write_bytes(workbook({"Detalle": [HEADER, ["A", "05/01/2021", "1"], ["B", "30/01/2021", "1"]]}))
    got = check_files(spark, str(tmp_path))
    dates = {(r.source_file.rsplit("/", 1)[1][:-4], r.id_producto): str(r.fecha)[5:] for r in got.valid.collect()}
    assert dates == {
        ("dia", "A"): "01-05", ("dia", "B"): "01-31", ("dia", "C"): "02-03", ("dia", "D"): "02-28",
        ("mes", "A"): "05-01", ("mes", "B"): "01-31", ("mes", "C"): "07-07",
        ("mezcla", "A"): "01-05", ("mezcla", "B"): "01-13", ("mezcla", "C"): "01-14", ("mezcla", "D"): "01-15",
        ("nada", "A"): "05-01", ("nada", "B"): "06-01", ("nada", "D"): "08-08",
        ("libro.", "A"): "01-05", ("libro.", "B"): "01-30",
    }
    orders = {r.source_file.rsplit("/", 1)[1]: (r.orden, r.fechas_dia, r.fechas_mes, r.fechas_ambos) for r in got.orders.collect()}
    assert orders == {"dia.csv": ("dia", 2, 0, 1), "mes.csv": ("mes", 0, 1, 1), "mezcla.csv": ("dia", 2, 1, 1),
                      "nada.csv": ("indeciso", 0, 0, 2), "libro.xlsx": ("dia", 1, 0, 1)}
    messages = {r.nombre_archivo: r.mensaje for r in got.outcomes.collect()}
    assert messages["nada.csv"] == MSG_SAVED + MSG_UNDECIDED % 2 and messages["dia.csv"] == MSG_SAVED
    fixed = check_files(spark, str(tmp_path / "dia.csv"), formats=("yyyy-M-d", "M/d/yyyy")).valid.collect()
    assert {str(r.fecha) for r in fixed} == {"2021-05-01", "2021-02-03"}  # one order only: no election


def test_history_filter_reaches_the_scan_and_years_prune(spark, inbox, tmp_path):
    path = str(tmp_path / "ventas")
    append_sales(check_files(spark, str(inbox)).valid, path, 1, NOW)
    plan = read_sales(spark, path).filter("id_producto = 'A' and anio = 2021").select("fecha")
    text = plan._jdf.queryExecution().toString()
    assert "EqualTo(id_producto,A)" in text
    filters = re.search(r"PartitionFilters: \[([^\]]*)", text)[1]
    assert "isnotnull(anio" in filters and re.search(r"\(anio#\d+ = 2021\)", filters)
    assert "ReadSchema: struct<id_producto:string,fecha:date>" in text


def test_stream_takes_each_file_once_and_survives_replay(spark, tmp_path):
    inbox, sales_path, registry = (str(tmp_path / n) for n in ("in", "ventas", "registro"))
    (tmp_path / "in").mkdir()

    def run(checkpoint="c1"):
        start_ingest(spark, inbox, sales_path, registry, str(tmp_path / checkpoint)).awaitTermination()
        return read_sales(spark, sales_path).count()

    (tmp_path / "in" / "a.csv").write_text("SKU,Fecha Venta,Cantidad\nA,2021-01-05,3\n")
    assert run() == 1
    assert run() == 1
    (tmp_path / "in" / "b [1] {x}#%20?.csv").write_text("Cantidad,SKU,Fecha Venta\n3,B,2021-01-05\n1,B,2022-01-05\n")
    (tmp_path / "in" / "c.csv").write_text("SKU,Fecha Venta,Cantidad\nA,abc,3\n")
    assert run() == 3
    files = {r.nombre_archivo: r.estado for r in read_snapshot(spark, registry, schemas.FILES).collect()}
    assert files == {"a.csv": "aprobado", "b [1] {x}#%20?.csv": "aprobado", "c.csv": "invalido"}


def test_temporary_results_are_deleted(spark):
    with temporary_results(spark):
        inside = materialize(spark.range(10))
        files = inside.inputFiles()
        assert inside.count() == 10
    path = files[0].removeprefix("file://")
    assert "/run-" in path and not os.path.exists(os.path.dirname(os.path.dirname(path)))
    assert materialize(spark.range(3)).count() == 3


def test_filesystem_paths():
    assert filesystem_of("file:/a/b c.csv")[1] == filesystem_of("file:///a/b c.csv")[1] == "/a/b c.csv"
    known = {"s3://cubo/": ("fs", "cubo"), "hdfs://nn:9000/": ("fs", "/")}
    assert filesystem_of("s3a://cubo/x/y z.csv", known) == ("fs", "cubo/x/y z.csv")
    assert filesystem_of("hdfs://nn:9000/x/y.csv", known) == ("fs", "/x/y.csv")


def test_files_of_one_name_are_one_for_each_folder(spark, tmp_path):
    rows = spark.range(60).selectExpr("concat('p', id % 6, '/dia0') as carpeta", "id as SKU", "date'2024-05-01' as `Fecha Venta`")
    assert write_named(rows, str(tmp_path), "ventas.csv") == 6
    files = sorted(tmp_path.rglob("ventas.csv"))
    assert [f.parent.parent.name for f in files] == [f"p{i}" for i in range(6)]
    lines = [f.read_text().splitlines() for f in files]
    assert all(len(x) == 11 and x[0] == "SKU,Fecha Venta" for x in lines) and "2,2024-05-01" in lines[2]


def test_many_folders_are_listed_by_few_frames_and_many_files_by_few_tasks(spark, tmp_path):
    folders = [tmp_path / f"p{i}" for i in range(50)]
    for folder in folders:
        folder.mkdir()
        (folder / "a.csv").write_text("SKU,Fecha Venta,Cantidad\nA,2021-01-05,1\n")
    named = pd.DataFrame({"ruta": [str(f) for f in folders]})
    frames = list(sales_files._list_folders(iter([named])))
    assert [len(f) for f in frames] == [50]  # before, a frame for each folder
    paths = [f"{f}/a.csv" for f in folders]
    setting, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    before = spark.conf.get(setting)
    listed = sales_files.list_files(spark, paths)
    spark.sparkContext.setJobGroup("lectura", "lectura")
    try:
        read = sales_files.read_csv_files(spark, paths, listed)
        tracker = spark.sparkContext.statusTracker()
        for job in tracker.getJobIdsForGroup("lectura"):
            for stage in tracker.getJobInfo(job).stageIds:
                info = tracker.getStageInfo(stage)
                if info:
                    seen.append(info.numTasks)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    # Before, a task for each file.
    assert max(seen) <= 4 * spark.sparkContext.defaultParallelism and spark.conf.get(setting) == before
    assert read.count() == 50
