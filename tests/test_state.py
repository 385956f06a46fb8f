"""State tables and batches: commits, folding, replays, crashes, writers at once."""

import datetime as dt
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from surtido import schemas
from surtido.plans import ingest
from surtido.plans.ingest import ingest_files, settle_batches
from surtido.sources import commits, snapshots
from surtido.sources.snapshots import (
    StaleVersion,
    latest_version,
    merge_snapshot,
    read_snapshot,
    read_version,
    remove_orphans,
    update_snapshot,
    write_snapshot,
)
from surtido.sources.tables import OtherFiles, append_sales, read_sales, remove_replaced_sales, write_attempt
from surtido.streaming.sales_stream import start_ingest

NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
NAMES = schemas.FILE_PROBLEMS  # source_file, problema


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), NAMES)


def put(spark, root, *pairs, **options):
    return merge_snapshot(root, NAMES, ["source_file"], lambda now: rows(spark, *pairs), spark, **options)


def stored(spark, root):
    return {tuple(r) for r in read_snapshot(spark, root, NAMES).collect()}


def test_versions_and_dead_writers(spark, tmp_path):
    root = str(tmp_path / "tabla con espacio %20#")
    assert read_snapshot(spark, root, NAMES).isEmpty() and latest_version(spark, root) == 0
    assert write_snapshot(rows(spark, ("a", "1")), root) == 1
    rows(spark, ("x", "x")).write.parquet(snapshots.new_folder(root))  # a writer that died
    assert stored(spark, root) == {("a", "1")}
    assert write_snapshot(rows(spark, ("b", "1")), root, after=1) == 2
    with pytest.raises(StaleVersion):
        write_snapshot(rows(spark, ("c", "1")), root, after=1)
    assert stored(spark, root) == {("b", "1")}
    assert {tuple(r) for r in read_version(spark, root, NAMES, 1).collect()} == {("a", "1")}
    assert remove_orphans(spark, root) == 0 and remove_orphans(spark, root, -1) == 1
    for i in range(4):
        update_snapshot(root, NAMES, lambda now: now.union(rows(spark, (f"n{i}", "1"))), spark, keep=2)
    assert latest_version(spark, root) == 6 and len(stored(spark, root)) == 5
    assert len(list((Path(root) / "_commits").glob("*.json"))) == 2
    assert len([p for p in Path(root).iterdir() if p.name.startswith("data-")]) == 2


def test_changes_are_folded(spark, tmp_path):
    root, wanted = str(tmp_path / "t"), {}
    for i in range(70):
        changes = {f"k{(i * j) % 23}": f"v{i}" for j in range(1, 3)}
        gone = f"k{i % 5}" if i % 3 == 0 and f"k{i % 5}" not in changes else None
        frame = rows(spark, *changes.items()).withColumn(snapshots.REMOVED, F.lit(False))
        if gone:
            frame = frame.union(rows(spark, (gone, None)).withColumn(snapshots.REMOVED, F.lit(True)))
        merge_snapshot(root, NAMES, ["source_file"], lambda now: frame, spark, fan=3)
        wanted |= changes
        wanted.pop(gone, None)
        if i % 10 == 9:
            assert stored(spark, root) == set(wanted.items())
            assert len(snapshots._commit(spark, root, i + 1)["runs"]) < 10


def test_a_commit_writes_its_changes_and_not_the_table(spark, tmp_path):
    root = str(tmp_path / "t")
    write_snapshot(spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("source_file"), F.lit("0").alias("problema")), root)

    def bytes_under():
        return sum(p.stat().st_size for p in Path(root).rglob("*") if p.is_file())

    sizes = []
    for i in range(10):
        before = bytes_under()
        put(spark, root, (f"k{i}", "1"), (f"neu{i}", "1"))
        sizes.append(bytes_under() - before)
    assert max(sizes) < 20_000 < before
    assert read_snapshot(spark, root, NAMES).filter("problema = '1'").count() == 20
    assert read_snapshot(spark, root, NAMES).count() == 200_010


class SlowStore:
    """A store without renames: creating is conditional, and others come in between reading and creating."""

    def __init__(self):
        self.lock, self.refused = threading.Lock(), 0

    def publish(self, spark, path, text):
        target = Path(path.removeprefix("file://"))
        with self.lock:
            if target.exists():
                self.refused += 1
                raise commits.Taken(path)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(text)


@pytest.mark.parametrize("publisher", ["link", "conditional"])
def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch, publisher):
    store = SlowStore()
    if publisher == "conditional":
        monkeypatch.setitem(commits.PUBLISHERS, "file", store.publish)
    root, errors = str(tmp_path / "t"), []

    def work(name):
        try:
            for i in range(3):
                put(spark, root, (f"{name}-{i}", "x"), attempts=100, fan=3)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and latest_version(spark, root) == 15
    assert stored(spark, root) == {(f"w{k}-{i}", "x") for k in range(5) for i in range(3)}
    if publisher == "conditional":
        assert store.refused > 0


def test_another_writer_in_between(spark, tmp_path):
    root = str(tmp_path / "t")

    def adding(name, first=None):
        def change(current):
            if first and first.pop("open", False):
                update_snapshot(root, NAMES, adding("dos"), spark)
            return current.union(rows(spark, (name, "x")))
        return change

    update_snapshot(root, NAMES, adding("uno", {"open": True}), spark)
    assert stored(spark, root) == {("uno", "x"), ("dos", "x")}


def test_lost_answers_and_unknown_stores(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/c/1.json"

    def lost(spark, path, text):
        commits.by_link(spark, path, text)
        raise OSError("sin respuesta")

    monkeypatch.setitem(commits.PUBLISHERS, "file", lost)
    commits.publish(spark, path, "mine")  # the file was made all the same
    with pytest.raises(commits.Taken):
        commits.publish(spark, path, "other")
    monkeypatch.delitem(commits.PUBLISHERS, "file")
    with pytest.raises(ValueError, match="register_publisher"):
        commits.publish(spark, path, "mine")


@pytest.mark.parametrize("publisher", [commits.by_create, commits.by_rename])
def test_other_publishers(spark, tmp_path, publisher, monkeypatch):
    monkeypatch.setitem(commits.PUBLISHERS, "file", publisher)
    commits.publish(spark, f"file://{tmp_path}/c/1.json", "one")
    with pytest.raises(commits.Taken):
        commits.publish(spark, f"file://{tmp_path}/c/1.json", "two")
    assert (tmp_path / "c" / "1.json").read_text() == "one"


# --- batches of sales ------------------------------------------------------------

def write_csv(path, *lines):
    path.write_text("\n".join(["SKU,Fecha Venta,Cantidad", *lines]) + "\n")


def sold(spark, path):
    return sorted((r.id_producto, str(r.fecha), r.batch_id) for r in read_sales(spark, path).collect())


def test_a_replay_with_other_years_leaves_its_own_rows(spark, tmp_path):
    sales, registry, file = str(tmp_path / "ventas"), str(tmp_path / "registro"), tmp_path / "a.csv"
    write_csv(file, "A,2023-05-01,1", "B,2023-05-01,1")
    ingest_files(spark, str(file), sales, registry, 1, NOW, approve=True)
    write_csv(file, "A,2024-05-01,1", "C,bad,1")
    outcome = ingest_files(spark, str(file), sales, registry, 1, NOW).collect()
    assert sold(spark, sales) == [("A", "2024-05-01", 1)]
    # The count is the new one; the approval stays.
    assert [(r.estado, r.filas_guardadas) for r in outcome] == [("aprobado", 1)]
    write_csv(file, "A,bad,1")
    outcome = ingest_files(spark, str(file), sales, registry, 1, NOW).collect()
    assert sold(spark, sales) == [] and [(r.estado, r.filas_guardadas) for r in outcome] == [("invalido", 0)]
    assert remove_replaced_sales(spark, sales) == 0 and remove_replaced_sales(spark, sales, -1) == 2
    assert sold(spark, sales) == []


def test_a_crash_anywhere_leaves_committed_rows(spark, tmp_path, monkeypatch):
    sales, registry, file = str(tmp_path / "ventas"), str(tmp_path / "registro"), tmp_path / "a.csv"
    write_csv(file, "A,2023-05-01,1")
    ingest_files(spark, str(file), sales, registry, 1, NOW)

    def dies(*_, **__):
        raise RuntimeError("cortado")

    write_csv(file, "B,2024-05-01,1", "C,2024-05-01,1")
    with monkeypatch.context() as m:
        m.setattr(ingest, "commit_batch", dies)  # rows written, not committed
        with pytest.raises(RuntimeError, match="cortado"):
            ingest_files(spark, str(file), sales, registry, 1, NOW)
    assert sold(spark, sales) == [("A", "2023-05-01", 1)]
    with monkeypatch.context() as m:
        m.setattr(ingest, "settle_batches", dies)  # committed, not registered
        with pytest.raises(RuntimeError, match="cortado"):
            ingest_files(spark, str(file), sales, registry, 1, NOW)
    assert [s[0] for s in sold(spark, sales)] == ["B", "C"]
    assert [r.filas_guardadas for r in read_snapshot(spark, registry, schemas.FILES).collect()] == [1]
    # The next ingest, of whatever batch, makes up for it.
    other = tmp_path / "b.csv"
    write_csv(other, "D,2024-05-01,1")
    ingest_files(spark, str(other), sales, registry, 2, NOW)
    counts = {r.nombre_archivo: r.filas_guardadas for r in read_snapshot(spark, registry, schemas.FILES).collect()}
    assert counts == {"a.csv": 2, "b.csv": 1} and settle_batches(spark, sales, registry) == 0


def test_two_writers_of_one_batch_with_other_files(spark, tmp_path, monkeypatch):
    sales, registry = str(tmp_path / "ventas"), str(tmp_path / "registro")
    one, two = tmp_path / "uno.csv", tmp_path / "dos.csv"
    write_csv(one, "A,2023-05-01,1")
    write_csv(two, "B,2023-05-01,1")
    commit = ingest.commit_batch

    def late(*args, **options):
        monkeypatch.setattr(ingest, "commit_batch", commit)
        ingest_files(spark, str(two), sales, registry, 1, NOW)  # both have passed the first look
        return commit(*args, **options)

    monkeypatch.setattr(ingest, "commit_batch", late)
    with pytest.raises(OtherFiles, match="lote 1"):
        ingest_files(spark, str(one), sales, registry, 1, NOW)
    assert [s[0] for s in sold(spark, sales)] == ["B"]
    assert [r.nombre_archivo for r in read_snapshot(spark, registry, schemas.FILES).collect()] == ["dos.csv"]


def test_attempts_without_a_commit_are_not_read(spark, tmp_path):
    path = str(tmp_path / "ventas")
    assert read_sales(spark, path).collect() == []
    frame = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1, "f")], "id_producto string, fecha date, cantidad_vendida int, source_file string")
    write_attempt(frame, path, 1, NOW)
    assert read_sales(spark, path).collect() == []
    append_sales(frame, path, 1, NOW)
    append_sales(frame, path, 1, NOW, origin="otro")
    assert read_sales(spark, path).count() == 2


def test_micro_batches_write_no_more_as_the_registry_grows(spark, tmp_path):
    sales, registry = str(tmp_path / "ventas"), str(tmp_path / "registro")
    known = spark.range(100_000).select(
        "id", F.concat(F.lit("f"), "id").alias("nombre_archivo"), F.lit(NOW).cast("timestamp").alias("fecha_carga"),
        F.lit("procesado").alias("estado"), F.lit(1).cast("bigint").alias("filas_guardadas"), F.lit("m").alias("mensaje"),
        F.lit("s").alias("cargado_por"), F.concat(F.lit("file:///f"), "id").alias("ruta"), F.lit("viejo").alias("origen"),
        F.lit(1).cast("bigint").alias("batch_id"))
    write_snapshot(known, registry)
    (tmp_path / "in").mkdir()

    def written():
        return sum(p.stat().st_size for p in Path(registry).rglob("*") if p.is_file())

    grown = []
    for i in range(3):
        write_csv(tmp_path / "in" / f"{i}.csv", f"A{i},2021-01-05,3")
        before = written()
        start_ingest(spark, str(tmp_path / "in"), sales, registry, str(tmp_path / "c")).awaitTermination()
        grown.append(written() - before)
    assert max(grown) < 30_000 < before
    files = read_snapshot(spark, registry, schemas.FILES)
    assert files.count() == 100_003 and files.filter("estado = 'aprobado'").count() == 3
