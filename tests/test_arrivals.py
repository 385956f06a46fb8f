"""Files that arrive while an ingest runs again and again."""

import datetime as dt
import shutil
import time

import pytest

from surtido import schemas
from surtido.fixed_values import MSG_EMPTY_FILE
from surtido.plans import arrivals
from surtido.plans.arrivals import arrivals_root, ingest_arrivals, new_arrivals
from surtido.sources.snapshots import read_snapshot
from surtido.sources.tables import OtherFiles, read_sales
from surtido.streaming.sales_stream import start_ingest

NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


class Place:
    def __init__(self, spark, root):
        self.spark, self.inbox = spark, root / "in"
        self.inbox.mkdir()
        self.sales, self.registry, self.checkpoint = (str(root / n) for n in ("ventas", "registro", "c"))

    def put(self, name, *lines):
        (self.inbox / name).write_text("\n".join(["SKU,Fecha Venta,Cantidad", *lines, ""]) if lines else "")

    def stream(self, **options):
        start_ingest(self.spark, str(self.inbox), self.sales, self.registry, self.checkpoint, **options).awaitTermination()

    def take(self, **options):
        return ingest_arrivals(self.spark, str(self.inbox), self.sales, self.registry, NOW, "prueba", **options)

    def outcomes(self):
        files = read_snapshot(self.spark, self.registry, schemas.FILES)
        return sorted((r.nombre_archivo, r.estado, r.filas_guardadas, r.batch_id) for r in files.collect())

    def skus(self):
        return sorted(r.id_producto for r in read_sales(self.spark, self.sales).collect())


@pytest.fixture
def place(spark, tmp_path):
    return Place(spark, tmp_path)


def test_stream_registers_empty_files_and_takes_them_when_filled(place):
    place.put("vacio.csv")
    place.put("a.csv", "A,2021-01-05,3")
    place.stream()
    assert place.outcomes() == [("a.csv", "aprobado", 1, 0), ("vacio.csv", "invalido", 0, 0)]
    messages = read_snapshot(place.spark, place.registry, schemas.FILES).filter("estado = 'invalido'").collect()
    assert [r.mensaje for r in messages] == [MSG_EMPTY_FILE]
    place.stream()
    place.put("vacio.csv", "B,2021-01-05,3")
    place.put("a.csv", "A,2021-01-05,3", "Z,2021-01-05,3")  # taken already, whatever becomes of it
    place.stream()
    place.stream()
    assert place.outcomes() == [
        ("a.csv", "aprobado", 1, 0), ("vacio.csv", "aprobado", 1, 1), ("vacio.csv", "invalido", 0, 0)]
    assert place.skus() == ["A", "B"]


def test_only_an_empty_file_and_an_empty_folder(place):
    place.stream()
    assert place.outcomes() == []
    place.put("vacio.csv")
    place.stream()
    assert place.outcomes() == [("vacio.csv", "invalido", 0, 0)] and place.skus() == []


def test_a_running_stream_takes_what_arrives(place):
    def wait(for_):
        end = time.monotonic() + 60
        while place.outcomes() != for_ and time.monotonic() < end:
            assert query.isActive, query.exception()
            time.sleep(0.5)
        assert place.outcomes() == for_

    query = start_ingest(
        place.spark, str(place.inbox), place.sales, place.registry, place.checkpoint, every="1 second", origin="buzon")
    try:
        place.put("vacio.csv")
        wait([("vacio.csv", "invalido", 0, 0)])
        place.put("b.csv", "B,2021-01-05,3")
        wait([("b.csv", "aprobado", 1, 1), ("vacio.csv", "invalido", 0, 0)])
    finally:
        query.stop()


def test_a_pattern_may_fit_nothing_yet_but_a_folder_has_to_exist(place):
    def take(source):
        return ingest_arrivals(place.spark, source, place.sales, place.registry, NOW, "prueba")

    assert take(f"{place.inbox}/*/ventas") == 0
    with pytest.raises(FileNotFoundError):
        take(f"{place.inbox}/nada")
    (place.inbox / "p1" / "ventas").mkdir(parents=True)
    place.put("p1/ventas/a.csv", "A,2021-01-05,3")
    assert take(f"{place.inbox}/*/ventas") == 1 and place.skus() == ["A"]


def test_batches_are_bounded_and_a_lost_checkpoint_takes_nothing_twice(place):
    for name in "abcde":
        place.put(f"{name}.csv", f"{name},2021-01-05,3")
    place.stream(max_files=2)
    assert [o[3] for o in place.outcomes()] == [0, 0, 1, 1, 2]
    shutil.rmtree(place.checkpoint)
    place.stream(max_files=2)
    assert place.skus() == list("abcde")


@pytest.mark.parametrize("lost", [(), ("a.csv",), ("a.csv", "b.csv")])
def test_a_noted_batch_is_ingested_after_a_crash(place, monkeypatch, lost):
    place.put("a.csv", "A,2021-01-05,3")
    place.put("b.csv", "B,2021-01-05,3")
    with monkeypatch.context() as broken:
        def fail(*_, **__):
            raise RuntimeError("driver lost")
        broken.setattr(arrivals, "ingest_files", fail)
        with pytest.raises(RuntimeError, match="driver lost"):
            place.take()
    for name in lost:
        (place.inbox / name).unlink()
    place.put("c.csv", "C,2021-01-05,3")
    kept = [n for n in ("a.csv", "b.csv") if n not in lost]
    assert place.take() == len(kept) + 1
    assert place.outcomes() == [*((n, "aprobado", 1, 0) for n in kept), ("c.csv", "aprobado", 1, 1)]
    assert place.take() == 0


def test_a_crash_after_the_commit_is_completed(place, monkeypatch):
    place.put("a.csv", "A,2021-01-05,3")
    from surtido.plans import ingest

    with monkeypatch.context() as broken:
        def fail(*_, **__):
            raise RuntimeError("driver lost")
        broken.setattr(ingest, "settle_batches", fail)
        with pytest.raises(RuntimeError, match="driver lost"):
            place.take()
    assert place.outcomes() == [] and place.skus() == ["A"]
    assert place.take() == 0
    assert place.outcomes() == [("a.csv", "aprobado", 1, 0)] and place.skus() == ["A"]


def test_a_second_writer_of_the_same_name_is_refused(place):
    place.put("a.csv", "A,2021-01-05,3")
    place.take()
    chosen = read_snapshot(place.spark, arrivals_root(place.sales), schemas.ARRIVALS).collect()
    with pytest.raises(OtherFiles):
        arrivals._note(place.spark, arrivals_root(place.sales), "prueba", 0, chosen)


def test_a_file_filled_between_listing_and_reading_is_taken_once(spark):
    present = spark.createDataFrame([("f1", 9), ("f2", 9), ("f3", 0), ("f4", 9), ("f5", 0)], "ruta string, bytes bigint")
    taken = spark.createDataFrame(
        [("o", "f1", 0, 3), ("o", "f2", 0, 3), ("o", "f3", 0, 3), ("o", "f4", 8, 3)], schemas.ARRIVALS)
    files = spark.createDataFrame(
        [("f1", 3, "procesado"), ("f2", 3, "invalido"), ("f2", 2, "aprobado")], "ruta string, batch_id bigint, estado string")
    assert sorted(map(tuple, new_arrivals(present, taken, files).collect())) == [("f2", 9), ("f5", 0)]


def test_batches_in_one_go_are_what_they_would_be_one_by_one(place):
    for name in "abcde":
        place.put(f"{name}.csv", f"{name},2021-01-05,3")
    place.put("f.csv")
    calls, ingest_files = [], arrivals.ingest_files

    def counted(*args, **options):
        calls.append(options["listed"].count())
        return ingest_files(*args, **options)

    arrivals.ingest_files = counted
    try:
        assert place.take(max_files=2) == 6
        assert calls == [6]  # before, a run of jobs for each batch: 2, 2, 2
    finally:
        arrivals.ingest_files = ingest_files
    assert place.outcomes() == [
        *((f"{n}.csv", "aprobado", 1, at // 2) for at, n in enumerate("abcde")), ("f.csv", "invalido", 0, 2)]
    sales = read_sales(place.spark, place.sales)
    assert sorted((r.id_producto, r.batch_id) for r in sales.collect()) == [(n, at // 2) for at, n in enumerate("abcde")]
    # One batch of them is replayed by itself; with other files it is refused.
    place.put("c.csv", "c,2021-01-05,3", "z,2021-01-05,3")
    pair = [f"{place.inbox}/{n}.csv" for n in "cd"]
    arrivals.ingest_files(place.spark, pair, place.sales, place.registry, 1, NOW, origin="prueba", approve=True)
    assert place.skus() == list("abcdez")
    assert [o for o in place.outcomes() if o[3] == 1] == [("c.csv", "aprobado", 2, 1), ("d.csv", "aprobado", 1, 1)]
    with pytest.raises(OtherFiles, match="lote 2"):
        arrivals.ingest_files(place.spark, pair, place.sales, place.registry, 2, NOW, origin="prueba")
    assert place.take(max_files=2) == 0


def test_batches_noted_in_one_go_keep_their_numbers_after_a_crash(place, monkeypatch):
    for name in "abcd":
        place.put(f"{name}.csv", f"{name},2021-01-05,3")
    with monkeypatch.context() as broken:
        def fail(*_, **__):
            raise RuntimeError("driver lost")
        broken.setattr(arrivals, "ingest_files", fail)
        with pytest.raises(RuntimeError, match="driver lost"):
            place.take(max_files=1)
    (place.inbox / "b.csv").unlink()
    place.put("e.csv", "e,2021-01-05,3")
    assert place.take(max_files=1) == 4
    assert [(o[0], o[3]) for o in place.outcomes()] == [("a.csv", 0), ("c.csv", 2), ("d.csv", 3), ("e.csv", 4)]
    assert place.skus() == list("acde") and place.take(max_files=1) == 0


def test_a_go_is_bounded_by_bytes(place):
    class File:
        def __init__(self, size):
            self.bytes = size

    files = [File(n) for n in (5, 5, 5, 5, 1)]
    assert [len(arrivals._in_one_go(files, 2, most)) for most in (9, 10, 19, 20, 21)] == [2, 2, 2, 4, 5]


def test_a_replaced_batch_is_registered_once_after_a_crash(place, monkeypatch):
    from surtido.plans import ingest

    for name in "ab":
        place.put(f"{name}.csv", f"{name},2021-01-05,3")
    settle = ingest.settle_batches
    with monkeypatch.context() as broken:
        def fail(*_, **__):
            raise RuntimeError("driver lost")
        broken.setattr(ingest, "settle_batches", fail)
        with pytest.raises(RuntimeError, match="driver lost"):
            place.take(max_files=1)
        place.put("a.csv", "a,2021-01-05,3", "z,2021-01-05,3")
        with pytest.raises(RuntimeError, match="driver lost"):
            arrivals.ingest_files(
                place.spark, [f"{place.inbox}/a.csv"], place.sales, place.registry, 0, NOW, origin="prueba", approve=True)
    assert settle(place.spark, place.sales, place.registry, True) == 2
    assert place.outcomes() == [("a.csv", "aprobado", 2, 0), ("b.csv", "aprobado", 1, 1)] and place.skus() == list("abz")
