"""Files that arrive in a folder, taken in numbered batches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import DATE_FORMATS
from ..operators.lookups import lookup_join
from ..schemas import ARRIVALS, BATCHES, FILES
from ..session import materialize, temporary_results
from ..sources.sales_files import list_files
from ..sources.snapshots import merge_snapshot, read_snapshot
from ..sources.tables import OtherFiles, batches_root
from ..sources.uris import literal
from .ingest import ingest_files, settle_batches


def arrivals_root(sales_path: str) -> str:
    """State table of the files that were taken, with the batch that took them, :data:`ARRIVALS`."""
    return f"{sales_path}/_llegadas"


def new_arrivals(present: DataFrame, taken: DataFrame, files: DataFrame) -> DataFrame:
    """Files of ``present`` (``ruta``, ``bytes``) that no batch has taken, or that were empty then and no longer are.

    A file that was filled between its listing and its reading counts as taken:
    the registry ``files`` says that it was not invalid.
    """
    before = taken.select("ruta", F.col("bytes").alias("_antes"), F.col("batch_id").alias("_lote"))
    seen = lookup_join(present, before, "ruta", "left")
    filled = seen.filter((F.col("_antes") == 0) & (F.col("bytes") > 0))
    read = files.filter(F.col("estado") != "invalido").select("ruta", F.col("batch_id").alias("_lote"))
    again = filled.join(read, ["ruta", "_lote"], "left_anti")
    return seen.filter(F.col("_lote").isNull()).unionByName(again).select("ruta", "bytes")


def ingest_arrivals(
    spark: SparkSession,
    source: str,
    sales_path: str,
    registry_root: str,
    loaded_at: dt.datetime,
    origin: str,
    max_files: int = 1000,
    approve: bool = True,
    formats: Sequence[str] = DATE_FORMATS,
    together: int = 32,
    together_bytes: int = 8 << 30,
) -> int:
    """Ingest all files under ``source`` that have arrived since the last call; returns how many were taken.

    Files without a single byte are taken too and registered as invalid; one
    that has content later is taken again. Other files are taken once, whatever
    becomes of them, so a file should be complete when it gets its name.

    Files form batches of ``max_files``, in the order of their paths. Up to
    ``together`` batches, of no more than ``together_bytes`` unless one alone has
    more, are ingested in one go: what a run of jobs costs beside its rows is paid
    once for all of them. They are first noted in the table of arrivals; batches
    that were noted but not ingested come first at the next call, with their own
    numbers and those of their files that still exist. Folders are listed by tasks
    and compared with the table by a join, so the driver sees the names of the
    files of one go only. A pattern that fits nothing yet gives nothing; a missing
    folder is an error. One writer at a time for each ``origin``: a second one is
    refused.
    """
    root = arrivals_root(sales_path)
    settle_batches(spark, sales_path, registry_root, approve)  # an ingest that died after its commit
    count = 0
    with temporary_results(spark):
        try:
            listed = list_files(spark, source)
        except FileNotFoundError:
            if source == literal(source):
                raise
            return 0
        present = listed.select(F.col("source_file").alias("ruta"), "bytes")
        while True:
            taken = read_snapshot(spark, root, ARRIVALS).filter(F.col("origen") == origin)
            numbers = _unfinished(spark, sales_path, origin, taken, present)
            if not numbers:
                last = taken.agg(F.max("batch_id")).first()[0]
                number = 0 if last is None else last + 1
                files = read_snapshot(spark, registry_root, FILES).filter(F.col("origen") == origin)
                chosen = new_arrivals(present, taken, files).orderBy("ruta").limit(max_files * together).collect()
                if not chosen:
                    return count
                chosen = _in_one_go(chosen, max_files, together_bytes)
                _note(spark, root, origin, number, chosen, max_files)
                taken = read_snapshot(spark, root, ARRIVALS).filter(F.col("origen") == origin)
                numbers = list(range(number, number + -(-len(chosen) // max_files)))
            noted = taken.filter(F.col("batch_id").isin(numbers)).select(F.col("ruta").alias("source_file"), "batch_id")
            own = materialize(lookup_join(listed, noted, "source_file", "inner"), "own")
            paths = [r[0] for r in own.select("source_file").collect()]
            ingest_files(
                spark, [literal(p) for p in paths], sales_path, registry_root, min(numbers), loaded_at,
                approve=approve, formats=formats, origin=origin, listed=own,
            )
            count += len(paths)


def _unfinished(spark: SparkSession, sales_path: str, origin: str, taken: DataFrame, present: DataFrame) -> list[int]:
    """Batches noted after the last one that is committed, as far as files of theirs exist."""
    committed = read_snapshot(spark, batches_root(sales_path), BATCHES).filter(F.col("origen") == origin)
    done = taken.join(committed.select("batch_id"), "batch_id", "left_semi").agg(F.max("batch_id")).first()[0]
    noted = taken if done is None else taken.filter(F.col("batch_id") > done)
    return [r[0] for r in noted.join(present, "ruta", "left_semi").select("batch_id").distinct().collect()]


def _in_one_go(chosen: list, max_files: int, most_bytes: int) -> list:
    """The first batches of ``chosen``, one at least, of ``most_bytes`` together."""
    size = 0
    for at in range(0, len(chosen), max_files):
        size += sum(r.bytes for r in chosen[at : at + max_files])
        if at and size > most_bytes:
            return chosen[:at]
    return chosen


def _note(
    spark: SparkSession, root: str, origin: str, number: int, chosen: list, max_files: int | None = None
) -> None:
    """Note files as taken, ``max_files`` a batch, by batches from ``number`` on."""
    each = max_files or len(chosen)

    def change(known: DataFrame) -> DataFrame:
        if not known.filter((F.col("origen") == origin) & (F.col("batch_id") >= number)).isEmpty():
            raise OtherFiles(f"lote {number} de {origin}: tomado por otro proceso")
        return spark.createDataFrame([(origin, r.ruta, r.bytes, number + at // each) for at, r in enumerate(chosen)], ARRIVALS)

    merge_snapshot(root, ARRIVALS, ["origen", "ruta"], change, spark)
