"""The registry of sales files and the choice of training rows it drives."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FILE_STATES
from ..functions.calendar import minute_text
from .lookups import lookup_join
from .snapshots import change_state, promote, remove_ids


def register_files(
    outcomes: DataFrame, batch_id: int | Column, loaded_at: dt.datetime, loaded_by: str = "Sistema", origin: str = "manual"
) -> DataFrame:
    """Registry rows of file outcomes, of one batch or by a column of them. The id follows from path, source and batch, so a replay repeats it."""
    moment = F.lit(loaded_at).cast("timestamp")
    batch = F.lit(batch_id).cast("bigint")
    return outcomes.select(
        F.xxhash64("ruta", F.lit(origin), batch).alias("id"),
        "nombre_archivo",
        moment.alias("fecha_carga"),
        "estado",
        F.col("filas_guardadas").cast("bigint").alias("filas_guardadas"),
        "mensaje",
        F.lit(loaded_by).alias("cargado_por"),
        "ruta",
        F.lit(origin).alias("origen"),
        batch.alias("batch_id"),
    )


def registered_again(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` as they are to be registered: new outcomes count, but a valid file keeps an approval it already has."""
    before = files.select("id", F.col("estado").alias("_antes"))
    kept = (F.col("estado") == "valido") & F.col("_antes").isin("aprobado", "procesado")
    approved = (F.col("estado") == "aprobado") & (F.col("_antes") == "procesado")
    return (
        rows.join(before, "id", "left")
        .withColumn("estado", F.when(kept | approved, F.col("_antes")).otherwise(F.col("estado")))
        .select(*rows.columns)
    )


def files_by_state(files: DataFrame) -> DataFrame:
    state = F.col("estado")
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(state == name).alias(name) for name in FILE_STATES],
    )


def list_files(files: DataFrame) -> DataFrame:
    """Registry, newest first, with the load time as text."""
    return files.orderBy(F.desc("fecha_carga"), "id").withColumn(
        "fecha_carga", minute_text(F.col("fecha_carga"))
    )


def approved_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("estado") == "aprobado")


def list_approved(files: DataFrame) -> DataFrame:
    """Approved files, oldest first."""
    return (
        approved_files(files)
        .orderBy("fecha_carga", "id")
        .select("id", "nombre_archivo", minute_text(F.col("fecha_carga")).alias("fecha_carga"),
                "filas_guardadas")
    )


def set_file_states(
    files: DataFrame, changes: DataFrame, order: Sequence[str] = ("estado",)
) -> DataFrame:
    """Set states by id; of several allowed changes the last by ``order`` counts."""
    return change_state(files, changes, FILE_STATES, order)


def approve_valid(files: DataFrame) -> DataFrame:
    return promote(files, "valido", "aprobado")


def count_valid(files: DataFrame) -> DataFrame:
    """How many files ``approve_valid`` promotes."""
    return files.agg(F.count_if(F.col("estado") == "valido").alias("promovidos"))


def mark_processed(files: DataFrame, used: DataFrame) -> DataFrame:
    """Approved files that a training run read become processed; later approvals wait."""
    read = used.select("id").distinct().withColumn("_used", F.lit(True))
    done = F.coalesce(F.col("_used"), F.lit(False)) & (F.col("estado") == "aprobado")
    return (
        files.join(read, "id", "left")
        .withColumn("estado", F.when(done, "procesado").otherwise(F.col("estado")))
        .select(*files.columns)
    )


def delete_files(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop registry rows; the sales they brought stay."""
    return remove_ids(files, ids)


def approved_sales(sales: DataFrame, files: DataFrame) -> DataFrame:
    """Sales whose file, by its path, is approved. The registry side is broadcast while small."""
    paths = approved_files(files).select(F.col("ruta").alias("source_file")).distinct()
    return lookup_join(sales, paths, "source_file", "left_semi")


def training_rows(sales: DataFrame, files: DataFrame, on_empty: str = "empty") -> DataFrame:
    """Rows to train on.

    No approved file gives no rows. If files are approved but none of their rows
    is found, ``on_empty`` decides: ``"empty"`` or ``"all"``.
    """
    if on_empty not in ("empty", "all"):
        raise ValueError(f"on_empty: {on_empty}")
    chosen = approved_sales(sales, files)
    if on_empty == "all" and not approved_files(files).isEmpty() and chosen.isEmpty():
        return sales
    return chosen
