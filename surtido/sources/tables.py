"""Stored tables: sales partitions and the metric log."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import BATCHES, METRICS, SALES
from .commits import hadoop
from .snapshots import merge_snapshot, read_snapshot, row_bound

_BROADCAST_BATCHES = 200_000


class OtherFiles(ValueError):
    """A batch that is already stored comes again from other files."""


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Whole stored table; the columns a query uses are the ones read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def batches_root(path: str) -> str:
    """State table of the committed batches of a sales table, :data:`BATCHES`."""
    return f"{path}/_lotes"


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """Sales of committed batches.

    Every writing of a batch, or of several in one go, lies in a folder of its own;
    the batch's row in the table of batches says which one counts for it, so what
    failed or replaced attempts have left is never read.
    """
    data, fs = hadoop(spark, f"{path}/datos")
    if not fs.exists(data):
        return spark.createDataFrame([], SALES)
    stored = StructType([*SALES.fields, StructField("intento", StringType())])
    rows = spark.read.schema(stored).parquet(f"{path}/datos")
    committed = read_snapshot(spark, batches_root(path), BATCHES).select("intento", "origen", "batch_id")
    # A short row a batch: the commit says how many there are at most.
    small = row_bound(spark, batches_root(path)) <= _BROADCAST_BATCHES
    # Of an attempt with several batches, one may have been replaced since: only then the rows' own batches are read.
    together = F.regexp_extract("intento", "x([0-9]+)$", 1).cast("int")
    shared = committed.filter(F.col("intento").contains("x")).groupBy("intento").agg(F.count(F.lit(1)).alias("n"))
    key = ["intento"] if shared.filter(F.col("n") < together).isEmpty() else ["intento", "origen", "batch_id"]
    wanted = committed.select(*key)
    return rows.join(F.broadcast(wanted) if small else wanted, key, "left_semi").select(*SALES.names)


def write_attempt(
    sales: DataFrame, path: str, batch_id: int | Column, loaded_at: dt.datetime, origin: str = "manual", batches: int = 1
) -> str:
    """Store the rows of a batch, or of several by a column of ``sales``, where no reader sees them yet; returns the name of the attempt.

    Partitioned by attempt and year, so that date filters prune. Rebalancing
    gives even files whatever the year or the SKU mix; the sort lets filters on
    a SKU skip row groups.
    """
    ready = sales.select(
        "id_producto", "fecha", "cantidad_vendida", "source_file",
        F.lit(loaded_at).cast("timestamp").alias("fecha_carga"),
        F.lit(origin).alias("origen"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.year("fecha").alias("anio"),
    )
    # The name tells how many batches it holds, where they are several.
    attempt = uuid.uuid4().hex + (f"x{batches}" if batches > 1 else "")
    (
        ready.hint("rebalance", "anio")
        .sortWithinPartitions("anio", "id_producto", "fecha")
        .write.partitionBy("anio").parquet(f"{path}/datos/intento={attempt}")
    )
    return attempt


def refuse_other_files(batches: DataFrame, origin: str, files: Mapping[int, str]) -> None:
    """Raise :class:`OtherFiles` if a batch of ``files`` is among ``batches`` with another digest."""
    known = batches.filter((F.col("origen") == origin) & F.col("batch_id").isin(list(files)))
    for row in known.select("batch_id", "huella").orderBy("batch_id").collect():
        if row.huella != files[row.batch_id]:
            raise OtherFiles(f"lote {row.batch_id} de {origin}: ya registrado con otros archivos")


def commit_batch(
    spark: SparkSession, path: str, files: Mapping[int, str], attempt: str, loaded_at: dt.datetime,
    origin: str = "manual", registered: bool = True,
) -> None:
    """Make an attempt the rows of its batches, in place of any earlier ones, in one step.

    ``files`` has each batch's digest of the files it came from; the same batch
    from other files is refused, also if two writers come at once.
    """

    def commit(batches: DataFrame) -> DataFrame:
        refuse_other_files(batches, origin, files)
        rows = [(origin, number, attempt, digest, loaded_at, registered) for number, digest in files.items()]
        return spark.createDataFrame(rows, BATCHES)

    merge_snapshot(batches_root(path), BATCHES, ["origen", "batch_id"], commit, spark)


def append_sales(
    sales: DataFrame, path: str, batch_id: int, loaded_at: dt.datetime, origin: str = "manual", files: str = ""
) -> None:
    """Write one batch of sales; the same batch written again replaces all its rows, of whatever years."""
    attempt = write_attempt(sales, path, batch_id, loaded_at, origin)
    commit_batch(sales.sparkSession, path, {batch_id: files}, attempt, loaded_at, origin)


def remove_replaced_sales(spark: SparkSession, path: str, older_than_ms: int = 7 * 86_400_000) -> int:
    """Delete the rows of attempts that failed or were replaced and that no reader can still use; returns how many.

    Outcomes of files that are in the registry go too.
    """
    now = spark._jvm.java.lang.System.currentTimeMillis()
    batches = read_snapshot(spark, batches_root(path), BATCHES)
    found = []
    for folder, needed in (("datos", batches), ("_archivos", batches.filter("not registrado"))):
        parent, fs = hadoop(spark, f"{path}/{folder}")
        there = fs.listStatus(parent) if fs.exists(parent) else []
        old = [s.getPath().toString() for s in there if now - s.getModificationTime() > older_than_ms]
        names = spark.createDataFrame([(p, p.rsplit("/", 1)[1].rpartition("=")[2]) for p in old], "ruta string, intento string")
        lost = names.join(needed.select("intento"), "intento", "left_anti").collect()
        for row in lost:
            fs.delete(hadoop(spark, row.ruta)[0], True)
        found.append(len(lost))
    return found[0]


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.select(*METRICS.names).coalesce(1).write.mode("append").parquet(path)

