"""Sales files to the sales table and the file registry."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import DATE_FORMATS, MSG_EMPTY_FILE, MSG_UNDECIDED
from ..operators.lookups import lookup_join
from ..operators.registry import approve_valid, register_files, registered_again
from ..operators.sales import (
    coerce_both_orders,
    date_orders,
    file_outcomes,
    quality_report,
    rejected_sales,
    settle_dates,
    valid_sales,
)
from ..schemas import BATCHES, FILES
from ..session import materialize, temporary_results
from ..sources.sales_files import list_files, read_sales_files
from ..sources.snapshots import merge_snapshot, read_snapshot
from ..sources.tables import batches_root, commit_batch, refuse_other_files, write_attempt


@dataclass
class Ingested:
    valid: DataFrame
    rejected: DataFrame
    report: DataFrame
    outcomes: DataFrame
    #: Files whose dates depend on the order of day and month, with the order found.
    orders: DataFrame


def check_files(
    spark: SparkSession, source: str | list[str], multiline: bool = False, formats: Sequence[str] = DATE_FORMATS,
    listed: DataFrame | None = None,
) -> Ingested:
    """Read and coerce a folder or list of files once; rows, rejects and reports share the result.

    ``formats`` are the day patterns to accept. Where they allow both orders of
    day and month, each file's own dates tell its order, and all its doubtful
    dates are read by it. Where they do not, the order of ``formats`` counts and
    the outcome of the file says how many dates are in doubt; for day-first
    sources pass ``DAY_FIRST_FORMATS``. ``listed`` is the ``list_files`` of
    ``source``, where that is known already.
    """
    if listed is None:
        listed = list_files(spark, source)
    raw = read_sales_files(spark, source, listed, multiline)
    coerced = coerce_both_orders(raw.filter(F.col("problema").isNull()), formats).withColumn(
        "problema", F.lit(None).cast("string")
    )
    broken = raw.filter(F.col("problema").isNotNull()).select("source_file", "problema")
    staged = materialize(coerced.unionByName(broken, allowMissingColumns=True), "ingest")

    # A file with a problem is rejected whole, even if some of its rows were read.
    problems = staged.filter(F.col("problema").isNotNull()).groupBy("source_file").agg(
        F.min("problema").alias("problema")
    )
    read = lookup_join(
        staged.filter(F.col("problema").isNull()).drop("problema"),
        problems.select("source_file"), "source_file", "left_anti",
    )
    orders = materialize(date_orders(read), "orders")
    rows = settle_dates(read, orders, formats)
    report = quality_report(rows)
    # Listed files that gave neither rows nor a problem hold a header only.
    silent = (
        listed.select("source_file").distinct()
        .join(staged.select("source_file").distinct(), "source_file", "left_anti")
        .withColumn("problema", F.lit(MSG_EMPTY_FILE))
    )
    return Ingested(
        valid=valid_sales(rows),
        rejected=rejected_sales(rows),
        report=report,
        outcomes=with_doubts(file_outcomes(report, problems.unionByName(silent)), orders),
        orders=orders,
    )


def with_doubts(outcomes: DataFrame, orders: DataFrame) -> DataFrame:
    """Outcomes whose message also says how many dates of the file are in doubt."""
    doubts = orders.filter("orden = 'indeciso'").select(F.col("source_file").alias("ruta"), "fechas_ambos")
    told = F.when(F.col("fechas_ambos") > 0, F.format_string(MSG_UNDECIDED, "fechas_ambos")).otherwise("")
    joined = lookup_join(outcomes, doubts, "ruta", "left")
    return joined.withColumn("mensaje", F.concat("mensaje", told)).select(*outcomes.columns)


def ingest_files(
    spark: SparkSession,
    source: str | list[str],
    sales_path: str,
    registry_root: str,
    batch_id: int,
    loaded_at: dt.datetime,
    loaded_by: str = "Sistema",
    approve: bool = False,
    multiline: bool = False,
    formats: Sequence[str] = DATE_FORMATS,
    origin: str = "manual",
    listed: DataFrame | None = None,
) -> DataFrame:
    """Check files, store their valid sales, register every file; returns the registry rows of the batch.

    A batch is known by ``origin`` and ``batch_id``. It can be repeated: its
    sales and the outcomes of its files then replace the earlier ones, only
    approved and processed files that are still valid stay so. The same batch
    with other files is refused, as it would delete the sales of the first ones.
    ``approve`` promotes valid files, as the periodic ingest does.

    ``listed`` names the files of several batches, the first of them ``batch_id``:
    the ``list_files`` of ``source`` with each file's own ``batch_id``. They are
    read, stored and committed in one go, and are afterwards what they would be
    one by one: each can be repeated by itself.

    The commit of the batch is the one step that counts. Its registry rows are
    stored before it, so if the job dies right after it, the next ingest
    registers them.
    """
    several = listed is not None
    numbers = [r[0] for r in listed.select("batch_id").distinct().collect()] if several else [batch_id]
    own = (F.col("origen") == origin) & F.col("batch_id").isin(numbers)
    with temporary_results(spark):
        checked = check_files(spark, source, multiline, formats, listed)
        valid, outcomes, number = checked.valid, checked.outcomes, batch_id
        if several:
            batch_of = listed.select("source_file", "batch_id")
            valid, number = lookup_join(valid, batch_of, "source_file", "inner"), F.col("batch_id")
            outcomes = lookup_join(outcomes, batch_of.withColumnRenamed("source_file", "ruta"), "ruta", "inner")
        rows = materialize(register_files(outcomes, number, loaded_at, loaded_by, origin), "outcomes")
        digests = files_digests(rows)
        files = {n: digests.get(n, _NO_FILES) for n in numbers}
        refuse_other_files(read_snapshot(spark, batches_root(sales_path), BATCHES), origin, files)
        attempt = write_attempt(valid, sales_path, number, loaded_at, origin, len(numbers))
        (approve_valid(rows) if approve else rows).write.parquet(_outcomes_path(sales_path, attempt))
        commit_batch(spark, sales_path, files, attempt, loaded_at, origin, registered=False)
    settle_batches(spark, sales_path, registry_root, approve)
    return read_snapshot(spark, registry_root, FILES).filter(own)


_NO_FILES = "0-None-None"


def files_digests(rows: DataFrame) -> dict[int, str]:
    """One text for the set of paths of each batch, in any order; added up by Spark."""
    paths = rows.select("batch_id", "ruta").distinct()
    pair = [F.xxhash64(F.lit(seed), "ruta").cast("decimal(38,0)") for seed in (1, 2)]
    sums = paths.groupBy("batch_id").agg(F.count(F.lit(1)), *[F.sum(h) for h in pair]).collect()
    return {number: "-".join(map(str, values)) for number, *values in sums}


def _outcomes_path(sales_path: str, attempt: str) -> str:
    return f"{sales_path}/_archivos/{attempt}"


def settle_batches(spark: SparkSession, sales_path: str, registry_root: str, approve: bool = False) -> int:
    """Register the files of committed batches that are not registered yet; returns how many batches there were.

    Safe to repeat and to run beside other writers.
    """
    root = batches_root(sales_path)
    # The batch just committed, and those whose ingest died before this step.
    open_ = read_snapshot(spark, root, BATCHES).filter("not registrado").collect()
    if not open_:
        return 0
    attempts = sorted({b.intento for b in open_})
    stored = spark.read.schema(FILES).parquet(*(_outcomes_path(sales_path, a) for a in attempts))
    # An attempt may hold several batches, of which another attempt can have replaced some.
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("intento")
    counted = spark.createDataFrame([(b.intento, b.origen, b.batch_id) for b in open_], "intento string, origen string, batch_id bigint")
    rows = stored.select("*", folder).join(F.broadcast(counted), ["intento", "origen", "batch_id"], "left_semi").select(*FILES.names)

    def register(registered: DataFrame) -> DataFrame:
        changed = registered_again(registered, rows)
        if approve:
            others = registered.filter("estado = 'valido'").join(rows.select("id"), "id", "left_anti")
            changed = approve_valid(changed.unionByName(others.select(*FILES.names)))
        return changed

    merge_snapshot(registry_root, FILES, ["id"], register, spark)
    merge_snapshot(
        root, BATCHES, ["origen", "batch_id"],
        lambda batches: batches.filter(F.col("intento").isin(attempts)).withColumn("registrado", F.lit(True)), spark)
    return len(open_)
