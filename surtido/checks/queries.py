"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..fixed_values import (
    ALERT_STATES,
    DAY_FIRST_FORMATS,
    FEATURES,
    MODEL_HYBRID,
    MODEL_NETWORK,
    MODEL_TREES,
    REQUIRED_COLUMNS,
    TARGET,
    TEST_SHARE,
    TREES,
)
from ..functions.calendar import day_text, minute_text
from ..functions.coerce import to_sale_date
from ..functions.numbers import mean_of_present
from ..models import network as net
from ..models import tables
from ..models import trees as gbt
from ..models.artifacts import Artifacts, load_artifacts
from ..operators import alerts, demand, digest, evaluation, features, registry, sales, snapshots, thresholds
from ..plans.daily_alerts import run_daily_alerts
from ..plans.forecasting import forecast, forecast_horizon, rejected_requests
from ..plans.ingest import ingest_files
from ..plans.training import hash_split, train
from ..session import materialize, scratch_path
from ..sources.snapshots import read_snapshot
from ..sources.tables import append_metrics, append_sales, read_sales, read_table, write_attempt
from ..streaming.sales_stream import start_ingest
from .fixtures import AS_OF, MOMENT, fixture
from .inbox import write_empty, write_inbox, write_named

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _stock_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return demand.horizon_grid(fixture(spark, sf, "pronostico"), AS_OF)


def _position(spark: SparkSession, sf: str) -> DataFrame:
    averages = demand.sku_averages(fixture(spark, sf, "ventas"))
    return alerts.stock_position(averages, fixture(spark, sf, "inventario"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    parts = (fixture(spark, sf, name) for name in ("ventas", "inventario", "umbrales"))
    return alerts.stock_alerts(*parts, _stock_forecast(spark, sf), AS_OF)


_RAW: dict[tuple[str, str], DataFrame] = {}


def shared_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw sales texts as stored rows, the way file readers hand them over."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RAW:
        _RAW[key] = materialize(fixture(spark, sf, "ventas_raw"), "raw")
    return _RAW[key]


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- alerts ---------------------------------------------------------------

@query
def stock_alerts(spark, sf):
    return _found(spark, sf)


@query
def sku_thresholds(spark, sf):
    skus = features.distinct_skus(fixture(spark, sf, "ventas"))
    return alerts.sku_thresholds(skus, fixture(spark, sf, "umbrales"))


@query
def effective_thresholds(spark, sf):
    position = alerts.sku_thresholds(_position(spark, sf), fixture(spark, sf, "umbrales"))
    return alerts.effective_thresholds(position).select(
        "id_producto", "stock_seguridad", "umbral_minimo", "umbral_sobreabastecimiento"
    )


@query
def projected_stock(spark, sf):
    wanted = demand.horizon_demand(_stock_forecast(spark, sf))
    return alerts.projected_stock(_position(spark, sf), wanted).select(
        "id_producto", "stock_actual", "demanda_48h", "stock_proyectado"
    )


@query
def alert_upsert(spark, sf):
    updated = alerts.upsert_alerts(fixture(spark, sf, "alertas_previas"), _found(spark, sf), MOMENT)
    return updated.withColumn("creado_en", minute_text(F.col("creado_en")))


@query
def alert_status_change(spark, sf):
    changed = alerts.set_alert_states(
        fixture(spark, sf, "alertas_previas"), fixture(spark, sf, "cambios_alertas")
    )
    return changed.select("id", "sku", "tipo_alerta", "estado")


@query
def alert_status_rejects(spark, sf):
    return snapshots.split_by_state(fixture(spark, sf, "cambios_alertas"), ALERT_STATES)[1]


@query
def active_alerts(spark, sf):
    listed = alerts.list_active_alerts(fixture(spark, sf, "alertas_previas"))
    return listed.withColumn("creado_en", minute_text(F.col("creado_en")))


@query
def active_alert_count(spark, sf):
    return alerts.active_alert_count(fixture(spark, sf, "alertas_previas"))


@query
def alert_records_json(spark, sf):
    found = _found(spark, sf).select("sku", "tipo_alerta", "mensaje", "fecha_proyeccion")
    return alerts.as_json(found)


# --- digests --------------------------------------------------------------

def _routed(spark: SparkSession, sf: str) -> DataFrame:
    settings = digest.settings_with_recipient(fixture(spark, sf, "configuracion"), fixture(spark, sf, "usuarios"))
    default = settings.select("email_destinatario_alertas").first()[0]
    return digest.route_alerts(_found(spark, sf), default)


@query
def alert_recipient(spark, sf):
    return digest.settings_with_recipient(
        fixture(spark, sf, "configuracion"), fixture(spark, sf, "usuarios")
    ).select("id", "email_remitente", "perfil_destinatario_alertas", "email_destinatario_alertas")


@query
def alerts_by_recipient(spark, sf):
    return digest.alerts_by_recipient(_routed(spark, sf))


@query
def alert_digest_pages(spark, sf):
    return digest.digest_pages(_routed(spark, sf), page_rows=50)


# --- thresholds and stock tables -------------------------------------------

@query
def threshold_rules(spark, sf):
    return thresholds.check_thresholds(fixture(spark, sf, "cambios_umbrales")).select(
        "producto_id", "umbral_minimo", "umbral_sobreabastecimiento", "motivo"
    )


@query
def active_thresholds(spark, sf):
    return thresholds.active_thresholds(fixture(spark, sf, "umbrales")).select(
        "producto_id", "umbral_minimo", "umbral_sobreabastecimiento"
    )


@query
def threshold_upsert(spark, sf):
    updated = thresholds.upsert_thresholds(
        fixture(spark, sf, "umbrales"), fixture(spark, sf, "cambios_umbrales")
    )
    return updated.withColumn("updated_at", minute_text(F.col("updated_at")))


@query
def threshold_page(spark, sf):
    page = thresholds.threshold_page(fixture(spark, sf, "umbrales"), skip=20, limit=30)
    return page.select("producto_id", "umbral_minimo", day_text(F.col("updated_at")).alias("updated_at"))


@query
def stock_upsert(spark, sf):
    updated = thresholds.upsert_stock(
        fixture(spark, sf, "inventario"), fixture(spark, sf, "cambios_inventario")
    )
    return updated.withColumn("ultima_actualizacion", minute_text(F.col("ultima_actualizacion")))


# --- sales: scan, validation, cleaning --------------------------------------

@query
def sales_scan(spark, sf):
    """Sales as a job reads them: a stored table through its reader."""
    path, rows = scratch_path(spark, "sales"), fixture(spark, sf, "ventas")
    rows.write.parquet(path)
    return read_table(spark, path, rows.schema)


@query
def required_columns(spark, sf):
    raw = shared_raw(spark, sf).withColumnsRenamed(
        dict(zip(("sku_raw", "fecha_raw", "cantidad_raw"), REQUIRED_COLUMNS))
    )
    return sales.project_required(raw)


@query
def coerced_sales(spark, sf):
    return sales.coerce_sales(shared_raw(spark, sf))


@query
def valid_sales(spark, sf):
    return sales.valid_sales(sales.coerce_sales(shared_raw(spark, sf)))


@query
def coerced_dates(spark, sf):
    rows = fixture(spark, sf, "fechas")
    date = F.when(F.col("dia_primero"), to_sale_date(F.col("texto"), DAY_FIRST_FORMATS))
    return rows.select("texto", "dia_primero", date.otherwise(to_sale_date(F.col("texto"))).alias("fecha"))


def _dates_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Raw sales of files of their own order each: one in two is day-first, one in five holds doubtful dates only."""
    day = "cast(l_shipdate as date)"
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").filter(
        f"l_suppkey % 5 <> 0 or (day({day}) <= 12 and day({day}) <> month({day}))").selectExpr(
        "concat('proveedor', l_suppkey, '.csv') AS source_file", "cast(l_partkey as string) AS sku_raw",
        f"date_format({day}, if(l_suppkey % 2 = 0, 'd/M/yyyy', 'M/d/yyyy')) AS fecha_raw",
        "cast(cast(l_quantity as int) as string) AS cantidad_raw")
    return materialize(sales.coerce_both_orders(raw), "both_orders")


@query
def dates_by_file(spark, sf):
    """No date of a decided file is lost or swapped; doubtful dates of an undecided one are read month first."""
    read = _dates_by_file(spark, sf)
    settled = sales.settle_dates(read, sales.date_orders(read))
    return sales.valid_sales(settled).select("source_file", "id_producto", "fecha", "cantidad_vendida")


@query
def file_date_orders(spark, sf):
    return sales.date_orders(_dates_by_file(spark, sf)).select("source_file", "orden", "fechas_dia", "fechas_mes", "fechas_ambos")


@query
def rejected_sales(spark, sf):
    return sales.rejected_sales(sales.coerce_sales(shared_raw(spark, sf)))


@query
def quality_report(spark, sf):
    return sales.quality_report(sales.coerce_sales(shared_raw(spark, sf)))


@query
def file_outcomes(spark, sf):
    return sales.file_outcomes(sales.quality_report(sales.coerce_sales(shared_raw(spark, sf)))).drop("ruta")


@query
def clean_stored_sales(spark, sf):
    return sales.clean_stored_sales(fixture(spark, sf, "ventas"))


@query
def distinct_sales(spark, sf):
    return sales.distinct_sales(fixture(spark, sf, "ventas"))


@query
def sales_counts(spark, sf):
    return sales.sales_counts(fixture(spark, sf, "ventas"))


@query
def finite_rows(spark, sf):
    return sales.drop_non_finite(fixture(spark, sf, "mediciones"), ["precio", "descuento"])


@query
def single_sku_history(spark, sf):
    return sales.sku_history(fixture(spark, sf, "ventas"), "SKU-000042")


@query
def sku_histories(spark, sf):
    active = alerts.active_alerts(fixture(spark, sf, "alertas_previas"))
    return sales.sku_histories(fixture(spark, sf, "ventas"), active.select(F.col("sku").alias("id_producto")))


@query
def appended_sales(spark, sf):
    path = scratch_path(spark, "sales")
    rows = sales.valid_sales(sales.coerce_sales(shared_raw(spark, sf)))
    for _ in range(2):  # the second write replaces the first
        append_sales(rows, path, 1, MOMENT)
    return read_sales(spark, path).select(
        "id_producto", "fecha", "cantidad_vendida", "source_file", "batch_id", "anio"
    )


@query
def replayed_sales(spark, sf):
    """A batch comes again with rows of other years, and an attempt at another is never committed."""
    path = scratch_path(spark, "sales")
    rows = sales.valid_sales(sales.coerce_sales(shared_raw(spark, sf)))
    early = F.year("fecha") < 1996
    append_sales(rows.filter(early), path, 1, MOMENT)
    append_sales(rows.filter(~early), path, 1, MOMENT)
    append_sales(rows.filter(early & (F.col("cantidad_vendida") > 25)), path, 2, MOMENT)
    write_attempt(rows, path, 2, MOMENT)
    return read_sales(spark, path).select(
        "id_producto", "fecha", "cantidad_vendida", "source_file", "batch_id", "anio"
    )


# --- file registry ----------------------------------------------------------

@query
def files_by_state(spark, sf):
    return registry.files_by_state(fixture(spark, sf, "archivos"))


@query
def registry_listing(spark, sf):
    return registry.list_files(fixture(spark, sf, "archivos"))


@query
def approved_files(spark, sf):
    return registry.list_approved(fixture(spark, sf, "archivos"))


def _last_file_changes(spark: SparkSession, sf: str, estado: str) -> DataFrame:
    last = snapshots.latest_per_key(fixture(spark, sf, "cambios_archivos"), "id", ["momento"])
    return last.filter(F.col("estado") == estado)


@query
def file_status_change(spark, sf):
    changes = fixture(spark, sf, "cambios_archivos")
    changed = registry.set_file_states(fixture(spark, sf, "archivos"), changes, ["momento"])
    return changed.select("id", "nombre_archivo", "estado")


@query
def approve_valid_files(spark, sf):
    return registry.approve_valid(fixture(spark, sf, "archivos")).select("id", "nombre_archivo", "estado")


@query
def promoted_file_count(spark, sf):
    return registry.count_valid(fixture(spark, sf, "archivos"))


@query
def mark_processed(spark, sf):
    files = fixture(spark, sf, "archivos")
    later = _last_file_changes(spark, sf, "aprobado")
    # Files approved after the training run read its snapshot stay approved.
    now = registry.set_file_states(files, later)
    return registry.mark_processed(now, registry.approved_files(files)).select("id", "estado")


@query
def delete_files(spark, sf):
    ids = _last_file_changes(spark, sf, "borrado")
    return registry.delete_files(fixture(spark, sf, "archivos"), ids).select("id", "nombre_archivo")


@query
def approved_sales(spark, sf):
    return registry.approved_sales(fixture(spark, sf, "ventas"), fixture(spark, sf, "archivos"))


@query
def training_rows_fallback(spark, sf):
    files = fixture(spark, sf, "archivos").withColumn("ruta", F.concat(F.lit("Manual_"), "ruta"))
    return registry.training_rows(fixture(spark, sf, "ventas"), files, on_empty="all")


# --- demand -----------------------------------------------------------------

@query
def sku_averages(spark, sf):
    return _round(demand.sku_averages(fixture(spark, sf, "ventas")), "promedio_historico")


@query
def first_skus(spark, sf):
    return demand.first_skus(features.distinct_skus(fixture(spark, sf, "ventas")), 50)


@query
def forecast_grid(spark, sf):
    return demand.horizon_grid(features.distinct_skus(fixture(spark, sf, "ventas")), AS_OF)


@query
def horizon_demand(spark, sf):
    return demand.horizon_demand(_stock_forecast(spark, sf))


@query
def ensemble_forecast(spark, sf):
    rows = fixture(spark, sf, "predicciones")
    combined = demand.combine_predictions(rows, ["pred_trees", "pred_network"])
    mean = mean_of_present(F.col("pred_trees"), F.col("pred_network"))
    return combined.select("id_producto", F.round(mean, 8).alias("media"), "prediccion")


# --- features ---------------------------------------------------------------

def _featured(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture(spark, sf, "ventas")
    return features.with_date_features(features.encode(rows, features.fit_encoder(rows)))


@query
def distinct_skus(spark, sf):
    return features.distinct_skus(fixture(spark, sf, "ventas"))


@query
def date_features(spark, sf):
    return features.with_date_features(fixture(spark, sf, "ventas")).drop("source_file")


@query
def label_encoder(spark, sf):
    return features.fit_encoder(fixture(spark, sf, "ventas"))


@query
def encoded_sales(spark, sf):
    return _featured(spark, sf).select(*FEATURES, TARGET)


@query
def encoded_sales_large_lookup(spark, sf):
    """The join used when the encoder is too large to broadcast."""
    rows = fixture(spark, sf, "ventas")
    return features.encode(rows, features.fit_encoder(rows), broadcast_bytes=0).drop("source_file")


@query
def unknown_sku_rows(spark, sf):
    encoder = features.fit_encoder(fixture(spark, sf, "ventas"))
    return features.unknown_skus(fixture(spark, sf, "solicitudes"), encoder)


@query
def unknown_sku_count(spark, sf):
    encoder = features.fit_encoder(fixture(spark, sf, "ventas"))
    return features.unknown_sku_count(fixture(spark, sf, "solicitudes"), encoder)


@query
def feature_ranges(spark, sf):
    return features.feature_ranges(_featured(spark, sf))


@query
def scaled_features(spark, sf):
    rows = _featured(spark, sf)
    scaled = features.scale(rows, features.fit_scaler(rows)).select(*FEATURES, TARGET)
    return _round(scaled, *FEATURES)


@query
def stratification_check(spark, sf):
    return sales.can_stratify(fixture(spark, sf, "ventas"))


@query
def hash_split_rows(spark, sf):
    return hash_split(fixture(spark, sf, "ventas")).drop("source_file")


@query
def split_sales_counts(spark, sf):
    counts = sales.sales_counts(fixture(spark, sf, "ventas"))
    return sales.split_counts(counts, "es_prueba", TEST_SHARE, "prueba")


@query
def stratified_split_rows(spark, sf):
    return sales.stratified_split(fixture(spark, sf, "ventas").drop("source_file"))


# --- metrics ----------------------------------------------------------------

@query
def model_metrics(spark, sf):
    rows = fixture(spark, sf, "predicciones").na.fill(20.0, ["pred_trees", "pred_network"])
    rows = rows.withColumn("pred_hybrid", (F.col("pred_trees") + F.col("pred_network")) / 2)
    names = {"pred_trees": "arboles", "pred_network": "red", "pred_hybrid": "hibrido"}
    return _round(evaluation.evaluate(rows, TARGET, names), "mae", "rmse", "r2")


@query
def metric_log(spark, sf):
    log = evaluation.metric_log(fixture(spark, sf, "entrenamiento"))
    return log.withColumn("fecha_registro", minute_text(F.col("fecha_registro")))


@query
def metric_series(spark, sf):
    log = evaluation.metric_series(fixture(spark, sf, "entrenamiento"))
    return log.withColumn("fecha_registro", minute_text(F.col("fecha_registro")))


@query
def appended_metrics(spark, sf):
    path, log = scratch_path(spark, "metrics"), fixture(spark, sf, "entrenamiento")
    append_metrics(log, path)
    append_metrics(evaluation.stamp_metrics(log, MOMENT), path)
    return read_table(spark, path, schemas.METRICS).withColumn(
        "fecha_registro", minute_text(F.col("fecha_registro"))
    )


# --- files to tables: batch and stream ----------------------------------------

_INBOXES: dict[tuple[str, str], str] = {}


def shared_inbox(spark: SparkSession, sf: str) -> str:
    """The raw sales as real files, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INBOXES:
        root = scratch_path(spark, "inbox")
        write_inbox(shared_raw(spark, sf), root)
        _INBOXES[key] = root
    return _INBOXES[key]


@query
def file_ingest_sales(spark, sf):
    sales_path, registry_root = scratch_path(spark, "sales"), scratch_path(spark, "registry")
    ingest_files(spark, shared_inbox(spark, sf), sales_path, registry_root, 1, MOMENT)
    name = F.element_at(F.split("source_file", "/"), -1).alias("source_file")
    return read_sales(spark, sales_path).select("id_producto", "fecha", "cantidad_vendida", name)


@query
def same_name_files(spark, sf):
    """A folder of each supplier with a file of the same name, those of one day without a quantity: each has its own outcome."""
    root, sales_path, registry_root = (scratch_path(spark, n) for n in ("inbox", "sales", "registry"))
    columns = ["carpeta", "id_producto AS SKU", "fecha AS `Fecha Venta`", "cantidad_vendida AS Cantidad"]
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_suppkey % 2 AS dia", "concat('proveedor', l_suppkey, '/dia', l_suppkey % 2) AS carpeta",
        "cast(l_partkey as string) AS id_producto", "cast(l_shipdate as date) AS fecha",
        "cast(l_quantity as int) AS cantidad_vendida")
    for day in (0, 1):
        part = lines.filter(F.col("dia") == day).selectExpr(*columns[: 4 - day])
        # A file for each supplier, so that no file grows with the table.
        write_named(part, root, "ventas.csv")
    ingest_files(spark, root, sales_path, registry_root, 1, MOMENT)
    files = read_snapshot(spark, registry_root, schemas.FILES)
    shown = F.concat_ws("/", F.slice(F.split("ruta", "/"), -2, 2)).alias("archivo")
    return files.groupBy(shown, "estado").agg(F.sum("filas_guardadas").alias("filas_guardadas"))


@query
def file_ingest_registry(spark, sf):
    sales_path, registry_root = scratch_path(spark, "sales"), scratch_path(spark, "registry")
    ingest_files(spark, shared_inbox(spark, sf), sales_path, registry_root, 1, MOMENT)
    files = read_snapshot(spark, registry_root, schemas.FILES)
    return files.select("nombre_archivo", "estado", "filas_guardadas", "mensaje")


@query
def stream_ingest(spark, sf):
    inbox, sales_path = shared_inbox(spark, sf), scratch_path(spark, "sales")
    registry_root, checkpoint = scratch_path(spark, "registry"), scratch_path(spark, "stream")
    for _ in range(2):  # the second run finds nothing new
        start_ingest(spark, inbox, sales_path, registry_root, checkpoint).awaitTermination()
    stored = read_sales(spark, sales_path).groupBy(F.col("source_file").alias("ruta")).agg(
        F.count(F.lit(1)).alias("filas"), F.sum("cantidad_vendida").alias("unidades")
    )
    files = read_snapshot(spark, registry_root, schemas.FILES).select(
        "ruta", F.col("nombre_archivo").alias("source_file"), "estado", "filas_guardadas"
    )
    return files.join(stored, "ruta", "left").drop("ruta")


@query
def stream_empty_files(spark, sf):
    """A file of each supplier, every third one empty when it arrives, and half of those filled before the second run."""
    root, sales_path, registry_root, checkpoint = (
        scratch_path(spark, n) for n in ("inbox", "sales", "registry", "stream"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_suppkey AS proveedor", "concat('proveedor', l_suppkey) AS carpeta", "cast(l_partkey as string) AS SKU",
        "cast(l_shipdate as date) AS `Fecha Venta`", "cast(l_quantity as int) AS Cantidad")
    write_named(lines.filter("proveedor % 3 <> 0").drop("proveedor"), root, "ventas.csv")
    write_empty(lines.filter("proveedor % 3 = 0"), root, "ventas.csv")
    start_ingest(spark, root, sales_path, registry_root, checkpoint).awaitTermination()
    write_named(lines.filter("proveedor % 6 = 0").drop("proveedor"), root, "ventas.csv")
    for _ in range(2):  # the third run finds nothing new
        start_ingest(spark, root, sales_path, registry_root, checkpoint).awaitTermination()
    stored = read_sales(spark, sales_path).groupBy(F.col("source_file").alias("ruta"), F.lit("aprobado").alias("estado")).agg(
        F.count(F.lit(1)).alias("filas"), F.sum("cantidad_vendida").alias("unidades"))
    files = read_snapshot(spark, registry_root, schemas.FILES).select("ruta", "estado", "filas_guardadas", "mensaje")
    folder = F.element_at(F.split("ruta", "/"), -2).alias("carpeta")
    return files.join(stored, ["ruta", "estado"], "left").select(
        folder, "estado", "filas_guardadas", "mensaje", "filas", "unidades")


# --- training and serving -------------------------------------------------------

_TRAINED: dict[tuple[str, str], tuple[str, str, DataFrame]] = {}


def shared_training(spark: SparkSession, sf: str) -> tuple[str, str, DataFrame]:
    """Artifacts, metric log path and metrics of one training run, shared by the queries below."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        root, log = scratch_path(spark, "models"), scratch_path(spark, "metrics")
        result = train(fixture(spark, sf, "ventas"), fixture(spark, sf, "archivos"), root, log, MOMENT)
        if result.status != "success":
            raise RuntimeError(result.message)
        _TRAINED[key] = (root, log, result.metrics)
    return _TRAINED[key]


def forget_training(spark: SparkSession, sf: str) -> None:
    """Let the next query that needs models train them."""
    _TRAINED.pop((spark.sparkContext.applicationId, sf), None)


def _artifacts(spark: SparkSession, sf: str) -> Artifacts:
    return load_artifacts(spark, shared_training(spark, sf)[0])


@query
def training_metrics(spark, sf):
    return shared_training(spark, sf)[2]


def _by_tables(rows: DataFrame, artifacts: Artifacts, key: str) -> DataFrame:
    """``rows`` with the scores of the stored trees and network, worked out from their tables."""
    trees = tables.tree_scores(rows, artifacts.splits, key, TREES["maxDepth"])
    return rows.join(trees, key).join(tables.network_scores(rows, artifacts.neurons, key), key)


def _close(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= F.lit(1e-7) * (1 + F.abs(F.col(b)))


@query
def training_metrics_recomputed(spark, sf):
    """Held-out rows behind each model's metrics, and whether plain SQL over the stored predictions gives those metrics."""
    measured = shared_training(spark, sf)[2]
    predictions = _artifacts(spark, sf).predictions
    names = {net.PREDICTION: MODEL_NETWORK, gbt.PREDICTION: MODEL_TREES, "pred_hybrid": MODEL_HYBRID}
    predictions.createOrReplaceTempView("predicciones_guardadas")
    again = spark.sql(" UNION ALL ".join(f"""
        SELECT '{name}' AS model, cast(sum(n) as bigint) AS filas, cast(sum(n * {TARGET}) as bigint) AS unidades,
               sum(n * abs({TARGET} - greatest({column}, 0))) / sum(n) AS mae_sql,
               sqrt(sum(n * pow({TARGET} - greatest({column}, 0), 2)) / sum(n)) AS rmse_sql,
               greatest(0, 1 - sum(n * pow({TARGET} - greatest({column}, 0), 2))
                   / (sum(n * {TARGET} * {TARGET}) - pow(sum(n * {TARGET}), 2) / sum(n))) AS r2_sql
        FROM predicciones_guardadas""" for column, name in names.items()))
    same = _close("mae_sql", "mae") & _close("rmse_sql", "rmse") & _close("r2_sql", "r2")
    return again.join(measured, "model").select("model", "filas", "unidades", same.alias("coincide"))


@query
def tree_predictions_by_splits(spark, sf):
    """Every held-out row, and whether a walk over the stored nodes gives the prediction of the trees."""
    artifacts = _artifacts(spark, sf)
    rows = materialize(artifacts.predictions.withColumn("fila", F.monotonically_increasing_id()), "held_out")
    scores = tables.tree_scores(rows, artifacts.splits, "fila", TREES["maxDepth"])
    return rows.join(scores, "fila").select(
        "id_producto", "fecha", "cantidad_vendida", F.col("n").cast("bigint").alias("n"),
        _close("pred_arboles", gbt.PREDICTION).alias("coincide"))


def _recomputed(spark: SparkSession, sf: str, forecasts: DataFrame) -> DataFrame:
    """Each forecast, and whether the tables of the models give it: scaled features, both scores, mean, whole units."""
    artifacts = _artifacts(spark, sf)
    asked = materialize(forecasts.distinct().withColumn("fila", F.monotonically_increasing_id()), "asked")
    rows = features.scale(features.with_date_features(features.encode(asked, artifacts.encoder)), artifacts.ranges)
    mean = (F.col("pred_arboles") + F.col("pred_red")) / 2
    # A mean next to a whole number may be rounded either way.
    low, high = (F.greatest(F.ceil(mean + e), F.lit(0)) for e in (-1e-7, 1e-7))
    return _by_tables(rows, artifacts, "fila").select(
        "id_producto", "fecha", F.col("prediccion").between(low, high).alias("coincide"))


@query
def request_forecasts_recomputed(spark, sf):
    return _recomputed(spark, sf, request_forecasts(spark, sf))


@query
def horizon_forecasts_recomputed(spark, sf):
    return _recomputed(spark, sf, horizon_forecasts(spark, sf))


@query
def stored_encoder(spark, sf):
    return _artifacts(spark, sf).encoder


@query
def request_forecasts(spark, sf):
    return forecast(fixture(spark, sf, "solicitudes"), _artifacts(spark, sf))


@query
def horizon_forecasts(spark, sf):
    skus = features.distinct_skus(fixture(spark, sf, "ventas"))
    return forecast_horizon(skus, _artifacts(spark, sf), AS_OF)


@query
def stored_scaler(spark, sf):
    rows = [(name, *ends) for name, ends in _artifacts(spark, sf).ranges.items()]
    return spark.createDataFrame(rows, "columna string, minimo double, maximo double")


@query
def request_forecast_keys(spark, sf):
    """Which requests get a forecast; the numbers themselves are the models'."""
    return forecast(fixture(spark, sf, "solicitudes"), _artifacts(spark, sf)).select("id_producto", "fecha")


@query
def rejected_forecast_requests(spark, sf):
    return rejected_requests(fixture(spark, sf, "solicitudes"), _artifacts(spark, sf))


@query
def horizon_forecast_keys(spark, sf):
    return horizon_forecasts(spark, sf).select("id_producto", "fecha")


@query
def daily_alerts_of_given_forecasts(spark, sf):
    """The whole daily job, fed with forecasts that SQL can follow."""
    names = ("ventas", "inventario", "umbrales", "configuracion", "usuarios")
    tables = [fixture(spark, sf, name) for name in names]
    run = run_daily_alerts(
        *tables, None, scratch_path(spark, "alerts"), AS_OF, MOMENT, forecasts=_stock_forecast(spark, sf))
    return run.alerts.select("sku", "tipo_alerta", "mensaje", "fecha_proyeccion", "estado")


@query
def daily_alert_run(spark, sf):
    names = ("ventas", "inventario", "umbrales", "configuracion", "usuarios")
    tables = [fixture(spark, sf, name) for name in names]
    root = scratch_path(spark, "alerts")
    run = run_daily_alerts(*tables, _artifacts(spark, sf), root, AS_OF, MOMENT)
    return run.alerts.select("sku", "tipo_alerta", "mensaje", "fecha_proyeccion", "estado")
