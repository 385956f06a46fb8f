"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    fields = [part.split() for part in text.strip().split(",")]
    kinds = {
        "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
        "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
        "boolean": T.BooleanType(),
    }
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


RAW_SALES = _schema("source_file string, sku_raw string, fecha_raw string, cantidad_raw string")
FILE_PROBLEMS = _schema("source_file string, problema string")
SALES = _schema(
    "id_producto string, fecha date, cantidad_vendida int, source_file string,"
    "fecha_carga timestamp, origen string, batch_id bigint, anio int"
)
FILES = _schema(
    "id bigint, nombre_archivo string, fecha_carga timestamp, estado string,"
    "filas_guardadas bigint, mensaje string, cargado_por string, ruta string, origen string, batch_id bigint"
)
BATCHES = _schema(
    "origen string, batch_id bigint, intento string, huella string, fecha_carga timestamp, registrado boolean"
)
ARRIVALS = _schema("origen string, ruta string, bytes bigint, batch_id bigint")
ALERTS = _schema(
    "id string, sku string, tipo_alerta string, mensaje string, fecha_proyeccion date,"
    "estado string, creado_en timestamp"
)
THRESHOLDS = _schema(
    "producto_id string, umbral_minimo int, umbral_sobreabastecimiento int,"
    "email_notificacion string, is_active boolean, updated_by string, updated_at timestamp"
)
STOCK = _schema(
    "id_producto string, stock_actual int, stock_seguridad int, ultima_actualizacion timestamp"
)
METRICS = _schema("model string, mae double, rmse double, r2 double, fecha_registro timestamp")
