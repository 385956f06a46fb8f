"""SQL for DuckDB over the given tables, one text per exactly checkable query."""

from __future__ import annotations

from ..fixed_values import (
    FEATURES,
    MISSING_MARKERS,
    MODEL_HYBRID,
    MODEL_NETWORK,
    MODEL_TREES,
    MSG_BAD_FORMAT,
    MSG_EMPTY_FILE,
    MSG_MISSING_COLUMNS,
    MSG_NO_VALID_ROWS,
    MSG_QUIEBRE,
    MSG_SAVED,
    MSG_SOBRESTOCK,
)
from ..operators.digest import PAGE_END, PAGE_START
from .fixtures import fixture_sql


def _text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def _with(names: str, body: str, *extra: str) -> str:
    """``body`` after the named fixtures and further ``WITH`` entries."""
    head = ", ".join(part for part in (fixture_sql(*names.split()), *extra) if part)
    return f"{head} {body}"


_MARKERS = ", ".join(map(_text, MISSING_MARKERS))

# --- shared steps -------------------------------------------------------------

_PROMEDIOS = """promedios AS (
    SELECT id_producto, coalesce(avg(cantidad_vendida), 10.0) AS promedio_historico
    FROM ventas GROUP BY id_producto)"""
_REJILLA = """rejilla AS (
    SELECT p.id_producto, d.fecha, p.prediccion FROM pronostico p
    CROSS JOIN (SELECT DATE '2001-11-06' AS fecha UNION ALL SELECT DATE '2001-11-07') d)"""
_DEMANDA = """demanda AS (
    SELECT id_producto, CAST(sum(coalesce(prediccion, 0)) AS BIGINT) AS demanda_48h
    FROM rejilla GROUP BY id_producto)"""
_POSICION = """posicion AS (
    SELECT p.id_producto, p.promedio_historico, coalesce(i.stock_actual, 0) AS stock_actual,
           coalesce(i.stock_seguridad, CAST(trunc(p.promedio_historico * 0.5) AS INT)) AS stock_seguridad
    FROM promedios p LEFT JOIN inventario i USING (id_producto))"""
_LIMITES = """limites AS (
    SELECT p.*, u.email_notificacion,
           coalesce(u.umbral_minimo, p.stock_seguridad) AS minimo,
           coalesce(u.umbral_sobreabastecimiento, CAST(trunc(p.promedio_historico * 30) AS BIGINT)) AS maximo
    FROM posicion p LEFT JOIN umbrales u ON u.producto_id = p.id_producto AND u.is_active)"""
_PROYECTADO = """proyectado AS (
    SELECT l.*, coalesce(d.demanda_48h, 0) AS demanda_48h,
           l.stock_actual - coalesce(d.demanda_48h, 0) AS proyectado
    FROM limites l LEFT JOIN demanda d USING (id_producto))"""
_ALERTAS = f"""alertas AS (
    SELECT id_producto AS sku, 'QUIEBRE' AS tipo_alerta,
           printf({_text(MSG_QUIEBRE)}, stock_actual, demanda_48h, proyectado, minimo) AS mensaje,
           DATE '2001-11-07' AS fecha_proyeccion, nullif(email_notificacion, '') AS email_notificacion
    FROM proyectado WHERE proyectado <= minimo
    UNION ALL
    SELECT id_producto, 'SOBRESTOCK',
           printf({_text(MSG_SOBRESTOCK)}, stock_actual, demanda_48h, proyectado, maximo),
           DATE '2001-11-05', nullif(email_notificacion, '')
    FROM proyectado WHERE stock_actual > maximo AND NOT proyectado <= minimo)"""
_ALERT_STEPS = (_PROMEDIOS, _REJILLA, _DEMANDA, _POSICION, _LIMITES, _PROYECTADO, _ALERTAS)
_ALERT_INPUTS = "ventas inventario umbrales pronostico"
_RUTAS = """rutas AS (
    SELECT a.*, coalesce(a.email_notificacion, (
        SELECT u.correo_electronico FROM configuracion c
        LEFT JOIN usuarios u ON u.username = c.perfil_destinatario_alertas ORDER BY c.id LIMIT 1
    )) AS destinatario FROM alertas a)"""
_DIGEST_INPUTS = _ALERT_INPUTS + " configuracion usuarios"

_COERCIONADAS = f"""leidas AS (
    SELECT CASE WHEN trim(sku_raw) NOT IN ({_MARKERS}) THEN trim(sku_raw) END AS id_producto,
           TRY_CAST(fecha_raw AS DATE) AS fecha,
           coalesce(CAST(trunc(TRY_CAST(cantidad_raw AS DOUBLE)) AS INT), 0) AS cantidad_vendida,
           source_file, proveedor
    FROM ventas_raw),
coercionadas AS (
    SELECT *, CASE WHEN fecha IS NULL THEN 'fecha' WHEN cantidad_vendida <= 0 THEN 'cantidad'
                   WHEN id_producto IS NULL THEN 'sku' END AS motivo
    FROM leidas)"""
# Day and month in the order of each file; files of doubtful dates only cannot tell theirs.
_ORDENES = """archivos_de_fechas AS (
    SELECT concat('proveedor', l_suppkey, '.csv') AS source_file, CAST(l_partkey AS VARCHAR) AS id_producto, CAST(l_shipdate AS DATE) AS f,
           CAST(l_quantity AS INT) AS cantidad_vendida, l_suppkey % 2 AS impar,
           bool_and(day(CAST(l_shipdate AS DATE)) <= 12) OVER (PARTITION BY l_suppkey) OR l_suppkey % 5 = 0 AS suelta
    FROM lineitem
    WHERE l_suppkey % 5 <> 0 OR (day(CAST(l_shipdate AS DATE)) <= 12 AND day(CAST(l_shipdate AS DATE)) <> month(CAST(l_shipdate AS DATE))))"""
_COERCED = "id_producto, fecha, cantidad_vendida, source_file"
_REGISTRO = f"""registro AS (
    SELECT source_file AS nombre_archivo,
           CASE WHEN n > 0 THEN 'valido' ELSE 'invalido' END AS estado, n AS filas_guardadas,
           CASE WHEN ilegible THEN {_text(MSG_BAD_FORMAT)}
                WHEN incompleto THEN {_text(MSG_MISSING_COLUMNS + "Cantidad")}
                WHEN n > 0 THEN {_text(MSG_SAVED)} ELSE {_text(MSG_NO_VALID_ROWS)} END AS mensaje
    FROM (SELECT source_file, source_file LIKE '%.txt' AS ilegible, proveedor % 20 = 0 AS incompleto,
                 count(*) FILTER (WHERE motivo IS NULL AND source_file NOT LIKE '%.txt' AND proveedor % 20 <> 0) AS n
          FROM coercionadas GROUP BY ALL) t)"""
_LEGIBLES = "motivo IS NULL AND source_file NOT LIKE '%.txt' AND proveedor % 20 <> 0"

# SKUs of the approved files, which are those that a model knows.
_APRENDIDOS = """SELECT DISTINCT id_producto FROM ventas v WHERE EXISTS (
    SELECT 1 FROM archivos a WHERE a.estado = 'aprobado' AND a.ruta = v.source_file)"""

# Held-out sales of approved files: a fifth of the copies of each row by hash; the first row keeps one, the last gives one up.
def _apartadas() -> str:
    return f"""apartadas AS (
    SELECT id_producto, fecha, cantidad_vendida, t AS n FROM (
        SELECT *, greatest(
            least(n // 5 + CASE WHEN {_below('prueba', '(n % 5)')} THEN 1 ELSE 0 END,
                  n - CASE WHEN ultima THEN 1 ELSE 0 END),
            CASE WHEN primera THEN 1 ELSE 0 END) AS t
        FROM (
            SELECT id_producto, fecha, cantidad_vendida, count(*) AS n,
                   row_number() OVER (ORDER BY id_producto, fecha, cantidad_vendida) = 1 AS primera,
                   row_number() OVER (ORDER BY id_producto DESC, fecha DESC, cantidad_vendida DESC) = 1 AS ultima
            FROM ventas v WHERE EXISTS (SELECT 1 FROM archivos a WHERE a.estado = 'aprobado' AND a.ruta = v.source_file)
            GROUP BY 1, 2, 3) c) h
    WHERE t > 0)"""


_CODIGOS = """codigos AS (
    SELECT id_producto, CAST(row_number() OVER (ORDER BY id_producto) - 1 AS INT) AS id_producto_encoded
    FROM (SELECT DISTINCT id_producto FROM ventas) t)"""
_RASGOS = """rasgos AS (
    SELECT c.id_producto_encoded, CAST(month(v.fecha) AS INT) AS mes, CAST(year(v.fecha) AS INT) AS anio,
           CAST(isodow(v.fecha) - 1 AS INT) AS dia_semana, CAST(day(v.fecha) AS INT) AS dia,
           v.cantidad_vendida
    FROM ventas v JOIN codigos c USING (id_producto))"""


def _escaped(column: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = f"replace({column}, '{sign}', '{name}')"
    return column


def _minute(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M') AS {column}"


def _last(table: str, key: str, order: str) -> str:
    """The last row of each key by the descending ``order`` expressions."""
    ordered = ", ".join(f"{c} DESC NULLS LAST" for c in order.split())
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {ordered}) = 1"


def _below(salt: str, num: str = "1") -> str:
    key = f"concat_ws('|', '{salt}', id_producto, CAST(fecha AS VARCHAR), CAST(cantidad_vendida AS VARCHAR))"
    return f"CAST(concat('0x', substring(md5({key}), 1, 8)) AS BIGINT) * 5 < {num} * 4294967296"


def _metrics(name: str, column: str) -> str:
    error = f"(cantidad_vendida - greatest({column}, 0))"
    return f"""
        SELECT '{name}' AS model, round(avg(abs({error})), 6) AS mae,
               round(sqrt(avg({error} * {error})), 6) AS rmse,
               round(greatest(0.0, 1 - sum({error} * {error}) / (var_pop(cantidad_vendida) * count(*))), 6) AS r2
        FROM p"""


ORACLES = {
    # --- alerts
    "stock_alerts": _with(_ALERT_INPUTS, "SELECT * FROM alertas", *_ALERT_STEPS),
    "sku_thresholds": _with(
        "ventas umbrales",
        """SELECT s.id_producto, u.umbral_minimo, u.umbral_sobreabastecimiento, u.email_notificacion
           FROM (SELECT DISTINCT id_producto FROM ventas) s
           LEFT JOIN umbrales u ON u.producto_id = s.id_producto AND u.is_active""",
    ),
    "effective_thresholds": _with(
        "ventas inventario umbrales",
        """SELECT id_producto, stock_seguridad, minimo AS umbral_minimo,
                  maximo AS umbral_sobreabastecimiento FROM limites""",
        _PROMEDIOS, _POSICION, _LIMITES,
    ),
    "projected_stock": _with(
        "ventas inventario pronostico",
        """SELECT p.id_producto, p.stock_actual, coalesce(d.demanda_48h, 0) AS demanda_48h,
                  p.stock_actual - coalesce(d.demanda_48h, 0) AS stock_proyectado
           FROM posicion p LEFT JOIN demanda d USING (id_producto)""",
        _PROMEDIOS, _REJILLA, _DEMANDA, _POSICION,
    ),
    "alert_upsert": _with(
        _ALERT_INPUTS + " alertas_previas",
        f"""SELECT p.id, p.sku, p.tipo_alerta, coalesce(a.mensaje, p.mensaje) AS mensaje,
                   coalesce(a.fecha_proyeccion, p.fecha_proyeccion) AS fecha_proyeccion, p.estado,
                   CASE WHEN a.sku IS NOT NULL THEN '2001-11-05 06:00'
                        ELSE strftime(p.creado_en, '%Y-%m-%d %H:%M') END AS creado_en
            FROM alertas_previas p LEFT JOIN alertas a
              ON p.estado = 'PENDIENTE' AND a.sku = p.sku AND a.tipo_alerta = p.tipo_alerta
            UNION ALL
            SELECT substring(sha256(concat_ws('|', a.sku, a.tipo_alerta, CAST(epoch_us(TIMESTAMP '2001-11-05 06:00:00') AS VARCHAR))), 1, 32),
                   a.sku, a.tipo_alerta, a.mensaje, a.fecha_proyeccion, 'PENDIENTE', '2001-11-05 06:00'
            FROM alertas a WHERE NOT EXISTS (
                SELECT 1 FROM alertas_previas p WHERE p.estado = 'PENDIENTE'
                   AND a.sku = p.sku AND a.tipo_alerta = p.tipo_alerta)""",
        *_ALERT_STEPS,
    ),
    "alert_status_change": _with(
        "alertas_previas cambios_alertas",
        """SELECT p.id, p.sku, p.tipo_alerta, coalesce(c.estado, p.estado) AS estado
           FROM alertas_previas p LEFT JOIN (
               SELECT id, max(estado) AS estado FROM cambios_alertas
               WHERE estado IN ('PENDIENTE', 'EN GESTIÓN', 'DESCARTADA') GROUP BY id) c USING (id)""",
    ),
    "alert_status_rejects": _with(
        "cambios_alertas",
        """SELECT id, estado FROM cambios_alertas
           WHERE estado IS NULL OR estado NOT IN ('PENDIENTE', 'EN GESTIÓN', 'DESCARTADA')""",
    ),
    "active_alerts": _with(
        "alertas_previas",
        f"""SELECT id, sku, tipo_alerta, mensaje, fecha_proyeccion, estado, {_minute('creado_en')}
            FROM alertas_previas a WHERE estado IN ('PENDIENTE', 'EN GESTIÓN')
            ORDER BY a.creado_en DESC, id""",
    ),
    "active_alert_count": _with(
        "alertas_previas",
        "SELECT count(*) AS alertas_activas FROM alertas_previas WHERE estado IN ('PENDIENTE', 'EN GESTIÓN')",
    ),
    "alert_records_json": _with(
        _ALERT_INPUTS,
        """SELECT CAST(to_json({'sku': sku, 'tipo_alerta': tipo_alerta, 'mensaje': mensaje,
                                'fecha_proyeccion': fecha_proyeccion}) AS VARCHAR) AS registro FROM alertas""",
        *_ALERT_STEPS,
    ),
    # --- digests
    "alert_recipient": _with(
        "configuracion usuarios",
        """SELECT c.id, c.email_remitente, c.perfil_destinatario_alertas,
                  u.correo_electronico AS email_destinatario_alertas
           FROM configuracion c LEFT JOIN usuarios u ON u.username = c.perfil_destinatario_alertas
           ORDER BY c.id LIMIT 1""",
    ),
    "alerts_by_recipient": _with(
        _DIGEST_INPUTS, "SELECT destinatario, count(*) AS n_alertas FROM rutas GROUP BY 1", *_ALERT_STEPS, _RUTAS
    ),
    "alert_digest_pages": _with(
        _DIGEST_INPUTS,
        f"""SELECT destinatario, pagina, count(*) AS n_alertas,
                   concat({_text(PAGE_START)}, string_agg(
                       concat('<li data-kind="', CASE tipo_alerta WHEN 'QUIEBRE' THEN 'short' ELSE 'excess' END,
                              '"><code>', {_escaped('sku')}, '</code> <time>', CAST(fecha_proyeccion AS VARCHAR),
                              '</time> ', {_escaped('mensaje')}, '</li>'),
                       '' ORDER BY sku, tipo_alerta), {_text(PAGE_END)}) AS html
            FROM (SELECT *, CAST(floor((row_number() OVER (
                      PARTITION BY destinatario ORDER BY sku, tipo_alerta) - 1) / 50) AS INT) AS pagina
                  FROM rutas) t
            GROUP BY destinatario, pagina""",
        *_ALERT_STEPS, _RUTAS,
    ),
    # --- thresholds and stock
    "threshold_rules": _with(
        "cambios_umbrales",
        """SELECT producto_id, umbral_minimo, umbral_sobreabastecimiento,
                  CASE WHEN producto_id IS NULL THEN 'producto_id'
                       WHEN umbral_minimo IS NULL OR umbral_minimo < 0 THEN 'umbral_minimo'
                       WHEN umbral_sobreabastecimiento IS NULL OR umbral_sobreabastecimiento <= 0
                            THEN 'umbral_sobreabastecimiento'
                       WHEN umbral_sobreabastecimiento <= umbral_minimo THEN 'orden' END AS motivo
           FROM cambios_umbrales""",
    ),
    "active_thresholds": _with(
        "umbrales", "SELECT producto_id, umbral_minimo, umbral_sobreabastecimiento FROM umbrales WHERE is_active"
    ),
    "threshold_upsert": _with(
        "umbrales cambios_umbrales",
        f"""SELECT coalesce(n.producto_id, o.producto_id) AS producto_id,
                   CASE WHEN n.producto_id IS NOT NULL THEN n.umbral_minimo ELSE o.umbral_minimo END AS umbral_minimo,
                   CASE WHEN n.producto_id IS NOT NULL THEN n.umbral_sobreabastecimiento
                        ELSE o.umbral_sobreabastecimiento END AS umbral_sobreabastecimiento,
                   coalesce(nullif(o.email_notificacion, ''), n.email_notificacion) AS email_notificacion,
                   CASE WHEN n.producto_id IS NOT NULL THEN n.is_active ELSE o.is_active END AS is_active,
                   coalesce(n.updated_by, o.updated_by) AS updated_by,
                   strftime(coalesce(n.updated_at, o.updated_at), '%Y-%m-%d %H:%M') AS updated_at
            FROM umbrales o FULL JOIN ultimos n ON n.producto_id = o.producto_id""",
        """buenos AS (SELECT * FROM cambios_umbrales WHERE umbral_minimo >= 0
             AND umbral_sobreabastecimiento > 0 AND umbral_sobreabastecimiento > umbral_minimo)""",
        "ultimos AS (" + _last(
            "buenos", "producto_id",
            "updated_at umbral_minimo umbral_sobreabastecimiento email_notificacion is_active updated_by",
        ) + ")",
    ),
    "threshold_page": _with(
        "umbrales",
        """SELECT producto_id, umbral_minimo, strftime(updated_at, '%Y-%m-%d') AS updated_at
           FROM umbrales u ORDER BY u.updated_at DESC, producto_id LIMIT 30 OFFSET 20""",
    ),
    "stock_upsert": _with(
        "inventario cambios_inventario",
        """SELECT coalesce(n.id_producto, o.id_producto) AS id_producto,
                  CASE WHEN n.id_producto IS NOT NULL THEN n.stock_actual ELSE o.stock_actual END AS stock_actual,
                  CASE WHEN n.id_producto IS NOT NULL THEN n.stock_seguridad
                       ELSE o.stock_seguridad END AS stock_seguridad,
                  strftime(coalesce(n.ultima_actualizacion, o.ultima_actualizacion), '%Y-%m-%d %H:%M')
                      AS ultima_actualizacion
           FROM inventario o FULL JOIN ultimos n ON n.id_producto = o.id_producto""",
        "ultimos AS (" + _last(
            "cambios_inventario", "id_producto", "ultima_actualizacion stock_actual stock_seguridad"
        ) + ")",
    ),
    # --- sales
    "sales_scan": _with("ventas", "SELECT * FROM ventas"),
    "required_columns": _with(
        "ventas_raw",
        """SELECT sku_raw AS id_producto, fecha_raw AS fecha, cantidad_raw AS cantidad_vendida, source_file
           FROM ventas_raw""",
    ),
    "coerced_sales": _with("ventas_raw", f"SELECT {_COERCED}, motivo FROM coercionadas", _COERCIONADAS),
    "valid_sales": _with(
        "ventas_raw", f"SELECT {_COERCED} FROM coercionadas WHERE motivo IS NULL", _COERCIONADAS
    ),
    "dates_by_file": f"""WITH {_ORDENES}
        SELECT source_file, id_producto, CASE WHEN suelta AND impar = 0 THEN make_date(year(f), day(f), month(f)) ELSE f END AS fecha,
               cantidad_vendida FROM archivos_de_fechas""",
    "file_date_orders": f"""WITH {_ORDENES}
        SELECT source_file, CASE WHEN count(*) FILTER (WHERE day(f) > 12) = 0 THEN 'indeciso' WHEN impar = 0 THEN 'dia' ELSE 'mes' END AS orden,
               count(*) FILTER (WHERE day(f) > 12 AND impar = 0) AS fechas_dia, count(*) FILTER (WHERE day(f) > 12 AND impar = 1) AS fechas_mes,
               count(*) FILTER (WHERE day(f) <= 12 AND day(f) <> month(f)) AS fechas_ambos
        FROM archivos_de_fechas GROUP BY source_file, impar HAVING count(*) FILTER (WHERE day(f) <= 12 AND day(f) <> month(f)) > 0""",
    "rejected_sales": _with(
        "ventas_raw", f"SELECT {_COERCED}, motivo FROM coercionadas WHERE motivo IS NOT NULL", _COERCIONADAS
    ),
    "quality_report": _with(
        "ventas_raw",
        """SELECT source_file, count(*) AS filas_leidas, count(*) FILTER (WHERE motivo IS NULL) AS filas_validas,
                  count(*) FILTER (WHERE motivo IS NOT NULL) AS filas_descartadas,
                  count(*) FILTER (WHERE motivo = 'fecha') AS fecha_invalida,
                  count(*) FILTER (WHERE motivo = 'cantidad') AS cantidad_invalida, count(*) FILTER (WHERE motivo = 'sku') AS sku_invalido
           FROM coercionadas GROUP BY source_file""",
        _COERCIONADAS,
    ),
    "file_outcomes": _with(
        "ventas_raw",
        f"""SELECT source_file AS nombre_archivo,
                   CASE WHEN count(*) FILTER (WHERE motivo IS NULL) > 0 THEN 'valido' ELSE 'invalido' END AS estado,
                   count(*) FILTER (WHERE motivo IS NULL) AS filas_guardadas,
                   CASE WHEN count(*) FILTER (WHERE motivo IS NULL) > 0 THEN {_text(MSG_SAVED)} ELSE {_text(MSG_NO_VALID_ROWS)} END AS mensaje
            FROM coercionadas GROUP BY source_file""",
        _COERCIONADAS,
    ),
    "clean_stored_sales": _with(
        "ventas",
        """SELECT DISTINCT id_producto, fecha, cantidad_vendida FROM ventas
           WHERE fecha IS NOT NULL AND cantidad_vendida > 0""",
    ),
    "distinct_sales": _with("ventas", "SELECT DISTINCT id_producto, fecha, cantidad_vendida FROM ventas"),
    "sales_counts": _with(
        "ventas", "SELECT id_producto, fecha, cantidad_vendida, count(*) AS n FROM ventas GROUP BY 1, 2, 3"
    ),
    "finite_rows": _with(
        "mediciones",
        "SELECT id_producto, precio, descuento FROM mediciones WHERE isfinite(precio) AND isfinite(descuento)",
    ),
    "single_sku_history": _with(
        "ventas",
        """SELECT CAST(fecha AS VARCHAR) AS fecha, cantidad_vendida FROM ventas v
           WHERE id_producto = 'SKU-000042' ORDER BY v.fecha""",
    ),
    "sku_histories": _with(
        "ventas alertas_previas",
        """SELECT id_producto, CAST(fecha AS VARCHAR) AS fecha, cantidad_vendida FROM ventas v
           WHERE EXISTS (SELECT 1 FROM alertas_previas a WHERE a.sku = v.id_producto
                         AND a.estado IN ('PENDIENTE', 'EN GESTIÓN'))
           ORDER BY id_producto, v.fecha, cantidad_vendida""",
    ),
    "appended_sales": _with(
        "ventas_raw",
        f"""SELECT {_COERCED}, CAST(1 AS BIGINT) AS batch_id, CAST(year(fecha) AS INT) AS anio
            FROM coercionadas WHERE motivo IS NULL""",
        _COERCIONADAS,
    ),
    "replayed_sales": _with(
        "ventas_raw",
        f"""SELECT {_COERCED}, CAST(CASE WHEN year(fecha) < 1996 THEN 2 ELSE 1 END AS BIGINT) AS batch_id,
                   CAST(year(fecha) AS INT) AS anio
            FROM coercionadas WHERE motivo IS NULL AND (year(fecha) >= 1996 OR cantidad_vendida > 25)""",
        _COERCIONADAS,
    ),
    # --- registry
    "files_by_state": _with(
        "archivos",
        """SELECT count(*) AS total, count(*) FILTER (WHERE estado = 'valido') AS valido,
                  count(*) FILTER (WHERE estado = 'aprobado') AS aprobado, count(*) FILTER (WHERE estado = 'procesado') AS procesado,
                  count(*) FILTER (WHERE estado = 'invalido') AS invalido FROM archivos""",
    ),
    "registry_listing": _with(
        "archivos",
        f"""SELECT id, nombre_archivo, {_minute('fecha_carga')}, estado, filas_guardadas, mensaje, cargado_por, ruta
            FROM archivos a ORDER BY a.fecha_carga DESC, id""",
    ),
    "approved_files": _with(
        "archivos",
        f"""SELECT id, nombre_archivo, {_minute('fecha_carga')}, filas_guardadas
            FROM archivos a WHERE estado = 'aprobado' ORDER BY a.fecha_carga, id""",
    ),
    "file_status_change": _with(
        "archivos cambios_archivos",
        """SELECT a.id, a.nombre_archivo, coalesce(c.estado, a.estado) AS estado
           FROM archivos a LEFT JOIN ultimos c USING (id)""",
        """permitidos AS (SELECT * FROM cambios_archivos
             WHERE estado IN ('valido', 'aprobado', 'procesado', 'invalido'))""",
        f"ultimos AS ({_last('permitidos', 'id', 'momento estado')})",
    ),
    "approve_valid_files": _with(
        "archivos",
        """SELECT id, nombre_archivo, CASE WHEN estado = 'valido' THEN 'aprobado' ELSE estado END AS estado
           FROM archivos""",
    ),
    "promoted_file_count": _with(
        "archivos", "SELECT count(*) AS promovidos FROM archivos WHERE estado = 'valido'"
    ),
    "mark_processed": _with(
        "archivos cambios_archivos",
        """SELECT a.id, CASE WHEN a.estado = 'aprobado' THEN 'procesado'
                             WHEN u.estado = 'aprobado' THEN 'aprobado' ELSE a.estado END AS estado
           FROM archivos a LEFT JOIN ultimos u ON u.id = a.id AND u.estado = 'aprobado'""",
        f"ultimos AS ({_last('cambios_archivos', 'id', 'momento estado')})",
    ),
    "delete_files": _with(
        "archivos cambios_archivos",
        """SELECT id, nombre_archivo FROM archivos
           WHERE id NOT IN (SELECT id FROM ultimos WHERE estado = 'borrado')""",
        f"ultimos AS ({_last('cambios_archivos', 'id', 'momento estado')})",
    ),
    "approved_sales": _with(
        "ventas archivos",
        """SELECT * FROM ventas v WHERE EXISTS (SELECT 1 FROM archivos a
             WHERE a.estado = 'aprobado' AND a.ruta = v.source_file)""",
    ),
    "training_rows_fallback": _with("ventas", "SELECT * FROM ventas"),
    # --- demand
    "sku_averages": _with(
        "ventas",
        "SELECT id_producto, round(promedio_historico, 6) AS promedio_historico FROM promedios", _PROMEDIOS,
    ),
    "first_skus": _with("ventas", "SELECT DISTINCT id_producto FROM ventas ORDER BY 1 LIMIT 50"),
    "forecast_grid": _with(
        "ventas",
        """SELECT s.id_producto, d.fecha FROM (SELECT DISTINCT id_producto FROM ventas) s
           CROSS JOIN (SELECT DATE '2001-11-06' AS fecha UNION ALL SELECT DATE '2001-11-07') d""",
    ),
    "horizon_demand": _with("pronostico", "SELECT * FROM demanda", _REJILLA, _DEMANDA),
    "ensemble_forecast": _with(
        "predicciones",
        """SELECT id_producto, round(media, 8) AS media,
                  CASE WHEN media IS NOT NULL THEN CAST(ceil(greatest(media, 0)) AS INT) END AS prediccion
           FROM (SELECT id_producto, CASE WHEN pred_trees IS NULL THEN pred_network
                          WHEN pred_network IS NULL THEN pred_trees
                          ELSE (pred_trees + pred_network) / 2 END AS media FROM predicciones) t""",
    ),
    # --- features
    "distinct_skus": _with("ventas", "SELECT DISTINCT id_producto FROM ventas"),
    "date_features": _with(
        "ventas",
        """SELECT id_producto, fecha, cantidad_vendida, CAST(month(fecha) AS INT) AS mes,
                  CAST(year(fecha) AS INT) AS anio, CAST(isodow(fecha) - 1 AS INT) AS dia_semana,
                  CAST(day(fecha) AS INT) AS dia FROM ventas""",
    ),
    "label_encoder": _with("ventas", "SELECT * FROM codigos", _CODIGOS),
    "encoded_sales": _with("ventas", "SELECT * FROM rasgos", _CODIGOS, _RASGOS),
    "encoded_sales_large_lookup": _with(
        "ventas",
        "SELECT id_producto, fecha, cantidad_vendida, id_producto_encoded FROM ventas JOIN codigos USING (id_producto)",
        _CODIGOS,
    ),
    "unknown_sku_rows": _with(
        "ventas solicitudes",
        "SELECT * FROM solicitudes WHERE id_producto NOT IN (SELECT id_producto FROM ventas)",
    ),
    "unknown_sku_count": _with(
        "ventas solicitudes",
        """SELECT count(*) AS filas_desconocidas FROM solicitudes
           WHERE id_producto NOT IN (SELECT id_producto FROM ventas)""",
    ),
    "feature_ranges": _with(
        "ventas",
        "SELECT " + ", ".join(
            f"CAST({fn}({c}) AS DOUBLE) AS {c}_{fn}" for c in FEATURES for fn in ("min", "max")
        ) + " FROM rasgos",
        _CODIGOS, _RASGOS,
    ),
    "scaled_features": _with(
        "ventas",
        "SELECT " + ", ".join(
            f"round((CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}"
            for c in FEATURES
        ) + ", cantidad_vendida FROM rasgos",
        _CODIGOS, _RASGOS,
    ),
    "stratification_check": _with(
        "ventas",
        """SELECT count(*) AS n_skus, min(n) AS min_muestras, count(*) > 1 AND min(n) >= 2 AS estratificable
           FROM (SELECT count(*) AS n FROM ventas GROUP BY id_producto) t""",
    ),
    "hash_split_rows": _with(
        "ventas", f"SELECT id_producto, fecha, cantidad_vendida, {_below('prueba')} AS es_prueba FROM ventas"
    ),
    "split_sales_counts": _with(
        "ventas",
        """SELECT id_producto, fecha, cantidad_vendida, true AS es_prueba, t AS n FROM c WHERE t > 0
           UNION ALL
           SELECT id_producto, fecha, cantidad_vendida, false, n - t FROM c WHERE n > t""",
        f"""c AS (SELECT *, n // 5 + CASE WHEN {_below('prueba', '(n % 5)')} THEN 1 ELSE 0 END AS t
             FROM (SELECT id_producto, fecha, cantidad_vendida, count(*) AS n FROM ventas GROUP BY 1, 2, 3) g)""",
    ),
    "stratified_split_rows": _with(
        "ventas",
        """SELECT id_producto, fecha, cantidad_vendida, (row_number() OVER (ORDER BY id_producto, substring(md5(
               concat_ws('|', id_producto, CAST(fecha AS VARCHAR), CAST(cantidad_vendida AS VARCHAR))), 1, 15)) - 1) % 5 = 0
               AS es_prueba
           FROM ventas""",
    ),
    # --- metrics
    "model_metrics": _with(
        "predicciones",
        " UNION ALL ".join([
            _metrics("arboles", "t"), _metrics("red", "r"), _metrics("hibrido", "((t + r) / 2)")
        ]),
        """p AS (SELECT cantidad_vendida, coalesce(pred_trees, 20.0) AS t, coalesce(pred_network, 20.0) AS r
                 FROM predicciones)""",
    ),
    "metric_log": _with(
        "entrenamiento",
        f"""SELECT model, mae, rmse, r2, {_minute('fecha_registro')}
            FROM entrenamiento e ORDER BY e.fecha_registro DESC, model""",
    ),
    "metric_series": _with(
        "entrenamiento",
        f"SELECT {_minute('fecha_registro')}, mae, rmse FROM entrenamiento e ORDER BY e.fecha_registro",
    ),
    "appended_metrics": _with(
        "entrenamiento",
        f"""SELECT model, mae, rmse, r2, {_minute('fecha_registro')} FROM entrenamiento
            UNION ALL SELECT model, mae, rmse, r2, '2001-11-05 06:00' FROM entrenamiento""",
    ),
    "coerced_dates": _with(
        "fechas", "SELECT texto, dia_primero, CAST(esperada AS DATE) AS fecha FROM fechas"
    ),
    "same_name_files": f"""
        SELECT concat('dia', CAST(l_suppkey % 2 AS VARCHAR), '/ventas.csv') AS archivo,
               CASE WHEN l_suppkey % 2 = 0 THEN 'valido' ELSE 'invalido' END AS estado,
               count(*) FILTER (WHERE l_suppkey % 2 = 0) AS filas_guardadas
        FROM lineitem GROUP BY 1, 2""",
    # --- files
    "file_ingest_sales": _with(
        "ventas_raw", f"SELECT {_COERCED} FROM coercionadas WHERE {_LEGIBLES}", _COERCIONADAS
    ),
    "file_ingest_registry": _with("ventas_raw", "SELECT * FROM registro", _COERCIONADAS, _REGISTRO),
    "stream_ingest": _with(
        "ventas_raw",
        f"""SELECT r.nombre_archivo AS source_file,
                   CASE WHEN r.estado = 'valido' THEN 'aprobado' ELSE r.estado END AS estado,
                   r.filas_guardadas, s.filas, s.unidades
            FROM registro r LEFT JOIN (
                SELECT source_file, count(*) AS filas, CAST(sum(cantidad_vendida) AS BIGINT) AS unidades
                FROM coercionadas WHERE {_LEGIBLES} GROUP BY 1) s ON s.source_file = r.nombre_archivo""",
        _COERCIONADAS, _REGISTRO,
    ),
    "stream_empty_files": f"""
        SELECT concat('proveedor', CAST(l_suppkey AS VARCHAR)) AS carpeta, 'aprobado' AS estado, count(*) AS filas_guardadas,
               {_text(MSG_SAVED)} AS mensaje, count(*) AS filas, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS unidades
        FROM lineitem WHERE l_suppkey % 3 <> 0 OR l_suppkey % 6 = 0 GROUP BY 1
        UNION ALL
        SELECT DISTINCT concat('proveedor', CAST(l_suppkey AS VARCHAR)), 'invalido', CAST(0 AS BIGINT),
               {_text(MSG_EMPTY_FILE)}, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
        FROM lineitem WHERE l_suppkey % 3 = 0""",
    "stored_scaler": _with(
        "ventas archivos",
        " UNION ALL ".join(
            f"SELECT '{c}' AS columna, CAST(min({c}) AS DOUBLE) AS minimo, CAST(max({c}) AS DOUBLE) AS maximo FROM rasgos"
            for c in FEATURES
        ),
        """aprobadas AS (SELECT * FROM ventas v WHERE EXISTS (SELECT 1 FROM archivos a
             WHERE a.estado = 'aprobado' AND a.ruta = v.source_file))""",
        _CODIGOS.replace("FROM ventas", "FROM aprobadas"), _RASGOS.replace("FROM ventas", "FROM aprobadas"),
    ),
    "training_metrics_recomputed": _with(
        "ventas archivos",
        f"""SELECT model, CAST(sum(n) AS BIGINT) AS filas, CAST(sum(n * cantidad_vendida) AS BIGINT) AS unidades, true AS coincide
            FROM apartadas, (VALUES ({_text(MODEL_TREES)}), ({_text(MODEL_NETWORK)}), ({_text(MODEL_HYBRID)})) m(model) GROUP BY model""",
        _apartadas(),
    ),
    "tree_predictions_by_splits": _with(
        "ventas archivos", "SELECT *, true AS coincide FROM apartadas", _apartadas(),
    ),
    "request_forecasts_recomputed": _with(
        "ventas archivos solicitudes",
        f"""SELECT DISTINCT id_producto, CAST(fecha_str AS DATE) AS fecha, true AS coincide
            FROM solicitudes WHERE id_producto IN ({_APRENDIDOS})""",
    ),
    "horizon_forecasts_recomputed": _with(
        "ventas archivos",
        f"""SELECT s.id_producto, d.fecha, true AS coincide FROM ({_APRENDIDOS}) s
            CROSS JOIN (SELECT DATE '2001-11-06' AS fecha UNION ALL SELECT DATE '2001-11-07') d""",
    ),
    "request_forecast_keys": _with(
        "ventas archivos solicitudes",
        f"SELECT id_producto, CAST(fecha_str AS DATE) AS fecha FROM solicitudes WHERE id_producto IN ({_APRENDIDOS})",
    ),
    "rejected_forecast_requests": _with(
        "ventas archivos solicitudes",
        f"""SELECT id_producto, fecha_str, 'sku' AS motivo FROM solicitudes
            WHERE id_producto NOT IN ({_APRENDIDOS})""",
    ),
    "horizon_forecast_keys": _with(
        "ventas archivos",
        f"""SELECT s.id_producto, d.fecha FROM ({_APRENDIDOS}) s
            CROSS JOIN (SELECT DATE '2001-11-06' AS fecha UNION ALL SELECT DATE '2001-11-07') d""",
    ),
    "daily_alerts_of_given_forecasts": _with(
        _ALERT_INPUTS,
        "SELECT sku, tipo_alerta, mensaje, fecha_proyeccion, 'PENDIENTE' AS estado FROM alertas", *_ALERT_STEPS,
    ),
    "stored_encoder": _with(
        "ventas archivos",
        """SELECT id_producto, CAST(row_number() OVER (ORDER BY id_producto) - 1 AS INT) AS id_producto_encoded
           FROM (SELECT DISTINCT id_producto FROM ventas v WHERE EXISTS (SELECT 1 FROM archivos a
                 WHERE a.estado = 'aprobado' AND a.ruta = v.source_file)) t""",
    ),
}
