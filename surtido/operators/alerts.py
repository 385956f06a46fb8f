"""Stock-out and overstock evaluation, and the alert table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    ACTIVE_ALERT_STATES,
    ALERT_STATES,
    HORIZON_DAYS,
    MSG_QUIEBRE,
    MSG_SOBRESTOCK,
    OVERSTOCK_FACTOR,
    QUIEBRE,
    SAFETY_STOCK_FACTOR,
    SOBRESTOCK,
)
from .demand import horizon_demand, sku_averages
from .snapshots import change_state, latest_per_key
from .thresholds import active_thresholds


def sku_thresholds(skus: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every SKU with its active threshold row, if any. Both sides are one row per SKU."""
    active = latest_per_key(
        active_thresholds(thresholds).select(
            F.col("producto_id").alias("id_producto"), "updated_at",
            "umbral_minimo", "umbral_sobreabastecimiento", "email_notificacion"),
        "id_producto", ["updated_at"]).drop("updated_at")
    return skus.join(active, "id_producto", "left")


def stock_position(averages: DataFrame, stock: DataFrame) -> DataFrame:
    """SKU averages with current stock; safety stock defaults to half the average."""
    safety = (F.col("promedio_historico") * SAFETY_STOCK_FACTOR).cast("int")
    # One row a SKU: of several the last update counts.
    held = latest_per_key(
        stock.select("id_producto", "stock_actual", "stock_seguridad", "ultima_actualizacion"),
        "id_producto", ["ultima_actualizacion"]).drop("ultima_actualizacion")
    return (
        averages.join(held, "id_producto", "left")
        .withColumn("stock_actual", F.coalesce("stock_actual", F.lit(0)))
        .withColumn("stock_seguridad", F.coalesce(F.col("stock_seguridad"), safety))
    )


def effective_thresholds(position: DataFrame) -> DataFrame:
    """Configured thresholds, else safety stock and thirty times the average."""
    ceiling = (F.col("promedio_historico") * OVERSTOCK_FACTOR).cast("bigint")
    return position.withColumns({
        "umbral_minimo": F.coalesce("umbral_minimo", "stock_seguridad"),
        "umbral_sobreabastecimiento": F.coalesce(F.col("umbral_sobreabastecimiento"), ceiling),
    })


def projected_stock(position: DataFrame, demand: DataFrame) -> DataFrame:
    """Stock left after the horizon's demand; SKUs without forecast demand nothing."""
    return (
        position.join(demand, "id_producto", "left")
        .withColumn("demanda_48h", F.coalesce("demanda_48h", F.lit(0)))
        .withColumn("stock_proyectado", F.col("stock_actual") - F.col("demanda_48h"))
    )


def evaluate_alerts(position: DataFrame, as_of: dt.date) -> DataFrame:
    """Alerts of SKUs that run short, or else are overstocked. One pass, no union."""
    short = F.col("stock_proyectado") <= F.col("umbral_minimo")
    over = F.col("stock_actual") > F.col("umbral_sobreabastecimiento")
    today = F.lit(as_of).cast("date")
    kind = F.when(short, QUIEBRE).when(over, SOBRESTOCK)
    facts = ["stock_actual", "demanda_48h", "stock_proyectado"]
    return (
        position.withColumn("tipo_alerta", kind)
        .filter(F.col("tipo_alerta").isNotNull())
        .select(
            F.col("id_producto").alias("sku"),
            "tipo_alerta",
            F.when(short, F.format_string(MSG_QUIEBRE, *facts, "umbral_minimo"))
            .otherwise(F.format_string(MSG_SOBRESTOCK, *facts, "umbral_sobreabastecimiento"))
            .alias("mensaje"),
            F.when(short, F.date_add(today, HORIZON_DAYS)).otherwise(today).alias("fecha_proyeccion"),
            F.nullif(F.col("email_notificacion"), F.lit("")).alias("email_notificacion"),
        )
    )


def stock_alerts(
    sales: DataFrame, stock: DataFrame, thresholds: DataFrame, forecasts: DataFrame, as_of: dt.date
) -> DataFrame:
    """Sales to alerts. The only shuffle of sales is the pre-combined average per SKU."""
    position = stock_position(sku_averages(sales), stock)
    position = effective_thresholds(sku_thresholds(position, thresholds))
    return evaluate_alerts(projected_stock(position, horizon_demand(forecasts)), as_of)


def upsert_alerts(current: DataFrame, found: DataFrame, moment: dt.datetime) -> DataFrame:
    """Refresh the pending alert of the same SKU and type, or insert a new one.

    ``found`` has one row per (sku, tipo_alerta). If several pending alerts share
    a key, the one with the smallest id is refreshed. Ids follow from key and run
    time, so repeating a run changes nothing.
    """
    now = F.lit(moment).cast("timestamp")
    pending = F.col("estado").eqNullSafe(F.lit("PENDIENTE"))
    place = F.row_number().over(Window.partitionBy("sku", "tipo_alerta").orderBy("id"))
    numbered = current.filter(pending).withColumn("_place", place)
    # Only alerts to refresh meet the new ones; settled alerts, whose number grows with the history, never move.
    others = current.filter(~pending).unionByName(numbered.filter("_place > 1").drop("_place"))
    old = numbered.filter("_place = 1").withColumns({"_sku": F.col("sku"), "_tipo": F.col("tipo_alerta")}).drop("_place")
    new = found.select(
        F.col("sku").alias("_sku"), F.col("tipo_alerta").alias("_tipo"),
        F.col("mensaje").alias("_mensaje"), F.col("fecha_proyeccion").alias("_fecha"), F.lit(True).alias("_hit"))
    text = F.concat_ws("|", "_sku", "_tipo", F.unix_micros(now).cast("string"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return old.join(new, ["_sku", "_tipo"], "full_outer").select(
        F.coalesce("id", F.substring(F.sha2(text, 256), 1, 32)).alias("id"),
        F.coalesce("sku", "_sku").alias("sku"),
        F.coalesce("tipo_alerta", "_tipo").alias("tipo_alerta"),
        F.when(hit, F.col("_mensaje")).otherwise(F.col("mensaje")).alias("mensaje"),
        F.when(hit, F.col("_fecha")).otherwise(F.col("fecha_proyeccion")).alias("fecha_proyeccion"),
        F.when(F.col("id").isNull(), F.lit("PENDIENTE")).otherwise(F.col("estado")).alias("estado"),
        F.when(hit, now).otherwise(F.col("creado_en")).alias("creado_en"),
    ).select(*current.columns).unionByName(others)


def set_alert_states(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    return change_state(alerts, changes, ALERT_STATES)


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("estado").isin(*ACTIVE_ALERT_STATES))


def list_active_alerts(alerts: DataFrame) -> DataFrame:
    """Active alerts, newest first."""
    return active_alerts(alerts).orderBy(F.desc("creado_en"), "id")


def active_alert_count(alerts: DataFrame) -> DataFrame:
    return active_alerts(alerts).agg(F.count(F.lit(1)).alias("alertas_activas"))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON record."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("registro"))
