"""Alert thresholds per SKU: rules, upsert, active rows, page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .snapshots import upsert


def threshold_error() -> Column:
    """Why a threshold row is not acceptable; null when it is."""
    low, high = F.col("umbral_minimo"), F.col("umbral_sobreabastecimiento")
    return (
        F.when(F.col("producto_id").isNull(), F.lit("producto_id"))
        .when(low.isNull() | (low < 0), F.lit("umbral_minimo"))
        .when(high.isNull() | (high <= 0), F.lit("umbral_sobreabastecimiento"))
        .when(high <= low, F.lit("orden"))
    )


def check_thresholds(changes: DataFrame) -> DataFrame:
    """Each row with ``motivo``: null for acceptable rows."""
    return changes.withColumn("motivo", threshold_error())


def active_thresholds(thresholds: DataFrame) -> DataFrame:
    return thresholds.filter(F.col("is_active"))


def upsert_thresholds(
    thresholds: DataFrame, changes: DataFrame, order: Sequence[str] = ("updated_at",)
) -> DataFrame:
    """Apply acceptable changes by SKU; a stored notification e-mail is kept."""
    accepted = check_thresholds(changes).filter(F.col("motivo").isNull()).drop("motivo")
    return upsert(thresholds, accepted, "producto_id", order, keep=("email_notificacion",))


def threshold_page(thresholds: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page, most recently updated first; ties by SKU."""
    return thresholds.orderBy(F.desc("updated_at"), "producto_id").offset(skip).limit(limit)


def upsert_stock(stock: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply stock changes by SKU, the latest ``ultima_actualizacion`` winning."""
    return upsert(stock, changes, "id_producto", ("ultima_actualizacion",))
