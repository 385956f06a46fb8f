"""Label encoding, date features and min-max scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FEATURES
from ..functions.calendar import date_features
from ..functions.numbers import rescale
from .lookups import BROADCAST_BYTES, lookup_join
from .positions import with_position

CODE = FEATURES[0]


def distinct_skus(sales: DataFrame) -> DataFrame:
    return sales.select("id_producto").distinct()


def fit_encoder(sales: DataFrame) -> DataFrame:
    """Code of each SKU: its rank among the distinct SKUs, from 0.

    The ranks are exact and no task sees more than its range of SKUs.
    """
    skus = distinct_skus(sales).filter(F.col("id_producto").isNotNull())
    placed = with_position(skus, ["id_producto"], CODE)
    return placed.withColumn(CODE, F.col(CODE).cast("int"))


def encode(rows: DataFrame, encoder: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of known SKUs with their code."""
    return lookup_join(rows, encoder, "id_producto", "inner", broadcast_bytes)


def unknown_skus(rows: DataFrame, encoder: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose SKU has no code."""
    return lookup_join(rows, encoder, "id_producto", "left_anti", broadcast_bytes)


def unknown_sku_count(rows: DataFrame, encoder: DataFrame) -> DataFrame:
    return unknown_skus(rows, encoder).agg(F.count(F.lit(1)).alias("filas_desconocidas"))


def with_date_features(rows: DataFrame) -> DataFrame:
    return rows.select("*", *date_features(F.col("fecha")))


def feature_ranges(features: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Minimum and maximum of every feature, one row, one pass."""
    bounds = [
        bound(F.col(name)).cast("double").alias(f"{name}_{label}")
        for name in columns
        for bound, label in ((F.min, "min"), (F.max, "max"))
    ]
    return features.agg(*bounds)


def fit_scaler(features: DataFrame, columns: Sequence[str] = FEATURES) -> dict[str, tuple[float, float]]:
    """Range of every feature: two numbers per column reach the driver."""
    row = feature_ranges(features, columns).first()
    if row[0] is None:
        raise ValueError("no rows to fit the scaler on")
    return {name: (row[f"{name}_min"], row[f"{name}_max"]) for name in columns}


def scale(features: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rescaled features. Values outside the fitted range leave [0, 1]."""
    return features.withColumns(
        {name: rescale(F.col(name), low, high) for name, (low, high) in ranges.items()}
    )
