"""Batch forecasts for many SKUs and dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DATE_FORMATS, HORIZON_DAYS
from ..functions.coerce import to_sale_date
from ..models import network as net
from ..models import trees as gbt
from ..models.artifacts import Artifacts
from ..operators.demand import combine_predictions, horizon_grid
from ..operators.features import CODE, encode, scale, unknown_skus, with_date_features
from ..operators.lookups import lookup_join


def score(coded: DataFrame, artifacts: Artifacts) -> DataFrame:
    """``prediccion`` for rows with ``fecha`` and a SKU code."""
    rows = scale(with_date_features(coded), artifacts.ranges)
    columns = []
    if artifacts.trees is not None:
        rows = gbt.predict_trees(artifacts.trees, rows)
        columns.append(gbt.PREDICTION)
    if artifacts.network is not None:
        rows = net.predict_network(artifacts.network, rows)
        columns.append(net.PREDICTION)
    if not columns:
        raise ValueError("no trained model")
    return combine_predictions(rows, columns)


def forecast(requests: DataFrame, artifacts: Artifacts, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Whole units expected for each request (``id_producto``, ``fecha_str``).

    Requests with an unreadable date or an unknown SKU get no row;
    :func:`rejected_requests` lists them. ``formats`` are the day patterns.
    """
    dated = requests.withColumn("fecha", to_sale_date(F.col("fecha_str"), formats)).filter("fecha is not null")
    return score(encode(dated, artifacts.encoder), artifacts).select(
        "id_producto", "fecha", "prediccion"
    )


def unknown_requests(requests: DataFrame, artifacts: Artifacts) -> DataFrame:
    return unknown_skus(requests, artifacts.encoder)


def rejected_requests(
    requests: DataFrame, artifacts: Artifacts, formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Requests without a forecast and why: ``fecha`` (unreadable) or ``sku`` (unknown to the models)."""
    coded = lookup_join(requests, artifacts.encoder, "id_producto", "left")
    why = F.when(to_sale_date(F.col("fecha_str"), formats).isNull(), F.lit("fecha")).when(F.col(CODE).isNull(), F.lit("sku"))
    return coded.withColumn("motivo", why).filter("motivo is not null").select(*requests.columns, "motivo")


def forecast_horizon(
    skus: DataFrame, artifacts: Artifacts, as_of: dt.date, days: int = HORIZON_DAYS
) -> DataFrame:
    """Forecast of every known SKU for each day after ``as_of``; codes are looked up once per SKU."""
    coded = encode(skus.select("id_producto"), artifacts.encoder)
    return score(horizon_grid(coded, as_of, days), artifacts).select("id_producto", "fecha", "prediccion")
