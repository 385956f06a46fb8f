"""SKU averages, the forecast grid and demand over the horizon."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_AVERAGE, HORIZON_DAYS
from ..functions.numbers import mean_of_present, never_negative, units_up


def sku_averages(sales: DataFrame) -> DataFrame:
    """Average quantity per sales row of each SKU; 10 where there is no quantity."""
    mean = F.coalesce(F.avg("cantidad_vendida"), F.lit(DEFAULT_AVERAGE))
    return sales.groupBy("id_producto").agg(mean.alias("promedio_historico"))


def first_skus(skus: DataFrame, n: int) -> DataFrame:
    """The first ``n`` SKUs in order, for runs that want only a few."""
    return skus.orderBy("id_producto").limit(n)


def horizon_grid(skus: DataFrame, as_of: dt.date, days: int = HORIZON_DAYS) -> DataFrame:
    """Every SKU with each of the ``days`` dates after ``as_of``; no join, no shuffle."""
    start = F.lit(as_of).cast("date")
    dates = F.sequence(F.date_add(start, 1), F.date_add(start, days))
    return skus.withColumn("fecha", F.explode(dates))


def combine_predictions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``prediccion``: mean of the models present, not negative, rounded up."""
    mean = mean_of_present(*[F.col(c) for c in columns])
    return rows.withColumn("prediccion", units_up(never_negative(mean)))


def horizon_demand(forecasts: DataFrame) -> DataFrame:
    """Demand of each SKU over the forecast dates; a missing prediction is 0."""
    predicted = F.coalesce(F.col("prediccion"), F.lit(0)).cast("bigint")
    return forecasts.groupBy("id_producto").agg(F.sum(predicted).alias("demanda_48h"))
