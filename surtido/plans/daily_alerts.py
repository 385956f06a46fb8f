"""The daily alert run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..models.artifacts import Artifacts
from ..operators.alerts import (
    effective_thresholds,
    evaluate_alerts,
    projected_stock,
    sku_thresholds,
    stock_position,
    upsert_alerts,
)
from ..operators.demand import first_skus, horizon_demand, sku_averages
from ..operators.digest import digest_pages, route_alerts, settings_with_recipient
from ..schemas import ALERTS
from ..session import materialize
from ..sources.snapshots import read_version, update_snapshot
from .forecasting import forecast_horizon


@dataclass
class DailyAlerts:
    found: DataFrame
    digest: DataFrame
    alerts: DataFrame


def run_daily_alerts(
    sales: DataFrame,
    stock: DataFrame,
    thresholds: DataFrame,
    settings: DataFrame,
    users: DataFrame,
    artifacts: Artifacts | None,
    alerts_root: str,
    as_of: dt.date,
    moment: dt.datetime,
    max_skus: int | None = None,
    forecasts: DataFrame | None = None,
) -> DailyAlerts:
    """Forecast, evaluate, update the alert table, build the digests.

    Every SKU is evaluated; ``max_skus`` restricts a trial run to the first ones.
    ``forecasts`` (one row a SKU and day) takes the place of the models. Run it
    inside ``temporary_results`` to drop the intermediate tables afterwards.
    """
    spark = sales.sparkSession
    averages = sku_averages(sales)
    if max_skus is not None:
        averages = first_skus(averages, max_skus)
    averages = materialize(averages, "averages")
    if forecasts is None:
        forecasts = forecast_horizon(averages, artifacts, as_of)
    demand = horizon_demand(forecasts)
    position = effective_thresholds(sku_thresholds(stock_position(averages, stock), thresholds))
    found = materialize(evaluate_alerts(projected_stock(position, demand), as_of), "alerts")

    version = update_snapshot(alerts_root, ALERTS, lambda current: upsert_alerts(current, found, moment), spark)
    recipient = settings_with_recipient(settings, users).select("email_destinatario_alertas").first()
    digest = digest_pages(route_alerts(found, recipient[0] if recipient else None))
    return DailyAlerts(found, digest, read_version(spark, alerts_root, ALERTS, version))
