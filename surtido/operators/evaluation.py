"""Error metrics of predictions and the metric log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import never_negative


def evaluate(rows: DataFrame, target: str, predictions: Mapping[str, str], weight: str | None = None) -> DataFrame:
    """MAE, RMSE and R2 of each prediction column, one row per model.

    ``predictions`` maps a column to the model's name. All models are measured
    in a single aggregation. Predictions below zero count as zero and R2 is never
    below zero; with a constant target it is 1 for exact predictions, else 0.
    ``weight`` is the number of equal rows a row stands for.
    """
    y = F.col(target).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    measured = [F.sum(w).alias("_n")]
    for i, column in enumerate(predictions):
        error = y - never_negative(F.col(column).cast("double"))
        measured += [F.sum(w * F.abs(error)).alias(f"_abs{i}"), F.sum(w * error * error).alias(f"_sq{i}")]
    if weight:
        spread = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)
    else:
        spread = F.var_pop(y) * F.sum(w)
    totals = rows.agg(*measured, spread.alias("_spread")).filter(F.col("_n") > 0)

    def r2(i: int):
        squares, total = F.col(f"_sq{i}"), F.col("_spread")
        constant = F.when(squares == 0, 1.0).otherwise(0.0)
        return F.when(total > 0, F.greatest(F.lit(0.0), 1 - squares / total)).otherwise(constant)

    per_model = [
        F.struct(
            F.lit(name).alias("model"),
            (F.col(f"_abs{i}") / F.col("_n")).alias("mae"),
            F.sqrt(F.col(f"_sq{i}") / F.col("_n")).alias("rmse"),
            r2(i).alias("r2"),
        )
        for i, name in enumerate(predictions.values())
    ]
    return totals.select(F.inline(F.array(*per_model)))


def stamp_metrics(metrics: DataFrame, moment: dt.datetime) -> DataFrame:
    return metrics.withColumn("fecha_registro", F.lit(moment).cast("timestamp"))


def metric_log(log: DataFrame) -> DataFrame:
    """Recorded metrics, newest first."""
    return log.orderBy(F.desc("fecha_registro"), "model")


def metric_series(log: DataFrame) -> DataFrame:
    """MAE and RMSE over time, for charting."""
    return log.select("fecha_registro", "mae", "rmse").orderBy("fecha_registro")
