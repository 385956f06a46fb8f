"""Approved sales to trained, measured and stored models."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    FEATURES,
    MODEL_HYBRID,
    MODEL_NETWORK,
    MODEL_TREES,
    NETWORK_VALIDATION_SHARE,
    TARGET,
    TEST_SHARE,
)
from ..functions.numbers import hash_below, mean_of_present
from ..models import network as net
from ..models import trees as gbt
from ..models.artifacts import Artifacts, save_artifacts
from ..operators.evaluation import evaluate, stamp_metrics
from ..operators.features import encode, fit_encoder, fit_scaler, scale, with_date_features
from ..operators.registry import approved_files, mark_processed, training_rows
from ..operators.sales import (
    BUSINESS_KEYS,
    can_stratify,
    clean_stored_sales,
    sales_counts,
    split_counts,
    stratified_split,
)
from ..schemas import FILES
from ..session import materialize
from ..sources.snapshots import merge_snapshot, new_folder, read_snapshot
from ..sources.tables import append_metrics

HYBRID = "pred_hybrid"
#: A model that does not fit its rows or settings; everything else is a failure of the job.
MODEL_ERRORS = (net.NotFitted, IllegalArgumentException)


@dataclass
class Trained:
    status: str
    message: str
    artifacts: Artifacts | None = None
    path: str | None = None
    metrics: DataFrame | None = None


def hash_split(sales: DataFrame, share: Sequence[int] = TEST_SHARE, salt: str = "prueba") -> DataFrame:
    """Flag about ``share`` of the rows as test rows, in ``es_prueba``.

    A narrow step: no shuffle, repeatable, equal rows on one side.
    """
    keys = [F.col(c) for c in BUSINESS_KEYS]
    return sales.withColumn("es_prueba", hash_below(*share, F.lit(salt), *keys))


def hash_sides(counts: DataFrame) -> DataFrame:
    """Counted sales divided by hash into test and training copies, ``es_prueba``.

    The first row by its keys has a test copy and the last one a training copy,
    however the hash falls, so two sales or more leave rows on both sides.
    """
    key = F.struct(*BUSINESS_KEYS)
    ends = counts.agg(F.min(key).alias("first"), F.max(key).alias("last"), F.sum("n").alias("total")).first()
    low, high = F.lit(0), F.col("n")
    if (ends["total"] or 0) > 1:
        def is_(row) -> Column:
            return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(row[c])) for c in BUSINESS_KEYS])

        low = F.when(is_(ends["first"]), 1).otherwise(0)
        high = F.col("n") - F.when(is_(ends["last"]), 1).otherwise(0)
    return split_counts(counts, "es_prueba", TEST_SHARE, "prueba", bounds=(low, high))


def training_cells(sales: DataFrame, stratified: bool = False) -> DataFrame:
    """Distinct sales with counts ``n`` and the sides ``es_prueba`` and ``es_validacion``, stored.

    Equal sales are collapsed here, in the only pass over the sales, so what
    follows is bounded by SKUs x days x quantities and no SKU is hot any more.
    A stratified split numbers single rows, so it stores those first.
    """
    if stratified:
        flagged = stratified_split(materialize(sales, "rows"))
        cells = flagged.groupBy(*BUSINESS_KEYS, "es_prueba").agg(F.count(F.lit(1)).alias("n"))
    else:
        cells = hash_sides(materialize(sales_counts(sales), "counts"))
    held = split_counts(cells, "es_validacion", NETWORK_VALIDATION_SHARE, "validacion", ~F.col("es_prueba"))
    return materialize(held, "cells")


def feature_table(
    cells: DataFrame, encoder: DataFrame, fit_on_train: bool = False
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Scaled features of the cells, and the ranges used."""
    features = with_date_features(encode(cells, encoder))
    ranges = fit_scaler(features.filter(~F.col("es_prueba")) if fit_on_train else features)
    return scale(features, ranges), ranges


def _sides(cells: DataFrame) -> tuple[int, int]:
    """Training and test cells."""
    row = cells.agg(F.count_if(~F.col("es_prueba")), F.count_if("es_prueba")).first()
    return row[0], row[1]


def train(
    sales: DataFrame,
    files: DataFrame,
    artifacts_root: str,
    metrics_path: str,
    moment: dt.datetime,
    on_empty: str = "empty",
    stratified: bool = False,
    fit_on_train: bool = False,
    use: Sequence[str] = ("trees", "network"),
    clean: bool = False,
    rows_per_partition: int = net.ROWS_PER_PARTITION,
    checkpoint: str | None = None,
) -> Trained:
    """Train on the sales of approved files, measure on held-out rows, store everything.

    ``clean`` drops duplicates and rows without a date or a positive quantity
    first. ``stratified`` gives every SKU its share of test rows, where every
    SKU has two sales or more; else the split is by hash.

    The metric log gets the row of the final model: the hybrid, or the only
    model that was asked for or could be trained. ``status`` is ``success``,
    ``partial`` (one of two models could not be fitted to these rows),
    or ``error`` (no rows, no model). Failures of Spark or of the store are
    raised. ``checkpoint`` is a folder for the state of the network between
    epochs; a run that died goes on from there.
    """
    spark = sales.sparkSession
    chosen = training_rows(sales, files, on_empty).select(*BUSINESS_KEYS)
    if clean:
        chosen = clean_stored_sales(chosen)
    stratified = stratified and bool(can_stratify(chosen).first().estratificable)
    cells = training_cells(chosen, stratified)
    trained_on, tested_on = _sides(cells)
    if not trained_on + tested_on:
        return Trained("error", "Sin ventas de archivos aprobados.")
    if not trained_on or not tested_on:
        return Trained("error", "Una sola venta no alcanza para entrenar y probar.")

    encoder = materialize(fit_encoder(cells), "encoder")
    table, ranges = feature_table(cells, encoder, fit_on_train)
    # Training passes over this table many times: even slices, as many as its rows ask for.
    columns = ["id_producto", "fecha", *FEATURES, TARGET, "n", "es_prueba", "es_validacion"]
    slices = net.partitions_for(trained_on + tested_on, rows_per_partition)
    table = materialize(table.select(*columns).repartition(slices, *FEATURES, TARGET), "scaled")
    train_rows, test_rows = table.filter(~F.col("es_prueba")), table.filter("es_prueba")

    artifacts = Artifacts(encoder, ranges)
    failures = []
    if "trees" in use:
        try:
            artifacts.trees = gbt.fit_trees(train_rows)
        except MODEL_ERRORS as error:
            failures.append(f"{MODEL_TREES}: {error}")
    if "network" in use:
        try:
            artifacts.network = net.fit_network(train_rows, trained_on, rows_per_partition, checkpoint=checkpoint)
        except MODEL_ERRORS as error:
            failures.append(f"{MODEL_NETWORK}: {error}")
    names, scored = {}, test_rows
    if artifacts.trees is not None:
        scored = gbt.predict_trees(artifacts.trees, scored)
        names[gbt.PREDICTION] = MODEL_TREES
    if artifacts.network is not None:
        scored = net.predict_network(artifacts.network, scored)
        names[net.PREDICTION] = MODEL_NETWORK
    if not names:
        return Trained("error", "Ningún modelo se pudo entrenar. " + " ".join(failures))
    if len(names) > 1:
        scored = scored.withColumn(HYBRID, mean_of_present(*[F.col(c) for c in names]))
        names[HYBRID] = MODEL_HYBRID

    # The metrics are those of the stored predictions, so they can be worked out again from them.
    path = new_folder(artifacts_root)
    scored.select("id_producto", "fecha", TARGET, "n", *FEATURES, *names).write.parquet(f"{path}/predictions")
    artifacts.predictions = spark.read.parquet(f"{path}/predictions")
    metrics = materialize(stamp_metrics(evaluate(artifacts.predictions, TARGET, names, "n"), moment), "metrics")
    final = list(names.values())[-1]
    path = save_artifacts(spark, artifacts, artifacts_root, path)
    append_metrics(metrics.filter(F.col("model") == final), metrics_path)
    status = "partial" if failures else "success"
    return Trained(status, " ".join(["Modelos guardados.", *failures]), artifacts, path, metrics)


def retrain(
    sales: DataFrame, registry_root: str, artifacts_root: str, metrics_path: str, moment: dt.datetime, **options
) -> Trained:
    """Train on the files approved now, then mark exactly those as processed."""
    spark = sales.sparkSession
    files = read_snapshot(spark, registry_root, FILES)
    used = materialize(approved_files(files).select("id", "ruta", "estado"), "used")
    options = {"checkpoint": f"{artifacts_root}/_avance", **options}
    result = train(sales, used, artifacts_root, metrics_path, moment, **options)
    if result.status in ("success", "partial"):
        merge_snapshot(
            registry_root, FILES, ["id"],
            lambda now: mark_processed(now.join(used.select("id"), "id", "left_semi"), used), spark)
    return result
