"""Gradient-boosted trees on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf, nextafter

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FEATURES, TARGET, TREES
from ..operators.positions import with_running_total
from ..session import materialize, shared_root

PREDICTION = "pred_trees"
MAX_BINS = 256
#: Up to so many rows Spark takes the thresholds from all of them, beyond from a sample.
GROUP_ABOVE = MAX_BINS**2
#: Rows of a partition of the grouped table.
_SLICE = 20_000


def fit_trees(train: DataFrame, weight: str = "n", group_above: int = GROUP_ABOVE, **params) -> PipelineModel:
    """Fit on scaled features; ``weight`` is the number of equal rows a row stands for.

    Boosted squared error depends on a group of rows with equal features only
    through their count and mean target, so weighted rows lose nothing. Trees
    tell values apart by bins only; a table of more than ``group_above`` rows
    is therefore cut into bins first, by quantiles of all its rows, and its
    rows of equal bins become one. What the hundred passes read is then bounded
    by bins x days, however many SKUs and sales there are.
    """
    shared_root(train.sparkSession)  # boosting cuts its lineage by checkpoints
    settings = {**TREES, "maxBins": MAX_BINS, "checkpointInterval": 10, **params}
    trees = GBTRegressor(
        featuresCol="features", labelCol=TARGET, predictionCol=PREDICTION, weightCol=weight, **settings
    )
    typed = train.select(*[F.col(c).cast("double") for c in FEATURES], F.col(TARGET).cast("double"),
                         F.col(weight).cast("double"))
    cuts = bin_cuts(typed, weight) if typed.count() > group_above else {}
    columns = [_bin(c) if c in cuts else c for c in FEATURES]
    stages = [VectorAssembler(inputCols=columns, outputCol="features")]
    if cuts:
        stages.insert(0, Bucketizer(inputCols=list(cuts), outputCols=[_bin(c) for c in cuts],
                                    splitsArray=[[-inf, *c, inf] for c in cuts.values()]))
        typed = group_bins(stages[0].transform(typed), columns, weight)
    return PipelineModel([*stages, trees.fit(stages[-1].transform(typed))])


def _bin(column: str) -> str:
    return f"{column}_tramo"


def bin_cuts(rows: DataFrame, weight: str, bins: int = MAX_BINS, columns: Sequence[str] = FEATURES) -> dict[str, list[float]]:
    """Where to cut the columns of more values than ``bins``: half way between values, as many rows in each bin as its values allow."""
    kinds = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    cuts = {}
    # The count of kinds may be a little off; a column close to the limit may be cut as well.
    for column in [c for c in columns if kinds[c] > 0.8 * bins]:
        values = rows.groupBy(column).agg(F.sum(weight).alias("_n"))
        total = values.agg(F.sum("_n")).first()[0]
        place = F.least(F.floor((F.col("_before") + F.col("_n") / 2) * bins / total), F.lit(bins - 1))
        ends = with_running_total(values, [column], "_n", "_before").groupBy(place.alias("_place")).agg(
            F.min(column).alias("low"), F.max(column).alias("high")).orderBy("low").collect()  # a row a bin
        found = sorted({(a.high + b.low) / 2 for a, b in zip(ends, ends[1:])})
        if found:
            cuts[column] = found
    return cuts


def group_bins(rows: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """One row for all rows of equal ``columns``, with their total weight and mean target, stored."""
    total = F.sum(weight)
    # Bins have an order; without a word the trees would take them for categories.
    ordered = [F.col(c).alias(c, metadata={"ml_attr": {"type": "numeric"}}) for c in columns]
    # A missing target stays one, so that the trees refuse it as they do in single rows.
    whole = F.count(TARGET) == F.count(F.lit(1))
    mean = F.when(whole, F.sum(F.col(weight) * F.col(TARGET)) / total)
    grouped = materialize(rows.groupBy(*ordered).agg(mean.alias(TARGET), total.alias(weight)), "bins")
    # Read again and again: even slices, where adaptive execution would make one.
    slices = max(1, -(-grouped.count() // _SLICE))
    return materialize(grouped.repartition(slices, *columns), "binned")


def thresholds(model: PipelineModel) -> dict[int, list[float]]:
    """By place of the feature: for each cut between its bins, the largest value that goes left."""
    found = {}
    for stage in model.stages:
        if isinstance(stage, Bucketizer):
            for column, splits in zip(stage.getInputCols(), stage.getSplitsArray()):
                found[FEATURES.index(column)] = [nextafter(c, -inf) for c in splits[1:-1]]
    return found


def predict_trees(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with ``pred_trees``."""
    return model.transform(rows).select(*[F.col(f"`{c}`") for c in rows.columns], PREDICTION)
