"""Models as tables, and their scores worked out from them.

What a model predicts can so be worked out again from stored rows alone, in any
engine: each tree is walked node by node, each layer of the network is a sum of
products by neuron. Here the model's rows, a few thousand, travel to the
tasks, and a batch of rows goes through them by array operations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..fixed_values import FEATURES
from .network import Network


def split_rows(spark: SparkSession, model_path: str, thresholds: Mapping[int, Sequence[float]] | None = None) -> DataFrame:
    """Nodes of stored boosted trees; ``thresholds`` are the values between the bins of features that were cut.

    ``arbol``, ``peso`` (the tree's weight), ``nodo`` (0 is the root), ``columna``
    (place of the feature, null in a leaf), ``umbral`` (values up to it go left),
    ``izquierda``, ``derecha``, ``valor``.
    """
    weights = spark.read.parquet(f"{model_path}/treesMetadata").toDF("arbol", "_meta", "peso").drop("_meta")
    nodes = spark.read.parquet(f"{model_path}/data").select(F.col("treeID").alias("arbol"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    threshold = F.element_at("split.leftCategoriesOrThreshold", 1)
    for place, values in (thresholds or {}).items():
        value = F.get(F.array(*map(F.lit, values)), F.floor(threshold).cast("int"))
        threshold = F.when(F.col("split.featureIndex") == place, value).otherwise(threshold)
    return nodes.join(F.broadcast(weights), "arbol").select(
        "arbol", "peso", F.col("id").alias("nodo"),
        F.when(inner, F.col("split.featureIndex")).alias("columna"),
        F.when(inner, threshold).alias("umbral"),
        F.when(inner, F.col("leftChild")).alias("izquierda"),
        F.when(inner, F.col("rightChild")).alias("derecha"),
        F.col("prediction").alias("valor"),
    )


def _inputs(features: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in features]


def _node_arrays(splits: DataFrame) -> tuple[np.ndarray, ...]:
    """Roots, feature, threshold, children (right, left) and weighted value of all nodes, numbered over all trees; a leaf is its own child."""
    nodes = splits.select("arbol", "nodo", "columna", "umbral", "izquierda", "derecha", F.col("peso") * F.col("valor")).collect()
    place = {(n.arbol, n.nodo): i for i, n in enumerate(nodes)}
    roots = np.array([place[t, n] for t, n in sorted(place) if n == 0])
    column = np.array([0 if n.columna is None else n.columna for n in nodes])
    threshold = np.array([np.nan if n.umbral is None else n.umbral for n in nodes])
    child = np.array([
        (i, i) if n.columna is None else (place[n.arbol, n.derecha], place[n.arbol, n.izquierda])
        for i, n in enumerate(nodes)]).ravel()
    return roots, column, threshold, child, np.array([n[-1] for n in nodes])


def tree_scores(rows: DataFrame, splits: DataFrame, key: str, depth: int, features: Sequence[str] = FEATURES) -> DataFrame:
    """``key`` and ``pred_arboles``: every row walks down every tree, level by level.

    ``splits`` has at most trees x 2^(depth + 1) rows, which is broadcast. A
    missing feature goes right.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_node_arrays(splits))

    @F.pandas_udf("double")
    def walk(*columns: pd.Series) -> pd.Series:
        roots, column, threshold, child, value = shared.value
        x = np.column_stack([c.to_numpy(float) for c in columns]).ravel()
        first = np.arange(len(columns[0])) * len(columns)
        total = np.zeros(len(first))
        for root in roots:
            at = np.full(len(first), root)
            for _ in range(depth):
                left = x[first + column[at]] <= threshold[at]
                at = child[2 * at + left]
            total += value[at]
        return pd.Series(total)

    scores = rows.select(key, walk(*_inputs(features)).alias("_puntaje"))
    return scores.groupBy(key).agg(F.sum("_puntaje").alias("pred_arboles"))


def neuron_rows(spark: SparkSession, model: Network) -> DataFrame:
    """``capa``, ``neurona``, ``pesos`` (one for each input), ``sesgo``: a row for each neuron."""
    rows, at = [], 0
    for layer, (a, b) in enumerate(zip(model.layers, model.layers[1:])):
        weights = model.flat[at : at + a * b].reshape(a, b)
        biases = model.flat[at + a * b : at + (a + 1) * b]
        rows += [(layer, j, weights[:, j].tolist(), float(biases[j])) for j in range(b)]
        at += (a + 1) * b
    return spark.createDataFrame(rows, "capa int, neurona int, pesos array<double>, sesgo double")


def network_scores(rows: DataFrame, neurons: DataFrame, key: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """``key`` and ``pred_red``: layer by layer, a sum of products for each neuron, ReLU inside and linear at the end.

    A layer is one broadcast row of its neurons, so the rows stay where they are: no row for each neuron, no shuffle.
    The first row of a task carries the neurons to it. A neuron that misses an
    input has no sum: inside it gives 0, at the end null.
    """
    layers = [r[0] for r in neurons.select("capa").distinct().orderBy("capa").collect()]  # one number a layer
    inputs = _inputs(features)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    sent = rows.select(F.col(key), *(c.alias(f"_x{i}") for i, c in enumerate(inputs)), first.alias("_primera"))
    names = [f"_capa{i}" for i in range(len(layers))]
    for name, layer in zip(names, layers):
        ordered = F.sort_array(F.collect_list(F.struct("neurona", F.concat("pesos", F.array("sesgo")).alias("numeros"))))
        # As a text, which keeps every digit: an array column costs each row far more, also where it is null.
        own = neurons.filter(F.col("capa") == layer).agg(
            F.to_json(F.flatten(F.transform(ordered, lambda n: n["numeros"]))).alias(name))
        sent = sent.join(F.broadcast(own.withColumn("_primera", F.lit(True))), "_primera", "left")
    sent = sent.select(key, *(f"_x{i}" for i in range(len(inputs))), *names)
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("pred_red", DoubleType())])
    places = range(1, 1 + len(inputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not arrays:
                width = len(places)
                for name in names:
                    own = np.array(json.loads(batch.column(name)[0].as_py()), dtype=float).reshape(-1, width + 1)
                    arrays.append((own[:, :-1].T.copy(), own[:, -1].copy()))
                    width = len(own)
            # A missing number is NaN here, and told apart from a NaN by ``lost``.
            values = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in places])
            lost = np.logical_or.reduce([batch.column(i).is_null().to_numpy(zero_copy_only=False) for i in places])
            for i, (weights, bias) in enumerate(arrays):
                values = values @ weights + bias
                if i < len(arrays) - 1:
                    values = np.maximum(values, 0.0)
                    if i == 0:
                        values[lost] = 0.0
            score = pa.array(values[:, 0], mask=lost if len(arrays) == 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=[key, "pred_red"])

    return sent.mapInArrow(run, schema)
