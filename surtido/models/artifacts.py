"""Everything a forecast needs, stored together under one path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..sources.snapshots import StaleVersion, latest_path, latest_version, new_folder, publish_version
from .network import Network, network_from_table, network_table
from .tables import neuron_rows, split_rows
from .trees import thresholds

_SCALER = "columna string, minimo double, maximo double"


@dataclass
class Artifacts:
    encoder: DataFrame
    ranges: dict[str, tuple[float, float]]
    trees: PipelineModel | None = None
    network: Network | None = None
    #: As stored: nodes of the trees, neurons of the network, predictions of the held-out rows.
    splits: DataFrame | None = None
    neurons: DataFrame | None = None
    predictions: DataFrame | None = None


def save_artifacts(spark: SparkSession, artifacts: Artifacts, root: str, path: str | None = None) -> str:
    """Write a new version under ``root`` and return its folder. The commit goes last and makes it count.

    ``path`` is a ``new_folder`` of ``root`` that already holds the predictions.
    Trees and network are stored as tables too, for scoring by joins.
    """
    path = path or new_folder(root)
    parts = ["encoder", "scaler"]
    artifacts.encoder.write.parquet(f"{path}/encoder")
    scaler = [(name, float(low), float(high)) for name, (low, high) in artifacts.ranges.items()]
    spark.createDataFrame(scaler, _SCALER).coalesce(1).write.parquet(f"{path}/scaler")
    if artifacts.trees is not None:
        artifacts.trees.write().save(f"{path}/trees")
        nodes = split_rows(spark, f"{path}/trees/stages/*", thresholds(artifacts.trees))
        nodes.coalesce(1).write.parquet(f"{path}/splits")
        parts += ["trees", "splits"]
    if artifacts.network is not None:
        network_table(spark, artifacts.network).coalesce(1).write.parquet(f"{path}/network")
        neuron_rows(spark, artifacts.network).coalesce(1).write.parquet(f"{path}/neurons")
        parts += ["network", "neurons"]
    if artifacts.predictions is not None:
        parts.append("predictions")
    manifest = spark.createDataFrame([(p,) for p in parts], "parte string").coalesce(1)
    # Appending files beside the part folders leaves those in place.
    manifest.write.mode("append").text(path)
    while True:
        try:
            # Two trainings at once are both versions, in the order in which they end.
            publish_version(spark, root, latest_version(spark, root), [{"path": path.rsplit("/", 1)[1], "rows": 0, "changes": False}])
            return path
        except StaleVersion:
            continue


def load_artifacts(spark: SparkSession, root: str) -> Artifacts:
    """Newest complete version under ``root``."""
    path = latest_path(spark, root)
    if path is None:
        raise FileNotFoundError(f"no trained model under {root}")
    parts = {r.value for r in spark.read.text(path).collect()}
    scaler = spark.read.parquet(f"{path}/scaler").collect()
    return Artifacts(
        encoder=spark.read.parquet(f"{path}/encoder"),
        ranges={r.columna: (r.minimo, r.maximo) for r in scaler},
        trees=PipelineModel.load(f"{path}/trees") if "trees" in parts else None,
        network=network_from_table(spark.read.parquet(f"{path}/network")) if "network" in parts else None,
        **{p: spark.read.parquet(f"{path}/{p}") for p in ("splits", "neurons", "predictions") if p in parts},
    )
