"""A small dense network trained data-parallel.

Every epoch is one Spark job: each partition starts from the same weights, runs
Adam over its own mini-batches and hands back its parameters; Spark averages
them by row count. Rows stay in their partitions and the driver holds only the
parameters, a few thousand numbers however large the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..fixed_values import (
    FEATURES,
    NETWORK_EPOCHS,
    NETWORK_LAYERS,
    NETWORK_LEARNING_RATE,
    NETWORK_PATIENCE,
    TARGET,
)
from ..sources.snapshots import read_snapshot, write_snapshot

PREDICTION = "pred_network"
_BETA1, _BETA2, _EPSILON = 0.9, 0.999, 1e-7
#: Rows of a partition. More of them train one after the other, so this sets the trained model
#: together with the rows, whatever the cluster.
ROWS_PER_PARTITION = 20_000
_PROGRESS = StructType([
    StructField("huella", StringType()), StructField("epoca", IntegerType()),
    *[StructField(c, ArrayType(DoubleType())) for c in ("estado", "mejor", "perdidas")],
    StructField("mejor_perdida", DoubleType()), StructField("sin_mejora", IntegerType()),
])
#: What a partition hands back: its loss and held-out weight, the weight it was trained on, its parameters times that weight.
_STATS = "part int, lost double, held double, seen double, packed binary"
#: A batch of a partition: rows to train on and held-out rows, each of features, target and weight.
_BLOCKS = "part int, fit binary, held binary"
#: So many partitions are added up by one task.
_TOGETHER = 64
#: Partitions beyond so many share tasks; a task costs as much as several thousand rows.
_TASKS = 128


def parameter_count(layers: tuple[int, ...]) -> int:
    return sum((a + 1) * b for a, b in zip(layers, layers[1:]))


def initial_parameters(layers: tuple[int, ...], seed: int) -> np.ndarray:
    """Uniform Glorot weights and zero biases, as one flat vector."""
    rng = np.random.default_rng(seed)
    blocks = []
    for a, b in zip(layers, layers[1:]):
        limit = np.sqrt(6.0 / (a + b))
        blocks += [rng.uniform(-limit, limit, a * b), np.zeros(b)]
    return np.concatenate(blocks)


def _views(flat: np.ndarray, layers: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def forward(flat: np.ndarray, layers: tuple[int, ...], x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer: ReLU inside, linear at the end."""
    views = _views(flat, layers)
    acts = [x]
    for i, (w, b) in enumerate(views):
        z = acts[-1] @ w + b
        acts.append(np.maximum(z, 0.0) if i < len(views) - 1 else z)
    return acts


def gradient(flat, layers, x, y, weight) -> np.ndarray:
    """Gradient of the weighted mean squared error."""
    acts = forward(flat, layers, x)
    views = _views(flat, layers)
    out = np.empty_like(flat)
    grads = _views(out, layers)
    delta = (2.0 / weight.sum()) * weight[:, None] * (acts[-1] - y[:, None])
    for i in range(len(views) - 1, -1, -1):
        grads[i][0][:] = acts[i].T @ delta
        grads[i][1][:] = delta.sum(axis=0)
        if i:
            delta = (delta @ views[i][0].T) * (acts[i] > 0)
    return out


class _Steps:
    """Mini-batch steps of Adam over one set of buffers; the numbers are those of ``gradient`` and ``AdamState.step``."""

    def __init__(self, state: AdamState, layers: tuple[int, ...], rate: float):
        self.state, self.rate = state, rate
        self.views = _views(state.flat, layers)
        self.grad, self.spare = np.empty_like(state.flat), np.empty_like(state.flat)
        self.grads = _views(self.grad, layers)

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        acts, last = [x], len(self.views) - 1
        for i, (w, b) in enumerate(self.views):
            z = acts[-1] @ w
            z += b
            acts.append(np.maximum(z, 0.0, out=z) if i < last else z)
        delta = acts[-1]
        delta -= y[:, None]
        delta *= ((2.0 / weight.sum()) * weight)[:, None]
        for i in range(last, -1, -1):
            np.matmul(acts[i].T, delta, out=self.grads[i][0])
            np.add.reduce(delta, axis=0, out=self.grads[i][1])
            if i:
                # A product with one neuron only is a plain one, at a fraction of the time.
                w = self.views[i][0]
                delta = delta * w[:, 0] if w.shape[1] == 1 else delta @ w.T
                delta *= acts[i] > 0
        self._adam()

    def _adam(self) -> None:
        state, grad, t = self.state, self.grad, self.spare
        state.steps += 1
        np.subtract(grad, state.first, out=t)
        t *= 1 - _BETA1
        state.first += t
        np.multiply(grad, grad, out=t)
        t -= state.second
        t *= 1 - _BETA2
        state.second += t
        np.sqrt(state.second, out=t)
        t += _EPSILON
        np.divide(state.first, t, out=t)
        t *= self.rate * np.sqrt(1 - _BETA2**state.steps) / (1 - _BETA1**state.steps)
        state.flat -= t


class NotFitted(ValueError):
    """The network does not fit its rows: the loss is no number."""


@dataclass
class AdamState:
    """Parameters with their Adam moments; ``steps`` is averaged like the rest."""

    flat: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    def step(self, grad: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.first += (1 - _BETA1) * (grad - self.first)
        self.second += (1 - _BETA2) * (grad * grad - self.second)
        scale = rate * np.sqrt(1 - _BETA2**self.steps) / (1 - _BETA1**self.steps)
        self.flat -= scale * self.first / (np.sqrt(self.second) + _EPSILON)

    def pack(self) -> np.ndarray:
        return np.concatenate([self.flat, self.first, self.second, [self.steps]])

    @staticmethod
    def unpack(packed: np.ndarray) -> AdamState:
        size = (len(packed) - 1) // 3
        parts = [packed[i * size : (i + 1) * size].copy() for i in range(3)]
        return AdamState(*parts, steps=float(packed[-1]))


@dataclass
class Network:
    """Trained parameters."""

    flat: np.ndarray
    layers: tuple[int, ...] = NETWORK_LAYERS
    losses: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return forward(self.flat, self.layers, x)[-1][:, 0]


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch as one row of :data:`_BLOCKS`, so that no epoch takes rows apart again."""
    for frame in batches:
        val = frame["es_validacion"].to_numpy(bool)
        rows = frame[[*FEATURES, TARGET, "n"]].to_numpy(float)
        # A batch lies in one partition of the sorted rows.
        yield pd.DataFrame([(int(frame["part"].iloc[0]), rows[~val].tobytes(), rows[val].tobytes())],
                           columns=["part", "fit", "held"])


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, target and weight of packed rows."""
    rows = np.frombuffer(block).reshape(-1, len(FEATURES) + 2)
    return np.ascontiguousarray(rows[:, :-2]), rows[:, -2].copy(), rows[:, -1].copy()


def _epoch_task(shared, layers, batch_size: int, rate: float, seed: int, train: bool):
    """Partition function: validation loss of the shared weights, then local training; one row of :data:`_STATS` for each ``part``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = (block for frame in batches for block in frame.itertuples(index=False))
        for part, own in groupby(blocks, key=lambda block: block.part):
            state = AdamState.unpack(np.frombuffer(shared.value))
            start, steps = state.flat.copy(), _Steps(state, layers, rate)
            rng = np.random.default_rng([seed, part])
            seen = lost = held = 0.0
            for block in own:
                if block.held:
                    x, y, w = _unpacked(block.held)
                    error = forward(start, layers, x)[-1][:, 0] - y
                    lost += float((w * error * error).sum())
                    held += float(w.sum())
                if train and block.fit:
                    x, y, w = _unpacked(block.fit)
                    order = rng.permutation(len(y))
                    x, y, w = x[order], y[order], w[order]
                    for at in range(0, len(order), batch_size):
                        steps.step(x[at : at + batch_size], y[at : at + batch_size], w[at : at + batch_size])
                    seen += float(w.sum())
            packed = (state.pack() * seen).tobytes() if seen else None
            yield pd.DataFrame([(part, lost, held, seen, packed)], columns=["part", "lost", "held", "seen", "packed"])

    return run


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of the rows of a partition, in the order of ``part``: it does not depend on which one came first."""
    rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["part", "lost", "held", "seen", "packed"])])
    if not len(rows):
        return
    rows = rows.sort_values("part")
    total = None
    for packed in rows["packed"].dropna():
        vector = np.frombuffer(packed)
        total = vector.copy() if total is None else np.add(total, vector, out=total)
    yield pd.DataFrame([(rows["part"].iloc[0], *(rows[c].sum() for c in ("lost", "held", "seen")),
                         None if total is None else total.tobytes())], columns=list(rows.columns))


def _total(partial: DataFrame, partitions: int):
    """The sum of all rows of :data:`_STATS`, by tasks of about as many rows as there are tasks."""
    if partitions > _TOGETHER:
        groups = int(partitions**0.5)
        partial = partial.repartition(groups, "part").mapInPandas(_add_up, _STATS)
    # All of the one row: taking the first would break off the task, and its Python worker with it, every epoch.
    return partial.repartition(1).mapInPandas(_add_up, _STATS).collect()[0]


def _even_pieces(rows: DataFrame) -> DataFrame:
    """Rows that stand for many equal ones, cut into pieces of about the mean weight.

    A mini-batch weighs its rows against each other, so a very heavy row has to
    appear in as many batches as its weight deserves. This at most doubles the
    rows. The total weight stays the same.
    """
    mean = rows.agg(F.avg("n")).first()[0] or 1.0
    pieces = F.ceil(F.col("n") / F.lit(mean)).cast("int")
    return (
        rows.withColumn("_pieces", F.greatest(pieces, F.lit(1)))
        .withColumn("_piece", F.explode(F.sequence(F.lit(1), F.col("_pieces"))))
        .withColumn("n", F.col("n") / F.col("_pieces")).drop("_pieces")
    )


def _fingerprint(data: DataFrame, *settings) -> str:
    """Tells rows and settings apart; the same whatever the order of the rows."""
    hashes = F.xxhash64(*data.columns).cast("decimal(38,0)")
    return "-".join(map(str, [*data.agg(F.count(F.lit(1)), F.sum(hashes)).first(), *settings]))


def partitions_for(rows: int, rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    return max(1, -(-rows // rows_per_partition))


def fit_network(
    train: DataFrame,
    rows: int,
    rows_per_partition: int = ROWS_PER_PARTITION,
    partitions: int | None = None,
    layers: tuple[int, ...] = NETWORK_LAYERS,
    rate: float = NETWORK_LEARNING_RATE,
    epochs: int = NETWORK_EPOCHS,
    patience: int = NETWORK_PATIENCE,
    seed: int = 42,
    checkpoint: str | None = None,
    checkpoint_every: int = 5,
) -> Network:
    """Train with early stopping; the weights of the best validation loss are kept.

    With a ``checkpoint`` folder, weights, moments and losses are stored every
    ``checkpoint_every`` epochs. A run over the same rows and settings goes on
    from there and ends with the same weights as one that was never cut short;
    other rows or settings start anew.

    ``train``: scaled features, target, ``n`` (equal rows a row stands for) and
    ``es_validacion``, read from a stored table; it is spread, packed and cached
    for the epochs. ``rows`` is its row count, which sets the batch size and, with
    ``rows_per_partition``, the number of partitions. Partitions are sorted, so
    that a second run over the same rows gives the same weights.
    """
    spark = train.sparkSession
    batch_size = max(4, min(32, rows // 10))
    if partitions is None:
        partitions = partitions_for(rows, rows_per_partition)
    columns = [*(F.col(c).cast("double") for c in FEATURES), F.col(TARGET).cast("double"),
               F.col("n").cast("double"), "es_validacion"]
    data = (
        _even_pieces(train.select(*columns)).repartition(partitions, *FEATURES, TARGET, "_piece")
        .sortWithinPartitions(*FEATURES, TARGET, "es_validacion", "n", "_piece")
        .withColumn("part", F.spark_partition_id()).mapInPandas(_packed, _BLOCKS)
        # Whole partitions one after the other: each still starts from the shared weights.
        .coalesce(min(partitions, _TASKS)).persist(StorageLevel.MEMORY_AND_DISK)
    )

    flat = initial_parameters(layers, seed)
    state = AdamState(flat, np.zeros_like(flat), np.zeros_like(flat))
    best, best_loss, since, losses, done = flat, np.inf, 0, [], 0
    if checkpoint:
        same = _fingerprint(data, layers, rate, seed, batch_size, partitions, patience, epochs)
        kept = read_snapshot(spark, checkpoint, _PROGRESS).first()
        if kept is not None and kept.huella == same:
            state, best, losses = AdamState.unpack(np.array(kept.estado)), np.array(kept.mejor), list(kept.perdidas)
            best_loss, since, done = kept.mejor_perdida, kept.sin_mejora, kept.epoca
    for epoch in range(done, epochs + 1):
        training = epoch < epochs
        shared = spark.sparkContext.broadcast(state.pack().tobytes())
        task = _epoch_task(shared, layers, batch_size, rate, seed + epoch, training)
        sums = _total(data.mapInPandas(task, _STATS), partitions)
        shared.destroy()
        if sums.held and not np.isfinite(sums.lost):
            raise NotFitted(f"loss {sums.lost} in epoch {epoch}")
        if epoch:  # the loss of the weights the previous epoch produced
            losses.append(sums.lost / sums.held if sums.held else np.nan)
            if not sums.held or losses[-1] < best_loss:
                best, best_loss, since = state.flat, losses[-1], 0
            else:
                since += 1
                if since >= patience:
                    break
        if training:
            state = AdamState.unpack(np.frombuffer(sums.packed) / sums.seen)
            if checkpoint and (epoch + 1) % checkpoint_every == 0:
                # Before the loss of these weights is known: the epoch it belongs to comes next.
                row = (same, epoch + 1, state.pack().tolist(), best.tolist(), losses, float(best_loss), since)
                write_snapshot(spark.createDataFrame([row], _PROGRESS), checkpoint, keep=2)
    data.unpersist()
    return Network(best, layers, losses)


def predict_network(model: Network, rows: DataFrame) -> DataFrame:
    """Rows with ``pred_network``: one matrix product per Arrow batch."""
    shared = rows.sparkSession.sparkContext.broadcast((model.flat, model.layers))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        flat, layers = shared.value
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(forward(flat, layers, x)[-1][:, 0])

    return rows.withColumn(PREDICTION, score(*[F.col(c).cast("double") for c in FEATURES]))


def network_table(spark: SparkSession, model: Network) -> DataFrame:
    """Parameters as rows, for storing."""
    layers = ",".join(map(str, model.layers))
    rows = [(layers, i, float(v)) for i, v in enumerate(model.flat)]
    return spark.createDataFrame(rows, "capas string, lugar int, valor double")


def network_from_table(table: DataFrame) -> Network:
    rows = table.orderBy("lugar").collect()
    layers = tuple(int(part) for part in rows[0].capas.split(","))
    return Network(np.array([r.valor for r in rows]), layers)
