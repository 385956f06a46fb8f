"""Exact row positions without pulling a group, or the table, into one task.

Rows are range-partitioned and sorted by the requested order; a row's place
inside its partition plus the size of the partitions before it is its global
position. A group with any share of all rows is simply spread over as many
partitions as the range sampling gives it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_ID_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def _placed(df: DataFrame, order: Sequence[str], ties: bool, drop: Sequence[str] = ()) -> DataFrame:
    """Sorted rows with ``_part`` and ``_row``, fixed by writing them once, without ``drop``."""
    keys = list(order)
    if ties:
        df, keys = df.withColumn("_tie", F.monotonically_increasing_id()), [*order, "_tie"]
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _ID_BITS).cast("int"))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << _ID_BITS) - 1)))
        .drop("_tie", "_id", *drop)
    )
    return materialize(ranged, "positions")


def with_position(
    df: DataFrame,
    order: Sequence[str],
    name: str = "posicion",
    ties: bool = False,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add the 0-based global position in ``order`` (ascending, nulls first).

    Pass ``ties`` if many rows can be equal in every order column: they are then
    spread over partitions and take neighbouring positions in any order. That
    numbers rows as they are read, so ``df`` must come straight from a stored
    table, which gives a retried task the same sequence. ``drop`` names order
    columns that are not wanted in the result.
    """
    placed = _placed(df, order, ties, drop)
    # One row per shuffle partition: the only thing this window ever sees.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_part", "_row", "_start")
    )


def with_running_total(df: DataFrame, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """Add the total of ``amount`` in the rows before, in ``order``, which tells all rows apart."""
    placed = _placed(df, order, ties=False)
    # As above: the window over all partitions sees one row of each.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part").agg(F.sum(amount).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_part", "_row", "_start")
    )


def with_group_position(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "posicion"
) -> DataFrame:
    """Add the 0-based position inside each group, as ``row_number() - 1`` would.

    The offsets are joined on (partition, group): no key there has more rows
    than one range partition, whatever share of the table the group holds.
    ``group`` columns must not be null, and ``order`` must tell rows of a group apart.
    """
    placed = _placed(df, [*group, *order], ties=False)
    pieces = placed.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "_part", *group,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
    )
    return (
        placed.join(offsets, ["_part", *group])
        .withColumn(name, F.col("_row") + F.col("_offset"))
        .drop("_part", "_row", "_offset")
    )
