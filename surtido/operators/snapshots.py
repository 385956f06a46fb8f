"""Keyed changes to small state tables: snapshot in, new snapshot out.

Changes are first reduced to one row per key, so both sides of every join are
unique on it and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last change of each key by ``order``, then by its other columns; combined before the shuffle."""
    rest = [c for c in changes.columns if c != key and c not in order]
    last = F.max(F.struct(*[c for c in order if c != key], *rest)).alias("_row")
    return changes.groupBy(key).agg(last).select(key, "_row.*").select(*changes.columns)


def upsert(
    current: DataFrame,
    changes: DataFrame,
    key: str,
    order: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Insert new keys, replace the columns of known ones.

    Columns in ``keep`` hold their present value when the key exists and that
    value is neither null nor empty; columns absent from ``changes`` are never
    touched.
    """
    last = latest_per_key(changes, key, order)
    old, new = current.alias("old"), last.withColumn("_new", F.lit(True)).alias("new")
    columns = []
    for name in current.columns:
        if name == key:
            columns.append(F.coalesce(F.col(f"new.{key}"), F.col(f"old.{key}")).alias(key))
        elif name not in last.columns:
            columns.append(F.col(f"old.{name}").alias(name))
        elif name in keep:
            present = F.nullif(F.col(f"old.{name}"), F.lit(""))
            columns.append(F.coalesce(present, F.col(f"new.{name}")).alias(name))
        else:
            changed = F.when(F.col("new._new"), F.col(f"new.{name}"))
            columns.append(changed.otherwise(F.col(f"old.{name}")).alias(name))
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    return joined.select(*columns)


def split_by_state(changes: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Changes with an allowed ``estado``, and the rest."""
    ok = F.coalesce(F.col("estado").isin(*allowed), F.lit(False))
    return changes.filter(ok), changes.filter(~ok)


def change_state(
    current: DataFrame, changes: DataFrame, allowed: Sequence[str], order: Sequence[str] = ("estado",)
) -> DataFrame:
    """Set ``estado`` by ``id``. Unknown ids and disallowed states change nothing."""
    valid, _ = split_by_state(changes, allowed)
    wanted = latest_per_key(valid.select("id", *dict.fromkeys(["estado", *order])), "id", order)
    wanted = wanted.select("id", F.col("estado").alias("_estado"))
    return (
        current.join(wanted, "id", "left")
        .withColumn("estado", F.coalesce("_estado", "estado"))
        .select(*current.columns)
    )


def promote(current: DataFrame, old: str, new: str) -> DataFrame:
    """Move every row in state ``old`` to state ``new``."""
    moved = F.when(F.col("estado") == old, F.lit(new)).otherwise(F.col("estado"))
    return current.withColumn("estado", moved)


def remove_ids(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("id").distinct(), "id", "left_anti").select(*current.columns)
