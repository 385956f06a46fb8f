"""Joins of a large table with a keyed lookup table.

A lookup is broadcast only when its measured size allows it. Beyond that the
join shuffles both sides once; adaptive execution splits the partitions of hot
keys, which it can do for every kind of join used here, as the large side stands
on the left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def measured_bytes(table: DataFrame) -> int:
    """Size of the rows in memory: the texts as they are, 16 bytes a column for the rest."""
    texts = [name for name, kind in table.dtypes if kind == "string"]
    width = F.lit(16 * len(table.columns)).cast("bigint")
    for name in texts:
        width = width + F.coalesce(F.octet_length(name), F.lit(0))
    return table.agg(F.sum(width)).first()[0] or 0


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join on ``key``; ``lookup`` is narrow and has one row per key.

    ``how``: ``inner``, ``left``, ``left_semi`` or ``left_anti``. With
    ``broadcast_bytes=0`` the join always shuffles.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    if broadcast_bytes and measured_bytes(lookup) <= broadcast_bytes:
        return rows.join(F.broadcast(lookup), key, how)
    return rows.join(lookup.hint("merge"), key, how)
