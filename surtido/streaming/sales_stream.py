"""Continuous ingest of the files that arrive in a folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..fixed_values import DATE_FORMATS
from ..plans.arrivals import ingest_arrivals


def start_ingest(
    spark: SparkSession,
    source: str,
    sales_path: str,
    registry_root: str,
    checkpoint: str,
    every: str | None = None,
    max_files: int = 1000,
    approve: bool = True,
    formats: Sequence[str] = DATE_FORMATS,
    origin: str | None = None,
) -> StreamingQuery:
    """Ingest files as they arrive under ``source``.

    Each micro-batch looks for what has arrived and takes all of it, by
    ``ingest_arrivals``: files without a single byte are registered too, which
    Spark's own file stream would pass over. ``every`` (say ``"1 minute"``) keeps
    it running; without it the query takes what is there and stops.

    The table of arrivals, not the stream's own offsets, says which files were
    taken: a micro-batch that Spark repeats, or a lost checkpoint, takes no file
    twice. Batches are numbered from 0 for each ``checkpoint``, so its path is the
    name of the source unless ``origin`` gives another; other ingests into the
    same tables keep apart. One running stream for each name.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        ingest_arrivals(
            batch.sparkSession, source, sales_path, registry_root, dt.datetime.now(dt.timezone.utc),
            origin or checkpoint, max_files, approve, formats,
        )

    # The rows only mark the time: one for each micro-batch.
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", "1").option("numPartitions", "1").load()
    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
