"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from surtido.session import scratch_path, temporary_results


def kept_by_worker(key: tuple, make: Callable):
    """``make()``, called once in each Python worker and kept for its later tasks.

    Functions of this package travel by value, so a module variable would be
    made again for every task; the store hangs on the interpreter instead.
    """
    store = sys.modules.setdefault("_surtido_worker_store", types.ModuleType("_surtido_worker_store"))
    kept = store.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def whole_text(name: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: T.StructType,
             batch_bytes: int = 16 << 20) -> DataFrame:
    """One Arrow pass: ``rows`` takes an iterator of tuples of a task and yields tuples of ``schema``.

    Output goes back in batches of about ``batch_bytes``, so that neither a
    task's whole result nor one large input batch has to fit in memory.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    yield from zip(*(column.to_pylist() for column in part.columns))

        held, size = [], 0
        for row in rows(taken()):
            held.append(row)
            size += 24 + sum(len(v) if isinstance(v, (str, bytes)) else 16 for v in row)
            if size >= batch_bytes or len(held) >= 8192:
                yield arrow_batch(held, arrow)
                held, size = [], 0
        if held:
            yield arrow_batch(held, arrow)

    return df.mapInArrow(run, schema)


def arrow_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)


def struct_of(**kinds: str) -> T.StructType:
    """Schema from ``name="long"`` pairs."""
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items()])


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``build()`` as a table in the shared folder; the tables that ``build`` stored on the way are deleted."""
    path = scratch_path(spark, name)
    with temporary_results(spark):
        built = build()
        schema = built.schema
        built.write.parquet(path)
    return release_shuffles(spark.read.schema(schema).parquet(path))


def stored_blocks(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for rows of a megabyte or so.

    Parquet looks at a page's size only once it has a hundred rows, and packs a
    page as a whole outside the heap; here it looks after each row.
    """
    path = scratch_path(df.sparkSession, name)
    checks = {f"parquet.{part}.size.row.check.{end}": "1" for part in ("page", "block") for end in ("min", "max")}
    df.write.options(**checks).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(df: DataFrame) -> DataFrame:
    """``df``, after asking the driver to let go of the shuffle files of finished steps now.

    Spark deletes them once the driver has collected the plan that made them,
    which a driver with little work may put off for half an hour.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df
