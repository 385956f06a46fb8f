"""Validation of incoming sales, cleaning of stored sales, history of SKUs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    DATE_FORMATS,
    MSG_MISSING_COLUMNS,
    MSG_NO_VALID_ROWS,
    MSG_SAVED,
    REQUIRED_COLUMNS,
    STORED_NAMES,
)
from ..functions.calendar import day_text
from ..functions.coerce import day_first, finite_or_null, order_told, other_order, to_quantity, to_sale_date, to_sku
from ..functions.numbers import hash60, hash_below
from .lookups import lookup_join
from .positions import with_position

BUSINESS_KEYS = ("id_producto", "fecha", "cantidad_vendida")


def missing_columns(columns: Iterable[str], required: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    """Required columns that a file lacks, in the required order."""
    present = set(columns)
    return [name for name in required if name not in present]


def project_required(df: DataFrame, names: dict[str, str] = STORED_NAMES) -> DataFrame:
    """The required columns under their stored names, plus ``source_file`` if present."""
    absent = missing_columns(df.columns, list(names))
    if absent:
        raise ValueError(MSG_MISSING_COLUMNS + ", ".join(absent))
    extra = [F.col("source_file")] if "source_file" in df.columns else []
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()], *extra)


def coerce_sales(raw: DataFrame, formats: Sequence[str] = DATE_FORMATS, *extra: str) -> DataFrame:
    """Typed columns, those named in ``extra``, and ``motivo``, the reason a row is rejected (null when kept).

    Input columns: ``source_file``, ``sku_raw``, ``fecha_raw``, ``cantidad_raw``.
    """
    typed = raw.select(
        to_sku(F.col("sku_raw")).alias("id_producto"),
        to_sale_date(F.col("fecha_raw"), formats).alias("fecha"),
        to_quantity(F.col("cantidad_raw")).alias("cantidad_vendida"),
        "source_file",
        *extra,
    )
    reason = (
        F.when(F.col("fecha").isNull(), F.lit("fecha"))
        .when(F.col("cantidad_vendida") <= 0, F.lit("cantidad"))
        .when(F.col("id_producto").isNull(), F.lit("sku"))
    )
    return typed.withColumn("motivo", reason)


def coerce_both_orders(raw: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """``coerce_sales`` with ``orden``, what the date tells, and ``fecha_otra``, its reading in the other order.

    Texts that can be read in both orders are read in that of ``formats`` until
    ``settle_dates`` knows the file's own.
    """
    told = order_told(F.col("fecha_raw")) if day_first(formats) is not None else F.lit(None).cast("string")
    other = F.when(told == "ambos", to_sale_date(F.col("fecha_raw"), other_order(formats)))
    extra = raw.withColumn("orden", told).withColumn("fecha_otra", other)
    coerced = coerce_sales(extra, formats, "orden", "fecha_otra")
    # A text of which one reading fails after all is no doubtful one.
    sure = F.col("fecha").isNull() | F.col("fecha_otra").isNull()
    return coerced.withColumn("orden", F.when((F.col("orden") == "ambos") & sure, F.lit(None)).otherwise(F.col("orden")))


def date_orders(coerced: DataFrame) -> DataFrame:
    """The order of day and month in each file with dates that depend on it, by one pass of partial counts.

    ``orden`` is what more of its dates tell, ``dia`` or ``mes``, and
    ``indeciso`` if none or as many of either do. Files whose dates leave no
    doubt are not listed.
    """
    counted = coerced.filter(F.col("orden").isNotNull()).groupBy("source_file").agg(
        *(F.count_if(F.col("orden") == name).alias(f"fechas_{name}") for name in ("dia", "mes", "ambos")))
    more = F.when(F.col("fechas_dia") > F.col("fechas_mes"), "dia").when(F.col("fechas_mes") > F.col("fechas_dia"), "mes")
    return counted.filter("fechas_ambos > 0").withColumn("orden", more.otherwise("indeciso"))


def settle_dates(coerced: DataFrame, orders: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Every doubtful date in its file's order; in that of ``formats`` where the file is undecided."""
    other = "mes" if day_first(formats) else "dia"
    turned = orders.filter(F.col("orden") == other).select("source_file", F.lit(True).alias("_otra"))
    joined = lookup_join(coerced, turned, "source_file", "left")
    use = F.col("_otra") & (F.col("orden") == "ambos")
    return joined.withColumn("fecha", F.when(use, F.col("fecha_otra")).otherwise(F.col("fecha"))).select(
        *[c for c in coerced.columns if c not in ("orden", "fecha_otra")])


def valid_sales(coerced: DataFrame) -> DataFrame:
    return coerced.filter(F.col("motivo").isNull()).drop("motivo")


def rejected_sales(coerced: DataFrame) -> DataFrame:
    return coerced.filter(F.col("motivo").isNotNull())


def quality_report(coerced: DataFrame) -> DataFrame:
    """Rows read, kept and dropped per file, with the reason of each drop. One pass."""
    reason = F.col("motivo")
    return coerced.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("filas_leidas"),
        F.count_if(reason.isNull()).alias("filas_validas"),
        F.count_if(reason.isNotNull()).alias("filas_descartadas"),
        F.count_if(reason == "fecha").alias("fecha_invalida"),
        F.count_if(reason == "cantidad").alias("cantidad_invalida"),
        F.count_if(reason == "sku").alias("sku_invalido"),
    )


def file_outcomes(report: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """Path, name, state, saved rows and message of each file, from its quality report.

    ``problems`` lists files that could not be read at all (``source_file``,
    ``problema``).
    """
    kept = F.col("filas_validas")
    name = F.element_at(F.split("source_file", "/"), -1).alias("nombre_archivo")
    outcomes = report.select(
        F.col("source_file").alias("ruta"), name,
        F.when(kept > 0, "valido").otherwise("invalido").alias("estado"),
        kept.alias("filas_guardadas"),
        F.when(kept > 0, MSG_SAVED).otherwise(MSG_NO_VALID_ROWS).alias("mensaje"),
    )
    if problems is not None:
        outcomes = outcomes.unionByName(
            problems.select(
                F.col("source_file").alias("ruta"), name,
                F.lit("invalido").alias("estado"),
                F.lit(0).cast("bigint").alias("filas_guardadas"),
                F.col("problema").alias("mensaje"),
            )
        )
    return outcomes


def distinct_sales(sales: DataFrame, keys: Sequence[str] = BUSINESS_KEYS) -> DataFrame:
    """One row per key. Copies collapse map-side before the shuffle."""
    return sales.select(*keys).distinct()


def clean_stored_sales(sales: DataFrame, keys: Sequence[str] = BUSINESS_KEYS) -> DataFrame:
    """Stored sales with a date, without duplicates, with a positive whole quantity."""
    typed = sales.select(
        F.col("id_producto").cast("string").alias("id_producto"),
        F.col("fecha").cast("date").alias("fecha"),
        to_quantity(F.col("cantidad_vendida")).alias("cantidad_vendida"),
    )
    kept = typed.filter(F.col("fecha").isNotNull() & (F.col("cantidad_vendida") > 0))
    return distinct_sales(kept, keys)


def drop_non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose listed columns are all finite numbers."""
    numeric = df.withColumns({name: finite_or_null(F.col(name)) for name in columns})
    return numeric.na.drop(subset=list(columns))


def sales_counts(sales: DataFrame) -> DataFrame:
    """Equal sales collapsed to one row with a count ``n``; the counts are exact.

    Training and evaluation read this instead of the raw rows: it holds at most
    SKUs x days x distinct quantities rows, however hot one SKU is.
    """
    return sales.groupBy(*BUSINESS_KEYS).agg(F.count(F.lit(1)).alias("n"))


def split_counts(
    counts: DataFrame, name: str, share: Sequence[int], salt: str, where: Column | None = None,
    bounds: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Divide the ``n`` copies of every row in the given share, flagged in ``name``.

    A row of many copies is divided like any other group of rows, so a hot one
    cannot upset the share; a hash of the row decides about the remainder. Rows
    outside ``where`` stay whole; ``bounds`` are the fewest and most copies of a
    row to flag. No shuffle.
    """
    num, den = share
    keys = [F.lit(salt), *[F.col(c) for c in BUSINESS_KEYS]]
    taken = F.floor(F.col("n") * num / den) + hash_below((F.col("n") * num) % den, den, *keys).cast("int")
    if bounds is not None:
        taken = F.least(F.greatest(taken, bounds[0]), bounds[1])
    if where is not None:
        taken = F.when(where, taken).otherwise(F.lit(0))
    others = [c for c in counts.columns if c != "n"]
    both = F.array(
        F.struct(F.lit(True).alias(name), F.col("_taken").alias("n")),
        F.struct(F.lit(False).alias(name), (F.col("n") - F.col("_taken")).alias("n")),
    )
    return (
        counts.withColumn("_taken", taken.cast("bigint"))
        .select(*others, F.inline(both)).filter(F.col("n") > 0)
    )


def sku_history(sales: DataFrame, sku: str) -> DataFrame:
    """Dates and quantities of one SKU, oldest first. The filter reaches the scan."""
    return (
        sales.filter(F.col("id_producto") == F.lit(str(sku)))
        .select("fecha", "cantidad_vendida")
        # The id spreads equal rows over the sort's partitions; it is not kept.
        .orderBy("fecha", "cantidad_vendida", F.monotonically_increasing_id())
        .select(day_text(F.col("fecha")).alias("fecha"), "cantidad_vendida")
    )


def sku_histories(sales: DataFrame, skus: DataFrame) -> DataFrame:
    """History of every SKU listed in ``skus`` (column ``id_producto``)."""
    wanted = skus.select("id_producto").distinct()
    numbered = sales.select("id_producto", "fecha", "cantidad_vendida").withColumn(
        "_tie", F.monotonically_increasing_id()
    )
    return (
        lookup_join(numbered, wanted, "id_producto", "left_semi")
        .orderBy("id_producto", "fecha", "cantidad_vendida", "_tie")
        .select("id_producto", day_text(F.col("fecha")).alias("fecha"), "cantidad_vendida")
    )


def stratified_split(sales: DataFrame, num: int = 1, den: int = 5) -> DataFrame:
    """Flag ``num/den`` of the rows of every SKU as test rows, in ``es_prueba``.

    Rows are put in order of SKU and a hash of the row and taken at a fixed step,
    so the test side has exactly ``ceil(rows * num / den)`` rows, at least one,
    and each SKU its share within one row. ``sales`` comes straight from a stored
    table.
    """
    hashed = sales.withColumn("_hash", hash60(*[F.col(c) for c in BUSINESS_KEYS]))
    placed = with_position(hashed, ["id_producto", "_hash"], "_pos", ties=True, drop=["_hash"])
    taken = F.pmod(-F.col("_pos") * num, F.lit(den)) < num
    return placed.withColumn("es_prueba", taken).drop("_pos")


def can_stratify(sales: DataFrame) -> DataFrame:
    """One row: SKUs, smallest sample, and whether every SKU can be on both sides."""
    per_sku = sales.groupBy("id_producto").agg(F.count(F.lit(1)).alias("n"))
    return per_sku.agg(
        F.count(F.lit(1)).alias("n_skus"),
        F.min("n").alias("min_muestras"),
        F.coalesce((F.count(F.lit(1)) > 1) & (F.min("n") >= 2), F.lit(False)).alias("estratificable"),
    )
