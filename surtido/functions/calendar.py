"""Calendar features and date texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_features(fecha: Column) -> list[Column]:
    """Month, year, day of week (Monday 0) and day of month."""
    return [
        F.month(fecha).alias("mes"),
        F.year(fecha).alias("anio"),
        F.weekday(fecha).alias("dia_semana"),
        F.dayofmonth(fecha).alias("dia"),
    ]


def day_text(fecha: Column) -> Column:
    return F.date_format(fecha, "yyyy-MM-dd")


def minute_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm")
