import datetime as dt

import pytest
from pyspark.sql import functions as F

from surtido.fixed_values import DAY_FIRST_FORMATS
from surtido.functions import coerce
from surtido.functions.calendar import date_features
from surtido.functions.numbers import mean_of_present, never_negative, rescale, units_up
from surtido.operators import evaluation, features, sales, thresholds


def values(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in rows.select("i", make(F.col("t"))).orderBy("i").collect()]


def test_quantity(spark):
    texts = ["2.7", "0.5", "-3", "abc", None, " 7 ", "1e3", "5d", "5f", "0x10", "inf", "NaN", "1,000",
             "2147483647", "2147483648", "-2147483649", "", ".5e1", "+4"]
    assert values(spark, texts, coerce.to_quantity) == [
        2, 0, -3, 0, 0, 7, 1000, 0, 0, 0, 0, 0, 0, 2147483647, 0, 0, 0, 5, 4,
    ]


def test_date(spark):
    day = dt.date(2021, 1, 5)
    texts = ["2021-01-05", "2021-1-5", "2021-01-05 10:20:30", "2021-01-05T10:20:30", "2021/01/05",
             "01/05/2021", " 2021-01-05 ", "20210105", "1-5-2021 10:00 pm", "2021-01-05T23:59:59.5-05:00", "1.5.2021",
             "abc", None, "2021-02-30", "44201", "", "2021-01-05 basura", "2021-01-05 25:00", "20211305", "13/13/2021"]
    assert values(spark, texts, coerce.to_sale_date) == [day] * 11 + [None] * 9


def test_day_first_is_a_choice_and_large_days_say_it_themselves(spark):
    texts = ["05/01/2021", "13/01/2021", "01/13/2021", "05-01-2021 00:00", "05.01.2021"]
    days = [dt.date(2021, 1, 5), dt.date(2021, 1, 13), dt.date(2021, 1, 13), dt.date(2021, 1, 5), dt.date(2021, 1, 5)]
    assert values(spark, texts, lambda c: coerce.to_sale_date(c, DAY_FIRST_FORMATS)) == days
    assert values(spark, texts[:3], coerce.to_sale_date) == [dt.date(2021, 5, 1), *days[1:3]]


def test_sku(spark):
    assert values(spark, ["  A ", "", "   ", None, "NaN", "N/A", "00123"], coerce.to_sku) == [
        "A", None, None, None, None, None, "00123",
    ]


def test_blank_to_default(spark):
    assert values(spark, ["", None, "x"], lambda c: coerce.blank_to(c, F.lit("d"))) == ["d", "d", "x"]


def test_calendar_features(spark):
    rows = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 3, 3),)], "fecha date")
    assert [tuple(r) for r in rows.select(*date_features(F.col("fecha"))).collect()] == [
        (2, 2024, 3, 29), (3, 2024, 6, 3),
    ]


def test_prediction_arithmetic(spark):
    rows = spark.createDataFrame([(1.0, 2.2), (None, 3.0), (-9.0, 1.0), (None, None)], "a double, b double")
    mean = mean_of_present(F.col("a"), F.col("b"))
    got = [r[0] for r in rows.select(units_up(never_negative(mean))).collect()]
    assert got == [2, 3, 0, None]


def test_rescale_constant_column_is_zero_and_nothing_is_clipped(spark):
    row = spark.range(1).select(
        rescale(F.lit(7), 7, 7).alias("constant"), rescale(F.lit(30), 10, 20).alias("beyond")
    ).first()
    assert (row.constant, row.beyond) == (0.0, 2.0)


def test_missing_columns_are_named():
    assert sales.missing_columns(["SKU", "x"]) == ["Fecha Venta", "Cantidad"]


def test_project_required_refuses_missing(spark):
    with pytest.raises(ValueError, match="Cantidad"):
        sales.project_required(spark.createDataFrame([("a", "b")], "`SKU` string, `Fecha Venta` string"))


def test_file_without_valid_rows_is_invalid(spark):
    raw = spark.createDataFrame(
        [("malo.csv", "A", "abc", "1"), ("malo.csv", "A", "2021-01-01", "0"), ("bueno.csv", "A", "2021-01-01", "1")],
        "source_file string, sku_raw string, fecha_raw string, cantidad_raw string",
    )
    outcomes = sales.file_outcomes(sales.quality_report(sales.coerce_sales(raw)))
    assert {(r.nombre_archivo, r.estado, r.filas_guardadas) for r in outcomes.collect()} == {
        ("malo.csv", "invalido", 0), ("bueno.csv", "valido", 1),
    }


def test_threshold_rules(spark):
    rows = spark.createDataFrame(
        [("a", 0, 1), ("b", -1, 5), ("c", 0, 0), ("d", 5, 5), ("e", 6, 5), (None, 1, 2), ("f", None, 2)],
        "producto_id string, umbral_minimo int, umbral_sobreabastecimiento int",
    )
    got = [r.motivo for r in thresholds.check_thresholds(rows).collect()]
    assert got == [None, "umbral_minimo", "umbral_sobreabastecimiento", "orden", "orden", "producto_id", "umbral_minimo"]


def test_metrics_edges(spark):
    rows = spark.createDataFrame([(5, 5.0, 6.0), (5, 5.0, -4.0)], "y int, exact double, off double")
    got = {r.model: r for r in evaluation.evaluate(rows, "y", {"exact": "E", "off": "O"}).collect()}
    assert (got["E"].mae, got["E"].rmse, got["E"].r2) == (0.0, 0.0, 1.0)
    assert got["O"].r2 == 0.0 and got["O"].mae == 3.0  # the negative prediction counts as 0


def test_weighted_metrics_equal_repeated_rows(spark):
    data = [(1, 2.0, 3), (4, 3.5, 1), (9, 8.0, 5)]
    weighted = spark.createDataFrame(data, "y int, p double, n int")
    repeated = spark.createDataFrame([(y, p) for y, p, n in data for _ in range(n)], "y int, p double")
    a = evaluation.evaluate(weighted, "y", {"p": "m"}, "n").first()
    b = evaluation.evaluate(repeated, "y", {"p": "m"}).first()
    assert [round(a[c], 9) for c in ("mae", "rmse", "r2")] == [round(b[c], 9) for c in ("mae", "rmse", "r2")]


def test_stratification_needs_two_rows_of_several_skus(spark):
    def check(skus):
        return sales.can_stratify(spark.createDataFrame([(s,) for s in skus], "id_producto string")).first()

    assert check(["a", "a", "b", "b"]).estratificable
    assert not check(["a", "a", "b"]).estratificable
    assert not check(["a", "a"]).estratificable
    assert not check([]).estratificable


def test_scaler_refuses_no_rows(spark):
    with pytest.raises(ValueError):
        features.fit_scaler(spark.createDataFrame([], "id_producto_encoded int, mes int, anio int, dia_semana int, dia int"))


def test_every_day_reads_back_in_every_format(spark):
    days = spark.range(0, 20000, 7).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for pattern in ("yyyy-MM-dd", "yyyy-M-d", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd",
                    "MM/dd/yyyy", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyyMMdd", "M-d-yyyy h:mm a"):
        read = days.withColumn("back", coerce.to_sale_date(F.date_format("d", pattern)))
        assert read.filter("back is null or back <> d").isEmpty(), pattern


def test_whole_numbers_read_back(spark):
    numbers = spark.range(-5000, 5000).selectExpr("cast(id * 429496 as int) as q")
    assert numbers.filter(coerce.to_quantity(F.col("q").cast("string")) != F.col("q")).isEmpty()


def test_dates_are_read_by_casts_and_as_the_patterns_say(spark):
    parts = spark.range(0, 36).select((F.col("id") - 1).cast("string").alias("a"))
    texts = parts.withColumn("a", F.explode(F.array("a", F.lpad("a", 2, "0")))).distinct()
    pairs = texts.crossJoin(texts.withColumnRenamed("a", "b")).crossJoin(
        spark.createDataFrame([("2024",), ("2023",), ("0000",), ("9999",), ("20240",), ("24",)], "y string"))
    for pattern, text in (("M/d/yyyy", F.concat_ws("/", "a", "b", "y")), ("d.M.yyyy", F.concat_ws(".", "a", "b", "y")),
                          ("yyyy/M/d", F.concat_ws("/", "y", "a", "b")), ("yyyyMMdd", F.concat("y", "a", "b")),
                          ("dd-MM-yyyy", F.concat_ws("-", "a", "b", "y"))):
        shaped = F.when(text.rlike(coerce._shape(pattern)), F.try_to_timestamp(text, F.lit(pattern)).cast("date"))
        both = pairs.select(text.alias("t"), coerce.to_sale_date(text, [pattern]).alias("x"), shaped.alias("w"))
        assert [r.t for r in both.filter("not (x <=> w)").limit(5).collect()] == [], pattern
    plan = pairs.select(coerce.to_sale_date(F.col("y")), coerce.order_told(F.col("y")))
    assert "gettimestamp" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_what_a_date_tells_about_its_order(spark):
    texts = ["13/1/2024", "1/13/2024", "1/2/2024", "01/1/2024", "1-01-2024", "11/1/2024", "12/12/2024", "0/00/2024",
             "0/1/2024", "13/13/2024", "2024/1/2", "1/2/20245", "1/2/2024 10:00", " 31.12.2024 ", "", None, "001/2/2024"]
    assert values(spark, texts, coerce.order_told) == [
        "dia", "mes", "ambos", None, None, "ambos", None, None, "ambos", None, None, None, "ambos", "dia", None, None, None]
