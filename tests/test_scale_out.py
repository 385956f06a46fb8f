"""Positions, joins and splits when one key holds a third of the rows or more."""

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from surtido import session
from surtido.checks.fixtures import fixture
from surtido.operators import features, lookups, positions, sales
from surtido.session import materialize


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    """Keep small test data in several shuffle partitions."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.set(setting, "true")


@pytest.fixture(scope="module")
def skewed(spark, many_partitions):
    """Sales with a third of the rows on one SKU, and many exact copies."""
    rows = fixture(spark, SF, "ventas").drop("source_file")
    hot = F.pmod(F.xxhash64("id_producto", "fecha", "cantidad_vendida"), F.lit(3)) == 0
    rows = rows.withColumn("id_producto", F.when(hot, "SKU-HOT").otherwise(F.col("id_producto")))
    copies = spark.range(2000).select(
        F.lit("SKU-HOT").alias("id_producto"), F.lit("2001-01-01").cast("date").alias("fecha"),
        F.lit(7).alias("cantidad_vendida"),
    )
    return materialize(rows.unionByName(copies), "skewed")


def as_table(df):
    con = duckdb.connect()
    con.register("t", df.toPandas())
    return con


def test_group_positions_match_row_number(spark, skewed):
    rows = materialize(skewed.distinct().withColumn("id", F.monotonically_increasing_id()))
    got = positions.with_group_position(rows, ["id_producto"], ["fecha", "id"])
    bad = as_table(got).sql("""
        SELECT count(*) FROM (SELECT posicion, row_number() OVER (
            PARTITION BY id_producto ORDER BY fecha, id) - 1 AS wanted FROM t) WHERE posicion <> wanted""")
    assert got.count() == rows.count() and bad.fetchall()[0][0] == 0


def test_positions_are_a_permutation_in_order(skewed):
    got = positions.with_position(skewed, ["id_producto", "fecha"], ties=True)
    con = as_table(got)
    assert con.sql("SELECT count(*) = count(DISTINCT posicion) AND max(posicion) = count(*) - 1 FROM t").fetchall()[0][0]
    assert con.sql("""SELECT count(*) FROM (SELECT id_producto, fecha,
        lag(id_producto) OVER w AS p, lag(fecha) OVER w AS f FROM t WINDOW w AS (ORDER BY posicion))
        WHERE p > id_producto OR (p = id_producto AND f > fecha)""").fetchall()[0][0] == 0


def test_copies_of_one_row_are_spread(skewed):
    placed = positions._placed(skewed, ["id_producto", "fecha", "cantidad_vendida"], ties=True)
    hot = placed.filter("id_producto = 'SKU-HOT'").groupBy("_part").count()
    assert hot.count() > 2


def test_stratified_split_is_exact(skewed):
    got = sales.stratified_split(skewed)
    total = skewed.count()
    assert got.count() == total
    assert got.filter("es_prueba").count() == -(-total // 5)
    off = got.groupBy("id_producto").agg(
        F.abs(F.count_if("es_prueba") - F.count(F.lit(1)) / 5).alias("d")
    ).filter("d >= 1")
    assert off.isEmpty()


@pytest.mark.parametrize("num,den", [(1, 5), (2, 5), (1, 3), (3, 10)])
def test_stratified_split_sizes(spark, num, den):
    rows = materialize(fixture(spark, SF, "ventas").drop("source_file"))
    total = rows.count()
    assert sales.stratified_split(rows, num, den).filter("es_prueba").count() == -(-total * num // den)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_large_lookup_join_equals_plain_join(spark, skewed, how):
    unmatched = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "SKU-SIN-CODIGO").alias("id_producto"),
        F.lit(None).cast("date").alias("fecha"), F.lit(1).alias("cantidad_vendida"),
    )
    rows = materialize(skewed.unionByName(unmatched))
    lookup = materialize(features.fit_encoder(skewed))
    wanted = rows.join(lookup, "id_producto", how)
    got = lookups.lookup_join(rows, lookup, "id_producto", how, broadcast_bytes=0)
    assert "SortMergeJoin" in got._jdf.queryExecution().toString()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert got.select(*wanted.columns).exceptAll(wanted).isEmpty()
    assert wanted.exceptAll(got.select(*wanted.columns)).isEmpty()


def test_scans_do_not_multiply(spark):
    from surtido.checks.queries import QUERIES

    def scans(name):
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("/lineitem.parquet")

    assert scans("encoded_sales_large_lookup") <= 2
    assert scans("alert_upsert") <= scans("stock_alerts") + 1


def test_lookup_size_counts_the_texts(spark):
    table = spark.createDataFrame([("añb", 1), (None, 2)], "t string, n int")
    assert lookups.measured_bytes(table) == 2 * 32 + 4
    assert lookups.measured_bytes(table.limit(0)) == 0


def test_shuffle_settings_follow_the_bytes():
    assert session.shuffle_settings(1)["spark.sql.shuffle.partitions"] == "200"
    assert session.shuffle_settings(10 << 40)["spark.sql.shuffle.partitions"] == str(10 * 8192)


def test_counts_collapse_copies(skewed):
    counted = sales.sales_counts(skewed)
    assert counted.agg(F.sum("n")).first()[0] == skewed.count()
    assert counted.filter("id_producto = 'SKU-HOT' and fecha = '2001-01-01' and cantidad_vendida = 7").first().n >= 2000


def test_unknown_join_kind_is_refused(spark, skewed):
    with pytest.raises(ValueError):
        lookups.lookup_join(skewed, skewed, "id_producto", "full")


def test_split_divides_a_hot_row_in_proportion(skewed):
    counted = sales.sales_counts(skewed)
    split = sales.split_counts(counted, "es_prueba", (1, 5), "prueba")
    assert split.agg(F.sum("n")).first()[0] == skewed.count()
    hot = counted.orderBy(F.desc("n")).first()
    sides = split.filter(
        (F.col("id_producto") == hot.id_producto) & (F.col("fecha") == hot.fecha)
        & (F.col("cantidad_vendida") == hot.cantidad_vendida)
    ).groupBy("es_prueba").agg(F.sum("n").alias("n"))
    test = {r.es_prueba: r.n for r in sides.collect()}[True]
    assert abs(test - hot.n / 5) < 1
