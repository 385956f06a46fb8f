import datetime as dt

import pytest
from pyspark.sql import functions as F

from surtido import schemas
from surtido.operators import alerts, digest, registry, snapshots, thresholds

AS_OF = dt.date(2024, 5, 1)
NOW = dt.datetime(2024, 5, 1, 8, tzinfo=dt.timezone.utc)


def position(spark, rows):
    return spark.createDataFrame(
        rows,
        "id_producto string, stock_actual int, demanda_48h bigint, stock_proyectado bigint,"
        "umbral_minimo int, umbral_sobreabastecimiento int, email_notificacion string",
    )


def test_boundaries(spark):
    rows = [
        ("igual_minimo", 10, 5, 5, 5, 100, None),
        ("sobre_minimo", 11, 5, 6, 5, 100, ""),
        ("igual_maximo", 100, 5, 95, 5, 100, None),
        ("sobre_maximo", 101, 5, 96, 5, 100, "a@b"),
        ("ambos", 101, 100, 1, 5, 100, None),
    ]
    got = {r.sku: r for r in alerts.evaluate_alerts(position(spark, rows), AS_OF).collect()}
    assert {k: v.tipo_alerta for k, v in got.items()} == {
        "igual_minimo": "QUIEBRE", "sobre_maximo": "SOBRESTOCK", "ambos": "QUIEBRE",
    }
    assert got["igual_minimo"].fecha_proyeccion == dt.date(2024, 5, 3)
    assert got["sobre_maximo"].fecha_proyeccion == AS_OF
    assert got["igual_minimo"].mensaje == (
        "Riesgo de quiebre. Stock: 10. Demanda esperada: 5. Proyectado: 5. Umbral: 5."
    )
    assert got["sobre_maximo"].mensaje == (
        "Sobrestock detectado. Stock: 101. Demanda esperada: 5. Proyectado: 96. Umbral máximo: 100."
    )


def found(spark, *keys, text="m"):
    return spark.createDataFrame(
        [(s, t, text, AS_OF) for s, t in keys], "sku string, tipo_alerta string, mensaje string, fecha_proyeccion date"
    )


def test_upsert_is_idempotent_and_respects_states(spark):
    empty = spark.createDataFrame([], schemas.ALERTS)
    first = alerts.upsert_alerts(empty, found(spark, ("A", "QUIEBRE"), ("B", "SOBRESTOCK")), NOW)
    again = alerts.upsert_alerts(first, found(spark, ("A", "QUIEBRE"), text="nuevo"), NOW)
    rows = {(r.sku, r.tipo_alerta): r for r in again.collect()}
    assert len(rows) == again.count() == 2
    assert rows["A", "QUIEBRE"].mensaje == "nuevo" and rows["B", "SOBRESTOCK"].mensaje == "m"
    assert all(len(r.id) <= 36 for r in rows.values())

    handled = alerts.set_alert_states(
        again, spark.createDataFrame([(rows["A", "QUIEBRE"].id, "EN GESTIÓN"), ("otro", "PENDIENTE")], "id string, estado string")
    )
    later = alerts.upsert_alerts(handled, found(spark, ("A", "QUIEBRE")), NOW + dt.timedelta(days=1))
    states = sorted(r.estado for r in later.filter("sku = 'A'").collect())
    assert states == ["EN GESTIÓN", "PENDIENTE"] and later.select("id").distinct().count() == 3


def test_upsert_refreshes_one_of_several_pending(spark):
    old = dt.datetime(2024, 1, 1)
    current = spark.createDataFrame(
        [(i, "A", "QUIEBRE", "viejo", AS_OF, "PENDIENTE", old) for i in ("2", "1")], schemas.ALERTS
    )
    got = alerts.upsert_alerts(current, found(spark, ("A", "QUIEBRE")), NOW)
    assert {(r.id, r.mensaje) for r in got.collect()} == {("1", "m"), ("2", "viejo")}


def test_state_changes_ignore_unknown_values(spark):
    current = spark.createDataFrame([("1", "PENDIENTE")], "id string, estado string")
    changes = spark.createDataFrame([("1", "CERRADA"), ("1", None)], "id string, estado string")
    assert snapshots.change_state(current, changes, ["PENDIENTE"]).collect() == current.collect()
    assert snapshots.split_by_state(changes, ["PENDIENTE"])[1].count() == 2


def test_threshold_upsert_keeps_email(spark):
    def table(rows):
        return spark.createDataFrame(rows, schemas.THRESHOLDS)

    t0, t1, t2 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
    current = table([("A", 1, 10, "a@x", True, "s", t0), ("B", 1, 10, "", True, "s", t0)])
    changes = table([
        ("A", 2, 20, "", False, "u", t1), ("A", 3, 30, "", True, "u", t2), ("B", 5, 4, "b@x", True, "u", t2),
        ("B", 4, 40, "b@x", True, "u", t1), ("C", 0, 1, "c@x", True, "u", t1),
    ])
    got = {r.producto_id: r for r in thresholds.upsert_thresholds(current, changes).collect()}
    assert (got["A"].umbral_minimo, got["A"].email_notificacion) == (3, "a@x")
    assert (got["B"].umbral_minimo, got["B"].email_notificacion) == (4, "b@x")
    assert set(got) == {"A", "B", "C"}
    once = thresholds.upsert_thresholds(current, changes)
    twice = thresholds.upsert_thresholds(once, changes)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_training_rows_rules(spark):
    sales = spark.createDataFrame([("A", "f1"), ("B", "f2")], "id_producto string, source_file string")

    def files(*rows):
        return spark.createDataFrame(rows, "id int, ruta string, estado string")

    def chosen(table, mode):
        return sorted(r.id_producto for r in registry.training_rows(sales, table, mode).collect())

    assert chosen(files((1, "f1", "aprobado"), (2, "f2", "valido")), "empty") == ["A"]
    assert chosen(files((1, "f1", "valido")), "all") == []
    assert chosen(files((1, "otro", "aprobado")), "all") == ["A", "B"]
    assert chosen(files((1, "otro", "aprobado")), "empty") == []
    with pytest.raises(ValueError):
        registry.training_rows(sales, files((1, "f1", "valido")), "some")


def test_digest_routing_and_pages(spark):
    rows = [(f"S{i:03d}", "QUIEBRE", f"m{i}", AS_OF, "own@x" if i < 3 else ("" if i % 2 else None)) for i in range(25)]
    table = spark.createDataFrame(
        rows, "sku string, tipo_alerta string, mensaje string, fecha_proyeccion date, email_notificacion string"
    )
    routed = digest.route_alerts(table, "default@x")
    assert {tuple(r) for r in digest.alerts_by_recipient(routed).collect()} == {("own@x", 3), ("default@x", 22)}
    pages = digest.digest_pages(routed, page_rows=10).orderBy("destinatario", "pagina").collect()
    assert [(p.destinatario, p.pagina, p.n_alertas) for p in pages] == [
        ("default@x", 0, 10), ("default@x", 1, 10), ("default@x", 2, 2), ("own@x", 0, 3),
    ]
    assert pages[0].html.index("S003") < pages[0].html.index("S012") and "S013" not in pages[0].html
    assert digest.route_alerts(table, None).count() == digest.route_alerts(table, "").count() == 3


def test_default_stock_and_thresholds(spark):
    averages = spark.createDataFrame([("A", 7.0)], "id_producto string, promedio_historico double")
    stock = spark.createDataFrame([], schemas.STOCK)
    none = spark.createDataFrame([], schemas.THRESHOLDS)
    got = alerts.effective_thresholds(alerts.sku_thresholds(alerts.stock_position(averages, stock), none)).first()
    assert (got.stock_actual, got.umbral_minimo, got.umbral_sobreabastecimiento) == (0, 3, 210)


def test_very_large_averages_do_not_overflow(spark):
    averages = spark.createDataFrame([("A", 2e9)], "id_producto string, promedio_historico double")
    stock = spark.createDataFrame([], schemas.STOCK)
    none = spark.createDataFrame([], schemas.THRESHOLDS)
    position = alerts.stock_position(averages, stock)
    got = alerts.effective_thresholds(alerts.sku_thresholds(position, none)).first()
    assert got.umbral_sobreabastecimiento == 60_000_000_000


def test_semi_join_and_no_cartesian(spark):
    from conftest import SF

    from surtido.checks.queries import QUERIES

    plan = QUERIES["approved_sales"](spark, SF)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan
    for name in ("stock_alerts", "forecast_grid", "alert_upsert", "threshold_upsert", "scaled_features"):
        text = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    grid = QUERIES["forecast_grid"](spark, SF)._jdf.queryExecution().toString()
    assert "Join" not in grid


def test_json_records(spark):
    rows = spark.createDataFrame([("A", AS_OF)], "sku string, fecha date")
    assert alerts.as_json(rows).first()[0] == '{"sku":"A","fecha":"2024-05-01"}'


def test_delete_keeps_sales_untouched(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, nombre_archivo string")
    left = registry.delete_files(files, files.filter(F.col("id") == 2))
    assert [r.id for r in left.collect()] == [1]


def test_settled_alerts_spread_over_the_tasks_of_the_upsert(spark):
    stored = spark.range(4000).select(
        F.col("id").cast("string"), F.concat(F.lit("S"), F.col("id") % 900).alias("sku"), F.lit("QUIEBRE").alias("tipo_alerta"),
        F.lit("m").alias("mensaje"), F.lit(AS_OF).alias("fecha_proyeccion"),
        F.when(F.col("id") < 100, "PENDIENTE").otherwise("RESUELTO").alias("estado"),
        F.lit(NOW).cast("timestamp").alias("creado_en"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        done = alerts.upsert_alerts(stored, found(spark, ("S1", "QUIEBRE"), ("new", "QUIEBRE")), NOW)
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4001 and max(sizes) < 1000
