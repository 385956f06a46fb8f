"""Every query against its DuckDB SQL; queries without SQL by their invariants."""

import pytest
from compare import connection, differences
from conftest import SF

import __spark_entry__ as entry_points
from surtido.fixed_values import MODEL_HYBRID, MODEL_NETWORK, MODEL_TREES

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


# The training-data queries have tests of their own.
@pytest.mark.parametrize("name", [n for n in entry_points.QUERIES if n in ORACLES])
def test_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_the_flagship(spark):
    result = entry_points.entry(spark)
    assert result.count() > 0
    assert {r.tipo_alerta for r in result.select("tipo_alerta").distinct().collect()} == {
        "QUIEBRE", "SOBRESTOCK",
    }


def test_training_metrics(spark):
    rows = QUERIES["training_metrics"](spark, SF).collect()
    assert [r.model for r in rows] == [MODEL_TREES, MODEL_NETWORK, MODEL_HYBRID]
    for r in rows:
        assert 0 < r.mae <= r.rmse and 0 <= r.r2 <= 1


def test_forecasts_cover_known_skus_and_are_whole_units(spark):
    requests = QUERIES["request_forecasts"](spark, SF)
    assert requests.filter("prediccion is null or prediccion < 0").isEmpty()
    unknown = requests.filter("id_producto like 'PRODUCTO-NUEVO-%'")
    assert unknown.isEmpty()
    per_sku = QUERIES["horizon_forecasts"](spark, SF).groupBy("id_producto").count()
    assert per_sku.filter("count <> 2").isEmpty()
    assert per_sku.count() == QUERIES["stored_encoder"](spark, SF).count()


def test_daily_run_stores_one_pending_alert_per_sku_and_type(spark):
    stored = QUERIES["daily_alert_run"](spark, SF)
    assert stored.count() > 0
    assert stored.groupBy("sku").count().filter("count > 1").isEmpty()
