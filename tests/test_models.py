import datetime as dt
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from surtido import schemas
from surtido.fixed_values import FEATURES, MODEL_HYBRID, MODEL_NETWORK, MODEL_TREES, NETWORK_LAYERS, TARGET, TREES
from surtido.models import network as net
from surtido.models import tables
from surtido.models import trees as gbt
from surtido.models.artifacts import load_artifacts
from surtido.operators import evaluation, features
from surtido.plans import training
from surtido.plans.forecasting import forecast, unknown_requests
from surtido.session import materialize, scratch_path
from surtido.sources.snapshots import latest_path, read_snapshot, write_snapshot

NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_parameter_count():
    assert net.parameter_count(NETWORK_LAYERS) == 2497
    assert len(net.initial_parameters(NETWORK_LAYERS, 1)) == 2497


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    layers = (5, 4, 3, 1)
    flat = net.initial_parameters(layers, 3) + rng.normal(0, 0.1, net.parameter_count(layers))
    x, y, w = rng.random((20, 5)), rng.random(20), rng.integers(1, 5, 20).astype(float)

    def loss(p):
        return (w * (net.forward(p, layers, x)[-1][:, 0] - y) ** 2).sum() / w.sum()

    wanted = [(loss(flat + e) - loss(flat - e)) / 2e-6 for e in np.eye(len(flat)) * 1e-6]
    assert np.allclose(net.gradient(flat, layers, x, y, w), wanted, atol=1e-5)


def test_state_packs_and_unpacks():
    state = net.AdamState(np.arange(3.0), np.ones(3), np.zeros(3), 7)
    back = net.AdamState.unpack(state.pack())
    assert back.steps == 7 and np.array_equal(back.flat, state.flat) and np.array_equal(back.first, state.first)


@pytest.fixture(scope="module")
def learnable(spark):
    """Scaled features whose target depends on them."""
    rows = spark.range(6000)
    for i, name in enumerate(FEATURES):
        rows = rows.withColumn(name, (F.pmod(F.hash("id", F.lit(i)), F.lit(1000)) / 1000.0))
    target = 10 + 20 * F.col(FEATURES[0]) + 10 * F.col(FEATURES[1]) * F.col(FEATURES[2])
    rows = rows.withColumn(TARGET, target).withColumn("n", F.lit(1))
    return materialize(rows.withColumn("es_validacion", F.col("id") % 5 == 0))


def r2(rows, column):
    error = F.sum(F.pow(F.col(TARGET) - F.col(column), 2))
    return rows.agg((1 - error / (F.var_pop(TARGET) * F.count("*"))).alias("r2")).first().r2


def test_network_learns_and_keeps_the_best_weights(spark, learnable):
    model = net.fit_network(learnable, 6000, partitions=4, epochs=40)
    assert min(model.losses) < model.losses[0] / 5
    assert r2(net.predict_network(model, learnable), net.PREDICTION) > 0.9
    held = net.predict_network(model, learnable.filter("es_validacion"))
    loss = held.agg(F.avg(F.pow(F.col(TARGET) - F.col(net.PREDICTION), 2))).first()[0]
    assert loss == pytest.approx(min(model.losses), rel=1e-6)


def test_heavy_rows_are_cut_without_losing_weight(spark):
    rows = spark.createDataFrame([(1, 1_000_000.0), (2, 1.0), (3, 2.0), (4, 1.0)], "id int, n double")
    cut = net._even_pieces(rows)
    assert cut.agg(F.sum("n")).first()[0] == pytest.approx(1_000_004)
    assert cut.count() <= 8 and cut.agg(F.max("n")).first()[0] <= 1_000_004 / 4


def test_few_sales_still_give_both_sides(spark):
    sales = materialize(spark.range(6).select(
        F.lit("A").alias("id_producto"), F.lit("2024-01-01").cast("date").alias("fecha"),
        F.lit(3).alias("cantidad_vendida"), F.lit("a.csv").alias("source_file"),
    ))
    for stratified in (True, False):
        cells = training.training_cells(sales.limit(2).drop("source_file"), stratified)
        assert training._sides(cells) == (1, 1)
    assert sum(training._sides(training.training_cells(sales.limit(1).drop("source_file")))) == 1


def test_network_repeats_itself(spark, learnable):
    runs = [net.fit_network(learnable, 6000, partitions=3, epochs=3).flat for _ in range(2)]
    assert np.array_equal(*runs)


def test_network_table_round_trip(spark, learnable):
    model = net.Network(net.initial_parameters(NETWORK_LAYERS, 5))
    back = net.network_from_table(net.network_table(spark, model))
    assert back.layers == model.layers and np.array_equal(back.flat, model.flat)


def test_weighted_rows_train_the_same_trees(spark, learnable):
    one = learnable.withColumn(FEATURES[0], F.round(FEATURES[0], 1)).filter("id < 1500")
    for name in FEATURES[1:]:
        one = one.withColumn(name, F.lit(0.5))
    one = one.withColumn(TARGET, F.round(TARGET).cast("int"))
    rows = materialize(one)
    counted = materialize(rows.groupBy(*FEATURES, TARGET).agg(F.count("*").alias("n")))
    grid = rows.select(*FEATURES).distinct()
    a = gbt.predict_trees(gbt.fit_trees(rows, maxIter=5), grid)
    b = gbt.predict_trees(gbt.fit_trees(counted, maxIter=5), grid)
    joined = a.join(b.withColumnRenamed(gbt.PREDICTION, "other"), list(FEATURES))
    assert joined.filter(F.abs(F.col("other") - F.col(gbt.PREDICTION)) > 1e-6).isEmpty()
    assert joined.count() == 11


def test_trees_read_bins_and_not_all_rows(spark, learnable):
    typed = materialize(learnable.select(*FEATURES, F.col(TARGET).cast("double"), F.lit(2.0).alias("n")))
    cuts = gbt.bin_cuts(typed, "n", bins=8, columns=FEATURES[:1])
    assert list(cuts) == [FEATURES[0]] and len(cuts[FEATURES[0]]) == 7
    place = sum((F.col(FEATURES[0]) >= c).cast("int") for c in cuts[FEATURES[0]])
    binned = typed.select(place.alias("b"), TARGET, "n")
    sizes = [r["count"] for r in binned.groupBy("b").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)  # a bin differs by a value's rows
    grouped = gbt.group_bins(binned, ["b"], "n")
    assert grouped.count() == 8 and grouped.agg(F.sum("n")).first()[0] == 12000
    mean = grouped.agg(F.sum(F.col("n") * F.col(TARGET)) / F.sum("n")).first()[0]
    assert mean == pytest.approx(typed.agg(F.avg(TARGET)).first()[0])


def test_a_missing_target_is_not_averaged_away(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, None, 1.0), (1.0, 3.0, 2.0)], f"b double, {TARGET} double, n double")
    got = {r.b: (r[TARGET], r.n) for r in gbt.group_bins(rows, ["b"], "n").collect()}
    assert got == {0.0: (None, 2.0), 1.0: (3.0, 2.0)}


def test_a_heavy_value_has_its_own_bin(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") == 500, 1e6).otherwise(1.0).alias("n"))
    cuts = gbt.bin_cuts(rows, "n", bins=256, columns=["x"])["x"]
    assert cuts == [499.5, 500.5]


def test_trees_of_binned_rows_are_as_good_and_stored_with_their_thresholds(spark, learnable):
    plain, binned = gbt.fit_trees(learnable, maxIter=10), gbt.fit_trees(learnable, group_above=0, maxIter=10)
    assert not gbt.thresholds(plain) and set(gbt.thresholds(binned)) == set(range(len(FEATURES)))
    both = [r2(gbt.predict_trees(m, learnable), gbt.PREDICTION) for m in (plain, binned)]
    assert both[1] == pytest.approx(both[0], abs=0.003)
    assert " in {" not in binned.stages[-1].trees[0].toDebugString  # thresholds, not categories
    path = scratch_path(spark, "trees")
    binned.write().save(path)
    scored = materialize(gbt.predict_trees(binned, learnable))
    assert scored.columns == [*learnable.columns, gbt.PREDICTION]
    nodes = materialize(tables.split_rows(spark, f"{path}/stages/*", gbt.thresholds(binned)))
    walked = scored.join(tables.tree_scores(scored, nodes, "id", TREES["maxDepth"]), "id")
    assert walked.filter(f"abs(pred_arboles - {gbt.PREDICTION}) > 1e-8").isEmpty() and walked.count() == 6000


def test_steps_in_place_are_those_of_the_gradient():
    rng = np.random.default_rng(1)
    x, y, w = rng.random((96, 5)), rng.random(96) * 50, rng.integers(1, 4, 96).astype(float)
    flat = net.initial_parameters(NETWORK_LAYERS, 2)
    plain, fast = (net.AdamState(flat.copy(), np.zeros_like(flat), np.zeros_like(flat)) for _ in range(2))
    steps = net._Steps(fast, NETWORK_LAYERS, 0.01)
    for at in range(0, 96, 32):
        part = slice(at, at + 32)
        plain.step(net.gradient(plain.flat, NETWORK_LAYERS, x[part], y[part], w[part]), 0.01)
        steps.step(x[part], y[part], w[part])
    assert np.allclose(plain.pack(), fast.pack(), rtol=1e-9, atol=1e-12)


def test_partial_sums_are_added_by_many_tasks_in_one_order(spark):
    rows = [(i, 1.0 / (i + 1), 1.0, 2.0, (np.arange(3.0) / (i + 1)).tobytes() if i % 3 else None) for i in range(100)]
    sums = [net._total(spark.createDataFrame(r, net._STATS).repartition(7), 100) for r in (rows, rows[::-1])]
    assert sums[0] == sums[1] and (sums[0].held, sums[0].seen) == (100.0, 200.0)
    assert np.allclose(np.frombuffer(sums[0].packed), np.arange(3.0) * sum(1 / (i + 1) for i in range(100) if i % 3))
    assert sums[0].lost == pytest.approx(sum(r[1] for r in rows))


def test_adding_up_an_epoch_leaves_its_python_worker_alive(spark, monkeypatch, tmp_path):
    add_up = net._add_up

    def noted(batches):
        import os
        (tmp_path / str(os.getpid())).touch()
        yield from add_up(batches)

    monkeypatch.setattr(net, "_add_up", noted)
    partial = materialize(spark.createDataFrame([(i, 1.0, 1.0, 1.0, np.arange(3.0).tobytes()) for i in range(4)], net._STATS))
    for _ in range(3):
        assert net._total(partial, 4).held == 4.0
    time.sleep(1)
    used = [int(p.name) for p in tmp_path.iterdir()]
    assert used and all(Path(f"/proc/{pid}").exists() for pid in used)


def test_partitions_of_one_task_train_as_by_themselves(spark, learnable, monkeypatch):
    alone = net.fit_network(learnable, 6000, partitions=6, epochs=2)
    monkeypatch.setattr(net, "_TASKS", 2)
    shared = net.fit_network(learnable, 6000, partitions=6, epochs=2)
    assert np.array_equal(alone.flat, shared.flat) and alone.losses == shared.losses


def test_network_scores_by_tables_move_no_rows(spark):
    model = net.Network(net.initial_parameters(NETWORK_LAYERS, 7))
    rows = spark.range(200).select("id", *[(F.pmod(F.hash("id", F.lit(i)), F.lit(100)) / 100).alias(c) for i, c in enumerate(FEATURES)])
    scores = tables.network_scores(rows, materialize(tables.neuron_rows(spark, model)), "id")
    both = net.predict_network(model, rows).join(scores, "id")
    assert both.count() == 200 and both.filter("abs(pred_red - pred_network) > 1e-9").isEmpty()
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == len(NETWORK_LAYERS) - 1  # of the neurons alone


@pytest.fixture(scope="module")
def sales(spark):
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 365).cast("int"))
    return materialize(spark.range(4000).select(
        F.concat(F.lit("SKU-"), (F.col("id") % 7).cast("string")).alias("id_producto"),
        day.alias("fecha"), (1 + (F.col("id") % 7) * 5).cast("int").alias("cantidad_vendida"),
        F.when(F.col("id") % 7 == 6, "b.csv").otherwise("a.csv").alias("source_file"),
    ))


def registry_of(spark, root, *rows):
    table = spark.createDataFrame(
        [(i, name, NOW.replace(tzinfo=None), state, 1, None, "Sistema", name, "manual", 1) for i, name, state in rows], schemas.FILES
    )
    write_snapshot(table, root)


def test_retrain_stores_a_model_and_marks_only_the_files_it_read(spark, sales):
    root, models, log = (scratch_path(spark, n) for n in ("registry", "models", "log"))
    registry_of(spark, root, (1, "a.csv", "aprobado"), (2, "b.csv", "valido"))
    result = training.retrain(sales, root, models, log, NOW, use=("trees",))
    assert result.status == "success" and result.path == latest_path(spark, models)
    states = {r.id: r.estado for r in read_snapshot(spark, root, schemas.FILES).collect()}
    assert states == {1: "procesado", 2: "valido"}
    logged = spark.read.parquet(log).collect()
    assert [r.model for r in logged] == [MODEL_TREES] and logged[0].r2 > 0.95

    artifacts = load_artifacts(spark, models)
    assert artifacts.network is None and artifacts.encoder.count() == 6  # b.csv's SKU was not approved
    requests = spark.createDataFrame(
        [("SKU-2", "2024-02-01"), ("SKU-6", "2024-02-01"), ("PRODUCTO-NUEVO-XYZ", "2024-02-01"), ("SKU-3", "abc")],
        "id_producto string, fecha_str string",
    )
    got = {(r.id_producto, str(r.fecha)): r.prediccion for r in forecast(requests, artifacts).collect()}
    assert set(got) == {("SKU-2", "2024-02-01")} and 11 <= got["SKU-2", "2024-02-01"] <= 12
    unknown = {r.id_producto for r in unknown_requests(requests, artifacts).collect()}
    assert unknown == {"SKU-6", "PRODUCTO-NUEVO-XYZ"}


def test_training_needs_approved_rows(spark, sales):
    files = spark.createDataFrame([(1, "a.csv", "valido")], "id bigint, ruta string, estado string")
    result = training.train(sales, files, scratch_path(spark, "m"), scratch_path(spark, "l"), NOW)
    assert result.status == "error" and result.artifacts is None


def test_one_failing_model_leaves_the_other(spark, sales, monkeypatch):
    def broken(*_, **__):
        raise net.NotFitted("sin ajuste")

    files = spark.createDataFrame(
        [(1, "a.csv", "aprobado")], "id bigint, ruta string, estado string"
    )
    monkeypatch.setattr(gbt, "fit_trees", broken)
    monkeypatch.setattr(
        net, "fit_network", lambda *_, **__: net.Network(net.initial_parameters(NETWORK_LAYERS, 1))
    )
    log = scratch_path(spark, "log")
    result = training.train(sales, files, scratch_path(spark, "m"), log, NOW)
    assert result.status == "partial" and "sin ajuste" in result.message
    assert [r.model for r in spark.read.parquet(log).collect()] == [MODEL_NETWORK]
    monkeypatch.setattr(net, "fit_network", broken)
    failed = training.train(sales, files, scratch_path(spark, "m"), log, NOW)
    assert failed.status == "error" and failed.path is None

    def dies(*_, **__):
        raise RuntimeError("sin memoria")

    monkeypatch.setattr(net, "fit_network", dies)  # no fault of the model
    with pytest.raises(RuntimeError, match="sin memoria"):
        training.train(sales, files, scratch_path(spark, "m"), log, NOW)


def test_a_network_that_diverges_is_not_fitted(spark, sales):
    files = spark.createDataFrame([(1, "a.csv", "aprobado")], "id bigint, ruta string, estado string")
    wild = sales.withColumn("cantidad_vendida", F.lit(2_000_000_000))
    cells = training.training_cells(wild.select(*training.BUSINESS_KEYS))
    table, _ = training.feature_table(cells, features.fit_encoder(cells))
    with pytest.raises(net.NotFitted):
        net.fit_network(table.withColumn(TARGET, F.col(TARGET) * 1e300), 100, epochs=2)


def test_training_goes_on_after_a_lost_driver(spark, sales, monkeypatch):
    cells = training.training_cells(sales.select(*training.BUSINESS_KEYS))
    table = materialize(training.feature_table(cells, features.fit_encoder(cells))[0])
    whole = net.fit_network(table, 4000, 2000, epochs=8)
    root, task, calls = scratch_path(spark, "avance"), net._epoch_task, []

    def counted(*args):
        calls.append(args)
        if len(calls) == 6:
            raise RuntimeError("conductor perdido")
        return task(*args)

    monkeypatch.setattr(net, "_epoch_task", counted)
    with pytest.raises(RuntimeError, match="conductor"):
        net.fit_network(table, 4000, 2000, epochs=8, checkpoint=root, checkpoint_every=2)
    again = net.fit_network(table, 4000, 2000, epochs=8, checkpoint=root, checkpoint_every=2)
    assert len(calls) == 6 + 5  # epochs 4 to 8
    assert (again.flat == whole.flat).all() and again.losses == whole.losses
    other = net.fit_network(table, 4000, 2000, epochs=8, seed=1, checkpoint=root)  # other settings start anew
    assert (other.flat != whole.flat).any() and len(calls) > 11 + 8


def test_scores_by_joins_equal_the_models(spark, sales):
    files = spark.createDataFrame([(1, "a.csv", "aprobado")], "id bigint, ruta string, estado string")
    root, log = scratch_path(spark, "m"), scratch_path(spark, "log")
    result = training.train(sales, files, root, log, NOW)
    stored = load_artifacts(spark, root)
    rows = materialize(stored.predictions.withColumn("fila", F.monotonically_increasing_id()))
    assert rows.count() > 100
    by_tree = tables.tree_scores(rows, stored.splits, "fila", TREES["maxDepth"])
    by_net = tables.network_scores(rows, stored.neurons, "fila")
    both = rows.join(by_tree, "fila").join(by_net, "fila")
    assert both.count() == rows.count()
    off = both.filter("abs(pred_trees - pred_arboles) > 1e-8 or abs(pred_network - pred_red) > 1e-8")
    assert off.isEmpty()
    again = evaluation.evaluate(stored.predictions, TARGET, {"pred_hybrid": MODEL_HYBRID}, "n").first()
    logged = spark.read.parquet(log).first()
    assert result.status == "success" and (again.mae, again.rmse, again.r2) == (logged.mae, logged.rmse, logged.r2)


def test_stratified_network_training(spark, sales):
    files = spark.createDataFrame(
        [(1, "a.csv", "aprobado"), (2, "b.csv", "aprobado")], "id bigint, ruta string, estado string"
    )
    models = scratch_path(spark, "models")
    result = training.train(
        sales, files, models, scratch_path(spark, "log"), NOW, stratified=True, fit_on_train=True, use=("network",)
    )
    assert [r.model for r in result.metrics.collect()] == [MODEL_NETWORK]
    back = load_artifacts(spark, models)
    assert back.trees is None and np.array_equal(back.network.flat, result.artifacts.network.flat)


def test_hash_split_is_disjoint_complete_and_about_a_fifth(sales):
    rows = training.hash_split(sales)
    share = rows.filter("es_prueba").count() / rows.count()
    assert rows.filter("es_prueba is null").isEmpty() and 0.15 < share < 0.25
    sides = rows.groupBy("id_producto", "fecha", "cantidad_vendida").agg(F.countDistinct("es_prueba").alias("k"))
    assert sides.filter("k > 1").isEmpty()


def test_scores_by_tables_of_missing_and_odd_values(spark):
    """Against plain walks and sums, value by value; a missing value goes right and gives a neuron nothing."""
    nan, inf = float("nan"), float("inf")
    values = [(None, 0.5), (nan, 0.5), (inf, -inf), (0.25, 0.5), (0.2500001, None), (-0.0, 2.0)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "k bigint, a double, b double").repartition(3)
    splits = spark.createDataFrame(
        [(0, 1.0, 0, 0, 0.25, 7, 9, 0.0), (0, 1.0, 7, 1, 0.5, 8, 4, 0.0), (0, 1.0, 9, None, None, None, None, 30.0),
         (0, 1.0, 8, None, None, None, None, 10.0), (0, 1.0, 4, None, None, None, None, 20.0),
         (1, 0.1, 0, None, None, None, None, 5.0)],
        "arbol int, peso double, nodo int, columna int, umbral double, izquierda int, derecha int, valor double")
    scores = tables.tree_scores(rows, splits, "k", 2, ("a", "b"))
    assert {r.k: r.pred_arboles for r in scores.collect()} == {0: 30.5, 1: 30.5, 2: 30.5, 3: 10.5, 4: 30.5, 5: 20.5}
    # The rows do not meet the nodes by joins, and no row for each tree is made.
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    neurons = spark.createDataFrame(
        [(0, 0, [1.0, 2.0], 0.5), (0, 1, [-1.0, 1.0], 0.0), (1, 0, [2.0, 3.0], -1.0)],
        "capa int, neurona int, pesos array<double>, sesgo double")

    def plain(a, b):
        if a is None or b is None:
            return -1.0
        inside = [a + 2 * b + 0.5, b - a]
        x, y = (v if v != v else max(v, 0.0) for v in inside)
        return 2 * x + 3 * y - 1

    found = {r.k: r.pred_red for r in tables.network_scores(rows, neurons, "k", ("a", "b")).collect()}
    for i, v in enumerate(values):
        assert found[i] == plain(*v) or (found[i] != found[i] and plain(*v) != plain(*v)), (v, found[i])
    last = tables.network_scores(rows, neurons.filter("capa = 1"), "k", ("a", "b"))
    assert {r.k: r.pred_red is None for r in last.collect()} == {i: None in v for i, v in enumerate(values)}
