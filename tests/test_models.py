"""Unsupervised models by property, DBSCAN against brute force, saved models, streaming against batch."""

import inspect
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import density, evaluation as EV, forest, isolation
from flowquarry.streaming import flows as STREAM


@pytest.fixture(scope="module")
def cloud(spark):
    random = np.random.default_rng(7)
    x = np.vstack([random.normal(0, 0.25, (110, 4)), random.normal(2, 0.25, (110, 4)), random.uniform(-4, 6, (50, 4)), np.zeros((30, 4))]).round(3)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "key long, a double, b double, c double, d double").repartition(4).cache()


COLS = ["a", "b", "c", "d"]


def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core, labels, cluster = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] < 0:
            stack, labels[i] = [i], cluster
            while stack:
                for k in np.flatnonzero(near[stack.pop()] & core & (labels < 0)):
                    labels[k] = cluster
                    stack.append(k)
            cluster += 1
    for i in np.flatnonzero(~core):
        touching = labels[near[i] & core]
        labels[i] = touching.min() if len(touching) else -1
    return labels


def test_dbscan_equals_brute_force(cloud):
    x, df = cloud
    got = dict(density.dbscan(df, COLS, "key", 0.8, 5, cell_limit=60, max_axes=3).select("key", "DBSCAN_Cluster").collect())
    want = brute_dbscan(x, 0.8, 5)
    assert [got[i] for i in range(len(x))] == list(want) and set(want) >= {-1, 0, 1}


def test_isolation_forest_marks_the_share_and_the_outliers(cloud):
    x, df = cloud
    out = isolation.isolation_forest(df, COLS, ["key"], trees=40, rows=64, contamination=0.1).select("key", "IsoForest_Pred")
    marked = {r.key for r in out.filter("IsoForest_Pred = -1").collect()}
    assert abs(len(marked) - 0.1 * len(x)) <= 2
    assert sum(220 <= k < 270 for k in marked) >= 0.9 * len(marked)
    again = isolation.isolation_forest(df.repartition(2), COLS, ["key"], trees=40, rows=64, contamination=0.1)
    assert {r.key for r in again.filter("IsoForest_Pred = -1").collect()} == marked


def test_one_class_svm_marks_about_nu(cloud):
    x, df = cloud
    marked = {r.key for r in isolation.one_class_svm(df, COLS, ["key"], nu=0.1).filter("OneClassSVM_Pred = -1").collect()}
    assert abs(len(marked) - 0.1 * len(x)) <= 2
    assert sum(220 <= k < 270 for k in marked) >= 0.8 * len(marked)


def test_forest_round_trip(spark, cloud, folder):
    _, df = cloud
    rows = df.withColumn("label", (F.col("a") > 1).cast("double"))
    model = forest.train_forest(rows, COLS, trees=10, depth=4)
    forest.save_model(model, os.path.join(folder, "m"))
    scored = forest.score(forest.load_model(os.path.join(folder, "m")), rows, COLS)
    assert EV.binary_metrics(scored, "label", "Prediction_Label").first().accuracy > 0.97
    assert forest.importances(model, COLS).orderBy(F.desc("importance")).first().feature == "a"


def test_bins_keep_a_frequent_value_apart(spark):
    """Three quarters are zero, the rest spread on both sides: zero is a bin of its own and the others share what is left."""
    rows = spark.range(40_000).selectExpr("CASE WHEN id % 4 > 0 THEN 0.0D ELSE (id - 8000) / 100.0D END AS x", "CAST(id % 60 AS DOUBLE) AS few", "1.0D AS one")
    x, few, one = forest.bin_edges(rows, ["x", "few", "one"])
    below, above = max(e for e in x if e < 0), min(e for e in x if e > 0)
    assert below > -2 and above < 6 and 20 <= len(x) <= 63
    assert few == [i + 0.5 for i in range(59)] and one == []


def test_forest_trains_on_cells_not_rows(spark, monkeypatch):
    rows = spark.range(6000).selectExpr("CAST(id % 40 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b", "id * 0.37 AS c", "0.0D AS d", "CAST(id % 40 < 13 AS DOUBLE) AS label")
    seen = []
    fit = forest.RandomForestClassifier.fit

    def counted(self, data):
        seen.append((data.count(), data.agg(F.sum("weight")).first()[0]))
        return fit(self, data)

    monkeypatch.setattr(forest.RandomForestClassifier, "fit", counted)
    monkeypatch.setattr(forest, "BAG_INSTANCES", 50)
    model = forest.train_forest(rows, ["a", "b", "d"], trees=10, depth=6)
    assert seen[0][0] <= 120 + 50 and seen[0][1] == pytest.approx(6000)
    scored = forest.score(model, rows, ["a", "b", "d"])
    assert scored.filter("Prediction_Label <> label").count() == 0 and not [c for c in scored.columns if c.startswith("_")]
    monkeypatch.setattr(forest, "BAG_INSTANCES", 10_000)
    forest.train_forest(rows, ["a", "c"], trees=2, depth=3, balanced=False, scale=False)
    assert seen[1] == (6000, 6000)


def test_axes_are_centred_and_signed(cloud):
    _, df = cloud
    axes, explained = forest.principal_axes(df, COLS)
    means = axes.agg(F.avg("PCA1"), F.avg("PCA2")).first()
    assert abs(means[0]) < 1e-9 and abs(means[1]) < 1e-9 and explained[0] > explained[1]


def _batches(spark, folder, parts):
    """Stream files with distinct modification times, in order."""
    for i, rows in enumerate(parts):
        path = os.path.join(folder, f"p{i}")
        spark.createDataFrame(rows, "Frame_Number long, Time_ns long, Source string, Destination string, Source_Port int, Destination_Port int, Protocol string, Length int") \
            .coalesce(1).write.parquet(path)
        name = next(n for n in os.listdir(path) if n.endswith(".parquet"))
        target = os.path.join(folder, "in")
        os.makedirs(target, exist_ok=True)
        os.link(os.path.join(path, name), os.path.join(target, f"{i}.parquet"))
        os.utime(os.path.join(target, f"{i}.parquet"), (time.time() - 1000 + 10 * i,) * 2)
    schema = spark.read.parquet(os.path.join(folder, "in")).schema
    return STREAM.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "in")))


def _packet(frame, seconds, source="a", target="b"):
    return (frame, int(seconds * 10**9), source, target, 1 if source == "a" else 2, 2 if source == "a" else 1, "TCP", 100)


def test_sessions_across_batches(spark, folder):
    stream = _batches(spark, folder, [[_packet(1, 0), _packet(2, 60, "b", "a")], [_packet(3, 180), _packet(4, 302)], [_packet(5, 900)]])
    out = sorted((r.start_ns // 10**9, r.Total_Packets, r.Forward_Packets) for r in STREAM.run_to_table(STREAM.session_flows(stream), "s").collect())
    assert out == [(0, 3, 2), (302, 1, 1)]  # 180 - 60 is exactly the timeout; 302 - 180 is longer


def test_a_hot_conversation_is_summed_in_cells_before_its_sessions_are_cut(spark, folder):
    random = np.random.default_rng(3)
    gaps = random.choice([1, 40 * 10**9, 120 * 10**9, 120 * 10**9 + 1000, 125 * 10**9, 131 * 10**9], 400, p=[0.5, 0.3, 0.1, 0.04, 0.03, 0.03])
    times = np.cumsum(gaps) // 1000 * 1000
    rows = [(i, int(t), "a", "b", 1, 2, "TCP", 100) for i, t in enumerate(times)]
    other = [(1000 + i, int(t), None if i % 2 else "c", "d", 1, None, "UDP", None) for i, t in enumerate(times[::40])]
    packets = sorted(rows + other, key=lambda r: r[1])
    stream = _batches(spark, folder, [packets[i:i + 70] for i in range(0, len(packets), 70)])
    finished = spark.read.parquet(os.path.join(folder, "in"))
    got = STREAM.run_finished(stream, finished, STREAM.session_flows, "hot").collect()
    flows = np.split(times, np.flatnonzero(np.diff(times) > 120 * 10**9) + 1)
    assert sorted((r.start_ns, r.end_ns, r.Total_Packets, r.Total_Bytes) for r in got if r.Protocol == "TCP") == [
        (int(x[0]), int(x[-1]), len(x), 100 * len(x)) for x in flows] and len(flows) > 20
    assert sum(r.Total_Packets for r in got if r.Protocol == "UDP") == len(other)
    plan = STREAM.session_flows(STREAM.with_event_time(finished))._jdf.queryExecution().toString()
    assert "hashpartitioning(window" in plan  # a 5-tuple is spread by cell, then by 5-tuple
    assert STREAM.session_flows(STREAM.with_event_time(finished.limit(0))).collect() == []


def test_ordered_flows_across_batches(spark, folder):
    STREAM.use_rocksdb(spark)
    stream = _batches(spark, folder, [[_packet(2, 6), _packet(1, 0)], [_packet(3, 12, "b", "a"), _packet(4, 150)], [_packet(5, 900)]])
    out = sorted((r.Subflow_ID, r.Total_Packets, r.Forward_Packets, r.Max_IAT) for r in STREAM.run_to_table(STREAM.ordered_flows(stream), "o").collect())
    assert out == [(0, 3, 2, 6.0), (1, 1, 1, 0.0)]


def test_finished_streams_lose_nothing_in_many_batches(spark, folder):
    STREAM.use_rocksdb(spark)
    random = np.random.default_rng(8)
    times = np.sort(random.choice(9_000, 160, replace=False))
    packets = [_packet(i, int(t), *(("a", "b") if random.random() < 0.7 else ("b", "a"))) for i, t in enumerate(times)]
    stream = _batches(spark, folder, [packets[i:i + 20] for i in range(0, 160, 20)])
    finished = spark.read.parquet(os.path.join(folder, "in"))
    cuts = np.flatnonzero(np.diff(times) > 120) + 1
    flows = [(int(x[0]), len(x)) for x in np.split(times, cuts)]
    got = STREAM.run_finished(stream, finished, STREAM.session_flows, "many").collect()
    assert sorted((r.start_ns // 10**9, r.Total_Packets) for r in got) == flows and len(flows) > 3
    ordered = STREAM.run_finished(stream, finished, STREAM.ordered_flows, "many").collect()
    assert sorted((r.start_ns // 10**9, r.Total_Packets) for r in ordered) == flows and [r.Subflow_ID for r in sorted(ordered, key=lambda r: r.start_ns)] == list(range(len(flows)))
    rates = STREAM.run_finished(stream, finished, STREAM.second_rates, "many").collect()
    assert sorted((r.Time_Int, r.packets) for r in rates) == [(int(t), 1) for t in times]


def test_slices_arrive_in_order(spark, folder):
    path = STREAM.store_in_slices(spark.range(100).selectExpr("id % 50 AS t"), "t", os.path.join(folder, "slices"), slices=4, files=1)
    files = sorted((os.path.getmtime(os.path.join(path, n)), os.path.join(path, n)) for n in os.listdir(path) if n.endswith(".parquet"))
    values = [[r.t for r in spark.read.parquet(f).collect()] for _, f in files]
    assert len(values) == 4 and sum(map(len, values)) == 100 and all(max(a) < min(b) for a, b in zip(values, values[1:]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the shared tables")
def test_registered_forest_learns_its_labels(spark):
    from flowquarry.catalog import QUERIES

    metrics = QUERIES["m11_forest_test_metrics"](spark, "/root/testdata/sf0.001").first()
    assert metrics.accuracy > 0.97 and metrics.recall > 0.9
    record = QUERIES["m12_model_record"](spark, "/root/testdata/sf0.001").first()
    assert (record.n_estimators, record.max_depth) == (200, 30)


@pytest.mark.parametrize("name, trainer, size", [
    ("m11_forest_test_metrics", "train_forest", {"trees": 200, "depth": 30}), ("s15_m11_m19_forest_scores", "train_forest", {"trees": 200, "depth": 30}),
    ("e3_capture_scoring", "train_forest", {"trees": 200, "depth": 30}), ("r07_feature_table", "train_forest", {"trees": 100, "depth": 15}),
    ("m21_multiclass_network", "train_network", {"iterations": 100})])
def test_registered_models_are_of_full_size(spark, monkeypatch, name, trainer, size):
    from flowquarry.catalog import QUERIES, model_queries
    from flowquarry.plans import capture_study

    class Asked(Exception):
        pass

    signature = inspect.signature(getattr(forest, trainer))

    def train(*args, **more):
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        raise Asked({k: bound.arguments[k] for k in size})

    rows = spark.createDataFrame([("train", "BENIGN", "BENIGN", 0, 1, 1.0, 0.0)], "split string, Original_Label string, Label string, `FIN Flag Count` int, `ACK Flag Count` int, f_packets double, f_iat double")
    monkeypatch.setattr(forest, trainer, train)
    for place, function in ((model_queries, "_split"), (model_queries, "imputed"), (model_queries.V, "labelled"), (model_queries.V, "feature_packets")):
        monkeypatch.setattr(place, function, lambda *_: rows)
    monkeypatch.setattr(capture_study.FL, "flow32", lambda packets: packets)
    monkeypatch.setattr(capture_study, "cut_lineage", lambda df: df)
    with pytest.raises(Asked) as asked:
        QUERIES[name](spark, "nowhere")
    assert asked.value.args == (size,)
