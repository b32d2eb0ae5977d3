"""Statistics, percentiles, ranking, splits and metrics against NumPy or by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowquarry.functions import columns as C
from flowquarry.operators import cleaning, evaluation as EV, investigation as INV, ordered, selection as SEL, statistics as ST
from flowquarry.operators.quantiles import percentile_row, wide_group_median


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).lognormal(3, 4, 5001), np.random.default_rng(2).integers(-5, 6, 4000).astype(float),
    1.7e9 + np.random.default_rng(3).random(6001), np.array([3.0]), np.array([-1e300, 0.0, 1e-12, 1e300]), np.repeat([0.0, 7.0], [900, 100]),
])
def test_percentiles_equal_numpy(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"v": values})).unionByName(spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double"))
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = percentile_row(df, {"v": F.col("v")}, probs)["v"]
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12)


def test_percentile_of_nothing(spark):
    assert percentile_row(spark.createDataFrame([], "v double"), {"v": F.col("v")}, [0.5]) == {"v": [None]}


def test_wide_group_median(spark):
    random = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": random.integers(0, 3, 4000), "v": (random.pareto(1.0, 4000) * 1e9).astype("int64")})
    got = {r.k: r.m for r in wide_group_median(spark.createDataFrame(pdf), ["k"], "v", "m").collect()}
    assert got == {k: float(m) for k, m in pdf.groupby("k").v.median().items()}


def test_entropy_and_summary(spark):
    packets = spark.createDataFrame([(0, 64, "a", "b", "TCP"), (10**9, 100, "a", "b", "TCP"), (2 * 10**9, 200, "c", "b", "UDP")],
                                    "Time_ns long, Length int, Source string, Destination string, Protocol string")
    entropy = {r.metric: r.entropy for r in ST.entropies(packets).collect()}
    assert entropy["entropy_source"] == 0.9183 and abs(entropy["entropy_destination"]) == 0.0
    row = ST.capture_summary(packets, 2).first()
    assert (row.total_packets, row.total_flows, row.total_bytes, row.avg_packet_rate) == (3, 2, 364, 1.5)


def test_correlation_leaves_constant_columns_out(spark):
    df = spark.createDataFrame([(float(i), float(-i), 1.0) for i in range(10)], "a double, b double, c double")
    rows = ST.correlations(df, ["a", "b", "c"]).collect()
    assert [(r.feature_a, r.feature_b, round(r.correlation, 9)) for r in rows] == [("a", "b", -1.0)]
    best = {r.feature: (r.partner, r.max_correlation) for r in ST.strongest_partner(ST.correlations(df, ["a", "b", "c"]), ["a", "b", "c"]).collect()}
    assert best["c"] == ("None", 0.0) and best["a"][0] == "b"


def test_imputation_can_fit_on_training_rows(spark):
    df = spark.createDataFrame([(1.0, "t"), (3.0, "t"), (None, "v"), (float("inf"), "v"), (100.0, "v")], "x double, s string")
    filled = cleaning.impute_median(df, ["x"], fit_on=df.filter("s = 't'"))
    assert sorted(r.x for r in filled.collect()) == [1.0, 2.0, 2.0, 3.0, 100.0]


def test_family_rules(spark):
    labels = ["BENIGN", " DDoS ", "DoS Hulk", "SSH-Patator", "Web Attack – Brute Force", "Web Attack – XSS", "Bot", "PortScan", "Infiltration", "Heartbleed", "?"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    plain = [r[0] for r in df.select(C.attack_family(F.col("l"))).collect()]
    assert plain == ["BENIGN", "DoS", "DoS", "Brute Force", "Brute Force", "Web Attack", "Botnet", "Port Scan", "Infiltration", "Heartbleed", "Other"]
    assert df.select(C.attack_family(F.col("l"), strict_families=True)).collect()[1][0] == "DDoS"


@pytest.mark.parametrize("partitions", [1, 8])
def test_split_is_exact_and_repeatable(spark, partitions):
    df = spark.range(2000).withColumn("y", (F.col("id") % 10 == 0).cast("int")).repartition(partitions)
    split = EV.stratified_split(df, "y", ["id"])
    sizes = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert sizes == {(0, "train"): 1260, (0, "validation"): 270, (0, "test"): 270, (1, "train"): 140, (1, "validation"): 30, (1, "test"): 30}
    assert split.filter("split = 'test'").agg(F.sum("id")).first()[0] == EV.stratified_split(df.repartition(3), "y", ["id"]).filter("split = 'test'").agg(F.sum("id")).first()[0]


def test_curve_areas_with_ties(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.4, 1), (0.1, 0)]
    points = EV.curve_points(spark.createDataFrame(rows, "s double, y int"), "s", "y", block_rows=2)
    area = EV.curve_areas(points).first()
    wins = sum((a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z)
    assert area.roc_auc == pytest.approx(wins / 6)
    assert area.average_precision == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 4)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, k double")
    assert [round(r.a, 6) for r in EV.robust_scale(df, EV.robust_fit(df, ["a"])).collect()] == [-0.666667, 0.0, 1.333333]
    assert {r.k for r in EV.standard_scale(df, ["a", "k"]).collect()} == {0.0}


def test_running_totals(spark):
    df = spark.range(1000).repartition(7)
    out = ordered.running_totals(df, [F.col("id")], {"t": F.col("id")}, block_rows=64).orderBy("id").collect()
    assert [r.t for r in out] == list(np.cumsum(np.arange(1000)))


FLOW = ("FlowID string, Source_IP string, Destination_IP string, Source_Port int, Destination_Port int, Protocol string, Total_Packets int, Total_Bytes int, "
        "Flow_Duration double, Packets_Per_Second double, Bytes_Per_Second double, Mean_IAT double, SYN_Count int, ACK_Count int, RST_Count int, SYN_ACK_Ratio double, RST_Ratio double")


def test_investigation(spark):
    flows = spark.createDataFrame([
        ("f1", "1.1.1.1", "2.2.2.2", 1000, 80, "TCP", 10, 800, 1.0, 10.0, 800.0, 0.1, 8, 0, 0, 8e6, 0.0),
        ("f2", "1.1.1.1", "224.0.0.251", 5353, 5353, "MDNS", 20, 2000, 1.0, 20.0, 2000.0, 0.05, 0, 0, 0, 0.0, 0.0),
        ("f3", "3.3.3.3", "4.4.4.4", 1, 2, "UDP", 1, 60, 1.0, 1.0, 60.0, 0.0, 0, 0, 0, 0.0, 0.0)], FLOW)
    verdicts = spark.createDataFrame([("f1", -1), ("f2", -1), ("f3", 1)], "FlowID string, Consensus_Anomaly int")
    found = {r.FlowID: r for r in INV.investigate(flows, verdicts).collect()}
    assert set(found) == {"f1", "f2"}
    assert "syn_heavy_tcp_behaviour" in found["f1"].observed_behaviours
    assert "excessive_mdns_multicast_activity" in found["f2"].observed_behaviours and found["f2"].possible_category == "mDNS anomaly"
    summary = INV.investigation_summary(INV.investigate(flows, verdicts))
    assert {r.Protocol: r.flows for r in summary["by_protocol"].collect()} == {"TCP": 1, "MDNS": 1}
    none = INV.investigate(flows, verdicts.filter("Consensus_Anomaly = 7"))
    assert none.count() == 0 and "FlowID" in none.columns
    assert INV.consensus_anomalies(flows, verdicts.select("FlowID")).count() == 0
    assert SEL.representative_flows(INV.investigate(flows, verdicts), "mdns").count() == 1


def test_verdict_fusion(spark):
    df = spark.createDataFrame([("ATTACK", "DoS"), ("ATTACK", "BENIGN"), ("BENIGN", "BENIGN")], "RF_Prediction string, ANN_Prediction string")
    status = lambda s: [r.Final_Status for r in EV.fuse_verdicts(df, s).collect()]
    assert status("consensus") == ["ATTACK", "MODEL DISAGREEMENT", "BENIGN"]
    assert status("high_recall") == ["ATTACK", "ATTACK", "BENIGN"] and status("conservative") == ["ATTACK", "BENIGN", "BENIGN"]
    with pytest.raises(ValueError):
        EV.fuse_verdicts(df, "other")


def test_report_explains_alerts_only(spark):
    rows = [(str(i), "BENIGN", "BENIGN", float(i), float(i % 4)) for i in range(8)] + [("x", "ATTACK", "DoS", 3.0, 90.0), ("y", "BENIGN", "DoS", 500.0, 1.0)]
    df = spark.createDataFrame(rows, "FlowID string, RF_Prediction string, ANN_Prediction string, size double, rate double")
    out = {r.FlowID: (r.Final_Predicted_Class, r.Explanation) for r in EV.explained_report(df, ["size", "rate"]).collect()}
    assert out["x"] == ("DoS", "rate, size") and out["y"] == ("DoS", "size, rate") and out["3"] == ("BENIGN", "")
    alone = EV.explained_report(df.filter("FlowID = 'x'"), ["size", "rate"]).first()
    assert (alone.Final_Status, alone.Explanation) == ("ATTACK", "")


def test_hash_sample_is_stable(spark):
    ids = lambda n: sorted(r.id for r in SEL.hash_sample(spark.range(500).repartition(n), 50, ["id"]).collect())
    assert ids(1) == ids(6) and len(ids(1)) == 50
