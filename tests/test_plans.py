"""The whole studies on the smallest shared tables."""

from pyspark.sql import functions as F

from flowquarry.catalog import views as V
from flowquarry.catalog.packet_queries import raw_named
from flowquarry.options import AnomalyOptions, JobOptions
from flowquarry.plans import capture_study, labelled_study

DATA = "/root/testdata/sf0.001"


def test_labelled_study(spark):
    cols = V.LABELLED_FEATURES
    table = labelled_study.prepare(V.labelled(spark, DATA), cols, ["f_header"], ["f_rate"])
    assert table.filter("f_rate IS NULL OR f_header < 0").count() == 0
    out = labelled_study.baseline(table, cols, ["l_orderkey", "l_linenumber", *cols], trees=5, depth=4)
    metrics = {r.split: r for r in out["metrics"].collect()}
    assert set(metrics) == {"validation", "test"} and 0 <= metrics["test"].f1 <= 1
    area = out["areas"].first()
    assert 0 <= area.roc_auc <= 1
    assert out["per_class"].agg(F.sum("Test_Samples")).first()[0] == out["scored"].filter("split = 'test'").count()
    assert out["importance"].count() == len(cols)


def test_packet_study(spark):
    out = capture_study.run(raw_named(spark, DATA), JobOptions(anomaly=AnomalyOptions(trees=20, tree_rows=64)))
    flows, verdicts = out["flows"].count(), out["verdicts"].count()
    assert flows == verdicts > 100
    assert out["summary"].first().total_flows == flows
    agreed = out["verdicts"].filter("Consensus_Anomaly = -1").count()
    assert out["investigation"].count() == agreed
    assert out["representative_packets"].select("FlowID").distinct().count() <= agreed
