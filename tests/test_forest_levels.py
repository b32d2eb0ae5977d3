"""A level of the trees needs the node of each instance, not the trees above; a capture is made into flows once."""

import pytest
from pyspark.sql import Observation, functions as F

from flowquarry.operators import forest
from flowquarry.plans import capture_study


@pytest.fixture
def rows(spark):
    return spark.range(3_000).selectExpr("CAST(id % 41 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "id * 0.37 AS c", "CAST((id * 31) % 97 < 30 AS DOUBLE) AS label")


def test_forest_keeps_the_node_of_each_instance_and_grows_the_same_trees(rows, monkeypatch):
    model = forest.train_forest(rows, ["a", "b", "c"], trees=6, depth=12)
    fit = forest.RandomForestClassifier.fit
    asked = []

    def walked(self, data):
        asked.append(self.getCacheNodeIds())
        return fit(self.setCacheNodeIds(False), data)

    monkeypatch.setattr(forest.RandomForestClassifier, "fit", walked)
    plain = forest.train_forest(rows, ["a", "b", "c"], trees=6, depth=12)
    assert asked == [True]
    assert model.stages[-1].toDebugString.split("\n")[1:] == plain.stages[-1].toDebugString.split("\n")[1:]


def test_forest_scores_after_something_was_observed(spark, rows):
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 3_000
    model = forest.train_forest(rows, ["a", "b", "c"], trees=3, depth=4)
    assert not model.stages[-1].hasSummary and forest.score(model, rows, ["a", "b", "c"]).checkpoint().count() == 3_000


def test_a_capture_is_made_into_flows_once(spark, monkeypatch):
    packets = spark.createDataFrame(
        [(i, i * 10**9, "a", f"b{i % 20}", 1, 2, "TCP", 100 + i, i % 3, 0, 1) for i in range(200)],
        "Frame_Number long, Time_ns long, Source string, Destination string, Source_Port int, Destination_Port int, Protocol string, Length int, Flag_FIN int, Flag_PSH int, Flag_ACK int")
    made, flow32 = [], capture_study.FL.flow32
    monkeypatch.setattr(capture_study.FL, "flow32", lambda *given: made.append(1) or flow32(*given))
    train = forest.train_forest
    monkeypatch.setattr(capture_study.forest, "train_forest", lambda *given, **_: train(*given, trees=3, depth=4))
    scored = capture_study.score_capture(packets)
    assert scored.count() == flow32(packets).count() and len(made) == 1
    want = {r.Flow_ID: "ATTACK" if r["FIN Flag Count"] * 3 > r["ACK Flag Count"] else "BENIGN" for r in flow32(packets).collect()}
    assert sum(want[r.Flow_ID] == r.Prediction for r in scored.select("Flow_ID", "Prediction").collect()) >= 0.8 * len(want)
    again = capture_study.score_capture(packets, capture_study.capture_model(packets))
    assert sorted(again.collect()) == sorted(scored.collect())
