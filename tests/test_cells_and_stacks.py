"""Grid cells that meet, and the spread of the rows a network learns from."""

import itertools

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from flowquarry.operators import density, forest


def test_only_occupied_cells_are_paired(spark):
    random = np.random.default_rng(5)
    cells = {tuple(c) for c in random.integers(-3, 4, (150, 3)).tolist()}
    df = spark.createDataFrame([([int(v) for v in c],) for c in cells for _ in range(2)], "_g array<bigint>")
    got = sorted((tuple(r._g), tuple(r.cell)) for r in density.adjacent_cells(df, 3).collect())
    want = sorted((a, b) for a, b in itertools.product(cells, cells) if a <= b and max(abs(x - y) for x, y in zip(a, b)) <= 1)
    assert got == want and len(got) < 14 * len(cells)


def test_network_learns_from_evenly_dealt_rows(spark, monkeypatch):
    seen = {}
    fit = MultilayerPerceptronClassifier.fit

    def watched(self, rows, *more):
        seen["sizes"] = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        seen["columns"] = rows.columns
        return fit(self, rows, *more)

    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", watched)
    rows = spark.range(4_000).coalesce(1).selectExpr("id", "CAST(id % 97 AS double) AS x", "CAST(id % 89 AS double) AS y", "'text' AS other", "CAST(id % 97 > 48 AS double) AS label")
    model = forest.train_network(rows, ["x", "y"], "label", 2, hidden=(4,), iterations=30)
    assert len(seen["sizes"]) == spark.sparkContext.defaultParallelism and max(seen["sizes"]) < 1.5 * 4_000 / len(seen["sizes"])
    assert seen["columns"] == ["label", "features"]
    assert model.transform(rows).filter("prediction = label").count() > 3_800


def test_crowded_cells_are_compared_in_chunks_by_many_tasks(spark, monkeypatch):
    random = np.random.default_rng(11)
    x = np.vstack([random.normal(0, 0.5, (300, 3)), random.normal(4, 0.3, (200, 3)), random.uniform(-9, 9, (60, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "key long, a double, b double, c double")
    parts, cut = {}, density.cut_lineage

    def watched(table):
        out = cut(table)
        parts["".join(out.columns)] = out.rdd.getNumPartitions()
        return out

    monkeypatch.setattr(density, "cut_lineage", watched)
    results = []
    for chunk in (density.CHUNK_POINTS, 7):
        monkeypatch.setattr(density, "CHUNK_POINTS", chunk)
        results.append(sorted(density.dbscan(df, ["a", "b", "c"], "key").select("key", "DBSCAN_Cluster").collect()))
        assert parts["abwawb"] >= spark.sparkContext.defaultParallelism
    assert results[0] == results[1] and len({r.DBSCAN_Cluster for r in results[0]}) >= 3
