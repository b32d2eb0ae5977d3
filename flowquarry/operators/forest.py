"""Supervised models from ``pyspark.ml``: forest, network, PCA, batch scoring, saved models."""

from __future__ import annotations

from collections import Counter

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer, PCA, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowquarry.operators.cleaning import numeric_columns
from flowquarry.operators.evaluation import balanced_weights, robust_fit
from flowquarry.session import cut_lineage

#: Bins of a feature, about how many instances a forest draws its bags from, and quantiles that bins are chosen from.
BINS, BAG_INSTANCES, QUANTILES = 64, 200_000, 1_024
#: Rows a network takes through its layers at once.
STACK_ROWS = 1_024
IDENTIFIERS = {"FlowID", "Source_IP", "Destination_IP", "Source_Port", "Destination_Port", "Protocol"}


def model_columns(df: DataFrame) -> list[str]:
    return numeric_columns(df, IDENTIFIERS)


def feature_matrix(df: DataFrame, cols: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=output, handleInvalid="error").transform(df)


def robust_stage(train: DataFrame, cols: list[str], scaled: list[str]) -> SQLTransformer:
    """Robust scaling as a saveable pipeline stage, fitted exactly on the training rows."""
    fitted = robust_fit(train, cols)
    terms = ", ".join(f"(`{c}` - ({fitted[c][0]!r}D)) / ({fitted[c][1]!r}D) AS `{s}`" for c, s in zip(cols, scaled))
    return SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")


def bin_edges(df: DataFrame, cols: list[str], bins: int = BINS) -> list[list[float]]:
    """Inner edges of about ``bins`` bins per column, chosen as Spark's own trees do, but from quantiles of all rows.

    Columns of few values are cut between all of them. Elsewhere a value that holds more than a bin's share is a bin of its
    own, and the bins it saves go to its neighbours.
    """
    points = ", ".join(f"{i / QUANTILES!r}D" for i in range(QUANTILES + 1))
    column = [F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in cols]
    shaped = df.select(*[x.alias(f"x{i}") for i, x in enumerate(column)])
    found = shaped.agg(*[F.approx_count_distinct(f"x{i}").alias(f"n{i}") for i in range(len(cols))],
                       *[F.expr(f"percentile_approx(x{i}, array({points}), 10000)").alias(f"q{i}") for i in range(len(cols))]).first()
    # the estimate is off by a few per cent, so what is gathered here is bounded too
    few = [i for i in range(len(cols)) if (found[f"n{i}"] or 0) <= 2 * bins]
    sets = shaped.agg(F.lit(0).alias("none"), *[F.collect_set(f"x{i}").alias(f"v{i}") for i in few]).first()
    edges = []
    for i in range(len(cols)):
        values = sorted(sets[f"v{i}"]) if i in few else None
        if values is None or len(values) > bins:
            values = _spread_edges(found[f"q{i}"] or [], bins)
        else:
            values = [a / 2 + b / 2 for a, b in zip(values, values[1:])]
        edges.append(sorted(set(values)))
    return edges


def _spread_edges(quantiles: list[float], bins: int) -> list[float]:
    """Edges between neighbouring values, one for each ``bins``-th part of the quantiles as far as the values allow."""
    counted = sorted(Counter(quantiles).items())
    part = len(quantiles) / bins
    passed, target, edges = 0, part, []
    for (value, n), (after, more) in zip(counted, counted[1:]):
        passed += n
        if len(counted) <= bins or abs(passed - target) < abs(passed + more - target):
            edges.append(value / 2 + after / 2)
            target += part
    return edges[:bins - 1]


def train_forest(train: DataFrame, cols: list[str], label: str = "label", trees: int = 200, depth: int = 30,
                 seed: int = 42, balanced: bool = True, scale: bool = True) -> PipelineModel:
    """A forest of ``trees`` trees over all rows.

    Trees only see the bin of a value, so rows of equal bins and label are one instance with their summed weight. A bag is
    drawn from rows up to ``BAG_INSTANCES`` of them; in larger tables from shares of a cell, which stand for as many rows each
    as bring the table to that size. What a level of the trees passes over is thus the cells and that many more at most.
    """
    scaled = [f"_s{i}" for i in range(len(cols))] if scale else cols
    binned = [f"_b{i}" for i in range(len(cols))]
    rows = balanced_weights(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    prepare = [robust_stage(train, cols, scaled)] if scale else []
    for stage in prepare:
        rows = stage.transform(rows)
    splits = [[-float("inf"), *inner, float("inf")] for inner in bin_edges(rows, scaled)]
    # a column of one bin still needs an inner edge
    splits = [s if len(s) > 2 else [-float("inf"), 0.0, float("inf")] for s in splits]
    prepare.append(Bucketizer(inputCols=scaled, outputCols=binned, splitsArray=splits, handleInvalid="error"))
    prepare.append(VectorAssembler(inputCols=binned, outputCol="features", handleInvalid="error"))
    cells = cut_lineage(prepare[-2].transform(rows).groupBy(label, *binned).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("weight")))
    total = cells.agg(F.sum("_n")).scalar()
    share = F.greatest(F.lit(1), F.ceil(total / BAG_INSTANCES))
    shares = F.ceil(F.col("_n") / share).cast("int")
    # Each share is an instance of its own. They are spread evenly, a level takes as long as its fullest partition, and sorted,
    # so that instances that take the same way through a tree follow one another.
    instances = cells.withColumn("weight", F.col("weight") / shares).withColumn("_i", F.explode(F.sequence(F.lit(1), shares)))
    instances = instances.repartition(train.sparkSession.sparkContext.defaultParallelism, label, *binned, "_i")
    instances = instances.sortWithinPartitions(label, *binned).select(label, "weight", *binned)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed,
        maxMemoryInMB=1024, subsamplingRate=1.0, maxBins=BINS, cacheNodeIds=True,
    )
    # The copy is without the training summary, which holds the session: tasks cannot be sent that once something was observed in it.
    return PipelineModel([*prepare, forest.fit(prepare[-1].transform(instances)).copy()])


def score(model: PipelineModel, df: DataFrame, cols: list[str]) -> DataFrame:
    """Verdict, label and attack probability per row."""
    helpers = [f"_{kind}{i}" for kind in "sb" for i in range(len(cols))]
    out = model.transform(df).withColumns({
        "Attack_Probability": F.get(vector_to_array("probability"), 1), "Prediction_Label": F.col("prediction").cast("int"),
    }).drop("features", "rawPrediction", "probability", "prediction", *helpers)
    return out.withColumn("Prediction", F.when(F.col("Prediction_Label") == 1, "ATTACK").otherwise("BENIGN"))


def importances(model: PipelineModel, cols: list[str]) -> DataFrame:
    spark = SparkSession.getActiveSession()
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, values)], "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_record(model: PipelineModel, cols: list[str], split_sizes: dict[str, int], seconds: float) -> DataFrame:
    forest = model.stages[-1]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(
        [("RandomForestClassifier", forest.getNumTrees, forest.getOrDefault("maxDepth"), forest.getOrDefault("seed"), "balanced", "RobustScaler",
          len(cols), list(cols), split_sizes.get("train", 0), split_sizes.get("validation", 0), split_sizes.get("test", 0), float(seconds))],
        "model_type string, n_estimators int, max_depth int, random_state long, class_weight string, scaler_type string, "
        "feature_count int, features array<string>, train_samples long, validation_samples long, test_samples long, training_time_seconds double",
    )


def train_network(train: DataFrame, cols: list[str], label: str, classes: int, hidden: tuple[int, ...] = (64, 32),
                  seed: int = 42, iterations: int = 100) -> PipelineModel:
    """Multiclass network. Spark's hidden units are sigmoid.

    Every pass takes as long as the fullest partition, so scaled rows are dealt evenly to all cores before the first one.
    Rows go through the layers in stacks of ``STACK_ROWS``; the sums they add up to do not depend on it.
    """
    scaled = [f"_s{i}" for i in range(len(cols))]
    prepare = [robust_stage(train, cols, scaled), VectorAssembler(inputCols=scaled, outputCol="features", handleInvalid="error")]
    rows = train
    for stage in prepare:
        rows = stage.transform(rows)
    rows = cut_lineage(rows.select(label, "features").repartition(train.sparkSession.sparkContext.defaultParallelism))
    network = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=label, layers=[len(cols), *hidden, classes], seed=seed, maxIter=iterations, blockSize=STACK_ROWS)
    return PipelineModel([*prepare, network.fit(rows)])


def principal_axes(df: DataFrame, cols: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Centred projection on the first k axes, and the explained share of variance.

    Signs are fixed: the largest loading of each axis is positive.
    """
    means = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centred = df.withColumns({f"_c{i}": F.col(f"`{c}`") - means[i] for i, c in enumerate(cols)})
    matrix = VectorAssembler(inputCols=[f"_c{i}" for i in range(len(cols))], outputCol="_centred").transform(centred)
    model = PCA(k=k, inputCol="_centred", outputCol="_axes").fit(matrix)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, a]).argmax(), a] >= 0 else -1.0 for a in range(k)]
    axes = model.transform(matrix).withColumn("_axes", vector_to_array("_axes"))
    out = axes.withColumns({f"PCA{a + 1}": F.get("_axes", a) * signs[a] for a in range(k)})
    return out.drop("_axes", "_centred", *[f"_c{i}" for i in range(len(cols))]), [float(v) for v in model.explainedVariance]


def kmeans_clusters(df: DataFrame, cols: list[str], k: int = 4, seed: int = 42, name: str = "KMeans_Cluster") -> DataFrame:
    matrix = feature_matrix(df, cols, "_features")
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=name).fit(matrix)
    return model.transform(matrix).drop("_features")
