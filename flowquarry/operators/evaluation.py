"""Splits, scaling, metrics, curves, votes and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowquarry.functions import columns as C
from flowquarry.operators.investigation import explain
from flowquarry.operators.ordered import BLOCK_ROWS, numbered, running_totals
from flowquarry.operators.quantiles import percentile_row
from flowquarry.operators.selection import detection_report


# --- split and scaling -----------------------------------------------------------------
def stratified_split(df: DataFrame, stratum: str, keys: list[str], seed: int = 42,
                     shares: tuple[float, float] = (0.70, 0.85), name: str = "split") -> DataFrame:
    """Exact stratified train / validation / test split in hash order.

    One global row number over (stratum, hash, keys) serves all strata, so a class that holds
    most rows is not ordered by one task. ``shares`` are the cumulative cuts.
    """
    hashed = df.withColumn("_h", F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(seed)))
    rows = numbered(hashed, [F.col(stratum), F.col("_h"), *[F.col(f"`{k}`") for k in keys]])
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"), F.min("_rn").alias("_first"))
    place = F.col("_rn") - F.col("_first")
    # one row per stratum; adaptive execution sees whether it is small enough to broadcast
    return rows.join(sizes, stratum).withColumn(
        name,
        F.when(place < F.round(F.col("_size") * shares[0]), "train")
        .when(place < F.round(F.col("_size") * shares[1]), "validation").otherwise("test"),
    ).drop("_h", "_rn", "_size", "_first")


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean, unit population deviation; a constant column becomes 0."""
    stats = df.agg(*[F.struct(F.avg(f"`{c}`").alias("m"), F.stddev_pop(f"`{c}`").alias("s")).alias(f"x{i}") for i, c in enumerate(cols)]).first()
    def scaled(i: int, c: str) -> Column:
        mean, std = (stats[i]["m"], stats[i]["s"]) if stats else (None, None)
        if not std:
            return F.lit(0.0)
        return (F.col(f"`{c}`") - mean) / std
    return df.withColumns({c: scaled(i, c) for i, c in enumerate(cols)})


def robust_fit(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Exact median and interquartile range per column (an IQR of 0 scales by 1)."""
    quartiles = percentile_row(train, {c: F.col(f"`{c}`") for c in cols}, [0.25, 0.5, 0.75])
    return {c: (q[1] or 0.0, ((q[2] - q[0]) if q[0] is not None else 0.0) or 1.0) for c, q in quartiles.items()}


def robust_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") - mid) / iqr for c, (mid, iqr) in fitted.items()})


def balanced_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """n / (classes x class size), as one row per class joined back."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    totals = sizes.agg(F.struct(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return df.join(sizes, label).withColumn(name, totals["n"] / (totals["k"] * F.col("_c"))).drop("_c")


# --- metrics ---------------------------------------------------------------------------
def binary_metrics(df: DataFrame, actual: str = "label", predicted: str = "prediction", by: list[str] | None = None) -> DataFrame:
    y, p = F.col(actual) == 1, F.col(predicted) == 1
    counts = df.groupBy(*(by or [])).agg(
        F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & p, 1)).alias("fp"),
        F.count(F.when(y & ~p, 1)).alias("fn"), F.count(F.when(~y & ~p, 1)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": C.ratio(tp + tn, tp + fp + fn + tn), "precision": C.ratio(tp, tp + fp), "recall": C.ratio(tp, tp + fn),
        "f1": C.ratio(tp * 2, tp * 2 + fp + fn), "fpr": C.ratio(fp, fp + tn), "fnr": C.ratio(fn, fn + tp),
    })


def confusion_matrix(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    pivoted = df.groupBy(F.col(actual).cast("int").alias("actual")).pivot(predicted, [0, 1]).agg(F.count(F.lit(1)))
    return pivoted.select("actual", F.coalesce("0", F.lit(0)).alias("predicted_0"), F.coalesce("1", F.lit(0)).alias("predicted_1"))


def curve_points(df: DataFrame, score: str, actual: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cumulative true and false positives per distinct score, from the highest score down.

    Scores are folded first; the running sums go over blocks, so a score column with as many
    distinct values as rows does not end in one task.
    """
    per_score = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(actual) == 1).cast("bigint")).alias("_pos"), F.sum((F.col(actual) != 1).cast("bigint")).alias("_neg")
    )
    points = running_totals(per_score, [F.desc("threshold")], {"tp": F.col("_pos"), "fp": F.col("_neg")}, block_rows)
    totals = per_score.agg(F.struct(F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))).scalar()
    return points.withColumns({
        "tpr": C.ratio(F.col("tp"), totals["p"]), "fpr": C.ratio(F.col("fp"), totals["n"]),
        "precision": C.ratio(F.col("tp"), F.col("tp") + F.col("fp")),
    }).withColumnsRenamed({"_pos": "positives", "_neg": "negatives"})


def curve_areas(points: DataFrame) -> DataFrame:
    """ROC area with ties counted half, and average precision, straight from the curve points."""
    wins = F.col("negatives") * (F.col("tp") - F.col("positives")) + F.col("negatives") * F.col("positives") / 2.0
    totals = points.agg(
        F.sum("positives").alias("p"), F.sum("negatives").alias("n"), F.sum(wins).alias("w"),
        F.sum(F.col("positives") * F.col("precision")).alias("ap"),
    )
    return totals.select(
        C.ratio(F.col("w"), F.col("p") * F.col("n")).alias("roc_auc"), C.ratio(F.col("ap"), F.col("p")).alias("average_precision")
    )


def per_class_detection(df: DataFrame, label: str = "Label", predicted: str = "prediction") -> DataFrame:
    """Share of each original label that got the right side of the verdict."""
    text = C.clean_label(F.col(label))
    right = (F.col(predicted) == C.is_attack(F.col(label))).cast("bigint")
    return df.groupBy(text.alias("Label")).agg(F.count(F.lit(1)).alias("Test_Samples"), F.sum(right).alias("Correct_Classifications")).withColumns({
        "Detection_Rate": C.ratio(F.col("Correct_Classifications"), F.col("Test_Samples")),
        "Reliability": F.when(F.col("Test_Samples") >= 100, "Reliable").otherwise("Unreliable (Small N)"),
    }).orderBy(F.desc("Test_Samples"), "Label")


# --- votes and verdicts ----------------------------------------------------------------
def consensus(verdicts: DataFrame) -> DataFrame:
    """-1 when at least two of the three voting models say -1; k-means has no vote."""
    votes = sum(((F.col(c) == -1).cast("int") for c in ("IsoForest_Pred", "OneClassSVM_Pred", "DBSCAN_Anomaly")), F.lit(0))
    return verdicts.withColumn("Consensus_Anomaly", F.when(votes >= 2, -1).otherwise(1))


def fuse_verdicts(scored: DataFrame, strategy: str = "consensus") -> DataFrame:
    """Combine a binary forest verdict and a multiclass network verdict.

    ``consensus``: both agree, else MODEL DISAGREEMENT; ``high_recall``: either attack is an
    attack; ``conservative``: only both.
    """
    forest, network = F.col("RF_Prediction") != "BENIGN", F.col("ANN_Prediction") != "BENIGN"
    agree = forest == network
    status = {
        "consensus": F.when(~agree, "MODEL DISAGREEMENT").when(forest, "ATTACK").otherwise("BENIGN"),
        "high_recall": F.when(forest | network, "ATTACK").otherwise("BENIGN"),
        "conservative": F.when(forest & network, "ATTACK").otherwise("BENIGN"),
    }
    if strategy not in status:
        raise ValueError(f"unknown strategy {strategy!r}")
    named = F.when(network, F.col("ANN_Prediction")).otherwise("ATTACK")
    out = scored.withColumns({"Model_Agreement": F.when(agree, "AGREE").otherwise("DISAGREE"), "Final_Status": status[strategy]})
    return out.withColumn("Final_Predicted_Class", F.when(F.col("Final_Status") == "BENIGN", "BENIGN").otherwise(named))


def explained_report(scored: DataFrame, features: list[str], strategy: str = "consensus") -> DataFrame:
    """Fused verdicts with the features that set each alert apart from the flows both models pass, as the 12-column report.

    Flows that end as BENIGN have an empty explanation, and so has everything if no flow is benign.
    """
    fused = fuse_verdicts(scored, strategy)
    told = explain(fused, features, F.col("Final_Status") == "BENIGN")
    return detection_report(told.withColumn("Explanation", F.when(F.col("Final_Status") == "BENIGN", "").otherwise(F.col("Explanation"))))


def detection_summary(fused: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    agree = F.count(F.when(F.col("Model_Agreement") == "AGREE", 1))
    return fused.agg(
        n.alias("total_flows"),
        F.count(F.when(F.col("RF_Prediction") == "BENIGN", 1)).alias("rf_normal"), F.count(F.when(F.col("RF_Prediction") == "ATTACK", 1)).alias("rf_attack"),
        F.count(F.when(F.col("ANN_Prediction") == "BENIGN", 1)).alias("ann_normal"), F.count(F.when(F.col("ANN_Prediction") != "BENIGN", 1)).alias("ann_attack"),
        C.ratio(agree * 100, n).alias("agreement_pct"), C.ratio((n - agree) * 100, n).alias("disagreement_pct"),
    )


def detected_classes(fused: DataFrame) -> DataFrame:
    return fused.filter(F.col("ANN_Prediction") != "BENIGN").groupBy("ANN_Prediction").agg(F.count(F.lit(1)).alias("flows"))
