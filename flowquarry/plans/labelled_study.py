"""The labelled flow-table study: clean, profile, rank, split, train, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowquarry.functions import columns as C
from flowquarry.operators import cleaning, evaluation as EV, forest, ranking, statistics as ST
from flowquarry.operators.neighbours import neighbour_information
from flowquarry.session import cut_lineage


def feature_analysis(cleaned: DataFrame, raw: DataFrame, cols: list[str], label: str = "Label", trees: int = 100, depth: int = 15) -> DataFrame:
    """The 26-column feature table over all rows (no sample)."""
    attack = C.is_attack(F.col(label))
    model = forest.train_forest(cleaned.withColumn("_y", attack.cast("double")), cols, "_y", trees, depth, balanced=False, scale=False)
    pairs = cut_lineage(ST.correlations(cleaned, cols))
    return ranking.feature_table(
        ST.feature_profile(cleaned, cols, raw), ST.strongest_partner(pairs, cols), ranking.anova_f(cleaned, cols, attack),
        neighbour_information(cleaned, cols, attack).withColumnRenamed("neighbour_information", "mutual_information_score"),
        forest.importances(model, cols),
    )


def prepare(raw: DataFrame, cols: list[str], overflow: list[str] | None = None, non_negative: list[str] | None = None) -> DataFrame:
    """Deduplicated and repaired table. Each step is cut, because its medians scan the step before."""
    distinct = cut_lineage(cleaning.drop_exact_duplicates(raw))
    filled = cut_lineage(cleaning.impute_median(distinct, cols))
    return cleaning.clip_negative(cleaning.repair_overflow(filled, overflow), non_negative)


def baseline(table: DataFrame, cols: list[str], keys: list[str], label: str = "Label", trees: int = 200, depth: int = 30, seed: int = 42) -> dict[str, DataFrame]:
    """Split, fit medians and scaling on the training rows only, train, evaluate."""
    rows = table.withColumn("_y", C.is_attack(F.col(label)).cast("double"))
    split = cut_lineage(EV.stratified_split(rows, "_y", keys, seed))
    train = split.filter(F.col("split") == "train")
    filled = cut_lineage(cleaning.impute_median(split, cols, fit_on=train))
    model = forest.train_forest(filled.filter(F.col("split") == "train"), cols, "_y", trees, depth, seed)
    scored = cut_lineage(forest.score(model, filled.filter(F.col("split") != "train"), cols))
    test = scored.filter(F.col("split") == "test")
    points = cut_lineage(EV.curve_points(test, "Attack_Probability", "_y"))
    return {
        "classes": ST.class_distribution(table, label), "split": split, "scored": scored,
        "metrics": EV.binary_metrics(scored, "_y", "Prediction_Label", ["split"]),
        "confusion": EV.confusion_matrix(test, "_y", "Prediction_Label"), "curve": points, "areas": EV.curve_areas(points),
        "per_class": EV.per_class_detection(test, label, "Prediction_Label"), "importance": ranking.importance_table(forest.importances(model, cols)),
    }
