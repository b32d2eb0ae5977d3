"""Feature scores, redundancy, leakage risk and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowquarry import fixed
from flowquarry.functions import columns as C
from flowquarry.operators.quantiles import percentile_row
from flowquarry.operators.statistics import long_view


def anova_f(df: DataFrame, cols: list[str], label: Column) -> DataFrame:
    """One-way ANOVA F per feature, from per-class count, mean and variance in one pass."""
    view = long_view(df.withColumn("_y", label), cols, ["_y"])
    per_class = view.groupBy("feature", "_y").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("ss")
    )
    all_classes = Window.partitionBy("feature")  # one row per class
    grand = F.sum(F.col("n") * F.col("m")).over(all_classes) / F.sum("n").over(all_classes)
    between = per_class.withColumn("b", F.col("n") * (F.col("m") - grand) * (F.col("m") - grand))
    k, n = F.count(F.lit(1)), F.sum("n")
    f = (F.sum("b") / F.nullif(k - 1, F.lit(0))) / F.nullif(F.sum("ss") / F.nullif(n - k, F.lit(0)), F.lit(0.0))
    return between.groupBy("feature").agg(F.coalesce(f, F.lit(0.0)).alias("anova_f_score"))


def mutual_information(df: DataFrame, cols: list[str], label: Column, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) with the label, over equal-frequency bins of all rows.

    A different estimator from the nearest-neighbour one on a sample: it needs no neighbour
    search, so it uses every row.
    """
    edges = percentile_row(df, {c: F.col(f"`{c}`") for c in cols}, [i / bins for i in range(1, bins)], interpolate=False)
    binned = df.select(label.alias("_y"), *[
        sum(((C.finite(F.col(f"`{c}`")) > e).cast("int") for e in dict.fromkeys(edges[c]) if e is not None), F.lit(0)).alias(c) for c in cols
    ])
    cells = binned.unpivot("_y", [F.col(f"`{c}`") for c in cols], "feature", "bin").groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).alias("n"))
    # From here on: features x bins x classes rows.
    total = F.sum("n").over(Window.partitionBy("feature"))
    in_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    in_class = F.sum("n").over(Window.partitionBy("feature", "_y"))
    term = F.col("n") / total * F.log(F.col("n") * total / (in_bin * in_class))
    return cells.withColumn("t", term).groupBy("feature").agg(F.sum("t").alias("mutual_information_score"))


def redundancy(constant: Column, corr: Column, partner: Column) -> Column:
    return (
        F.when(constant, F.lit("Constant (Zero Variance)"))
        .when(corr >= 0.99, F.concat(F.lit("Duplicate/Extremely Redundant with "), partner))
        .when(corr >= 0.90, F.concat(F.lit("Highly Redundant with "), partner))
        .otherwise(F.lit("Unique/Non-Redundant"))
    )


def leakage_risk(name: Column) -> Column:
    return (
        F.when(name == "Destination Port", "High")
        .when((name == "Flow Duration") | name.contains("Header Length") | name.contains("min_seg_size"), "Medium")
        .otherwise("Low")
    )


def suitability(constant: Column, corr: Column, leakage: Column, importance: Column, mi: Column, skewed: Column) -> dict[str, Column]:
    """Suitability letter, tier and generator suitability by the same ordered rules."""
    strong = (importance >= 0.005) | (mi >= 0.05)
    shape = F.when(skewed, "Needs preprocessing").otherwise("High")

    def choose(poor, copied, leaking, redundant, strong_value, other):
        return (
            F.when(constant, poor).when(corr >= 0.99, copied).when(leakage == "High", leaking)
            .when(corr >= 0.90, redundant).when(strong, strong_value).otherwise(other)
        )

    avoid, maybe, best = "Tier 3 - Remove/Avoid", "Tier 2 - Possible candidate", "Tier 1 - Strong candidate"
    return {
        "ml_suitability": choose("E. Poor candidate", "C. Redundant", "D. Potential leakage", "C. Redundant", "A. Strong candidate", "B. Possible candidate"),
        "preliminary_recommendation": choose(avoid, avoid, maybe + " (Use with caution)", maybe, best, F.when(mi >= 0.02, best).otherwise(maybe)),
        "gan_suitability": choose("Low", "Low", "Medium", "Medium", shape, shape),
    }


def feature_meaning(df: DataFrame, name: str = "feature") -> DataFrame:
    """Meaning of each feature from the fixed dictionary (78 rows)."""
    rows = list(fixed.FEATURE_MEANINGS.items())
    known = df.sparkSession.createDataFrame(rows, f"`{name}` string, meaning string")
    return df.join(F.broadcast(known), name, "left").withColumn("meaning", F.coalesce("meaning", F.lit(fixed.DEFAULT_MEANING)))


def feature_table(profile: DataFrame, partners: DataFrame, f_scores: DataFrame, mi: DataFrame, importances: DataFrame) -> DataFrame:
    """The feature analysis table: one row per feature, 26 columns."""
    joined = feature_meaning(
        profile.join(partners, "feature", "left").join(f_scores, "feature", "left").join(mi, "feature", "left").join(importances, "feature", "left")
    )
    corr = F.coalesce("max_correlation", F.lit(0.0))
    risk = leakage_risk(F.col("feature"))
    verdicts = suitability(
        F.col("is_constant"), corr, risk, F.coalesce("importance", F.lit(0.0)), F.coalesce("mutual_information_score", F.lit(0.0)), F.col("is_skewed")
    )
    text = F.when(corr >= 0.90, F.concat(F.lit("Max corr "), F.format_number(corr, 2), F.lit(" with "), F.col("partner"))).otherwise("No high correlation")
    return joined.select(
        F.col("feature").alias("feature_name"), "meaning", "datatype", "unique_values", "min", "max", "mean", "median", "std",
        "missing_count", "infinite_count", "zero_percentage", "is_constant", "skewness", "is_skewed", "has_outliers",
        text.alias("correlation_information"), corr.alias("max_correlation"),
        F.coalesce("mutual_information_score", F.lit(0.0)).alias("mutual_information_score"),
        F.coalesce("anova_f_score", F.lit(0.0)).alias("anova_f_score"),
        F.coalesce("importance", F.lit(0.0)).alias("random_forest_importance"),
        redundancy(F.col("is_constant"), corr, F.col("partner")).alias("redundancy_status"),
        risk.alias("leakage_risk"), verdicts["gan_suitability"].alias("gan_suitability"),
        verdicts["preliminary_recommendation"].alias("preliminary_recommendation"), verdicts["ml_suitability"].alias("ml_suitability"),
    )


def ranked(scores: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """Rank by score. One row per feature, so a single ordered window is fine."""
    order = Window.orderBy(F.desc(score), F.asc("feature"))
    return scores.withColumn(name, F.row_number().over(order))


def importance_table(importances: DataFrame) -> DataFrame:
    return ranked(importances.withColumn("percentage", F.col("importance") * 100), "importance").select("rank", "feature", "importance", "percentage")
