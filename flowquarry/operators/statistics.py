"""Capture and flow statistics. Column statistics go through one long (feature, value) view, so
one small aggregation serves any number of columns and combines map-side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowquarry import fixed
from flowquarry.functions import columns as C
from flowquarry.operators.cleaning import numeric_columns
from flowquarry.operators.quantiles import percentile_row


def long_view(df: DataFrame, cols: list[str], keep: list[str] | None = None, value: str = "value") -> DataFrame:
    keep = keep or []
    wide = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return wide.unpivot([F.col(k) for k in keep], [F.col(f"`{c}`") for c in cols], "feature", value)


def _looked_up(numbers: dict[str, float | None], key: Column) -> Column:
    pairs = [F.lit(x) for name, v in numbers.items() if v is not None for x in (name, float(v))]
    if not pairs:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*pairs), key)


# --- capture ---------------------------------------------------------------------------
def capture_summary(packets: DataFrame, flow_count: Column | int) -> DataFrame:
    """``flow_count`` is a number or a scalar subquery such as ``flows.agg(count).scalar()``."""
    flows = flow_count if isinstance(flow_count, Column) else F.lit(flow_count)
    totals = packets.agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.coalesce(F.sum(F.col("Length").cast("bigint")), F.lit(0)).alias("total_bytes"),
        F.coalesce(C.seconds(F.max("Time_ns") - F.min("Time_ns")), F.lit(0.0)).alias("_d"),
    )
    floor = F.greatest(F.lit(0.001), F.col("_d"))
    return totals.select(
        "total_packets", flows.cast("bigint").alias("total_flows"), "total_bytes",
        F.round("_d", 2).alias("capture_duration_seconds"),
        F.round(F.col("total_packets") / floor, 2).alias("avg_packet_rate"),
        F.round(F.col("total_bytes") / floor, 2).alias("avg_byte_rate"),
    )


def frequency(df: DataFrame, col: str, name: str = "Packet_Count") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def share(counts: DataFrame, count_col: str, name: str = "Percentage", digits: int | None = 2) -> DataFrame:
    """Percent of the total. The total is a one-row subquery, not an unpartitioned window."""
    total = counts.agg(F.sum(count_col).alias("t")).scalar()
    percent = C.ratio(F.col(count_col) * 100, total)
    return counts.withColumn(name, percent if digits is None else F.round(percent, digits))


def entropies(packets: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Shannon entropy in bits, one row per column."""
    cols = cols or ["Source", "Destination", "Protocol"]
    text = packets.select(*[F.col(c).cast("string").alias(c) for c in cols])
    counts = text.unpivot([], [F.col(c) for c in cols], "field", "value").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    total = packets.agg(F.count(F.lit(1)).alias("t")).scalar()
    p = F.col("n") / total
    return counts.groupBy(F.concat(F.lit("entropy_"), F.lower("field")).alias("metric")).agg(
        F.round(-F.sum(p * F.log2(p + 1e-12)), 4).alias("entropy")
    )


def top_values(df: DataFrame, col: str, n: int = 10, positive_only: bool = False, name: str = "Packet_Count") -> DataFrame:
    rows = df.filter(F.col(col) > 0) if positive_only else df
    return frequency(rows, col, name).orderBy(F.desc(name), F.asc(col)).limit(n)


def per_second(packets: DataFrame) -> DataFrame:
    second = F.floor(F.col("Time_ns") / C.NANOS).cast("bigint")
    return packets.groupBy(second.alias("Time_Int")).agg(
        F.count(F.lit(1)).alias("packets"), (F.sum(F.col("Length").cast("bigint")) / 1024.0).alias("kilobytes")
    )


# --- distributions ---------------------------------------------------------------------
def histogram(df: DataFrame, value: Column, bins: int = 50, log_scale: bool = False, by: str | None = None) -> DataFrame:
    """Counts per equal-width bin between the least and largest finite value (of log10 of positive ones when ``log_scale``)."""
    sound = C.finite(value)
    v = F.log10(sound) if log_scale else sound
    usable = sound.isNotNull() & ((sound > 0) if log_scale else F.lit(True))
    keep = [by] if by else []
    rows = df.filter(usable).select(*keep, v.alias("_v"))
    bounds = rows.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))).scalar()
    low, width = bounds["lo"], bounds["hi"] - bounds["lo"]
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - low) / width * bins), F.lit(bins - 1))).otherwise(0)
    counted = rows.groupBy(*keep, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keep, "bin", (low + F.col("bin") * width / bins).alias("bin_start"), "n")


def box_statistics(df: DataFrame, group: str, value: str, groups: int = 6) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers for the most frequent groups."""
    spark = df.sparkSession
    names = [r[0] for r in top_values(df, group, groups).collect()]  # at most ``groups`` names
    picked = {g: F.when(F.col(group) == g, F.col(value).cast("double")) for g in names}
    quartiles = percentile_row(df, picked, [0.25, 0.5, 0.75])
    rows = [(g, *quartiles[g]) for g in names]
    schema = f"`{group}` string, q1 double, median double, q3 double"
    small = spark.createDataFrame(rows, schema)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value).cast("double")
    return df.join(F.broadcast(small), group).groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
        F.count(F.lit(1)).alias("n"),
    )


def top_and_other(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    counts = frequency(df, col)
    named = counts.orderBy(F.desc("Packet_Count"), F.asc(col)).limit(n).select(F.col(col).alias("_top"))
    flagged = counts.join(F.broadcast(named), F.col(col) == F.col("_top"), "left")  # at most n rows
    return flagged.groupBy(F.coalesce("_top", F.lit("OTHER")).alias(col)).agg(F.sum("Packet_Count").alias("Packet_Count"))


# --- columns ---------------------------------------------------------------------------
def moments(df: DataFrame, cols: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Mean, median, variance, deviation, skewness, excess kurtosis and 95 % interval per column."""
    cols = cols or numeric_columns(df, {"Source_Port", "Destination_Port"})
    medians = {c: v[0] for c, v in percentile_row(df, {c: F.col(f"`{c}`") for c in cols}, [0.5]).items()}
    stats = long_view(df, cols).filter(F.col("value").isNotNull()).groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"),
    )
    margin = 1.96 * F.col("std") / F.sqrt("n")
    r = lambda c, name: F.round(c, digits).alias(name)
    return stats.select(
        F.col("feature").alias("Feature"), r(F.col("mean"), "Mean"),
        r(_looked_up(medians, F.col("feature")), "Median"),
        r(F.col("var"), "Variance"), r(F.col("std"), "Std_Dev"),
        r(F.when(F.col("n") > 2, F.col("skew")).otherwise(0.0), "Skewness"),
        r(F.when(F.col("n") > 3, F.col("kurt")).otherwise(0.0), "Kurtosis"),
        r(F.col("mean") - margin, "CI_95_Lower"), r(F.col("mean") + margin, "CI_95_Upper"),
    )


def correlations(df: DataFrame, cols: list[str], digits: int | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns i < j that vary, over the rows that have both.

    Every task sums the products of its own rows, shifted by the column means, in a few
    matrices and emits them once; rows never meet each other.
    """
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    first = wide.agg(*[F.avg(C.finite(F.col(f"c{i}"))).alias(f"m{i}") for i in range(len(cols))]).first()
    means = np.array([0.0 if first[i] is None else first[i] for i in range(len(cols))])
    kinds = ["s", "si", "sj", "n", "qi", "qj"]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(kinds), len(means), len(means)))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - means
            there = np.isfinite(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([x.T @ x, x.T @ m, m.T @ x, m.T @ m, (x * x).T @ m, m.T @ (x * x)])
        i, j = np.triu_indices(len(means), 1)
        yield pd.DataFrame({"i": i, "j": j, **{k: total[n, i, j] for n, k in enumerate(kinds)}})

    schema = "i int, j int, " + ", ".join(f"{k} double" for k in kinds)
    sums = wide.mapInPandas(products, schema).groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in kinds])
    spread_i = F.col("qi") - F.col("si") * F.col("si") / F.col("n")
    spread_j = F.col("qj") - F.col("sj") * F.col("sj") / F.col("n")
    corr = (F.col("s") - F.col("si") * F.col("sj") / F.col("n")) / F.sqrt(spread_i) / F.sqrt(spread_j)
    names = F.array(*[F.lit(c) for c in cols])
    # what rounding alone can leave of a constant column
    noise = F.array(*[F.lit((1e-13 * abs(m)) ** 2) for m in means.tolist()])
    varies = (spread_i > F.get(noise, F.col("i")) * F.col("n")) & (spread_j > F.get(noise, F.col("j")) * F.col("n"))
    return sums.filter(F.col("n") > 1).filter(varies).select(
        F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"),
        (corr if digits is None else F.round(corr, digits)).alias("correlation"),
    )


def correlated_pairs(pairs: DataFrame, threshold: float = 0.90) -> DataFrame:
    strong = pairs.withColumn("correlation", F.abs("correlation")).filter(F.col("correlation") >= threshold)
    return strong.orderBy(F.desc("correlation"), "feature_a", "feature_b")


def strongest_partner(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Per feature the partner with the largest absolute correlation; none gives 0.0 and "None"."""
    both = pairs.select("feature_a", "feature_b", F.abs("correlation").alias("c")).unionByName(
        pairs.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), F.abs("correlation").alias("c"))
    )
    position = {c: i for i, c in enumerate(cols)}
    rank = F.element_at(F.create_map(*[F.lit(x) for c, i in position.items() for x in (c, -i)]), F.col("feature_b"))
    best = both.groupBy("feature_a").agg(
        F.max("c").alias("max_correlation"), F.max_by("feature_b", F.struct("c", rank)).alias("partner")
    )
    every = pairs.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return every.join(best, every.feature == best.feature_a, "left").select(
        "feature", F.coalesce("max_correlation", F.lit(0.0)).alias("max_correlation"),
        F.coalesce("partner", F.lit("None")).alias("partner"),
    )


def feature_profile(df: DataFrame, cols: list[str], raw: DataFrame | None = None, exact_distinct: bool = True) -> DataFrame:
    """Profile per column. ``raw`` is the table before imputation, for missing and infinite counts."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    medians = {c: v[0] for c, v in percentile_row(df, {c: C.finite(F.col(f"`{c}`")) for c in cols}, [0.5]).items()}
    view = long_view(df, cols)
    v = F.col("value")
    stats = view.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.skewness(v).alias("_skew"),
        (F.sum((v == 0).cast("bigint")) / F.count(F.lit(1)) * 100).alias("zero_percentage"),
        *([] if exact_distinct else [F.approx_count_distinct(v).alias("unique_values")]),
    )
    if exact_distinct:
        # two steps instead of count(distinct): the first is spread by (column, value)
        distinct = view.groupBy("feature", "value").agg(F.lit(1).alias("_")).groupBy("feature").agg(F.count(F.lit(1)).alias("unique_values"))
        stats = stats.join(distinct, "feature")
    source = long_view(raw if raw is not None else df, cols)
    gaps = source.groupBy("feature").agg(
        F.sum(C.is_missing(v).cast("bigint")).alias("missing_count"), F.sum(C.is_infinite(v).cast("bigint")).alias("infinite_count")
    )
    std = F.coalesce(F.col("std"), F.lit(0.0))
    skew = F.when(std > 0, F.col("_skew")).otherwise(0.0)
    dtype = F.element_at(F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])]), F.col("feature"))
    return stats.join(gaps, "feature").select(
        "feature", dtype.alias("datatype"), "unique_values", "min", "max", "mean",
        _looked_up(medians, F.col("feature")).alias("median"), std.alias("std"), "missing_count", "infinite_count",
        "zero_percentage", ((std == 0) | (F.col("unique_values") <= 1)).alias("is_constant"), skew.alias("skewness"),
        (F.abs(skew) > 3.0).alias("is_skewed"),
        F.when(std > 0, F.col("max") > F.col("mean") + 5.0 * std).otherwise(False).alias("has_outliers"),
    )


# --- labels, verdicts, subsets ---------------------------------------------------------
def class_distribution(df: DataFrame, label: str = "Label", strict_families: bool = False) -> DataFrame:
    counts = df.groupBy(C.clean_label(F.col(label)).alias("Label")).agg(F.count(F.lit(1)).alias("Samples"))
    return share(counts, "Samples", digits=None).withColumns({
        "Attack_Family": C.attack_family(F.col("Label"), strict_families), "Binary": C.is_attack(F.col("Label")),
    })


def family_distribution(classes: DataFrame) -> DataFrame:
    return share(classes.groupBy("Attack_Family").agg(F.sum("Samples").alias("Samples")), "Samples", digits=None).orderBy(
        F.desc("Samples"), "Attack_Family"
    )


def file_audit(df: DataFrame, label: str = "Label", file: Column | None = None) -> DataFrame:
    """Rows per input file and label. The file name is hidden metadata of a file scan."""
    name = file if file is not None else F.col("_metadata.file_name")
    return df.groupBy(name.alias("file_name"), C.clean_label(F.col(label)).alias("Label")).agg(F.count(F.lit(1)).alias("rows"))


def dataset_summary(raw: DataFrame, cols: list[str], label: str = "Label") -> DataFrame:
    """One row: raw and distinct rows, duplicates, missing and infinite cells, classes, families."""
    names = [F.col(f"`{c}`") for c in raw.columns]
    folded = raw.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    missing, infinite = F.lit(0), F.lit(0)
    for c in cols:
        missing = missing + C.is_missing(F.col(f"`{c}`")).cast("bigint")
        infinite = infinite + C.is_infinite(F.col(f"`{c}`")).cast("bigint")
    text = C.clean_label(F.col(label))
    totals = folded.agg(
        F.sum("_copies").alias("total_samples_raw"), F.count(F.lit(1)).alias("total_samples_cleaned"),
        F.sum(F.col("_copies") * missing).alias("missing_values_raw"), F.sum(F.col("_copies") * infinite).alias("infinite_values_raw"),
        F.count_distinct(text).alias("unique_attack_classes"), F.count_distinct(C.attack_family(text)).alias("attack_families"),
    )
    duplicates = F.col("total_samples_raw") - F.col("total_samples_cleaned")
    return totals.withColumns({
        "duplicate_count": duplicates, "duplicate_percentage": C.ratio(duplicates * 100, F.col("total_samples_raw")),
        "feature_count": F.lit(len(cols)).cast("bigint"),
    })


def class_means(df: DataFrame, cols: list[str], label: str = "Label") -> DataFrame:
    """Means by attack and benign, melted to one row per class and feature."""
    side = F.when(C.is_attack(F.col(label)) == 1, "ATTACK").otherwise("BENIGN")
    means = df.groupBy(side.alias("Is_Attack")).agg(*[F.avg(C.finite(F.col(f"`{c}`"))).alias(c) for c in cols])
    return means.unpivot("Is_Attack", [F.col(f"`{c}`") for c in cols], "Feature", "Mean_Value")


def attack_feature_statistics(scored: DataFrame, cols: list[str], verdict: str = "Prediction") -> DataFrame:
    """min, max, mean, median over predicted attacks; all zero when there are none."""
    attacks = scored.filter(F.col(verdict) == "ATTACK")
    medians = {c: v[0] for c, v in percentile_row(attacks, {c: F.col(f"`{c}`") for c in cols}, [0.5]).items()}
    stats = long_view(attacks, cols).groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    every = scored.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    zero = F.lit(0.0)
    return every.join(stats, "feature", "left").select(
        "feature", F.coalesce("min", zero).alias("min"), F.coalesce("max", zero).alias("max"),
        F.coalesce("mean", zero).alias("mean"), F.coalesce(_looked_up(medians, F.col("feature")), zero).alias("median"),
    )


def population_thresholds(flows: DataFrame) -> dict[str, float]:
    """Percentiles over all flows that the behaviour rules compare with; constants when empty."""
    finite = {c: C.finite(F.col(c)) for c in ("Packets_Per_Second", "Bytes_Per_Second", "Total_Packets", "Total_Bytes")}
    high = percentile_row(flows, finite, [0.95])
    short = percentile_row(flows, {"Mean_IAT": F.when(F.col("Mean_IAT") > 0, C.finite(F.col("Mean_IAT")))}, [0.05])
    found = {
        "pps_95th": high["Packets_Per_Second"][0], "bps_95th": high["Bytes_Per_Second"][0],
        "iat_5th": short["Mean_IAT"][0], "pkts_95th": high["Total_Packets"][0], "bytes_95th": high["Total_Bytes"][0],
    }
    return {k: fixed.THRESHOLD_DEFAULTS[k] if v is None else v for k, v in found.items()}


def anomaly_summary(verdicts: DataFrame) -> DataFrame:
    def hits(col: str) -> Column:
        return F.count(F.when(F.col(col) == -1, 1))

    return verdicts.agg(
        F.count(F.lit(1)).alias("total_flows_evaluated"), hits("IsoForest_Pred").alias("isolation_forest_anomalies"),
        hits("OneClassSVM_Pred").alias("one_class_svm_anomalies"), hits("DBSCAN_Anomaly").alias("dbscan_outliers"),
        hits("Consensus_Anomaly").alias("consensus_anomalies"),
        F.round(hits("Consensus_Anomaly") / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 2).alias("anomaly_rate_percent"),
    )


def vote_distribution(verdicts: DataFrame) -> DataFrame:
    votes = sum(((F.col(c) == -1).cast("int") for c in ("IsoForest_Pred", "OneClassSVM_Pred", "DBSCAN_Anomaly")), F.lit(0))
    return verdicts.groupBy(votes.alias("votes")).agg(F.count(F.lit(1)).alias("flows"))


def prediction_counts(scored: DataFrame, verdict: str = "Prediction") -> DataFrame:
    attack = F.count(F.when(F.col(verdict) == "ATTACK", 1))
    return scored.agg(
        F.count(F.lit(1)).alias("total_flows"), (F.count(F.lit(1)) - attack).alias("benign_flows"), attack.alias("attack_flows"),
        C.ratio(attack * 100, F.count(F.lit(1))).alias("attack_percentage"),
    )
