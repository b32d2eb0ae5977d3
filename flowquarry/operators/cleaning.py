"""Cleaning of packet tables and of labelled flow tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import NumericType

from flowquarry import fixed
from flowquarry.functions import columns as C
from flowquarry.operators.quantiles import percentile_row


# --- headers ---------------------------------------------------------------------------
def standard_headers(df: DataFrame) -> DataFrame:
    """Strip blanks and quotes from headers and apply the alias names."""
    names = []
    for raw in df.columns:
        name = raw.strip().strip("\"'").strip()
        names.append(fixed.HEADER_ALIASES.get(name, name))
    return df.toDF(*names)


def numbered_repeats(names: list[str]) -> list[str]:
    """Make repeated headers unique as ``name``, ``name.1``, ``name.2``."""
    seen: dict[str, int] = {}
    out = []
    for name in (n.strip() for n in names):
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(name if count == 0 else f"{name}.{count}")
    return out


def require_columns(df: DataFrame, needed: list[str], what: str = "input") -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} misses required columns: {missing}")
    return df


def missing_recommended(df: DataFrame) -> list[str]:
    return [c for c in fixed.RECOMMENDED_COLUMNS if c not in df.columns]


# --- packets ---------------------------------------------------------------------------
def load_statistics(df: DataFrame) -> DataFrame:
    """Row count and null count per column in one pass, one output row per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.sum(F.col(f"`{c}`").isNull().cast("bigint")).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("null_count"))
        for i, c in enumerate(df.columns)
    ])
    return counts.select("row_count", F.explode(pairs).alias("p")).select(
        F.col("p.column_name"), "row_count", F.col("p.null_count")
    )


def drop_exact_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def _typed(df: DataFrame) -> DataFrame:
    """Add the usable time and length; NULL where the row breaks the rule."""
    time = F.col("Time_ns") if "Time_ns" in df.columns else C.time_ns(F.col("Time"))
    rows = df.withColumns({"_t": time, "_l": C.number(F.col("Length"))})
    keep = (F.col("_l") > 0) & (F.col("_l") <= fixed.MAX_PACKET_LENGTH)
    return rows.withColumn("_l", F.when(keep, F.col("_l").cast("int")))


def _judged(df: DataFrame) -> DataFrame:
    """Add the first rule each row breaks, if any."""
    return _typed(df).withColumn(
        "reject_reason",
        F.when(F.col("_t").isNull() | (F.col("_t") < 0), F.lit("malformed_time"))
        .when(F.col("_l").isNull(), F.lit("impossible_length"))
        .otherwise(F.lit("kept")),
    )


def _normalised(df: DataFrame) -> DataFrame:
    out = {
        "Time_ns": F.col("_t"),
        "Time": C.seconds(F.col("_t")),
        "Length": F.col("_l"),
        "Protocol": C.protocol_name(F.col("Protocol")) if "Protocol" in df.columns else F.lit("UNKNOWN"),
    }
    for side in ("Source", "Destination"):
        out[side] = C.address(F.col(side)) if side in df.columns else F.lit("UNKNOWN")
    for port in ("Source_Port", "Destination_Port"):
        if port in df.columns:
            out[port] = C.whole_number(F.col(port))
    if "Info" in df.columns:
        out["Info"] = F.coalesce(F.col("Info").cast("string"), F.lit(""))
    if "Frame_Number" in df.columns:
        out["Frame_Number"] = C.whole_number(F.col("Frame_Number")).cast("bigint")
    known = set(out) | {"_t", "_l", "reject_reason"}
    for field in df.schema.fields:
        if field.name not in known and field.dataType.simpleString() == "string":
            out[field.name] = F.coalesce(F.col(f"`{field.name}`"), F.lit("UNKNOWN"))
    return df.withColumns(out).drop("_t", "_l", "reject_reason")


def clean_packets(raw: DataFrame, deduplicate: bool = True, subset: list[str] | None = None) -> DataFrame:
    """Strict cleaning: duplicates out, unusable times and lengths out, text normalised.

    There is no global sort: every operator that needs an order states it itself.
    """
    require_columns(raw, fixed.REQUIRED_COLUMNS, "packet table")
    rows = drop_exact_duplicates(raw, subset) if deduplicate else raw
    return _normalised(_typed(rows).filter((F.col("_t") >= 0) & F.col("_l").isNotNull()))


def clean_packets_lenient(raw: DataFrame) -> DataFrame:
    """Keep every row: an unusable time becomes 0.0, an unusable length 0."""
    require_columns(raw, fixed.REQUIRED_COLUMNS, "packet table")
    time = C.time_ns(F.col("Time"))
    length = C.finite(C.number(F.col("Length")))
    return raw.withColumns({
        "Time_ns": F.coalesce(time, F.lit(0).cast("bigint")),
        "Time": C.seconds(F.coalesce(time, F.lit(0).cast("bigint"))),
        "Length": F.coalesce(length.try_cast("int"), F.lit(0)),
        "Source": F.coalesce(F.col("Source").cast("string"), F.lit("0.0.0.0")),
        "Destination": F.coalesce(F.col("Destination").cast("string"), F.lit("0.0.0.0")),
        "Protocol": F.coalesce(F.col("Protocol").cast("string"), F.lit("UNKNOWN")),
        "Info": F.coalesce(F.col("Info").cast("string"), F.lit("")),
    })


def _folded(raw: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, judged. Copies are folded before the shuffle, so a huge group of copies is cheap."""
    return _judged(raw.groupBy(*[F.col(f"`{c}`") for c in raw.columns]).agg(F.count(F.lit(1)).alias("_copies")))


def _counters(names: list[str]) -> list[Column]:
    filled = set(fixed.PACKET_COLUMNS) - {"Frame_Number"}
    other = [c for c in names if c not in filled]
    gaps = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("bigint") for c in other], F.lit(0))
    kept = F.col("reject_reason") == "kept"
    return [
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("initial_row_count"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows_removed"),
        F.count(F.when(F.col("reject_reason") == "malformed_time", 1)).alias("malformed_rows_removed"),
        F.count(F.when(F.col("reject_reason") == "impossible_length", 1)).alias("impossible_values_removed"),
        F.coalesce(F.sum(F.when(kept, gaps)), F.lit(0)).alias("missing_values_handled"),
        F.count(F.when(kept, 1)).alias("final_row_count"),
    ]


def cleaning_report(raw: DataFrame) -> DataFrame:
    """One row of counters."""
    return _folded(raw).agg(*_counters(raw.columns))


def clean_to_table(raw: DataFrame, path: str) -> DataFrame:
    """Writes the strictly cleaned packets to ``path`` (Parquet, which must not exist) and returns the cleaning report of that write.

    The counters are observed while the rows are written, so the input is read once. They are made in the tasks that write,
    after the only shuffle, and Spark counts each of these once when it succeeds, so lost executors do not count twice. An
    empty table gives an empty Parquet table and a report of zeros.
    """
    require_columns(raw, fixed.REQUIRED_COLUMNS, "packet table")
    seen, counters = Observation(), _counters(raw.columns)
    judged = _folded(raw).observe(seen, *counters)
    _normalised(judged.filter(F.col("reject_reason") == "kept")).drop("_copies").write.parquet(path)
    names = ["initial_row_count", "duplicate_rows_removed", "malformed_rows_removed", "impossible_values_removed", "missing_values_handled", "final_row_count"]
    found = seen.get
    return raw.sparkSession.createDataFrame([tuple(int(found.get(n) or 0) for n in names)], ", ".join(f"{n} long" for n in names))


# --- labelled flow tables --------------------------------------------------------------
def numeric_columns(df: DataFrame, exclude: set[str] | None = None) -> list[str]:
    exclude = exclude or set()
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def duplicate_count(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    cols = [F.col(f"`{c}`") for c in (subset or df.columns)]
    folded = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    total, extra = F.coalesce(F.sum("_copies"), F.lit(0)), F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))
    return folded.agg(total.alias("total_rows"), extra.alias("duplicate_rows")).withColumn(
        "duplicate_pct", C.ratio(F.col("duplicate_rows") * 100, F.col("total_rows"))
    )


def value_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing and infinite values per column, one row per column, one pass."""
    measured = df.agg(*[
        F.struct(
            F.sum(C.is_missing(F.col(f"`{c}`")).cast("bigint")).alias("missing_count"),
            F.sum(C.is_infinite(F.col(f"`{c}`")).cast("bigint")).alias("infinite_count"),
        ).alias(f"m{i}")
        for i, c in enumerate(cols)
    ])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("m")) for i, c in enumerate(cols)])
    return measured.select(F.explode(rows).alias("r")).select(
        F.col("r.feature"),
        F.coalesce(F.col("r.m.missing_count"), F.lit(0)).alias("missing_count"),
        F.coalesce(F.col("r.m.infinite_count"), F.lit(0)).alias("infinite_count"),
    )


def impute_median(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Infinite and missing values become the exact column median (0 if the column has none).

    ``fit_on`` takes the medians from another table, such as the training split.
    """
    medians = percentile_row(fit_on if fit_on is not None else df, {c: C.finite(F.col(f"`{c}`")) for c in cols}, [0.5])
    return df.withColumns({
        c: F.coalesce(C.finite(F.col(f"`{c}`")), F.lit(medians[c][0]), F.lit(0.0)) for c in cols
    })


def repair_overflow(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Negative counters from integer overflow become the median of the column's non-negative values."""
    cols = [c for c in (cols or fixed.OVERFLOW_COLUMNS) if c in df.columns]
    if not cols:
        return df
    medians = percentile_row(df, {c: F.when(F.col(f"`{c}`") >= 0, C.finite(F.col(f"`{c}`"))) for c in cols}, [0.5])
    return df.withColumns({
        c: F.when(F.col(f"`{c}`") < 0, F.lit(medians[c][0])).otherwise(F.col(f"`{c}`").cast("double")) for c in cols
    })


def clip_negative(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or fixed.NON_NEGATIVE_COLUMNS) if c in df.columns]
    return df.withColumns({
        c: F.when(F.col(f"`{c}`") < 0, F.lit(0)).otherwise(F.col(f"`{c}`")) for c in cols
    }) if cols else df


def zero_unusable(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(C.finite(F.col(f"`{c}`")), F.lit(0.0)) for c in cols})
