"""Exact percentiles that never gather a column in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one aggregation
buffer. That is right for small groups and fatal for a whole table. Here a column is
narrowed instead: one scan counts values per order-preserving bucket (map-side combined, so
only bucket counts travel), the bucket that holds the wanted rank becomes the next bracket,
and so on until the bracket is a single value or holds a handful of values. Every scan reads
only the columns asked for; what reaches the driver is bounded by columns x buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

LOG_BUCKETS_PER_E = 64
LINEAR_BUCKETS = 65_536
PASS_BUCKETS = 262_144
FINAL_VALUES = 2_000
SMALLEST = 1e-6


@dataclass
class _Bracket:
    feature: str
    rank: int
    low: float
    high: float
    below: int
    inside: int

    @property
    def settled(self) -> bool:
        return self.low == self.high


def _log_code(value: Column) -> Column:
    """Integer code that never decreases with the value; 64 steps per factor e above 1e-6."""
    magnitude = F.log1p(F.least(F.abs(value), F.lit(1e300)) / SMALLEST)
    return F.floor(F.signum(value) * magnitude * LOG_BUCKETS_PER_E).cast("int")


def _usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def _counted(cells: DataFrame) -> list:
    """Counts, minima and maxima per (slot, code) of a (slot, code, value) view."""
    return cells.groupBy("slot", "code").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    ).collect()


def _first_counts(values: DataFrame, slots: int) -> list:
    view = values.unpivot([], [f"v{i}" for i in range(slots)], "slot", "value").filter(_usable(F.col("value")))
    return _counted(view.withColumn("code", _log_code(F.col("value"))))


def _bracket_counts(values: DataFrame, slots: int, brackets: list[tuple[int, float, float, bool]], steps: int) -> list:
    """Counts inside each (slot, low, high, every value) bracket; brackets of a slot are disjoint.

    Works on the long (slot, value) view. A filter over all columns at once would be one
    predicate with many aliased columns, for which the optimizer derives 2^columns variants.
    """
    view = values.unpivot([], [f"v{i}" for i in range(slots)], "slot", "value")
    value, number = F.col("value"), None
    for slot in sorted({b[0] for b in brackets}):
        inside = None
        for i, (owner, low, high, _) in enumerate(brackets):
            if owner == slot:
                test = (value >= low) & (value <= high)
                inside = F.when(test, F.lit(i)) if inside is None else inside.when(test, F.lit(i))
        mine = F.col("slot") == f"v{slot}"
        number = F.when(mine, inside) if number is None else number.when(mine, inside)
    lows = F.array(*[F.lit(low) for _, low, _, _ in brackets])
    widths = F.array(*[F.lit((high / 2 - low / 2) * 2) for _, low, high, _ in brackets])
    single = F.array(*[F.lit(every) for _, _, _, every in brackets])
    share = (value - F.get(lows, F.col("bracket"))) / F.get(widths, F.col("bracket"))
    step = F.least(F.floor(share * steps), F.lit(steps - 1)).cast("double")
    near = view.withColumn("bracket", number).filter(F.col("bracket").isNotNull())
    return _counted(near.select(
        F.col("bracket").alias("slot"), F.when(F.get(single, F.col("bracket")), value).otherwise(step).alias("code"), "value"
    ))


def _narrow(rows: list, bracket: _Bracket) -> _Bracket:
    below = bracket.below
    for row in sorted(rows, key=lambda r: r["code"]):
        if bracket.rank < below + row["n"]:
            return _Bracket(bracket.feature, bracket.rank, row["lo"], row["hi"], below, row["n"])
        below += row["n"]
    raise AssertionError("rank outside the counted values; the input changed between scans")


def percentile_row(df: DataFrame, exprs: dict[str, Column], probs: list[float],
                   interpolate: bool = True) -> dict[str, list[float | None]]:
    """Exact percentiles of several columns, as plain numbers.

    Linear interpolation between the two neighbouring ranks, or the lower one of them when
    ``interpolate`` is off. NULL, NaN and infinite values do not take part. A column without values gives ``None``.
    ``df`` is scanned a few times, so it should be a table or a cut lineage.
    """
    names = list(exprs)
    values = df.select(*[exprs[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])

    per_slot: dict[int, list] = {}
    for row in _first_counts(values, len(names)):
        per_slot.setdefault(int(row["slot"][1:]), []).append(row)

    totals = {n: sum(r["n"] for r in per_slot.get(i, [])) for i, n in enumerate(names)}
    brackets: dict[tuple[str, int], _Bracket] = {}
    for i, name in enumerate(names):
        total = totals[name]
        for p in probs:
            if total:
                position = p * (total - 1)
                for rank in {math.floor(position), math.ceil(position)}:
                    whole = _Bracket(name, rank, -math.inf, math.inf, 0, total)
                    brackets[(name, rank)] = _narrow(per_slot[i], whole)

    found: dict[tuple[str, int], float] = {}
    while True:
        open_brackets = {}
        for key, b in brackets.items():
            if b.settled:
                found[key] = b.low
            elif key not in found:
                open_brackets.setdefault((b.feature, b.low, b.high), []).append(b)
        if not open_brackets:
            break
        slots = list(open_brackets)
        steps = max(64, min(LINEAR_BUCKETS, PASS_BUCKETS // len(slots)))
        wanted = [(names.index(feature), low, high, open_brackets[(feature, low, high)][0].inside <= FINAL_VALUES) for feature, low, high in slots]
        by_slot: dict[int, list] = {}
        for row in _bracket_counts(values, len(names), wanted, steps):
            by_slot.setdefault(row["slot"], []).append(row)
        for slot, key in enumerate(slots):
            for b in open_brackets[key]:
                brackets[(b.feature, b.rank)] = _narrow(by_slot[slot], b)

    out: dict[str, list[float | None]] = {}
    for name in names:
        total = totals[name]
        out[name] = []
        for p in probs:
            if not total:
                out[name].append(None)
                continue
            position = p * (total - 1)
            low, high = found[(name, math.floor(position))], found[(name, math.ceil(position))]
            share = position - math.floor(position) if interpolate else 0.0
            out[name].append(low + (high - low) * share)
    return out


def wide_group_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median of an integer column for groups too large for one aggregation buffer.

    Two rounds of bucket counts per group (log, then 65,536 linear steps inside the bucket
    that holds the middle ranks) leave a short list of values per group. Bucket counts are
    combined map-side, so a group holding a third of all rows is still spread evenly.
    """
    rows = df.select(*keys, F.col(value).cast("bigint").alias("_v")).filter(F.col("_v").isNotNull())
    coded = rows.withColumn("_c1", F.floor(F.signum("_v") * F.log1p(F.abs("_v").cast("double")) * 256).cast("int"))

    def located(hist: DataFrame, within: list[str], code: str, base: Column) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(code)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        return hist.withColumn("_below", base + F.coalesce(F.sum("_n").over(before), F.lit(0)))

    def counted(frame: DataFrame, by: list[str], *more: Column) -> DataFrame:
        return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *more)

    bounds = (F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    first = located(counted(coded, keys + ["_c1"], *bounds), keys, "_c1", F.lit(0))
    first = first.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    low_rank, high_rank = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
    holds = (
        ((F.col("_below") <= low_rank) & (low_rank < F.col("_below") + F.col("_n")))
        | ((F.col("_below") <= high_rank) & (high_rank < F.col("_below") + F.col("_n")))
    )
    bracket1 = first.filter(holds).select(*keys, "_c1", "_lo", "_hi", "_total", F.col("_below").alias("_base1"))

    inside1 = coded.join(bracket1, keys + ["_c1"]).withColumn(
        "_c2",
        F.floor((F.col("_v") - F.col("_lo")).cast("double")
                / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)).cast("double") * LINEAR_BUCKETS).cast("int"),
    )
    second = counted(inside1, keys + ["_c1", "_c2"], F.first("_total").alias("_total"), F.first("_base1").alias("_base1"))
    second = located(second, keys + ["_c1"], "_c2", F.col("_base1"))
    bracket2 = second.filter(holds).select(*keys, "_c1", "_c2", F.col("_below").alias("_base2"))

    inside2 = inside1.join(bracket2, keys + ["_c1", "_c2"])
    third = counted(inside2, keys + ["_c1", "_c2", "_v"], F.first("_total").alias("_total"), F.first("_base2").alias("_base2"))
    third = located(third, keys + ["_c1", "_c2"], "_v", F.col("_base2"))
    at_low = (F.col("_below") <= low_rank) & (low_rank < F.col("_below") + F.col("_n"))
    at_high = (F.col("_below") <= high_rank) & (high_rank < F.col("_below") + F.col("_n"))
    return third.filter(holds).groupBy(*keys).agg(
        ((F.max(F.when(at_low, F.col("_v"))) + F.max(F.when(at_high, F.col("_v")))).cast("double") / 2).alias(name)
    )
