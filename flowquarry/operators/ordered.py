"""Whole-table ordered operators without a single-task window.

A window without a partition key sorts the whole table in one task. Here rows are range
partitioned by the order, numbered within their partition, and the partition sizes (one row
per partition) turn that into a dense row number. Equal blocks of row numbers then serve as
window partitions; a block borrows the last rows of its predecessor as a halo, and running
sums get the totals of the earlier blocks added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowquarry.functions import columns as C
from flowquarry.session import cut_lineage

BLOCK_ROWS = 1_000_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def numbered(df: DataFrame, order: list[Column], name: str = "_rn") -> DataFrame:
    """Dense row number 1..n over the whole table.

    The range-partitioned rows are checkpointed, so that the partition sizes and the rows
    come from the same partitioning even when an executor is lost in between.
    """
    spread = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the range shuffle: small by construction.
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return spread.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + in_part + 1
    ).drop("_mid", "_part", "_offset")


def _block(name: str, block_rows: int) -> Column:
    return F.floor((F.col(name) - 1) / block_rows).cast("bigint")


def _earlier_blocks(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier blocks; one row per block."""
    totals = rows.groupBy("_block").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running sums in the given order, this row included."""
    rows = numbered(df, order).withColumn("_block", _block("_rn", block_rows))
    earlier = _earlier_blocks(rows, {f"_e_{n}": c for n, c in sums.items()})
    inside = Window.partitionBy("_block").orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({f"_l_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    full = local.join(earlier, "_block").withColumns({n: F.col(f"_e_{n}") + F.col(f"_l_{n}") for n in sums})
    return full.drop("_block", "_rn", *[f"_e_{n}" for n in sums], *[f"_l_{n}" for n in sums])


def capture_features(packets: DataFrame, rolling_rows: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inter-arrival time over the whole capture, running and rolling length and rate columns."""
    order = [F.col("Time_ns"), F.col("Frame_Number")]
    if block_rows <= rolling_rows:
        raise ValueError("a block must be longer than the rolling window")
    rows = numbered(packets, order).withColumn("_block", _block("_rn", block_rows))
    earlier = _earlier_blocks(rows, {"_bytes_before": F.col("Length").cast("bigint")})

    # The last rows of a block also go to the next block as its halo.
    place = F.pmod(F.col("_rn") - 1, F.lit(block_rows))
    targets = F.when(place >= block_rows - rolling_rows, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array(F.col("_block")))
    spread = rows.withColumn("_home", F.col("_block")).withColumn("_block", F.explode(targets))
    own = F.col("_home") == F.col("_block")

    order_in = Window.partitionBy("_block").orderBy("_rn")
    rolling = order_in.rowsBetween(-(rolling_rows - 1), 0)
    so_far = order_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.greatest(F.lit(0), F.coalesce(F.col("Time_ns") - F.lag("Time_ns").over(order_in), F.lit(0)))
    step = spread.withColumn("IAT", C.seconds(gap)).withColumn("_safe", F.when(F.col("IAT") == 0, 0.000001).otherwise(F.col("IAT")))
    step = step.withColumns({
        "Instant_Packet_Rate": F.lit(1.0) / F.col("_safe"),
        "Instant_Bytes_Per_Sec": F.col("Length") / F.col("_safe"),
    }).withColumns({
        "Moving_Avg_Length": F.avg("Length").over(rolling),
        "Rolling_Std_Length": F.coalesce(F.stddev_samp("Length").over(rolling), F.lit(0.0)),
        "Rolling_Packet_Rate": F.avg("Instant_Packet_Rate").over(rolling),
        "Rolling_Bytes_Per_Sec": F.avg("Instant_Bytes_Per_Sec").over(rolling),
        "_bytes_here": F.sum(F.when(own, F.col("Length").cast("bigint")).otherwise(0)).over(so_far),
    })
    out = step.filter(own).join(earlier, "_block").withColumn(
        "Running_Avg_Length", (F.col("_bytes_before") + F.col("_bytes_here")) / F.col("_rn")
    )
    return out.drop("_block", "_home", "_safe", "_bytes_before", "_bytes_here", "_rn")
