"""Packets to bidirectional flows.

A flow is a canonical 5-tuple cut wherever it stays silent for longer than the timeout.
Ordering all packets of one 5-tuple in one task fails as soon as one conversation dominates
the capture, so packets are ordered inside short time cells instead:

* a cell is (5-tuple, time div cell width) with a width no larger than the timeout, so a
  timeout can only fall between cells, never inside one;
* cell edges (first and last time, counts) are combined map-side and are few; the running
  subflow number and the last time before each cell are windows over cells, not packets;
* packets get their own ``lag`` within the cell and take the value across the cell edge from
  the cell table, joined on the same key the packets are already partitioned by.

Aggregates then combine map-side per flow, so a busy flow is spread over many tasks all along.

The flow table does this only for 5-tuples too busy for one task (``FlowOptions.wide_flow_packets``).
The packets of all others move once: ordered, cut, ranked and summed in the partition of their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowquarry import fixed
from flowquarry.functions import columns as C
from flowquarry.operators.quantiles import wide_group_median
from flowquarry.options import FlowOptions
from flowquarry.session import store_scratch

KEY = ["Canonical_IP1", "Canonical_IP2", "Canonical_Port1", "Canonical_Port2", "Protocol"]
FLOW = KEY + ["Subflow_ID"]
MIN_DURATION = 0.000001
RATIO_EPSILON = 1e-6


def canonical_key(packets: DataFrame, order_ports_on_equal_ip: bool = False) -> DataFrame:
    """Smaller address first, ports follow. ``Is_Forward`` is 1 when the source is the first address.

    With equal addresses the published flow table leaves ports as they are, the directional
    one orders them; ``order_ports_on_equal_ip`` selects the second.
    """
    source, target = F.col("Source"), F.col("Destination")
    forward = source <= target
    if order_ports_on_equal_ip:
        forward = (source < target) | ((source == target) & (F.col("Source_Port") <= F.col("Destination_Port")))
    # Keys that cannot be NULL: otherwise the join on them adds IS NOT NULL filters, which are
    # pushed to the scan with the whole port-parsing expression inlined and evaluated again.
    unknown, no_port = F.lit("UNKNOWN"), F.lit(-1)
    return packets.withColumns({
        "Canonical_IP1": F.coalesce(F.when(forward, source).otherwise(target), unknown),
        "Canonical_IP2": F.coalesce(F.when(forward, target).otherwise(source), unknown),
        "Canonical_Port1": F.coalesce(F.when(forward, F.col("Source_Port")).otherwise(F.col("Destination_Port")), no_port),
        "Canonical_Port2": F.coalesce(F.when(forward, F.col("Destination_Port")).otherwise(F.col("Source_Port")), no_port),
        "Protocol": F.coalesce(F.col("Protocol"), unknown),
        "Is_Forward": F.coalesce(forward.cast("int"), F.lit(0)),
    })


def flow_id() -> Column:
    return F.concat_ws("_", *[F.col(c) for c in KEY], F.concat(F.lit("F"), F.col("Subflow_ID")))


def _packet_order(packets: DataFrame) -> list[Column]:
    return [F.col("Time_ns"), F.col("Frame_Number")] if "Frame_Number" in packets.columns else [F.col("Time_ns")]


def _timeout_ns(options: FlowOptions) -> int:
    if options.timeout_seconds <= 0:
        raise ValueError("the flow timeout must be positive")
    return round(options.timeout_seconds * C.NANOS)


def _in_cells(keyed: DataFrame, options: FlowOptions) -> tuple[DataFrame, int]:
    timeout = _timeout_ns(options)
    width = min(round(options.cell_seconds * C.NANOS), timeout)
    start = F.col("Time_ns") - F.pmod(F.col("Time_ns"), F.lit(width).cast("bigint"))
    return keyed.withColumn("_cell", F.coalesce(start, F.lit(-1).cast("bigint"))), timeout


def _cell_table(cells: DataFrame, timeout: int, directional: bool) -> DataFrame:
    """One row per cell: subflow number, last time before the cell, packets in the whole flow."""
    edges = [F.min("Time_ns").alias("_start"), F.max("Time_ns").alias("_end"), F.count(F.lit(1)).alias("_n")]
    if directional:
        edges += [F.max(F.when(F.col("Is_Forward") == d, F.col("Time_ns"))).alias(f"_end{d}") for d in (1, 0)]
    table = cells.groupBy(*KEY, "_cell").agg(*edges)
    order = Window.partitionBy(*KEY).orderBy("_cell")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_prev_end", F.lag("_end").over(order))
    if directional:
        for d in (1, 0):
            table = table.withColumn(f"_prev_end{d}", F.last(f"_end{d}", ignorenulls=True).over(before))
    gap = F.coalesce(F.col("_start") - F.col("_prev_end"), F.lit(0))
    table = table.withColumn("_split", (gap > timeout).cast("int"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = table.withColumn("Subflow_ID", F.coalesce(F.sum("_split").over(running).cast("int"), F.lit(0)))
    return table.withColumn("_flow_packets", F.sum("_n").over(Window.partitionBy(*FLOW))).drop("_start", "_end", "_end0", "_end1", "_n")


def trace_packets(packets: DataFrame, options: FlowOptions = FlowOptions(), keep_gap: bool = False,
                  directional: bool = False, order_ports_on_equal_ip: bool = False) -> DataFrame:
    """Every packet with its subflow number and inter-arrival time in nanoseconds.

    ``IAT_ns`` is 0 on the first packet of a flow. With ``keep_gap`` only the first packet of
    the 5-tuple gets 0 and the first packet of a later subflow keeps the silent gap.
    ``directional`` adds ``Dir_IAT_ns``, the same measured within one direction of the 5-tuple.
    """
    return _trace_in_cells(canonical_key(packets, order_ports_on_equal_ip), options, keep_gap, directional)


def _trace_in_cells(keyed: DataFrame, options: FlowOptions, keep_gap: bool = False, directional: bool = False) -> DataFrame:
    cells, timeout = _in_cells(keyed, options)
    table = _cell_table(cells, timeout, directional)
    order = _packet_order(keyed)
    in_cell = Window.partitionBy(*KEY, "_cell").orderBy(*order)
    rows = cells.withColumn("_lag", F.lag("Time_ns").over(in_cell))
    if directional:
        same = Window.partitionBy(*KEY, "_cell", "Is_Forward").orderBy(*order)
        rows = rows.withColumn("_dir_lag", F.lag("Time_ns").over(same))
    joined = rows.join(table, KEY + ["_cell"])
    across = F.col("_prev_end") if keep_gap else F.when(F.col("_split") == 0, F.col("_prev_end"))
    opens = F.col("_lag").isNull() & (F.col("_prev_end").isNull() | (F.col("_split") == 1))
    out = joined.withColumns({
        "IAT_ns": F.coalesce(F.col("Time_ns") - F.coalesce(F.col("_lag"), across), F.lit(0)), "_opens_flow": opens,
    })
    if directional:
        earlier = F.coalesce(F.col("_dir_lag"), F.when(F.col("Is_Forward") == 1, F.col("_prev_end1")).otherwise(F.col("_prev_end0")))
        out = out.withColumn("Dir_IAT_ns", F.coalesce(F.col("Time_ns") - earlier, F.lit(0)))
    return out.drop("_lag", "_dir_lag", "_prev_end", "_prev_end0", "_prev_end1", "_split", "_cell")


def packets_with_flow_id(packets: DataFrame, options: FlowOptions = FlowOptions()) -> DataFrame:
    """The packet table with ``FlowID``, for tracing flows back to their packets."""
    traced = trace_packets(packets, options).withColumns({"FlowID": flow_id(), "Flow_IAT": C.seconds(F.col("IAT_ns"))})
    return traced.drop("_flow_packets", "_opens_flow", "IAT_ns", *KEY[:4])


def _of_first_packet(name: str) -> Column:
    """Value of the packet that opens the flow. A plain maximum keeps the aggregate on fixed-width
    buffers, where ``min_by`` over a struct would need a sort."""
    return F.max(F.when(F.col("_opens_flow"), F.col(name)))


def _above(keyed: DataFrame, by: list[str], packets: int) -> DataFrame:
    """The groups with more packets than that, as a stored table."""
    counts = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return store_scratch(counts.filter(F.col("_n") > packets).select(*by), "busy")


def flow37(packets: DataFrame, options: FlowOptions = FlowOptions()) -> DataFrame:
    """The 37-column flow table, times in seconds.

    ``packets`` needs ``Time_ns, Frame_Number, Source, Destination, Source_Port,
    Destination_Port, Protocol, Length`` and the eight flag columns.
    """
    order = [c for c in ("Time_ns", "Frame_Number") if c in packets.columns]
    keyed = canonical_key(packets).select(*KEY, *order, "Is_Forward", "Length", *[f"Flag_{f}" for f in fixed.TCP_FLAGS])
    # No 5-tuple has more packets than its two addresses, and those are counted without reading ports or flags.
    pairs = _above(keyed, KEY[:2], options.wide_flow_packets)
    if pairs.isEmpty():
        return _finish37(_plain_flows(keyed, options))
    keyed = store_scratch(keyed, "keyed")  # read several times from here on
    busy = _above(keyed.join(pairs, KEY[:2], "left_semi"), KEY, options.wide_flow_packets)
    if busy.isEmpty():
        return _finish37(_plain_flows(keyed, options))
    plain = _plain_flows(keyed.join(busy, KEY, "left_anti"), options)
    return _finish37(plain.unionByName(_busy_flows(keyed.join(busy, KEY, "left_semi"), options)))


def _plain_flows(keyed: DataFrame, options: FlowOptions) -> DataFrame:
    """Flows of 5-tuples that one task can order: a single shuffle, everything else within the partition of the key.

    Medians come from ranks, sorted like everything else; ``median`` would keep a map of values for every flow. A hash ahead
    of the key settles most comparisons of the sorts, as addresses begin alike.
    """
    timeout = _timeout_ns(options)
    order = Window.partitionBy("_hash", *KEY).orderBy(*_packet_order(keyed))
    rows = keyed.withColumn("_hash", F.xxhash64(*KEY)).withColumn("_lag", F.lag("Time_ns").over(order))
    gap = F.coalesce(F.col("Time_ns") - F.col("_lag"), F.lit(0))
    rows = rows.withColumn("_split", (gap > timeout).cast("int"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "Subflow_ID": F.sum("_split").over(running).cast("int"),
        "IAT_ns": F.when(F.col("_split") == 0, gap).otherwise(F.lit(0)),
        "_opens_flow": F.col("_lag").isNull() | (F.col("_split") == 1),
    }).drop("_lag", "_split", "Frame_Number")
    for name in ("Length", "IAT_ns"):
        rows = _with_middle(rows, name)
    return _flow_sums(rows, options, F.avg("_middle_Length"), F.avg("_middle_IAT_ns"), ["_hash", *FLOW]).drop("_hash")


def _with_middle(rows: DataFrame, name: str) -> DataFrame:
    """``_middle_<name>``: the value on the one or two rows of a flow that hold its middle ranks, else NULL."""
    order = Window.partitionBy("_hash", *FLOW).orderBy(F.asc_nulls_last(name))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank, n = F.col("_rank"), F.col("_values")
    ranked = rows.withColumns({"_rank": F.row_number().over(order), "_values": F.count(name).over(whole)})
    middle = (rank == F.floor((n + 1) / 2)) | (rank == F.floor(n / 2) + 1)
    return ranked.withColumn(f"_middle_{name}", F.when(middle, F.col(name))).drop("_rank", "_values")


def _busy_flows(keyed: DataFrame, options: FlowOptions) -> DataFrame:
    """Flows of 5-tuples that are ordered in cells, by many tasks."""
    needed = [*FLOW, "IAT_ns", "_flow_packets", "_opens_flow", "Is_Forward", "Time_ns", "Length", *[f"Flag_{f}" for f in fixed.TCP_FLAGS]]
    # written once: the flow aggregate reads it all, the median of wide flows only what the statistics of the files let through
    traced = store_scratch(_trace_in_cells(keyed, options).select(*needed), "traced")
    wide = F.col("_flow_packets") > options.wide_flow_packets
    # at most 65,535 distinct lengths per flow
    base = _flow_sums(traced, options, F.median("Length"), F.median(F.when(~wide, F.col("IAT_ns"))))
    widest = wide_group_median(traced.filter(wide), FLOW, "IAT_ns", "_wide_median")
    return base.join(widest, FLOW, "left").withColumn("_iat_median", F.coalesce(F.col("_wide_median"), F.col("_iat_median"))).drop("_wide_median")


def _flow_sums(traced: DataFrame, options: FlowOptions, length_median: Column, iat_median: Column, by: list[str] = FLOW) -> DataFrame:
    iat = C.seconds(F.col("IAT_ns"))
    return traced.groupBy(*by).agg(
        _of_first_packet("Is_Forward").alias("_first_forward"),
        F.min("Time_ns").alias("_start"),
        F.max("Time_ns").alias("_end"),
        F.count(F.lit(1)).alias("Total_Packets"),
        F.sum(F.col("Length").cast("bigint")).alias("Total_Bytes"),
        length_median.alias("Median_Packet_Length"),
        F.min("Length").alias("Min_Packet_Length"),
        F.max("Length").alias("Max_Packet_Length"),
        F.coalesce(F.var_samp("Length"), F.lit(0.0)).alias("Packet_Length_Var"),
        F.coalesce(F.stddev_samp("Length"), F.lit(0.0)).alias("Packet_Length_Std"),
        iat_median.alias("_iat_median"),
        F.sum("IAT_ns").alias("_iat_sum"),
        F.min("IAT_ns").alias("_iat_min"),
        F.max("IAT_ns").alias("_iat_max"),
        F.coalesce(F.stddev_samp(iat), F.lit(0.0)).alias("Std_IAT"),
        F.sum(F.when(F.col("IAT_ns") >= round(options.idle_seconds * C.NANOS), F.col("IAT_ns")).otherwise(0)).alias("_idle"),
        F.sum("Is_Forward").alias("Forward_Packets"),
        *[F.sum(f"Flag_{f}").alias(f"{f}_Count") for f in fixed.TCP_FLAGS],
    )


def _finish37(base: DataFrame) -> DataFrame:
    forward = F.col("_first_forward") == 1
    packets = F.col("Total_Packets")
    duration = F.greatest(F.lit(MIN_DURATION), C.seconds(F.col("_end") - F.col("_start")))
    idle = C.seconds(F.col("_idle"))
    named = base.withColumns({
        "FlowID": flow_id(),
        "Source_IP": F.when(forward, F.col("Canonical_IP1")).otherwise(F.col("Canonical_IP2")),
        "Destination_IP": F.when(forward, F.col("Canonical_IP2")).otherwise(F.col("Canonical_IP1")),
        "Source_Port": F.when(forward, F.col("Canonical_Port1")).otherwise(F.col("Canonical_Port2")),
        "Destination_Port": F.when(forward, F.col("Canonical_Port2")).otherwise(F.col("Canonical_Port1")),
        "Flow_Duration": duration,
        "Backward_Packets": packets - F.col("Forward_Packets"),
        "Avg_Packet_Length": F.col("Total_Bytes") / packets,
        "Mean_IAT": F.col("_iat_sum") / packets / float(C.NANOS),
        "Median_IAT": F.col("_iat_median") / float(C.NANOS),
        "Min_IAT": C.seconds(F.col("_iat_min")),
        "Max_IAT": C.seconds(F.col("_iat_max")),
        "Flow_Idle_Time": idle,
        "SYN_ACK_Ratio": F.col("SYN_Count") / (F.col("ACK_Count") + RATIO_EPSILON),
        "FIN_ACK_Ratio": F.col("FIN_Count") / (F.col("ACK_Count") + RATIO_EPSILON),
        "RST_Ratio": F.col("RST_Count") / (packets + RATIO_EPSILON),
    })
    rated = named.withColumns({
        "Packets_Per_Second": packets / F.col("Flow_Duration"),
        "Bytes_Per_Second": F.col("Total_Bytes") / F.col("Flow_Duration"),
        "Flow_Active_Time": F.greatest(F.lit(0.0), F.col("Flow_Duration") - F.col("Flow_Idle_Time")),
    })
    return rated.select(*fixed.FLOW37_COLUMNS)


def idle_times(traced: DataFrame, idle_seconds: float = 1.0) -> DataFrame:
    """Sum of long gaps per flow, for flows that have any (``traced`` has FlowID and Flow_IAT)."""
    return traced.filter(F.col("Flow_IAT") >= idle_seconds).groupBy("FlowID").agg(
        (F.sum(F.round(F.col("Flow_IAT") * C.NANOS).cast("bigint")) / float(C.NANOS)).alias("Flow_Idle_Time")
    )


def directional_lengths(packets: DataFrame) -> DataFrame:
    return packets.withColumns({
        "Fwd_Len": F.when(F.col("Is_Forward") == 1, F.col("Length")),
        "Bwd_Len": F.when(F.col("Is_Forward") == 0, F.col("Length")),
    })


def trace_directional(packets: DataFrame, options: FlowOptions = FlowOptions()) -> DataFrame:
    """Packets with the microsecond times and directional lengths the 32-feature table is built from."""
    traced = directional_lengths(trace_packets(
        packets, options, keep_gap=True, directional=True, order_ports_on_equal_ip=True
    ))
    micros = F.col("Dir_IAT_ns") / 1000.0
    return traced.withColumns({
        "Flow_IAT_us": F.col("IAT_ns") / 1000.0,
        "Fwd_IAT_us": F.when(F.col("Is_Forward") == 1, micros),
        "Bwd_IAT_us": F.when(F.col("Is_Forward") == 0, micros),
    })


def flow32(packets: DataFrame, options: FlowOptions = FlowOptions()) -> DataFrame:
    """The 32 directional features, times in microseconds, plus ids. One packet shuffle, no medians."""
    traced = trace_directional(packets, options)

    def spread(col: str) -> Column:
        return F.coalesce(F.stddev_samp(col), F.lit(0.0))

    def mean_us(nanos: Column) -> Column:
        total = F.sum(nanos).cast("double") / F.count(nanos).cast("double") / 1000.0
        return F.coalesce(F.when(F.count(nanos) > 0, total), F.lit(0.0))

    def zero(col: Column) -> Column:
        return F.coalesce(col.cast("double"), F.lit(0.0))

    forward, backward = F.col("Is_Forward") == 1, F.col("Is_Forward") == 0
    fwd_ns, bwd_ns = F.when(forward, F.col("Dir_IAT_ns")), F.when(backward, F.col("Dir_IAT_ns"))
    base = traced.groupBy(*FLOW).agg(
        _of_first_packet("Is_Forward").alias("_first_forward"),
        F.min("Time_ns").alias("_start"), F.max("Time_ns").alias("_end"),
        F.sum("Is_Forward").alias("_fwd"), F.count(F.lit(1)).alias("_all"),
        F.sum(F.col("Length").cast("bigint")).alias("_bytes"),
        zero(F.sum(F.col("Fwd_Len").cast("bigint"))).alias("Total Length of Fwd Packets"),
        zero(F.sum(F.col("Bwd_Len").cast("bigint"))).alias("Total Length of Bwd Packets"),
        zero(F.max("Fwd_Len")).alias("Fwd Packet Length Max"), zero(F.min("Fwd_Len")).alias("Fwd Packet Length Min"),
        spread("Fwd_Len").alias("Fwd Packet Length Std"),
        zero(F.max("Bwd_Len")).alias("Bwd Packet Length Max"), zero(F.min("Bwd_Len")).alias("Bwd Packet Length Min"),
        spread("Bwd_Len").alias("Bwd Packet Length Std"),
        mean_us(F.col("IAT_ns")).alias("Flow IAT Mean"), spread("Flow_IAT_us").alias("Flow IAT Std"),
        zero(F.max("Flow_IAT_us")).alias("Flow IAT Max"), zero(F.min("Flow_IAT_us")).alias("Flow IAT Min"),
        mean_us(fwd_ns).alias("Fwd IAT Mean"), spread("Fwd_IAT_us").alias("Fwd IAT Std"),
        zero(F.min("Fwd_IAT_us")).alias("Fwd IAT Min"),
        mean_us(bwd_ns).alias("Bwd IAT Mean"), spread("Bwd_IAT_us").alias("Bwd IAT Std"),
        zero(F.min("Bwd_IAT_us")).alias("Bwd IAT Min"),
        zero(F.min("Length")).alias("Min Packet Length"), zero(F.max("Length")).alias("Max Packet Length"),
        spread("Length").alias("Packet Length Std"),
        F.coalesce(F.var_samp("Length"), F.lit(0.0)).alias("Packet Length Variance"),
        *[F.sum(f"Flag_{f}").cast("double").alias(f"{f} Flag Count") for f in ("FIN", "PSH", "ACK")],
    )
    first = F.col("_first_forward") == 1
    duration_us = (F.col("_end") - F.col("_start")) / 1000.0
    dur = F.greatest(C.seconds(F.col("_end") - F.col("_start")), F.lit(MIN_DURATION))
    backward_n = F.col("_all") - F.col("_fwd")
    full = base.withColumns({
        "Flow_ID": flow_id(),
        "Source_IP": F.when(first, F.col("Canonical_IP1")).otherwise(F.col("Canonical_IP2")),
        "Destination_IP": F.when(first, F.col("Canonical_IP2")).otherwise(F.col("Canonical_IP1")),
        "Flow Duration": duration_us,
        "Total Fwd Packets": F.col("_fwd").cast("double"),
        "Total Backward Packets": backward_n.cast("double"),
        "Flow Bytes/s": F.col("_bytes") / dur, "Flow Packets/s": F.col("_all") / dur,
        "Fwd Packets/s": F.col("_fwd") / dur, "Bwd Packets/s": backward_n / dur,
    })
    return full.select("Flow_ID", "Source_IP", "Destination_IP", "Protocol", *[F.col(f"`{c}`") for c in fixed.FLOW32_FEATURES])
