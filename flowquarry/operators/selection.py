"""Joins, unions, samples and top-n selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowquarry import fixed


def union_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def attach_verdicts(flows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left join on FlowID with only the columns flows do not have yet."""
    new = [c for c in verdicts.columns if c == "FlowID" or c not in flows.columns]
    return flows.join(verdicts.select(*new), "FlowID", "left")


def attach_idle(flows: DataFrame, idle: DataFrame) -> DataFrame:
    """Join form of the idle time: flows without a long gap get 0."""
    return flows.drop("Flow_Idle_Time").join(idle, "FlowID", "left").withColumn(
        "Flow_Idle_Time", F.coalesce("Flow_Idle_Time", F.lit(0.0))
    )


def packets_of_flow(packets: DataFrame, flow_id: str) -> DataFrame:
    return packets.filter(F.col("FlowID") == flow_id)


def packets_of_flows(packets: DataFrame, ids: DataFrame) -> DataFrame:
    """Left-semi join. No broadcast hint: the id list grows with the data, adaptive execution sees its size."""
    return packets.join(ids.select("FlowID"), "FlowID", "left_semi")


def hash_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (all when fewer), the same ones on every run and any partitioning.

    The rows of least hash, by a threshold found from bucket counts (65,536 at most a pass); only the bucket that holds
    the threshold is sorted, so the sample stays spread over the tasks of ``df``, which is read a few times.
    """
    key = F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(seed))
    rows, low, missing = df, -(1 << 63), n
    for shift in (48, 32, 16, 0):
        counts = dict(rows.groupBy(F.shiftright(key, shift).alias("b")).count().collect())
        below = 0
        for bucket in sorted(counts):
            if below + counts[bucket] > missing:
                break
            below += counts[bucket]
        else:
            return df if low == -(1 << 63) else df.filter(key < low + (1 << (shift + 16)))
        missing -= below
        low, inside = bucket << shift, counts[bucket]
        rows = df.filter(F.shiftright(key, shift) == bucket)
        if inside <= 4_096:
            break
    if not missing:
        return df.filter(key < low)
    return df.filter(key < low).unionByName(rows.orderBy(key, *[F.col(f"`{k}`") for k in keys]).limit(missing))


def top_flows(flows: DataFrame, metric: str, n: int = 5) -> DataFrame:
    cols = ["FlowID", "Protocol", "Source_IP", "Destination_IP", metric]
    return flows.select(*cols).orderBy(F.desc(metric), F.asc("FlowID")).limit(n)


def _criteria() -> dict[str, tuple[Column, str | None]]:
    """Condition and metric of each criterion; without a metric the first flows by id are taken."""
    def protocol(*names: str) -> Column:
        return F.col("Protocol").isin(*names)

    return {
        "packet_count": (F.lit(True), "Total_Packets"), "byte_count": (F.lit(True), "Total_Bytes"),
        "packet_rate": (F.lit(True), "Packets_Per_Second"), "syn_heavy": (protocol("TCP"), "SYN_Count"),
        "arp": (protocol("ARP"), None), "dns": (protocol("DNS"), None), "mdns": (protocol("MDNS"), None),
        "udp_quic": (protocol("UDP", "QUIC"), None), "sslv2": (protocol("SSLV2"), None),
    }


def top_lists(flows: DataFrame, n: int = 20) -> DataFrame:
    """At most n flows for every criterion, in one scan: ``flows`` with ``criterion``, ``priority`` (its place, from 0) and ``place`` (from 1).

    A flow is copied once for each criterion it meets; the filter on the row number limits every criterion to n rows in each
    partition before the shuffle, so a task of the window gets n rows a partition, whatever the criterion's share. Ties go to
    the smaller FlowID, flows without the metric come last, metrics are compared as doubles, an empty table has no lists. Other columns of these three names
    are replaced.
    """
    flows = flows.drop("criterion", "priority", "place")
    picks = _criteria()
    entries = F.array_compact(F.array(*[
        F.when(condition, F.struct(F.lit(i).alias("i"), (F.col(metric).cast("double") if metric else F.lit(0.0)).alias("score")))
        for i, (condition, metric) in enumerate(picks[c] for c in fixed.REPRESENTATIVE_CATEGORIES)
    ]))
    spread = flows.select("*", F.explode(entries).alias("_e")).select(*flows.columns, F.col("_e.i").alias("priority"), F.col("_e.score").alias("_score"))
    order = Window.partitionBy("priority").orderBy(F.desc("_score"), F.asc("FlowID"))
    names = F.array(*map(F.lit, fixed.REPRESENTATIVE_CATEGORIES))
    return spread.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).withColumn("criterion", F.get(names, F.col("priority"))).drop("_score")


def representative_flows(flows: DataFrame, category: str = "all", n: int = 20) -> DataFrame:
    """At most n flows by one criterion, or the distinct union of all of them.

    The union keeps a flow under the first criterion that takes it and comes in the order of criteria and of places, both
    given as ``priority`` and ``place``.
    """
    category = category.lower()
    if category == "all":
        # At most n rows a criterion from here on.
        first = Window.partitionBy("FlowID").orderBy("priority", "place")
        lists = top_lists(flows, n).withColumn("_first", F.row_number().over(first)).filter("_first = 1")
        return lists.drop("_first", "criterion").orderBy("priority", "place")
    if category in _criteria():
        condition, metric = _criteria()[category]
        order = [F.desc(metric)] if metric else []
        return flows.filter(condition).orderBy(*order, F.asc("FlowID")).limit(n)
    return flows.orderBy("FlowID").limit(n)


def detection_report(scored: DataFrame) -> DataFrame:
    return scored.select(*[c for c in fixed.DETECTION_REPORT_COLUMNS if c in scored.columns])


def listed(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """A list column as ", "-joined text, for CSV."""
    return df.withColumn(name or col, F.array_join(F.col(col), ", "))


def title_case(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))
