"""Rule-based tags and categories for anomalous flows, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowquarry.functions import columns as C
from flowquarry.operators.quantiles import percentile_row
from flowquarry.operators.selection import attach_verdicts, top_flows
from flowquarry.operators.statistics import long_view, population_thresholds, top_values


def consensus_anomalies(flows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Flows the models agree on. Without verdicts the result is empty but keeps its schema."""
    joined = attach_verdicts(flows, verdicts)
    if "Consensus_Anomaly" not in joined.columns:
        return joined.withColumn("Consensus_Anomaly", F.lit(None).cast("int")).limit(0)
    return joined.filter(F.col("Consensus_Anomaly") == -1)


def behaviours(limits: dict[str, float]) -> Column:
    """Array of observed behaviour tags, in rule order."""
    proto, dst = F.upper("Protocol"), F.col("Destination_IP")
    pps, bps = F.col("Packets_Per_Second"), F.col("Bytes_Per_Second")
    packets, size = F.col("Total_Packets"), F.col("Total_Bytes")
    syn, rst = F.col("SYN_Count"), F.col("RST_Count")
    tcp = proto == "TCP"
    busy = pps > 10.0

    def tag(rule: Column, name: str) -> Column:
        return F.when(rule, F.lit(name))

    # One branch per protocol; a branch that matches without its inner test gives no tag.
    by_protocol = (
        F.when(proto == "ARP", tag((packets >= 5) | busy, "excessive_arp_activity"))
        .when((proto == "MDNS") | dst.isin("224.0.0.251", "ff02::fb"), tag((packets >= 10) | busy, "excessive_mdns_multicast_activity"))
        .when(proto == "DNS", tag((packets >= 5) | busy | (size > 2000), "dns_query_bursts"))
        .when(proto.isin("UDP", "QUIC"), tag((size >= limits["bytes_95th"]) | (packets >= limits["pkts_95th"]), "high_volume_udp_quic_traffic"))
        .when(proto.isin("SSLV2", "SSL"), F.lit("legacy_protocol_usage"))
    )
    multicast = dst.startswith("224.") | dst.startswith("239.") | dst.startswith("ff0")
    by_target = F.when(
        dst.isin("Broadcast", "255.255.255.255") | dst.endswith(".255"), F.lit("unusual_broadcast_traffic")
    ).when(multicast & (proto != "MDNS"), F.lit("unusual_multicast_traffic"))
    found = F.array_compact(F.array(
        tag((pps >= limits["pps_95th"]) & (packets > 1) & (F.col("Flow_Duration") > 0.001), "unusually_high_packet_rate"),
        tag((bps >= limits["bps_95th"]) | (size >= limits["bytes_95th"]), "unusually_high_byte_rate"),
        tag((packets > 2) & (F.col("Mean_IAT") > 0) & (F.col("Mean_IAT") <= limits["iat_5th"]), "extremely_short_iat"),
        tag(tcp & (syn > 0) & ((F.col("SYN_ACK_Ratio") >= 2.0) | (syn >= 5) | (F.col("ACK_Count") == 0)), "syn_heavy_tcp_behaviour"),
        tag(tcp & ((rst >= 2) | (F.col("RST_Ratio") >= 0.25)), "excessive_rst_behaviour"),
        by_protocol,
        by_target,
    ))
    return F.when(F.size(found) == 0, F.array(F.lit("statistically_unusual_feature_profile"))).otherwise(found)


def category(tags: Column) -> Column:
    """Possible category from the tags, first rule that matches."""
    proto = F.upper("Protocol")
    packets, size = F.col("Total_Packets"), F.col("Total_Bytes")

    def has(name: str) -> Column:
        return F.array_contains(tags, name)

    return (
        F.when(has("legacy_protocol_usage") | proto.isin("SSLV2", "SSL"), "Legacy protocol anomaly")
        .when((proto == "ARP") | has("excessive_arp_activity"),
              F.when(has("unusual_broadcast_traffic") | (packets >= 20), "Possible ARP spoofing/broadcast storm pattern").otherwise("ARP anomaly"))
        .when(has("syn_heavy_tcp_behaviour"),
              F.when((F.col("SYN_Count") > 0) & (F.col("ACK_Count") == 0) & (packets <= 5), "Possible port scanning pattern").otherwise("Possible SYN flood pattern"))
        .when((proto == "DNS") | has("dns_query_bursts"),
              F.when((size > 5000) | has("unusually_high_byte_rate"), "Possible DNS tunneling pattern").otherwise("DNS anomaly"))
        .when((proto == "MDNS") | has("excessive_mdns_multicast_activity"), "mDNS anomaly")
        .when(proto.isin("UDP", "QUIC") | has("high_volume_udp_quic_traffic"), "Suspicious high-volume UDP/QUIC behaviour")
        .when(has("excessive_rst_behaviour") | ((proto == "TCP") & (has("unusually_high_packet_rate") | has("extremely_short_iat"))), "TCP anomaly")
        .when(has("unusual_broadcast_traffic") | has("unusual_multicast_traffic"), "Unusual broadcast/multicast anomaly")
        .when(has("unusually_high_packet_rate") | has("unusually_high_byte_rate"), "High-volume traffic anomaly")
        .otherwise("Unclassified anomaly")
    )


def investigate(flows: DataFrame, verdicts: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Anomalous flows with tags and category. Thresholds come from all flows, not only the anomalous."""
    limits = limits or population_thresholds(flows)
    tagged = consensus_anomalies(flows, verdicts).withColumn("observed_behaviours", behaviours(limits))
    return tagged.withColumns({
        "behaviours_str": F.array_join("observed_behaviours", ", "),
        "possible_category": category(F.col("observed_behaviours")),
    })


def tag_frequency(investigated: DataFrame) -> DataFrame:
    return investigated.select(F.explode("observed_behaviours").alias("behaviour")).groupBy("behaviour").agg(F.count(F.lit(1)).alias("flows"))


def by_protocol(investigated: DataFrame) -> DataFrame:
    return investigated.groupBy("Protocol").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("Total_Packets").alias("packets"), F.sum("Total_Bytes").alias("bytes")
    )


def investigation_summary(investigated: DataFrame) -> dict[str, DataFrame]:
    """Named tables instead of one nested driver-side dictionary."""
    return {
        "total": investigated.agg(F.count(F.lit(1)).alias("total_consensus_anomalous_flows")),
        "by_protocol": by_protocol(investigated),
        "top_source_ips": top_values(investigated, "Source_IP", name="flows"),
        "top_destination_ips": top_values(investigated, "Destination_IP", name="flows"),
        "top_source_ports": top_values(investigated, "Source_Port", positive_only=True, name="flows"),
        "top_destination_ports": top_values(investigated, "Destination_Port", positive_only=True, name="flows"),
        "behaviours": tag_frequency(investigated),
        "categories": investigated.groupBy("possible_category").agg(F.count(F.lit(1)).alias("flows")),
        "top_by_packets": top_flows(investigated, "Total_Packets"),
        "top_by_bytes": top_flows(investigated, "Total_Bytes"),
        "top_by_packet_rate": top_flows(investigated, "Packets_Per_Second"),
        "top_by_byte_rate": top_flows(investigated, "Bytes_Per_Second"),
    }


def explain(flows: DataFrame, features: list[str], benign: Column, top: int = 3, name: str = "Explanation") -> DataFrame:
    """The features furthest from the benign median, in benign IQR units."""
    fits = percentile_row(flows.filter(benign), {c: C.finite(F.col(f"`{c}`")) for c in features}, [0.25, 0.5, 0.75])
    scores = []
    for c in features:
        q1, mid, q3 = fits[c]
        if mid is None or q3 == q1:
            continue
        z = F.abs(C.finite(F.col(f"`{c}`")) - mid) / (q3 - q1)
        scores.append(F.struct((-F.round(z, 6)).alias("rank"), F.lit(c).alias("feature")))
    if not scores:
        return flows.withColumn(name, F.lit(""))
    ordered = F.slice(F.array_sort(F.filter(F.array(*scores), lambda s: s["rank"].isNotNull())), 1, top)
    return flows.withColumn(name, F.array_join(F.transform(ordered, lambda s: s["feature"]), ", "))
