"""Queries over flow tables and labelled tables: statistics, selections, investigation, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry import fixed
from flowquarry.catalog import sql as S, views as V
from flowquarry.catalog.book import query, round_to, stored
from flowquarry.catalog.packet_queries import flow_table
from flowquarry.functions import columns as C
from flowquarry.operators import cleaning, evaluation as EV, investigation as INV, ordered, ranking, selection as SEL, statistics as ST

L = V.LABELLED_FEATURES
ATTACK = "CAST(trim(Label) <> 'BENIGN' AS INT)"
FAMILY = ("CASE WHEN {0} = 'BENIGN' THEN 'BENIGN' WHEN contains({0}, 'DoS') THEN 'DoS' WHEN contains({0}, 'DDoS') THEN 'DDoS' "
          "WHEN contains({0}, 'Patator') OR contains({0}, 'Brute Force') THEN 'Brute Force' "
          "WHEN contains({0}, 'Web Attack') OR contains({0}, 'Sql') OR contains({0}, 'XSS') THEN 'Web Attack' "
          "WHEN contains({0}, 'Infiltration') OR contains({0}, 'Infilteration') THEN 'Infiltration' WHEN contains({0}, 'Bot') THEN 'Botnet' "
          "WHEN contains({0}, 'PortScan') THEN 'Port Scan' WHEN contains({0}, 'Heartbleed') THEN 'Heartbleed' ELSE 'Other' END").format("trim(Label)")
ID = "l_orderkey, l_linenumber"


def finite(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


IMPUTED = S.LABELLED + ",\nmedians AS (SELECT " + ", ".join(f"median({finite(c)}) AS m_{c}" for c in L) + " FROM labelled),\nimputed AS (SELECT " + ID + ", " + \
    ", ".join(f"coalesce({finite(c)}, m_{c}, 0.0) AS {c}" for c in L) + ", Label FROM labelled, medians)"


def imputed(spark, d):
    return stored(spark, d, "imputed", lambda: cleaning.impute_median(V.labelled(spark, d), L))


# --- labelled cleaning -----------------------------------------------------------------
@query("c13_duplicate_share", S.with_(S.LABELLED, """
SELECT (SELECT count(*) FROM labelled) AS total_rows, (SELECT count(*) FROM labelled) - count(*) AS duplicate_rows,
       ((SELECT count(*) FROM labelled) - count(*))::DOUBLE * 100 / (SELECT count(*) FROM labelled) AS duplicate_pct
FROM (SELECT DISTINCT f_packets, f_iat, f_header, Label FROM labelled)"""))
def _(spark, d):
    return cleaning.duplicate_count(V.labelled(spark, d), ["f_packets", "f_iat", "f_header", "Label"])


@query("c14_value_audit", S.with_(S.LABELLED, "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS missing_count, count(*) FILTER (WHERE isinf({c})) AS infinite_count FROM labelled" for c in L)))
def _(spark, d):
    return cleaning.value_audit(V.labelled(spark, d), L)


@query("c15_impute_median", S.with_(IMPUTED, f"SELECT {ID}, f_rate, f_header, Label FROM imputed"))
def _(spark, d):
    return cleaning.impute_median(V.labelled(spark, d), L).select(*ID.split(", "), "f_rate", "f_header", "Label")


@query("c16_overflow_to_median", S.with_(S.LABELLED, f"""
SELECT {ID}, CASE WHEN f_header < 0 THEN (SELECT median(f_header) FROM labelled WHERE f_header >= 0) ELSE f_header END AS f_header FROM labelled"""))
def _(spark, d):
    return cleaning.repair_overflow(V.labelled(spark, d), ["f_header"]).select(*ID.split(", "), "f_header")


@query("c17_c20_clip_negative", S.with_(S.LABELLED, f"""
SELECT {ID}, greatest(f_header, 0.0) AS f_header, CASE WHEN l_linenumber = 1 THEN -1 ELSE 8192 END AS Init_Win_bytes_forward FROM labelled"""))
def _(spark, d):
    rows = V.labelled(spark, d).withColumn("Init_Win_bytes_forward", F.when(F.col("l_linenumber") == 1, -1).otherwise(8192))
    return cleaning.clip_negative(cleaning.clip_negative(rows), ["f_header"]).select(*ID.split(", "), "f_header", "Init_Win_bytes_forward")


@query("c18_unusable_to_zero", S.with_(S.LABELLED, f"SELECT {ID}, coalesce({finite('f_rate')}, 0.0) AS f_rate FROM labelled"))
def _(spark, d):
    return cleaning.zero_unusable(V.labelled(spark, d), L).select(*ID.split(", "), "f_rate")


# --- labels ----------------------------------------------------------------------------
@query("p08_p09_labels_and_families", S.with_(S.LABELLED, f"SELECT {ID}, {ATTACK} AS is_attack, {FAMILY} AS family FROM labelled"))
def _(spark, d):
    return V.labelled(spark, d).select(*ID.split(", "), C.is_attack(F.col("Label")).alias("is_attack"), C.attack_family(F.col("Label")).alias("family"))


@query("p10_p11_numeric_subset", S.with_(S.FLOWS, "SELECT count(*) AS flows, 31 AS numeric_columns FROM flows WHERE Destination_Port > 0 AND Protocol IN ('TCP', 'UDP')"))
def _(spark, d):
    rows = flow_table(spark, d)
    n = len(cleaning.numeric_columns(rows, {"Source_Port", "Destination_Port"}))
    return rows.filter((F.col("Destination_Port") > 0) & F.col("Protocol").isin("TCP", "UDP")).agg(F.count(F.lit(1)).alias("flows"), F.lit(n).alias("numeric_columns"))


_MEANINGS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in fixed.FEATURE_MEANINGS.items())


@query("p15_feature_meaning", S.with_(S.FLOWS + f""",
known(feature, meaning) AS (VALUES {_MEANINGS}),
names AS (SELECT DISTINCT CASE Protocol WHEN 'TCP' THEN 'Flow Duration' WHEN 'UDP' THEN 'Flow Bytes/s' ELSE Protocol END AS feature FROM flows)""",
    f"SELECT feature, coalesce(meaning, '{fixed.DEFAULT_MEANING}') AS meaning FROM names LEFT JOIN known USING (feature)"))
def _(spark, d):
    name = F.when(F.col("Protocol") == "TCP", "Flow Duration").when(F.col("Protocol") == "UDP", "Flow Bytes/s").otherwise(F.col("Protocol"))
    return ranking.feature_meaning(flow_table(spark, d).select(name.alias("feature")).distinct())


# --- capture statistics ----------------------------------------------------------------
@query("a01_capture_summary", S.with_(S.FLOWS, """
SELECT count(*) AS total_packets, (SELECT count(*) FROM flows) AS total_flows, sum(Length)::BIGINT AS total_bytes,
       round((max(Time_ns) - min(Time_ns))::DOUBLE / 1e9, 2) AS capture_duration_seconds,
       round(count(*)::DOUBLE / greatest(0.001, (max(Time_ns) - min(Time_ns))::DOUBLE / 1e9), 2) AS avg_packet_rate,
       round(sum(Length)::DOUBLE / greatest(0.001, (max(Time_ns) - min(Time_ns))::DOUBLE / 1e9), 2) AS avg_byte_rate FROM packets"""))
def _(spark, d):
    return ST.capture_summary(V.packets(spark, d), flow_table(spark, d).agg(F.count(F.lit(1)).alias("n")).scalar())


@query("a02_a03_protocol_share", S.with_(S.PACKETS, """
SELECT Protocol, count(*) AS Packet_Count, round(count(*)::DOUBLE * 100 / (SELECT count(*) FROM packets), 2) AS Percentage FROM packets GROUP BY Protocol"""))
def _(spark, d):
    return ST.share(ST.frequency(V.packets(spark, d), "Protocol"), "Packet_Count")


@query("a04_entropy", S.with_(S.PACKETS, "\nUNION ALL ".join(f"""
SELECT 'entropy_{c.lower()}' AS metric, round(-sum(p * log2(p + 1e-12)), 4) AS entropy
FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM packets) AS p FROM packets GROUP BY {c})""" for c in ("Source", "Destination", "Protocol"))))
def _(spark, d):
    return ST.entropies(V.packets(spark, d))


MOMENT_COLUMNS = ["Flow_Duration", "Total_Packets", "Total_Bytes", "Avg_Packet_Length", "Packet_Length_Std", "Mean_IAT", "SYN_Count", "ACK_Count"]


def _moment_sql(c: str) -> str:
    return f"""SELECT '{c}' AS Feature, round(m, 4) AS Mean, round(md, 4) AS Median, round(v, 4) AS Variance, round(s, 4) AS Std_Dev,
  round(avg(pow(x - m, 3)) / pow(any_value(sp), 3), 4) AS Skewness, round(avg(pow(x - m, 4)) / pow(any_value(sp), 4) - 3, 4) AS Kurtosis,
  round(m - 1.96 * s / sqrt(n), 4) AS CI_95_Lower, round(m + 1.96 * s / sqrt(n), 4) AS CI_95_Upper
FROM (SELECT {c}::DOUBLE AS x FROM flows), (SELECT avg({c}::DOUBLE) AS m, median({c}::DOUBLE) AS md, var_samp({c}::DOUBLE) AS v,
  stddev_samp({c}::DOUBLE) AS s, stddev_pop({c}::DOUBLE) AS sp, count(*) AS n FROM flows) GROUP BY m, md, v, s, n"""


@query("a05_moments", S.with_(S.FLOWS, "\nUNION ALL ".join(_moment_sql(c) for c in MOMENT_COLUMNS)))
def _(spark, d):
    return ST.moments(flow_table(spark, d), MOMENT_COLUMNS)


def _pairs(cols: list[str], table: str, digits: int = 4) -> str:
    return "\nUNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}::DOUBLE, {b}::DOUBLE), {digits}) AS correlation FROM {table}"
                               for i, a in enumerate(cols) for b in cols[i + 1:])


@query("a06_correlation_matrix", S.with_(S.FLOWS, _pairs(MOMENT_COLUMNS, "flows")))
def _(spark, d):
    return ST.correlations(flow_table(spark, d), MOMENT_COLUMNS, 4)


PAIRS = IMPUTED + ",\npairs AS (" + _pairs(L, "imputed", 6) + ")"


@query("a07_correlated_pairs", S.with_(PAIRS, "SELECT feature_a, feature_b, abs(correlation) AS correlation FROM pairs WHERE abs(correlation) >= 0.3"))
def _(spark, d):
    return ST.correlated_pairs(ST.correlations(imputed(spark, d), L, 6), 0.3)


@query("a08_strongest_partner", S.with_(PAIRS + """,
both_ways AS (SELECT feature_a AS feature, feature_b AS partner, abs(correlation) AS c FROM pairs
UNION ALL SELECT feature_b, feature_a, abs(correlation) FROM pairs)""", """
SELECT feature, max(c) AS max_correlation, arg_max(partner, c) AS partner FROM both_ways GROUP BY feature"""))
def _(spark, d):
    return ST.strongest_partner(ST.correlations(imputed(spark, d), L, 6), L)


CLASSES = S.LABELLED + f""",
classes AS (SELECT trim(Label) AS Label, count(*) AS Samples, count(*)::DOUBLE * 100 / (SELECT count(*) FROM labelled) AS Percentage,
  any_value({FAMILY}) AS Attack_Family, any_value({ATTACK}) AS "Binary" FROM labelled GROUP BY trim(Label))"""


@query("a09_class_distribution", S.with_(CLASSES, 'SELECT * FROM classes'))
def _(spark, d):
    return ST.class_distribution(V.labelled(spark, d))


@query("a10_family_distribution", S.with_(CLASSES, """
SELECT Attack_Family, sum(Samples)::BIGINT AS Samples, sum(Samples)::DOUBLE * 100 / (SELECT count(*) FROM labelled)::DOUBLE AS Percentage FROM classes GROUP BY 1"""))
def _(spark, d):
    return ST.family_distribution(ST.class_distribution(V.labelled(spark, d)))


def _profile_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, 'double' AS datatype, u AS unique_values, mn AS min, mx AS max, round(m, 9) AS mean, md AS median, round(s, 6) AS std,
  mi AS missing_count, inf AS infinite_count, round(z, 9) AS zero_percentage, s = 0 OR u <= 1 AS is_constant,
  round(avg(pow(x - m, 3)) / pow(any_value(sp), 3), 4) AS skewness, abs(avg(pow(x - m, 3)) / pow(any_value(sp), 3)) > 3.0 AS is_skewed, mx > m + 5.0 * s AS has_outliers
FROM (SELECT {c}::DOUBLE AS x FROM imputed), (SELECT count(DISTINCT {c}) AS u, min({c}) AS mn, max({c}) AS mx, avg({c}) AS m, median({c}) AS md, stddev_samp({c}) AS s,
  stddev_pop({c}) AS sp, count(*) FILTER (WHERE {c} = 0)::DOUBLE / count(*) * 100 AS z FROM imputed),
  (SELECT count(*) FILTER (WHERE {c} IS NULL) AS mi, count(*) FILTER (WHERE isinf({c})) AS inf FROM labelled)
GROUP BY u, mn, mx, m, md, s, mi, inf, z"""


@query("a11_feature_profile", S.with_(IMPUTED, "\nUNION ALL ".join(_profile_sql(c) for c in L)))
def _(spark, d):
    out = ST.feature_profile(imputed(spark, d), L, raw=V.labelled(spark, d))
    return round_to(round_to(round_to(out, 9, "mean", "zero_percentage"), 6, "std"), 4, "skewness")


@query("a12_dataset_summary", S.with_(S.LABELLED, "SELECT count(*) AS total_samples_raw, (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled)) AS total_samples_cleaned, "
       "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled)) AS duplicate_count, "
       "(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled)))::DOUBLE * 100 / count(*) AS duplicate_percentage, "
       "count(*) FILTER (WHERE f_rate IS NULL) AS missing_values_raw, count(*) FILTER (WHERE isinf(f_rate)) AS infinite_values_raw, "
       f"5::BIGINT AS feature_count, count(DISTINCT trim(Label)) AS unique_attack_classes, count(DISTINCT {FAMILY}) AS attack_families FROM labelled"))
def _(spark, d):
    return ST.dataset_summary(V.labelled(spark, d), L)


@query("a14_per_second", S.with_(S.PACKETS, "SELECT Time_ns // 1000000000 AS Time_Int, count(*) AS packets, sum(Length)::DOUBLE / 1024.0 AS kilobytes FROM packets GROUP BY 1"))
def _(spark, d):
    return ST.per_second(V.packets(spark, d))


def _hist_sql(expr: str, table: str, by: str = "") -> str:
    key = by + ", " if by else ""
    return f"""SELECT {key}bin, round(lo + bin * (hi - lo) / 50, 6) AS bin_start, count(*) AS n FROM (
SELECT {key}lo, hi, CASE WHEN hi > lo THEN CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS INT) ELSE 0 END AS bin
FROM (SELECT {key}{expr} AS x FROM {table}), (SELECT min({expr}) AS lo, max({expr}) AS hi FROM {table})) GROUP BY {key}bin, lo, hi"""


@query("a15_packet_size_histogram", S.with_(S.PACKETS, _hist_sql("Length::DOUBLE", "packets")))
def _(spark, d):
    return round_to(ST.histogram(V.packets(spark, d), F.col("Length")), 6, "bin_start")


@query("a15_duration_histogram_log", S.with_(S.FLOWS, _hist_sql("round(log10(Flow_Duration), 9)", "flows")))
def _(spark, d):
    rows = flow_table(spark, d).withColumn("x", F.round(F.log10("Flow_Duration"), 9))
    return round_to(ST.histogram(rows, F.col("x")), 6, "bin_start")


@query("a16_box_statistics", S.with_(S.FLOWS + """,
q AS (SELECT Protocol, quantile_cont(Flow_Duration, 0.25) AS q1, median(Flow_Duration) AS median, quantile_cont(Flow_Duration, 0.75) AS q3 FROM flows GROUP BY Protocol)""", """
SELECT Protocol, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
       min(Flow_Duration) FILTER (WHERE Flow_Duration >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       max(Flow_Duration) FILTER (WHERE Flow_Duration <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) AS n
FROM flows JOIN q USING (Protocol) GROUP BY Protocol"""))
def _(spark, d):
    return round_to(ST.box_statistics(flow_table(spark, d), "Protocol", "Flow_Duration"), 6, "q1", "median", "q3")


@query("a17_top_and_other", S.with_(S.PACKETS + """,
c AS (SELECT Source, count(*) AS n FROM packets GROUP BY Source), t AS (SELECT Source FROM c ORDER BY n DESC, Source LIMIT 5)""", """
SELECT CASE WHEN Source IN (SELECT Source FROM t) THEN Source ELSE 'OTHER' END AS Source, sum(n)::BIGINT AS Packet_Count FROM c GROUP BY 1"""))
def _(spark, d):
    return ST.top_and_other(V.packets(spark, d), "Source")


SCORED = S.FLOWS + """,
scored AS (SELECT *, CASE WHEN Total_Bytes % 4 = 0 THEN 'ATTACK' ELSE 'BENIGN' END AS Prediction FROM flows)"""


def scored(spark, d):
    return flow_table(spark, d).withColumn("Prediction", F.when(F.col("Total_Bytes") % 4 == 0, "ATTACK").otherwise("BENIGN"))


@query("a19_attack_feature_statistics", S.with_(SCORED, "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}::DOUBLE), 6) AS mean, round(median({c}::DOUBLE), 6) AS median FROM scored WHERE Prediction = 'ATTACK'"
    for c in ("Flow_Duration", "Total_Packets", "Total_Bytes", "Mean_IAT"))))
def _(spark, d):
    return round_to(ST.attack_feature_statistics(scored(spark, d), ["Flow_Duration", "Total_Packets", "Total_Bytes", "Mean_IAT"]), 6, "mean", "median")


@query("a20_density_by_verdict", S.with_(SCORED, _hist_sql("Total_Bytes::DOUBLE", "scored", "Prediction")))
def _(spark, d):
    return round_to(ST.histogram(scored(spark, d), F.col("Total_Bytes"), by="Prediction"), 6, "bin_start")


@query("a21_class_means_melted", S.with_(S.LABELLED, "\nUNION ALL ".join(
    f"SELECT CASE {ATTACK} WHEN 1 THEN 'ATTACK' ELSE 'BENIGN' END AS Is_Attack, '{c}' AS Feature, round(avg({finite(c)}), 9) AS Mean_Value FROM labelled GROUP BY 1" for c in L[:4])))
def _(spark, d):
    return round_to(ST.class_means(V.labelled(spark, d), L[:4]), 9, "Mean_Value")


THRESHOLDS = S.FLOWS + """,
limits AS (SELECT quantile_cont(Packets_Per_Second, 0.95) AS pps, quantile_cont(Bytes_Per_Second, 0.95) AS bps,
  quantile_cont(Mean_IAT, 0.05) FILTER (WHERE Mean_IAT > 0) AS iat, quantile_cont(Total_Packets, 0.95) AS pkts, quantile_cont(Total_Bytes, 0.95) AS bytes FROM flows)"""


@query("a22_population_thresholds", S.with_(THRESHOLDS, """
SELECT round(pps, 4) AS pps_95th, round(bps, 2) AS bps_95th, round(iat, 6) AS iat_5th, round(pkts, 6) AS pkts_95th, round(bytes, 6) AS bytes_95th FROM limits"""))
def _(spark, d):
    t = ST.population_thresholds(flow_table(spark, d))
    digits = {"pps_95th": 4, "bps_95th": 2, "iat_5th": 6, "pkts_95th": 6, "bytes_95th": 6}
    return spark.range(1).select(*[F.round(F.lit(v), digits[k]).alias(k) for k, v in t.items()])


@query("a24_prediction_counts", S.with_(SCORED, """
SELECT count(*) AS total_flows, count(*) FILTER (WHERE Prediction <> 'ATTACK') AS benign_flows, count(*) FILTER (WHERE Prediction = 'ATTACK') AS attack_flows,
       count(*) FILTER (WHERE Prediction = 'ATTACK')::DOUBLE * 100 / count(*) AS attack_percentage FROM scored"""))
def _(spark, d):
    return ST.prediction_counts(scored(spark, d))


# --- top k -----------------------------------------------------------------------------
@query("k01_top_addresses", S.with_(S.PACKETS, "SELECT Source, count(*) AS Packet_Count FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(spark, d):
    return ST.top_values(V.packets(spark, d), "Source")


@query("k02_top_ports", S.with_(S.FEATURES, "SELECT Destination_Port, count(*) AS Packet_Count FROM feature_packets WHERE Destination_Port > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(spark, d):
    return ST.top_values(V.feature_packets(spark, d), "Destination_Port", positive_only=True)


@query("k03_top_flows", S.with_(S.FLOWS, "SELECT FlowID, Protocol, Source_IP, Destination_IP, Total_Bytes FROM flows ORDER BY Total_Bytes DESC, FlowID LIMIT 5"))
def _(spark, d):
    return SEL.top_flows(flow_table(spark, d), "Total_Bytes")


@query("k06_hash_sample")
def _(spark, d):
    return SEL.hash_sample(V.packets(spark, d), 500, ["Frame_Number"])


# --- verdicts and investigation --------------------------------------------------------
VOTES = S.FLOWS + """,
votes AS (SELECT FlowID, CASE WHEN Total_Bytes % 3 = 0 THEN -1 ELSE 1 END AS IsoForest_Pred, CASE WHEN Total_Bytes % 2 = 0 THEN -1 ELSE 1 END AS OneClassSVM_Pred,
  CASE WHEN Total_Packets % 2 = 0 THEN -1 ELSE 1 END AS DBSCAN_Anomaly FROM flows),
verdicts AS (SELECT *, CASE WHEN (IsoForest_Pred = -1)::INT + (OneClassSVM_Pred = -1)::INT + (DBSCAN_Anomaly = -1)::INT >= 2 THEN -1 ELSE 1 END AS Consensus_Anomaly FROM votes)"""


def verdicts(spark, d):
    rows = flow_table(spark, d).select(
        "FlowID", F.when(F.col("Total_Bytes") % 3 == 0, -1).otherwise(1).alias("IsoForest_Pred"),
        F.when(F.col("Total_Bytes") % 2 == 0, -1).otherwise(1).alias("OneClassSVM_Pred"), F.when(F.col("Total_Packets") % 2 == 0, -1).otherwise(1).alias("DBSCAN_Anomaly"))
    return EV.consensus(rows)


_TAGS = """
tagged AS (SELECT i.*, list_filter([
  CASE WHEN Packets_Per_Second >= pps AND Total_Packets > 1 AND Flow_Duration > 0.001 THEN 'unusually_high_packet_rate' END,
  CASE WHEN Bytes_Per_Second >= bps OR Total_Bytes >= bytes THEN 'unusually_high_byte_rate' END,
  CASE WHEN Total_Packets > 2 AND Mean_IAT > 0 AND Mean_IAT <= iat THEN 'extremely_short_iat' END,
  CASE WHEN Protocol = 'TCP' AND SYN_Count > 0 AND (SYN_ACK_Ratio >= 2.0 OR SYN_Count >= 5 OR ACK_Count = 0) THEN 'syn_heavy_tcp_behaviour' END,
  CASE WHEN Protocol = 'TCP' AND (RST_Count >= 2 OR RST_Ratio >= 0.25) THEN 'excessive_rst_behaviour' END,
  CASE WHEN Protocol = 'ARP' THEN CASE WHEN Total_Packets >= 5 OR Packets_Per_Second > 10 THEN 'excessive_arp_activity' END
       WHEN Protocol = 'MDNS' OR Destination_IP IN ('224.0.0.251', 'ff02::fb') THEN CASE WHEN Total_Packets >= 10 OR Packets_Per_Second > 10 THEN 'excessive_mdns_multicast_activity' END
       WHEN Protocol = 'DNS' THEN CASE WHEN Total_Packets >= 5 OR Packets_Per_Second > 10 OR Total_Bytes > 2000 THEN 'dns_query_bursts' END
       WHEN Protocol IN ('UDP', 'QUIC') THEN CASE WHEN Total_Bytes >= bytes OR Total_Packets >= pkts THEN 'high_volume_udp_quic_traffic' END
       WHEN Protocol IN ('SSLV2', 'SSL') THEN 'legacy_protocol_usage' END,
  CASE WHEN Destination_IP IN ('Broadcast', '255.255.255.255') OR Destination_IP LIKE '%.255' THEN 'unusual_broadcast_traffic'
       WHEN (Destination_IP LIKE '224.%' OR Destination_IP LIKE '239.%' OR Destination_IP LIKE 'ff0%') AND Protocol <> 'MDNS' THEN 'unusual_multicast_traffic' END
  ], lambda x: x IS NOT NULL) AS found FROM inv i, limits),
named AS (SELECT *, CASE WHEN len(found) = 0 THEN ['statistically_unusual_feature_profile'] ELSE found END AS tags FROM tagged),
investigated AS (SELECT *, array_to_string(tags, ', ') AS behaviours_str, CASE
  WHEN list_contains(tags, 'legacy_protocol_usage') OR Protocol IN ('SSLV2', 'SSL') THEN 'Legacy protocol anomaly'
  WHEN Protocol = 'ARP' OR list_contains(tags, 'excessive_arp_activity') THEN CASE WHEN list_contains(tags, 'unusual_broadcast_traffic') OR Total_Packets >= 20 THEN 'Possible ARP spoofing/broadcast storm pattern' ELSE 'ARP anomaly' END
  WHEN list_contains(tags, 'syn_heavy_tcp_behaviour') THEN CASE WHEN SYN_Count > 0 AND ACK_Count = 0 AND Total_Packets <= 5 THEN 'Possible port scanning pattern' ELSE 'Possible SYN flood pattern' END
  WHEN Protocol = 'DNS' OR list_contains(tags, 'dns_query_bursts') THEN CASE WHEN Total_Bytes > 5000 OR list_contains(tags, 'unusually_high_byte_rate') THEN 'Possible DNS tunneling pattern' ELSE 'DNS anomaly' END
  WHEN Protocol = 'MDNS' OR list_contains(tags, 'excessive_mdns_multicast_activity') THEN 'mDNS anomaly'
  WHEN Protocol IN ('UDP', 'QUIC') OR list_contains(tags, 'high_volume_udp_quic_traffic') THEN 'Suspicious high-volume UDP/QUIC behaviour'
  WHEN list_contains(tags, 'excessive_rst_behaviour') OR (Protocol = 'TCP' AND (list_contains(tags, 'unusually_high_packet_rate') OR list_contains(tags, 'extremely_short_iat'))) THEN 'TCP anomaly'
  WHEN list_contains(tags, 'unusual_broadcast_traffic') OR list_contains(tags, 'unusual_multicast_traffic') THEN 'Unusual broadcast/multicast anomaly'
  WHEN list_contains(tags, 'unusually_high_packet_rate') OR list_contains(tags, 'unusually_high_byte_rate') THEN 'High-volume traffic anomaly'
  ELSE 'Unclassified anomaly' END AS possible_category FROM named)"""
ANOMALIES = THRESHOLDS + VOTES[len(S.FLOWS):] + ",\ninv AS (SELECT f.*, Consensus_Anomaly FROM flows f JOIN verdicts USING (FlowID) WHERE Consensus_Anomaly = -1)"
INVESTIGATED = ANOMALIES + "," + _TAGS


def investigated(spark, d):
    return stored(spark, d, "investigated", lambda: INV.investigate(flow_table(spark, d), verdicts(spark, d)))


@query("m08_consensus_vote", S.with_(VOTES, "SELECT * FROM verdicts"))
def _(spark, d):
    return verdicts(spark, d)


@query("a13_anomaly_summary", S.with_(VOTES, """
SELECT count(*) AS total_flows_evaluated, count(*) FILTER (WHERE IsoForest_Pred = -1) AS isolation_forest_anomalies, count(*) FILTER (WHERE OneClassSVM_Pred = -1) AS one_class_svm_anomalies,
       count(*) FILTER (WHERE DBSCAN_Anomaly = -1) AS dbscan_outliers, count(*) FILTER (WHERE Consensus_Anomaly = -1) AS consensus_anomalies,
       round(count(*) FILTER (WHERE Consensus_Anomaly = -1)::DOUBLE / count(*) * 100, 2) AS anomaly_rate_percent FROM verdicts"""))
def _(spark, d):
    return ST.anomaly_summary(verdicts(spark, d))


@query("a18_vote_distribution", S.with_(VOTES, "SELECT (IsoForest_Pred = -1)::INT + (OneClassSVM_Pred = -1)::INT + (DBSCAN_Anomaly = -1)::INT AS votes, count(*) AS flows FROM verdicts GROUP BY 1"))
def _(spark, d):
    return ST.vote_distribution(verdicts(spark, d))


@query("j02_attach_verdicts", S.with_(VOTES, """
SELECT FlowID, Total_Bytes, IsoForest_Pred, Consensus_Anomaly FROM flows LEFT JOIN (SELECT * FROM verdicts WHERE DBSCAN_Anomaly = -1) USING (FlowID)"""))
def _(spark, d):
    return SEL.attach_verdicts(flow_table(spark, d).select("FlowID", "Total_Bytes"), verdicts(spark, d).filter("DBSCAN_Anomaly = -1")).select(
        "FlowID", "Total_Bytes", "IsoForest_Pred", "Consensus_Anomaly")


@query("j05_threshold_comparison", S.with_(THRESHOLDS, "SELECT FlowID, Total_Bytes >= bytes AS heavy, Total_Packets >= pkts AS busy FROM flows, limits"))
def _(spark, d):
    rows = flow_table(spark, d)
    t = ST.population_thresholds(rows)
    return rows.select("FlowID", (F.col("Total_Bytes") >= t["bytes_95th"]).alias("heavy"), (F.col("Total_Packets") >= t["pkts_95th"]).alias("busy"))


@query("i01_consensus_anomalies", S.with_(ANOMALIES, "SELECT FlowID, Protocol, Total_Packets, Consensus_Anomaly FROM inv"))
def _(spark, d):
    return INV.consensus_anomalies(flow_table(spark, d), verdicts(spark, d)).select("FlowID", "Protocol", "Total_Packets", "Consensus_Anomaly")


@query("i02_i04_tags_and_categories", S.with_(INVESTIGATED, "SELECT FlowID, behaviours_str, possible_category FROM investigated"))
def _(spark, d):
    return INV.investigate(flow_table(spark, d), verdicts(spark, d)).select("FlowID", "behaviours_str", "possible_category")


@query("s14_list_to_text", S.with_(INVESTIGATED, "SELECT FlowID, behaviours_str AS observed_behaviours FROM investigated"))
def _(spark, d):
    return SEL.listed(investigated(spark, d).select("FlowID", "observed_behaviours"), "observed_behaviours")


@query("i05_tag_frequency", S.with_(INVESTIGATED, "SELECT unnest(tags) AS behaviour, count(*) AS flows FROM investigated GROUP BY 1"))
def _(spark, d):
    return INV.tag_frequency(investigated(spark, d))


@query("i06_summary_by_protocol", S.with_(INVESTIGATED, "SELECT Protocol, count(*) AS flows, sum(Total_Packets)::BIGINT AS packets, sum(Total_Bytes)::BIGINT AS bytes FROM investigated GROUP BY 1"))
def _(spark, d):
    return INV.by_protocol(investigated(spark, d))


@query("i06_summary_categories", S.with_(INVESTIGATED, "SELECT possible_category, count(*) AS flows FROM investigated GROUP BY 1"))
def _(spark, d):
    return INV.investigation_summary(investigated(spark, d))["categories"]


@query("i06_top_source_ports", S.with_(INVESTIGATED, "SELECT Source_Port, count(*) AS flows FROM investigated WHERE Source_Port > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(spark, d):
    return INV.investigation_summary(investigated(spark, d))["top_source_ports"]


_EXPLAIN = ["Total_Packets", "Total_Bytes", "Flow_Duration", "Avg_Packet_Length"]


@query("i07_explanation", S.with_(SCORED + ",\nfit AS (SELECT " + ", ".join(
    f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS r_{c}" for c in _EXPLAIN) + " FROM scored WHERE Prediction = 'BENIGN')", """
SELECT FlowID, array_to_string(list_transform(list_sort([""" + ", ".join(f"{{'rank': -round(abs({c} - m_{c}) / r_{c}, 6), 'feature': '{c}'}}" for c in _EXPLAIN) + """])[1:3], lambda s: s.feature), ', ') AS Explanation
FROM scored, fit"""))
def _(spark, d):
    return INV.explain(scored(spark, d), _EXPLAIN, F.col("Prediction") == "BENIGN").select("FlowID", "Explanation")


@query("k05_u02_representative_flows", S.with_(ANOMALIES, "\nUNION\n".join(
    f"(SELECT FlowID, Protocol, Total_Packets, Total_Bytes FROM inv WHERE {w} ORDER BY {o} LIMIT 20)" for w, o in [
        ("true", "Total_Packets DESC, FlowID"), ("true", "Total_Bytes DESC, FlowID"), ("true", "Packets_Per_Second DESC, FlowID"), ("Protocol = 'TCP'", "SYN_Count DESC, FlowID"),
        ("Protocol = 'ARP'", "FlowID"), ("Protocol = 'DNS'", "FlowID"), ("Protocol = 'MDNS'", "FlowID"), ("Protocol IN ('UDP', 'QUIC')", "FlowID"), ("Protocol = 'SSLV2'", "FlowID")])))
def _(spark, d):
    return SEL.representative_flows(investigated(spark, d)).select("FlowID", "Protocol", "Total_Packets", "Total_Bytes")


# --- ranking ---------------------------------------------------------------------------
@query("r02_anova_f", S.with_(IMPUTED + f",\nt AS (SELECT *, {ATTACK} AS y FROM imputed)", "\nUNION ALL ".join(f"""
SELECT '{c}' AS feature, round((sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 4) AS anova_f_score
FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS ss FROM t GROUP BY y), (SELECT avg({c}) AS g FROM t)""" for c in L)))
def _(spark, d):
    return round_to(ranking.anova_f(imputed(spark, d), L, C.is_attack(F.col("Label"))), 4, "anova_f_score")


def _mi_sql(c: str) -> str:
    edges = ", ".join(f"v[1 + CAST(floor({i / 10!r} * (len(v) - 1)) AS BIGINT)]" for i in range(1, 10))
    return f"""SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (b * k))), 6) AS mutual_information_score FROM (
SELECT n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY bin)::DOUBLE AS b, sum(n) OVER (PARTITION BY y)::DOUBLE AS k FROM (
SELECT len(list_filter(list_distinct(e), lambda z: {c} > z)) AS bin, y, count(*)::DOUBLE AS n
FROM t, (SELECT [{edges}] AS e FROM (SELECT list_sort(list({c})) AS v FROM t)) GROUP BY 1, 2))"""


@query("r03_mutual_information", S.with_(IMPUTED + f",\nt AS (SELECT *, {ATTACK} AS y FROM imputed)", "\nUNION ALL ".join(_mi_sql(c) for c in L)))
def _(spark, d):
    return round_to(ranking.mutual_information(imputed(spark, d), L, C.is_attack(F.col("Label"))), 6, "mutual_information_score")


_NAMES = "['Destination Port', 'Flow Duration', 'Fwd Header Length', 'min_seg_size_forward', 'Flow Bytes/s']"


@query("r04_r06_status_and_tiers", S.with_(S.FLOWS + f""",
f AS (SELECT FlowID, ({_NAMES})[1 + Total_Packets % 5] AS feature, Total_Packets = 1 AS is_constant, (Total_Bytes % 101) / 100.0 AS corr,
  (Total_Bytes % 13) / 1000.0 AS importance, (Total_Bytes % 7) / 100.0 AS mi, Total_Packets > 4 AS is_skewed FROM flows),
g AS (SELECT *, CASE WHEN feature = 'Destination Port' THEN 'High' WHEN feature = 'Flow Duration' OR contains(feature, 'Header Length') OR contains(feature, 'min_seg_size') THEN 'Medium' ELSE 'Low' END AS leakage_risk,
  importance >= 0.005 OR mi >= 0.05 AS strong, CASE WHEN is_skewed THEN 'Needs preprocessing' ELSE 'High' END AS shape FROM f)""", """
SELECT FlowID, leakage_risk,
  CASE WHEN is_constant THEN 'Constant (Zero Variance)' WHEN corr >= 0.99 THEN 'Duplicate/Extremely Redundant with x' WHEN corr >= 0.90 THEN 'Highly Redundant with x' ELSE 'Unique/Non-Redundant' END AS redundancy_status,
  CASE WHEN is_constant THEN 'E. Poor candidate' WHEN corr >= 0.99 THEN 'C. Redundant' WHEN leakage_risk = 'High' THEN 'D. Potential leakage' WHEN corr >= 0.90 THEN 'C. Redundant' WHEN strong THEN 'A. Strong candidate' ELSE 'B. Possible candidate' END AS ml_suitability,
  CASE WHEN is_constant OR corr >= 0.99 THEN 'Tier 3 - Remove/Avoid' WHEN leakage_risk = 'High' THEN 'Tier 2 - Possible candidate (Use with caution)' WHEN corr >= 0.90 THEN 'Tier 2 - Possible candidate'
       WHEN strong OR mi >= 0.02 THEN 'Tier 1 - Strong candidate' ELSE 'Tier 2 - Possible candidate' END AS preliminary_recommendation,
  CASE WHEN is_constant OR corr >= 0.99 THEN 'Low' WHEN leakage_risk = 'High' OR corr >= 0.90 THEN 'Medium' ELSE shape END AS gan_suitability FROM g"""))
def _(spark, d):
    names = F.array(*[F.lit(n.strip(" '")) for n in _NAMES.strip("[]").split(",")])
    size, n = F.col("Total_Bytes"), F.col("Total_Packets")
    rows = flow_table(spark, d).select("FlowID", F.get(names, n % 5).alias("feature"), (n == 1).alias("is_constant"), (size % 101 / 100.0).alias("corr"),
                                       (size % 13 / 1000.0).alias("importance"), (size % 7 / 100.0).alias("mi"), (n > 4).alias("is_skewed"))
    rows = rows.withColumn("leakage_risk", ranking.leakage_risk(F.col("feature")))
    verdict = ranking.suitability(*[F.col(c) for c in ("is_constant", "corr", "leakage_risk", "importance", "mi", "is_skewed")])
    return rows.withColumns({**verdict, "redundancy_status": ranking.redundancy(F.col("is_constant"), F.col("corr"), F.lit("x"))}).select(
        "FlowID", "leakage_risk", "redundancy_status", "ml_suitability", "preliminary_recommendation", "gan_suitability")


@query("w08_k04_ranked_scores", S.with_(IMPUTED, "SELECT feature, deviation, row_number() OVER (ORDER BY deviation DESC, feature) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(stddev_samp({c}), 4) AS deviation FROM imputed" for c in L) + ") ORDER BY rank LIMIT 4"))
def _(spark, d):
    stats = ST.long_view(imputed(spark, d), L).groupBy("feature").agg(F.round(F.stddev_samp("value"), 4).alias("deviation"))
    return ranking.ranked(stats, "deviation").orderBy("rank").limit(4)


# --- split, scaling, metrics, curves ---------------------------------------------------
@query("m09_stratified_split", S.with_(S.LABELLED, f"""
SELECT y, unnest(['train', 'validation', 'test']) AS split, unnest([a, b - a, n - b]) AS "rows" FROM
(SELECT {ATTACK} AS y, count(*) AS n, CAST(round(count(*) * 0.70) AS BIGINT) AS a, CAST(round(count(*) * 0.85) AS BIGINT) AS b FROM labelled GROUP BY 1)"""))
def _(spark, d):
    rows = V.labelled(spark, d).withColumn("y", C.is_attack(F.col("Label")))
    split = EV.stratified_split(rows, "y", ["l_orderkey", "l_linenumber", *L])
    return split.groupBy("y", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("j06_split_columns_together", S.with_(S.LABELLED, "SELECT trim(Label) AS Label, count(*) AS \"rows\" FROM labelled GROUP BY 1"))
def _(spark, d):
    rows = V.labelled(spark, d).withColumn("y", C.is_attack(F.col("Label")))
    split = EV.stratified_split(rows, "y", ["l_orderkey", "l_linenumber", *L])
    parts = [split.filter(F.col("split") == s).select(C.clean_label(F.col("Label")).alias("Label")) for s in ("train", "validation", "test")]
    return SEL.union_tables(*parts).groupBy("Label").agg(F.count(F.lit(1)).alias("rows"))


@query("m02_m03_standard_scale", S.with_(S.FLOWS, "SELECT FlowID, " + ", ".join(
    f"round(({c} - (SELECT avg({c}::DOUBLE) FROM flows)) / (SELECT stddev_pop({c}::DOUBLE) FROM flows), 6) AS {c}" for c in _EXPLAIN) + ", 0.0::DOUBLE AS URG_Count FROM flows"))
def _(spark, d):
    cols = [*_EXPLAIN, "URG_Count"]
    return round_to(EV.standard_scale(flow_table(spark, d).select("FlowID", *cols), cols), 6, *cols)


@query("m10_robust_scale", S.with_(IMPUTED, f"SELECT {ID}, " + ", ".join(
    f"round(({c} - (SELECT median({c}) FROM imputed WHERE l_orderkey % 2 = 0)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM imputed WHERE l_orderkey % 2 = 0), 6) AS {c}" for c in L) + " FROM imputed"))
def _(spark, d):
    rows = imputed(spark, d)
    return round_to(EV.robust_scale(rows, EV.robust_fit(rows.filter("l_orderkey % 2 = 0"), L)), 6, *L).drop("Label")


JUDGED = S.LABELLED + f",\njudged AS (SELECT *, {ATTACK} AS y, CAST(f_packets > 25 AS INT) AS pred, f_bytes AS score FROM labelled)"


def judged(spark, d):
    return V.labelled(spark, d).withColumns({"y": C.is_attack(F.col("Label")), "pred": (F.col("f_packets") > 25).cast("int"), "score": F.col("f_bytes")})


_COUNTS = ("SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, "
           "count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn FROM judged")


@query("m13_binary_metrics", S.with_(JUDGED, f"""
SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall,
  (2 * tp)::DOUBLE / (2 * tp + fp + fn) AS f1, fp::DOUBLE / (fp + tn) AS fpr, fn::DOUBLE / (fn + tp) AS fnr FROM ({_COUNTS})"""))
def _(spark, d):
    return EV.binary_metrics(judged(spark, d), "y", "pred")


@query("m14_confusion_matrix", S.with_(JUDGED, "SELECT y AS actual, count(*) FILTER (WHERE pred = 0) AS predicted_0, count(*) FILTER (WHERE pred = 1) AS predicted_1 FROM judged GROUP BY y"))
def _(spark, d):
    return EV.confusion_matrix(judged(spark, d), "y", "pred")


CURVE = JUDGED + """,
per_score AS (SELECT score AS threshold, sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives FROM judged GROUP BY score),
curve AS (SELECT *, sum(positives) OVER w::BIGINT AS tp, sum(negatives) OVER w::BIGINT AS fp FROM per_score WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
points AS (SELECT *, tp::DOUBLE / (SELECT sum(positives) FROM per_score)::DOUBLE AS tpr, fp::DOUBLE / (SELECT sum(negatives) FROM per_score)::DOUBLE AS fpr, tp::DOUBLE / (tp + fp)::DOUBLE AS precision FROM curve)"""
CURVE = CURVE.replace("sum(positives) OVER w::BIGINT", "(sum(positives) OVER w)::BIGINT").replace("sum(negatives) OVER w::BIGINT", "(sum(negatives) OVER w)::BIGINT")


@query("w09_m16_curve_points", S.with_(CURVE, "SELECT threshold, tp, fp, tpr, fpr, precision FROM points"))
def _(spark, d):
    return EV.curve_points(judged(spark, d), "score", "y").select("threshold", "tp", "fp", "tpr", "fpr", "precision")


@query("m15_roc_auc_and_average_precision", S.with_(CURVE, """
SELECT round(sum(negatives * (tp - positives) + negatives * positives / 2.0)::DOUBLE / sum(positives)::DOUBLE / sum(negatives)::DOUBLE, 9) AS roc_auc,
       round(sum(positives * precision) / sum(positives)::DOUBLE, 9) AS average_precision FROM points"""))
def _(spark, d):
    return round_to(EV.curve_areas(EV.curve_points(judged(spark, d), "score", "y")), 9, "roc_auc", "average_precision")


@query("m17_per_class_detection", S.with_(JUDGED, """
SELECT trim(Label) AS Label, count(*) AS Test_Samples, sum((pred = y)::INT)::BIGINT AS Correct_Classifications, sum((pred = y)::INT)::DOUBLE / count(*) AS Detection_Rate,
       CASE WHEN count(*) >= 100 THEN 'Reliable' ELSE 'Unreliable (Small N)' END AS Reliability FROM judged GROUP BY 1"""))
def _(spark, d):
    return EV.per_class_detection(judged(spark, d), predicted="pred")


# --- fused verdicts --------------------------------------------------------------------
DUAL = S.FLOWS + """,
dual AS (SELECT FlowID, Source_IP, Destination_IP, Protocol, CASE WHEN Total_Packets > 5 THEN 'ATTACK' ELSE 'BENIGN' END AS RF_Prediction, (Total_Packets % 10) / 10.0::DOUBLE AS RF_Score,
  CASE WHEN Total_Bytes > 4000 THEN 'DoS' WHEN Total_Bytes % 5 = 0 THEN 'Botnet' ELSE 'BENIGN' END AS ANN_Prediction, (Total_Bytes % 10) / 10.0::DOUBLE AS ANN_Score FROM flows),
fused AS (SELECT *, CASE WHEN (RF_Prediction <> 'BENIGN') = (ANN_Prediction <> 'BENIGN') THEN 'AGREE' ELSE 'DISAGREE' END AS Model_Agreement,
  CASE WHEN (RF_Prediction <> 'BENIGN') <> (ANN_Prediction <> 'BENIGN') THEN 'MODEL DISAGREEMENT' WHEN RF_Prediction <> 'BENIGN' THEN 'ATTACK' ELSE 'BENIGN' END AS Final_Status FROM dual)"""


def dual(spark, d, more=()):
    return flow_table(spark, d).select(
        *more, "FlowID", "Source_IP", "Destination_IP", "Protocol", F.when(F.col("Total_Packets") > 5, "ATTACK").otherwise("BENIGN").alias("RF_Prediction"),
        (F.col("Total_Packets") % 10 / 10.0).alias("RF_Score"),
        F.when(F.col("Total_Bytes") > 4000, "DoS").when(F.col("Total_Bytes") % 5 == 0, "Botnet").otherwise("BENIGN").alias("ANN_Prediction"), (F.col("Total_Bytes") % 10 / 10.0).alias("ANN_Score"))


@query("m22_verdict_fusion", S.with_(DUAL, """
SELECT FlowID, Model_Agreement, Final_Status AS consensus, CASE WHEN RF_Prediction <> 'BENIGN' OR ANN_Prediction <> 'BENIGN' THEN 'ATTACK' ELSE 'BENIGN' END AS high_recall,
       CASE WHEN RF_Prediction <> 'BENIGN' AND ANN_Prediction <> 'BENIGN' THEN 'ATTACK' ELSE 'BENIGN' END AS conservative FROM fused"""))
def _(spark, d):
    rows = EV.fuse_verdicts(dual(spark, d)).withColumnRenamed("Final_Status", "consensus")
    for strategy in ("high_recall", "conservative"):
        rows = EV.fuse_verdicts(rows, strategy).withColumnRenamed("Final_Status", strategy)
    return rows.select("FlowID", "Model_Agreement", "consensus", "high_recall", "conservative")


_TOP_THREE = ("array_to_string(list_transform(list_sort([" + ", ".join(f"{{'rank': -round(abs({c} - m_{c}) / r_{c}, 6), 'feature': '{c}'}}" for c in _EXPLAIN)
              + "])[1:3], lambda s: s.feature), ', ')")
_BENIGN_FIT = ",\nfit AS (SELECT " + ", ".join(f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS r_{c}" for c in _EXPLAIN) + """
FROM fused JOIN flows USING (FlowID) WHERE Final_Status = 'BENIGN')"""


@query("m23_detection_report", S.with_(DUAL + _BENIGN_FIT, """
SELECT FlowID, Source_IP, Destination_IP, Protocol, RF_Prediction, RF_Score, ANN_Prediction, ANN_Score, Final_Status,
       CASE WHEN Final_Status = 'BENIGN' THEN 'BENIGN' WHEN ANN_Prediction <> 'BENIGN' THEN ANN_Prediction ELSE 'ATTACK' END AS Final_Predicted_Class, Model_Agreement,
       CASE WHEN Final_Status = 'BENIGN' THEN '' ELSE """ + _TOP_THREE + """ END AS Explanation FROM fused JOIN flows USING (FlowID, Source_IP, Destination_IP, Protocol), fit"""))
def _(spark, d):
    return EV.explained_report(dual(spark, d, _EXPLAIN), _EXPLAIN)


@query("a23_detection_summary", S.with_(DUAL, """
SELECT count(*) AS total_flows, count(*) FILTER (WHERE RF_Prediction = 'BENIGN') AS rf_normal, count(*) FILTER (WHERE RF_Prediction = 'ATTACK') AS rf_attack,
  count(*) FILTER (WHERE ANN_Prediction = 'BENIGN') AS ann_normal, count(*) FILTER (WHERE ANN_Prediction <> 'BENIGN') AS ann_attack,
  count(*) FILTER (WHERE Model_Agreement = 'AGREE')::DOUBLE * 100 / count(*) AS agreement_pct, count(*) FILTER (WHERE Model_Agreement <> 'AGREE')::DOUBLE * 100 / count(*) AS disagreement_pct FROM fused"""))
def _(spark, d):
    return EV.detection_summary(EV.fuse_verdicts(dual(spark, d)))
