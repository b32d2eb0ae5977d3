"""The rest of the investigation tables, top lists, histograms and planted source folders, each with its check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.catalog import sql as S, views as V
from flowquarry.catalog.book import QUERIES, query, round_to
from flowquarry.catalog.model_queries import scaled_flows
from flowquarry.catalog.packet_queries import CAPTURE, flow_table
from flowquarry.catalog.table_queries import ANOMALIES, ATTACK, DUAL, IMPUTED, INVESTIGATED, L, SCORED, dual, imputed, investigated, scored
from flowquarry.functions import columns as C
from flowquarry.operators import evaluation as EV, forest, investigation as INV, isolation, ordered, packets as P, selection as SEL, statistics as ST
from flowquarry.operators.neighbours import neighbour_information
from flowquarry.options import AnomalyOptions
from flowquarry.session import scratch_path
from flowquarry.sources import readers

OPT = AnomalyOptions()


# --- sources ---------------------------------------------------------------------------


@query("s06_mixed_headers", S.with_(S.LABELLED, """
SELECT l_linenumber % 3 AS file, count(*) AS "rows", sum(l_orderkey)::BIGINT AS keys,
       count(*) FILTER (WHERE l_linenumber % 3 <> 2 AND f_packets IS NOT NULL) AS with_packets FROM labelled GROUP BY 1"""))
def _(spark, d):
    """Two header orders, one file without a column, and a foreign file beside them."""
    rows, place = V.labelled(spark, d), scratch_path(spark, "mixed-headers")
    part = lambda i: rows.filter(F.col("l_linenumber") % 3 == i)
    names = rows.columns
    part(0).write.options(header=True).mode("append").csv(place)
    part(1).select(*reversed(names)).write.options(header=True).mode("append").csv(place)
    part(2).drop("f_packets").write.options(header=True).mode("append").csv(place)
    spark.createDataFrame([("x,y",), ("1,2",)], "value string").coalesce(1).write.mode("append").text(place)
    read = readers.read_directory(spark, place)
    return read.groupBy((F.col("l_linenumber") % 3).cast("bigint").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").cast("bigint").alias("keys"), F.count("f_packets").alias("with_packets"))


@query("s08_mixed_headers", """
SELECT * FROM (VALUES ('l_orderkey,l_linenumber,Label', true), ('Label,l_linenumber,l_orderkey', false)) AS t(header, compatible)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def _(spark, d):
    place = scratch_path(spark, "two-headers")
    names = ["l_orderkey", "l_linenumber", "Label"]
    rows = V.labelled(spark, d).select(*names)
    rows.filter("l_linenumber % 2 = 0").coalesce(1).write.options(header=True).csv(f"{place}/a")
    rows.filter("l_linenumber % 2 = 1").select(*reversed(names)).coalesce(1).write.options(header=True).csv(f"{place}/b")
    heads = readers.header_compatibility(spark, f"{place}/*")
    first = heads.agg(F.min_by("header", "file_name")).scalar()
    # which file comes first depends on its generated name
    return heads.select("header", F.when(first == ",".join(names), F.col("compatible")).otherwise(~F.col("compatible")).alias("compatible")).distinct()


@query("s02_s03_planted_dialects", "SELECT * FROM (VALUES ('a', ';', 'UTF-8', (SELECT count(*) FROM nation)), ('b', '|', 'ISO-8859-1', (SELECT count(*) FROM nation))) AS t(file, delimiter, encoding, \"rows\")")
def _(spark, d):
    rows = V.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("é"), F.col("n_name")).alias("n_name"))
    found = []
    for file, sep, encoding in (("a", ";", "UTF-8"), ("b", "|", "ISO-8859-1")):
        path = scratch_path(spark, f"dialect-{file}")
        rows.coalesce(1).write.options(header=True, sep=sep, encoding=encoding).csv(path)
        read = readers.read_text_table(spark, path)
        found.append((file, readers.detect_delimiter(spark, path), readers.detect_encoding(spark, path), read.filter(F.col("n_name").startswith("é")).count()))
    return spark.createDataFrame(found, "file string, delimiter string, encoding string, rows bigint")


@query("s04_merged_exports", S.with_(S.PACKETS, "SELECT Frame_Number % 2 AS part, least(count(*), 300) AS packets FROM packets GROUP BY 1"))
def _(spark, d):
    raw, paths = V.packets(spark, d).withColumn("Time", C.seconds(F.col("Time_ns"))).drop("Time_ns").withColumnRenamed("Frame_Number", "No."), []
    for i in (0, 1):
        paths.append(scratch_path(spark, f"export-{i}"))
        raw.filter(F.col("`No.`") % 2 == i).write.options(header=True).csv(paths[-1])
    merged = readers.merge_packets(spark, paths, limit=300)
    return merged.groupBy((F.col("Frame_Number").cast("bigint") % 2).alias("part")).agg(F.count(F.lit(1)).alias("packets"))


# --- packets and distributions ---------------------------------------------------------
@query("p01_port_columns", """
SELECT event_id AS Frame_Number, coalesce(TRY_CAST(CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE CAST(1024 + user_id AS VARCHAR) END AS INT), -1) AS port FROM events""")
def _(spark, d):
    port = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "x").otherwise((1024 + F.col("user_id")).cast("string"))
    raw = V.table(spark, d, "events").select(F.col("event_id").alias("Frame_Number"), port.alias("Source_Port"))
    return P.with_ports(raw).select("Frame_Number", F.col("Source_Port").alias("port"))


def _hist(expr: str, table: str, by: str = "", where: str = "true") -> str:
    key = by + ", " if by else ""
    return f"""SELECT {key}bin, round(lo + bin * (hi - lo) / 50, 6) AS bin_start, count(*) AS n FROM (
SELECT {key}lo, hi, CASE WHEN hi > lo THEN CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS INT) ELSE 0 END AS bin
FROM (SELECT {key}{expr} AS x FROM {table} WHERE {where}), (SELECT min({expr}) AS lo, max({expr}) AS hi FROM {table} WHERE {where})) GROUP BY {key}bin, lo, hi"""


@query("a15_size_histogram_log_axis", S.with_(S.PACKETS, _hist("log10(Length::DOUBLE)", "packets", where="Length > 0")))
def _(spark, d):
    return round_to(ST.histogram(V.packets(spark, d), F.col("Length"), log_scale=True), 6, "bin_start")


@query("a15_infinite_rates_left_out", S.with_(S.LABELLED, _hist("f_rate", "labelled", where="f_rate IS NOT NULL AND NOT isinf(f_rate) AND NOT isnan(f_rate)")))
def _(spark, d):
    return round_to(ST.histogram(V.labelled(spark, d), F.col("f_rate")), 6, "bin_start")


@query("a15_inter_arrival_histogram_log", S.with_(CAPTURE, _hist("round(log10(IAT), 9)", "iat", where="IAT > 0")))
def _(spark, d):
    """Times between neighbouring packets of the whole capture; equal times (0) have no place on a log axis."""
    rows = ordered.capture_features(V.packets(spark, d)).filter("IAT > 0").select(F.round(F.log10("IAT"), 9).alias("x"))
    return round_to(ST.histogram(rows, F.col("x")), 6, "bin_start")


@query("a20_duration_by_verdict", S.with_(SCORED, _hist("round(log10(Flow_Duration), 9)", "scored", "Prediction")))
def _(spark, d):
    rows = scored(spark, d).withColumn("x", F.round(F.log10("Flow_Duration"), 9))
    return round_to(ST.histogram(rows, F.col("x"), by="Prediction"), 6, "bin_start")


@query("a20_size_by_verdict_packets", S.with_(SCORED, _hist("Total_Packets::DOUBLE", "scored", "Prediction")))
def _(spark, d):
    return round_to(ST.histogram(scored(spark, d), F.col("Total_Packets"), by="Prediction"), 6, "bin_start")


@query("a23_detected_classes", S.with_(DUAL, "SELECT ANN_Prediction, count(*) AS flows FROM fused WHERE ANN_Prediction <> 'BENIGN' GROUP BY 1"))
def _(spark, d):
    return EV.detected_classes(EV.fuse_verdicts(dual(spark, d)))


# --- top lists and investigation -------------------------------------------------------
for _metric in ("Total_Packets", "Packets_Per_Second", "Bytes_Per_Second"):
    @query(f"k03_top_by_{_metric.lower()}", S.with_(S.FLOWS, f"SELECT FlowID, Protocol, Source_IP, Destination_IP, {_metric} FROM flows ORDER BY {_metric} DESC, FlowID LIMIT 5"))
    def _(spark, d, metric=_metric):
        return SEL.top_flows(flow_table(spark, d), metric)


for _name, _where, _order in [
    ("packet_count", "true", "Total_Packets DESC, FlowID"), ("byte_count", "true", "Total_Bytes DESC, FlowID"), ("packet_rate", "true", "Packets_Per_Second DESC, FlowID"),
    ("syn_heavy", "Protocol = 'TCP'", "SYN_Count DESC, FlowID"), ("arp", "Protocol = 'ARP'", "FlowID"), ("dns", "Protocol = 'DNS'", "FlowID"),
    ("mdns", "Protocol = 'MDNS'", "FlowID"), ("udp_quic", "Protocol IN ('UDP', 'QUIC')", "FlowID"), ("sslv2", "Protocol = 'SSLV2'", "FlowID"), ("other", "true", "FlowID"),
]:
    @query(f"k05_{_name}_flows", S.with_(ANOMALIES, f"SELECT FlowID, Protocol, Total_Packets, Total_Bytes FROM inv WHERE {_where} ORDER BY {_order} LIMIT 20"))
    def _(spark, d, name=_name):
        return SEL.representative_flows(investigated(spark, d), name).select("FlowID", "Protocol", "Total_Packets", "Total_Bytes")


@query("i06_summary_total", S.with_(INVESTIGATED, "SELECT count(*) AS total_consensus_anomalous_flows FROM investigated"))
def _(spark, d):
    return INV.investigation_summary(investigated(spark, d))["total"]


for _name, _column, _where in [("top_source_ips", "Source_IP", "true"), ("top_destination_ips", "Destination_IP", "true"), ("top_destination_ports", "Destination_Port", "Destination_Port > 0")]:
    @query(f"i06_{_name}", S.with_(INVESTIGATED, f"SELECT {_column}, count(*) AS flows FROM investigated WHERE {_where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
    def _(spark, d, name=_name):
        return INV.investigation_summary(investigated(spark, d))[name]


for _name, _metric in [("top_by_packets", "Total_Packets"), ("top_by_bytes", "Total_Bytes"), ("top_by_packet_rate", "Packets_Per_Second"), ("top_by_byte_rate", "Bytes_Per_Second")]:
    @query(f"i06_{_name}", S.with_(INVESTIGATED, f"SELECT FlowID, Protocol, Source_IP, Destination_IP, {_metric} FROM investigated ORDER BY {_metric} DESC, FlowID LIMIT 5"))
    def _(spark, d, name=_name):
        return INV.investigation_summary(investigated(spark, d))[name]


# --- samples and models ----------------------------------------------------------------
@query("k06_sample_size", "SELECT least(count(*), 500) AS sampled, least(count(*), 500) AS distinct_frames, true AS from_table FROM events")
def _(spark, d):
    rows = V.packets(spark, d)
    taken = SEL.hash_sample(rows, 500, ["Frame_Number"])
    known = taken.join(rows.select("Frame_Number"), "Frame_Number", "left_semi").count()
    return taken.agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("Frame_Number").alias("distinct_frames")).withColumn("from_table", F.col("sampled") == known)


@query("m04_outlier_share", S.with_(S.FLOWS, "SELECT count(*) AS flows, true AS share_holds FROM flows"))
def _(spark, d):
    rows, cols = scaled_flows(spark, d)
    out = isolation.isolation_forest(rows, cols, ["FlowID"], OPT.trees, OPT.tree_rows, OPT.contamination, OPT.seed)
    return out.agg(F.count(F.lit(1)).alias("flows"), F.sum((F.col("IsoForest_Pred") == -1).cast("int")).alias("n")).select(
        "flows", F.col("n").between(F.col("flows") * OPT.contamination * 0.8, F.col("flows") * OPT.contamination + 1).alias("share_holds"))


@query("m05_outlier_share", S.with_(S.FLOWS, f"SELECT count(*) AS flows, ceil({OPT.nu} * (count(*) - 1))::BIGINT AS outside FROM flows"))
def _(spark, d):
    rows, cols = scaled_flows(spark, d)
    out = isolation.one_class_svm(rows, cols, ["FlowID"], OPT.nu, OPT.svm_features, seed=OPT.seed)
    return out.agg(F.count(F.lit(1)).alias("flows"), F.sum((F.col("OneClassSVM_Pred") == -1).cast("bigint")).alias("outside"))


@query("m20_axes_sound", S.with_(S.FLOWS, "SELECT count(*) AS flows, true AS centred, true AS uncorrelated FROM flows"))
def _(spark, d):
    rows, cols = scaled_flows(spark, d)
    axes, _ = forest.principal_axes(rows, cols)
    return axes.agg(F.count(F.lit(1)).alias("flows"), (F.greatest(F.abs(F.avg("PCA1")), F.abs(F.avg("PCA2"))) < 1e-6).alias("centred"), (F.abs(F.corr("PCA1", "PCA2")) < 1e-6).alias("uncorrelated"))


@query("m07_every_flow_in_a_cluster", S.with_(S.FLOWS, f"SELECT count(*) AS flows, {OPT.clusters} AS clusters FROM flows"))
def _(spark, d):
    rows, cols = scaled_flows(spark, d)
    found = forest.kmeans_clusters(rows, cols, OPT.clusters, OPT.seed)
    return found.agg(F.count("KMeans_Cluster").alias("flows"), F.count_distinct("KMeans_Cluster").cast("int").alias("clusters"))


@query("s15_scored_rows", S.with_(IMPUTED + f",\nt AS (SELECT CASE WHEN {V.TRAFFIC_ATTACK} THEN 1 ELSE 0 END AS label FROM imputed)", """
SELECT label::DOUBLE AS label, (count(*) - round(count(*) * 0.85))::BIGINT AS "rows", true AS probabilities_fit FROM t GROUP BY label"""))
def _(spark, d):
    scores = QUERIES["s15_m11_m19_forest_scores"](spark, d)
    fits = F.col("Attack_Probability").between(0, 1) & ((F.col("Attack_Probability") >= 0.5) == (F.col("Prediction_Label") == 1))
    return scores.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(fits | (F.abs(F.col("Attack_Probability") - 0.5) < 1e-9)).alias("probabilities_fit"))


def _digamma_sql(n: str) -> str:
    """Digamma by the recurrence and the series, as text."""
    x = f"({n} + 8.0::DOUBLE)"
    series = f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * pow({x}, 2)) + 1 / (120 * pow({x}, 4)) - 1 / (252 * pow({x}, 6)) + 1 / (240 * pow({x}, 8)) - 1 / (132 * pow({x}, 10)))"
    return "(" + series + "".join(f" - 1 / ({n} + {i}.0::DOUBLE)" for i in range(8)) + ")"


@query("r03_neighbour_information", S.with_(IMPUTED + f""",
t AS (SELECT *, CASE WHEN {V.TRAFFIC_ATTACK} THEN 1 ELSE 0 END AS y FROM imputed),
x AS ({" UNION ALL ".join(f"SELECT '{c}' AS f, {c} AS v, y FROM t" for c in L)}),
near AS (SELECT f, y, v, count(*) OVER (PARTITION BY f, y) AS c, count(*) OVER (PARTITION BY f, y, v) AS same, count(*) OVER (PARTITION BY f, v) AS at_value,
  list_sort(list_filter([{", ".join(f"abs({d}(v, {i}) OVER w - v)" for d in ("lag", "lead") for i in (1, 2, 3))}], lambda e: e IS NOT NULL)) AS ds
  FROM x WINDOW w AS (PARTITION BY f, y ORDER BY v)),
balls AS (SELECT *, ds[least(3, len(ds))] AS r, len(list_filter(ds, lambda e: e < ds[least(3, len(ds))])) + 1 AS closer FROM near),
upto AS (SELECT f, v, sum(count(*)) OVER (PARTITION BY f ORDER BY v) AS n FROM x GROUP BY f, v),
counted AS (SELECT b.f, b.c, CASE WHEN b.r = 0 THEN b.same ELSE b.closer END AS s,
  CASE WHEN b.r = 0 THEN b.at_value ELSE greatest(b.closer, coalesce(h.n, 0) - coalesce(l.n, 0)) END AS m
  FROM balls b ASOF LEFT JOIN upto h ON b.f = h.f AND b.v + b.r > h.v ASOF LEFT JOIN upto l ON b.f = l.f AND b.v - b.r >= l.v)""", f"""
SELECT f AS feature, round(greatest(0.0, {_digamma_sql("count(*)")} + avg({_digamma_sql("s")} - {_digamma_sql("c")} - {_digamma_sql("m")})), 6) AS neighbour_information
FROM counted GROUP BY f"""))
def _(spark, d):
    rows = V.with_traffic_label(imputed(spark, d))
    return round_to(neighbour_information(rows, L, C.is_attack(F.col("Label"))), 6, "neighbour_information")


_LISTS = [("true", "Total_Packets"), ("true", "Total_Bytes"), ("true", "Packets_Per_Second"), ("Protocol = 'TCP'", "SYN_Count"), ("Protocol = 'ARP'", "0"),
          ("Protocol = 'DNS'", "0"), ("Protocol = 'MDNS'", "0"), ("Protocol IN ('UDP', 'QUIC')", "0"), ("Protocol = 'SSLV2'", "0")]


@query("u02_representative_order", S.with_(ANOMALIES + ",\nlists AS (" + "\nUNION ALL ".join(
    f"(SELECT FlowID, {i} AS priority, row_number() OVER (ORDER BY {metric} DESC, FlowID) AS place FROM inv WHERE {condition} QUALIFY place <= 20)"
    for i, (condition, metric) in enumerate(_LISTS)) + ")", """
SELECT FlowID, priority, place::INT AS place FROM lists QUALIFY row_number() OVER (PARTITION BY FlowID ORDER BY priority, place) = 1"""))
def _(spark, d):
    return SEL.representative_flows(investigated(spark, d)).select("FlowID", "priority", "place")
