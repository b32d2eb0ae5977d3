"""Queries over the packet view: sources, cleaning, packet features, windows, flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry import fixed
from flowquarry.catalog import sql as S, views as V
from flowquarry.catalog.book import query, round_to, stored
from flowquarry.functions import columns as C
from flowquarry.operators import cleaning, flows as FL, ordered, packets as P, selection as SEL, statistics as ST
from flowquarry.plans import capture_study
from flowquarry.session import scratch_path
from flowquarry.sources import readers, writers

CLEAN = S.PACKETS + """,
raw_base AS (
SELECT Frame_Number AS n,
  CASE WHEN n % 67 = 0 THEN 'n/a' ELSE CAST(n AS VARCHAR) END AS "No.",
  CASE WHEN n % 101 = 0 THEN 'invalid' WHEN n % 103 = 0 THEN '-1.0'
       ELSE concat(Time_ns // 1000000000, '.', lpad(CAST(Time_ns % 1000000000 AS VARCHAR), 9, '0')) END AS Time,
  CASE WHEN n % 59 = 0 THEN NULL WHEN n % 61 = 0 THEN concat(' ', Source) ELSE Source END AS Source,
  CASE WHEN n % 71 = 0 THEN 'nan' ELSE Destination END AS Destination,
  CASE WHEN n % 73 = 0 THEN '' WHEN n % 79 = 0 THEN ' tcp ' WHEN n % 83 = 0 THEN NULL ELSE Protocol END AS Protocol,
  CASE WHEN n % 107 = 0 THEN '-50' WHEN n % 109 = 0 THEN '70000' WHEN n % 113 = 0 THEN 'oops' ELSE CAST(Length AS VARCHAR) END AS Length,
  CASE WHEN n % 89 = 0 THEN NULL ELSE Info END AS Info,
  CASE WHEN n % 97 = 0 THEN NULL ELSE 'eth0' END AS Interface
FROM packets),
raw_rows AS (SELECT * EXCLUDE n FROM raw_base UNION ALL SELECT * EXCLUDE n FROM raw_base WHERE n % 50 = 0),
distinct_rows AS (SELECT DISTINCT * FROM raw_rows),
typed AS (
SELECT *, CASE WHEN try_cast(Time AS DOUBLE) >= 0 THEN CAST(try_cast(Time AS DECIMAL(28,9)) * 1000000000 AS BIGINT) END AS t,
       CASE WHEN try_cast(Length AS DOUBLE) > 0 AND try_cast(Length AS DOUBLE) <= 65535 THEN CAST(trunc(try_cast(Length AS DOUBLE)) AS INT) END AS l
FROM distinct_rows),
cleaned AS (
SELECT coalesce(try_cast("No." AS BIGINT), -1) AS Frame_Number, t::DOUBLE / 1e9 AS Time,
       CASE WHEN Source IS NULL OR trim(Source) IN ('nan', 'None', '') THEN 'UNKNOWN' ELSE trim(Source) END AS Source,
       CASE WHEN Destination IS NULL OR trim(Destination) IN ('nan', 'None', '') THEN 'UNKNOWN' ELSE trim(Destination) END AS Destination,
       CASE WHEN Protocol IS NULL OR upper(trim(Protocol)) IN ('NAN', 'NONE', '') THEN 'UNKNOWN' ELSE upper(trim(Protocol)) END AS Protocol,
       l AS Length, coalesce(Info, '') AS Info, coalesce(Interface, 'UNKNOWN') AS Interface, t AS Time_ns
FROM typed WHERE t IS NOT NULL AND l IS NOT NULL)"""

TRACED_COLUMNS = "Frame_Number, Time_ns, Source, Destination, Protocol, Length, FlowID"


def flow_table(spark, sf_dir):
    return stored(spark, sf_dir, "flow37", lambda: FL.flow37(V.feature_packets(spark, sf_dir)))


def raw_named(spark, sf_dir):
    return cleaning.standard_headers(V.raw_export(spark, sf_dir))


def _csv_copy(spark, sf_dir):
    """The dirty export as real CSV files, written once."""
    path = None

    def build():
        nonlocal path
        path = scratch_path(spark, "export-csv")
        V.raw_export(spark, sf_dir).write.options(header=True).csv(path)
        return spark.createDataFrame([(path,)], "path string")

    return stored(spark, sf_dir, "export-csv-place", build).first()[0]


# --- sources and sinks -----------------------------------------------------------------
@query("s01_packet_csv_scan", S.with_(CLEAN, "SELECT Protocol, count(*) AS packets, sum(Length)::BIGINT AS bytes FROM cleaned GROUP BY Protocol"))
def _(spark, d):
    rows = cleaning.clean_packets(readers.read_packets(spark, _csv_copy(spark, d)))
    return rows.groupBy("Protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("Length").cast("bigint").alias("bytes"))


@query("s02_s03_csv_dialect", "SELECT ',' AS delimiter, 'UTF-8' AS encoding")
def _(spark, d):
    path = _csv_copy(spark, d)
    return spark.createDataFrame([(readers.detect_delimiter(spark, path), readers.detect_encoding(spark, path))], "delimiter string, encoding string")


@query("s04_row_cap_per_source", S.with_(S.PACKETS, """
SELECT Frame_Number % 2 AS part, least(count(*), 400) AS packets FROM packets GROUP BY 1"""))
def _(spark, d):
    rows = V.packets(spark, d)
    parts = [rows.filter(F.col("Frame_Number") % 2 == i).limit(400) for i in (0, 1)]
    return SEL.union_tables(*parts).groupBy((F.col("Frame_Number") % 2).alias("part")).agg(F.count(F.lit(1)).alias("packets"))


@query("s05_union_of_files", S.with_(S.PACKETS, """
SELECT Frame_Number, Protocol, CASE WHEN Frame_Number % 2 = 0 THEN Info END AS Info FROM packets"""))
def _(spark, d):
    rows = V.packets(spark, d).select("Frame_Number", "Protocol", "Info")
    return SEL.union_tables(rows.filter("Frame_Number % 2 = 0"), rows.filter("Frame_Number % 2 = 1").drop("Info"))


def _labelled_csv(spark, d):
    path = None

    def build():
        nonlocal path
        path = scratch_path(spark, "labelled-csv")
        V.labelled(spark, d).repartition("l_orderkey", "l_linenumber").write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        return spark.createDataFrame([(path,)], "path string")

    return stored(spark, d, "labelled-csv-place", build).first()[0]


@query("s06_directory_scan", S.with_(S.LABELLED, """
SELECT trim(Label) AS Label, count(*) AS "rows", sum(CASE WHEN f_rate IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_rate FROM labelled GROUP BY 1"""))
def _(spark, d):
    rows = readers.read_directory(spark, _labelled_csv(spark, d))
    return rows.groupBy(C.clean_label(F.col("Label")).alias("Label")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("f_rate").isNull().cast("bigint")).alias("missing_rate"))


@query("s07_file_audit", S.with_(S.LABELLED, "SELECT 'lineitem.parquet' AS file_name, trim(Label) AS Label, count(*) AS \"rows\" FROM labelled GROUP BY 2"))
def _(spark, d):
    items = V.table(spark, d, "lineitem").select("*", F.col("_metadata.file_name").alias("file"))
    rows = spark.sql(V.LABELLED_SQL.replace("SELECT l_orderkey,", "SELECT file, l_orderkey,").format(lineitem="{li}"), li=items)
    return ST.file_audit(rows, file=F.col("file"))


@query("s08_header_compatibility", "SELECT true AS compatible, 'l_orderkey,l_linenumber,f_packets,f_bytes,f_iat,f_rate,f_header,Label' AS header")
def _(spark, d):
    return readers.header_compatibility(spark, _labelled_csv(spark, d)).select("compatible", "header").distinct()


@query("s09_flow_table_scan", S.with_(S.FLOWS, "SELECT FlowID, Total_Packets, Total_Bytes FROM flows"))
def _(spark, d):
    path = scratch_path(spark, "flows-parquet")
    flow_table(spark, d).write.parquet(path)
    return readers.read_flow_table(spark, path).select("FlowID", "Total_Packets", "Total_Bytes")


@query("s10_kind_dispatch", "SELECT 'packets' AS kind, count(*) + (SELECT count(*) FROM events WHERE event_id % 50 = 0) AS \"rows\" FROM events")
def _(spark, d):
    path = scratch_path(spark, "dispatch-csv")
    raw_named(spark, d).write.options(header=True).csv(path)
    kind, rows = readers.read_any(spark, path)
    return rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"))


@query("s11_csv_sink", S.with_(S.FLOWS, "SELECT Protocol, count(*) AS flows, sum(Total_Bytes)::BIGINT AS bytes FROM flows GROUP BY 1"))
def _(spark, d):
    path = writers.write_csv(flow_table(spark, d), scratch_path(spark, "flows-csv"))
    back = spark.read.schema("FlowID string, Source_IP string, Destination_IP string, Source_Port int, Destination_Port int, Protocol string, "
                             "Flow_Duration double, Total_Packets bigint, Forward_Packets bigint, Backward_Packets bigint, Total_Bytes bigint").options(header=True).csv(path)
    return back.groupBy("Protocol").agg(F.count(F.lit(1)).alias("flows"), F.sum("Total_Bytes").alias("bytes"))


@query("s12_parquet_sink_partitioned", S.with_(S.FLOWS, "SELECT Protocol, count(*) AS flows FROM flows WHERE Protocol IN ('TCP', 'UDP') GROUP BY 1"))
def _(spark, d):
    path = writers.write_parquet(flow_table(spark, d), scratch_path(spark, "flows-by-protocol"), ["Protocol"])
    return spark.read.parquet(path).filter(F.col("Protocol").isin("TCP", "UDP")).groupBy("Protocol").agg(F.count(F.lit(1)).alias("flows"))


@query("s13_json_sink", S.with_(S.FLOWS, "SELECT FlowID, Total_Packets FROM flows"))
def _(spark, d):
    path = writers.write_json(flow_table(spark, d).select("FlowID", "Total_Packets"), scratch_path(spark, "flows-json"))
    return spark.read.schema("FlowID string, Total_Packets bigint").json(path)


@query("c02_c19_required_columns", "SELECT 'Info' AS missing_recommended, 0::BIGINT AS missing_features, count(*) AS packets FROM events")
def _(spark, d):
    rows = cleaning.require_columns(V.packets(spark, d).drop("Info").withColumn("Time", C.seconds(F.col("Time_ns"))), fixed.REQUIRED_COLUMNS)
    flows32 = cleaning.require_columns(FL.flow32(V.feature_packets(spark, d)), fixed.FLOW32_FEATURES)
    absent = len([c for c in fixed.FLOW32_FEATURES if c not in flows32.columns])
    return rows.agg(F.lit(",".join(cleaning.missing_recommended(rows))).alias("missing_recommended"),
                    F.lit(absent).cast("bigint").alias("missing_features"), F.count(F.lit(1)).alias("packets"))


# --- cleaning --------------------------------------------------------------------------
@query("c01_header_aliases", S.with_(CLEAN, 'SELECT "No." AS Frame_Number, Source, Length FROM raw_rows'))
def _(spark, d):
    return raw_named(spark, d).select("Frame_Number", "Source", "Length")


@query("c03_load_statistics", S.with_(CLEAN, "\nUNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) AS row_count, (count(*) - count(\"{c}\"))::BIGINT AS null_count FROM raw_rows"
    for n, c in [("Frame_Number", "No.")] + [(x, x) for x in ("Time", "Source", "Destination", "Protocol", "Length", "Info", "Interface")])))
def _(spark, d):
    return cleaning.load_statistics(raw_named(spark, d))


@query("c04_exact_duplicates", S.with_(CLEAN, 'SELECT "No." AS Frame_Number, Time, Source, Destination, Protocol, Length, Info, Interface FROM distinct_rows'))
def _(spark, d):
    return cleaning.drop_exact_duplicates(raw_named(spark, d))


@query("c05_c10_clean_packets", S.with_(CLEAN, "SELECT * FROM cleaned"))
def _(spark, d):
    return cleaning.clean_packets(raw_named(spark, d))


@query("c11_cleaning_report", S.with_(CLEAN, """
SELECT (SELECT count(*) FROM raw_rows) AS initial_row_count,
       (SELECT count(*) FROM raw_rows) - count(*) AS duplicate_rows_removed,
       count(*) FILTER (WHERE t IS NULL) AS malformed_rows_removed,
       count(*) FILTER (WHERE t IS NOT NULL AND l IS NULL) AS impossible_values_removed,
       count(*) FILTER (WHERE t IS NOT NULL AND l IS NOT NULL AND Interface IS NULL) AS missing_values_handled,
       count(*) FILTER (WHERE t IS NOT NULL AND l IS NOT NULL) AS final_row_count
FROM typed"""))
def _(spark, d):
    return cleaning.cleaning_report(raw_named(spark, d))


@query("c11_counted_write", S.with_(CLEAN, """
SELECT (SELECT count(*) FROM raw_rows) AS initial_row_count, (SELECT count(*) FROM raw_rows) - count(*) AS duplicate_rows_removed,
       count(*) FILTER (WHERE t IS NULL) AS malformed_rows_removed, count(*) FILTER (WHERE t IS NOT NULL AND l IS NULL) AS impossible_values_removed,
       count(*) FILTER (WHERE t IS NOT NULL AND l IS NOT NULL AND Interface IS NULL) AS missing_values_handled,
       count(*) FILTER (WHERE t IS NOT NULL AND l IS NOT NULL) AS final_row_count,
       (SELECT count(*) FROM cleaned) AS rows_written, (SELECT sum(Length)::BIGINT FROM cleaned) AS bytes_written
FROM typed"""))
def _(spark, d):
    path = scratch_path(spark, "cleaned")
    report = cleaning.clean_to_table(raw_named(spark, d), path)
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_written"), F.sum("Length").alias("bytes_written")).first()
    return report.withColumns({name: F.lit(written[name]).cast("bigint") for name in ("rows_written", "bytes_written")})


@query("c12_lenient_cast", S.with_(CLEAN, """
SELECT "No." AS Frame_Number, CASE WHEN try_cast(Time AS DOUBLE) >= 0 THEN CAST(try_cast(Time AS DECIMAL(28,9)) * 1000000000 AS BIGINT) ELSE 0 END AS Time_ns,
       CAST(coalesce(try_cast(Length AS DOUBLE), 0) AS INT) AS Length, coalesce(Protocol, 'UNKNOWN') AS Protocol
FROM raw_rows"""))
def _(spark, d):
    return cleaning.clean_packets_lenient(raw_named(spark, d)).select("Frame_Number", "Time_ns", "Length", "Protocol")


# --- packet features -------------------------------------------------------------------
@query("p01_p04_ports_and_flags", S.with_(S.FEATURES, f"""
SELECT Frame_Number, Source_Port, Destination_Port, {', '.join('Flag_' + f for f in fixed.TCP_FLAGS)} FROM feature_packets"""))
def _(spark, d):
    return P.with_flags(P.with_ports(V.packets(spark, d))).select("Frame_Number", "Source_Port", "Destination_Port", *[f"Flag_{f}" for f in fixed.TCP_FLAGS])


@query("p03_protocol_ports", S.with_(S.FEATURES.replace("FROM packets)", "FROM (SELECT * REPLACE (CASE WHEN Frame_Number % 3 = 0 THEN '' ELSE Info END AS Info) FROM packets))"), """
SELECT Protocol, Source_Port, Destination_Port, count(*) AS packets FROM feature_packets GROUP BY ALL"""))
def _(spark, d):
    rows = V.packets(spark, d).withColumn("Info", F.when(F.col("Frame_Number") % 3 == 0, "").otherwise(F.col("Info")))
    return P.with_ports(rows).groupBy("Protocol", "Source_Port", "Destination_Port").agg(F.count(F.lit(1)).alias("packets"))


@query("p05_size_class", S.with_(S.FEATURES, """
SELECT Frame_Number, Packet_Size_Category, CAST(Packet_Size_Category = 'SMALL' AS INT) AS Size_Small,
       CAST(Packet_Size_Category = 'MEDIUM' AS INT) AS Size_Medium, CAST(Packet_Size_Category = 'LARGE' AS INT) AS Size_Large FROM feature_packets"""))
def _(spark, d):
    return P.with_size_class(V.packets(spark, d)).select("Frame_Number", "Packet_Size_Category", "Size_Small", "Size_Medium", "Size_Large")


@query("p06_direction", S.with_(S.FEATURES, "SELECT Frame_Number, Direction FROM feature_packets"))
def _(spark, d):
    return P.with_direction(V.packets(spark, d)).select("Frame_Number", "Direction")


# --- whole-capture windows -------------------------------------------------------------
CAPTURE = S.PACKETS + """,
iat AS (
SELECT *, greatest(0, coalesce(Time_ns - lag(Time_ns) OVER (ORDER BY Time_ns, Frame_Number), 0))::DOUBLE / 1e9 AS IAT FROM packets),
rates AS (
SELECT *, 1.0::DOUBLE / (CASE WHEN IAT = 0 THEN 0.000001 ELSE IAT END) AS Instant_Packet_Rate,
       Length::DOUBLE / (CASE WHEN IAT = 0 THEN 0.000001 ELSE IAT END) AS Instant_Bytes_Per_Sec FROM iat)"""


@query("w01_w05_capture_windows", S.with_(CAPTURE, """
SELECT Frame_Number, IAT, round(avg(Length) OVER (ORDER BY Time_ns, Frame_Number ROWS UNBOUNDED PRECEDING), 6) AS Running_Avg_Length,
       round(avg(Length) OVER w, 6) AS Moving_Avg_Length, round(coalesce(stddev_samp(Length) OVER w, 0.0), 4) AS Rolling_Std_Length,
       round(avg(Instant_Packet_Rate) OVER w, 2) AS Rolling_Packet_Rate, round(avg(Instant_Bytes_Per_Sec) OVER w, 1) AS Rolling_Bytes_Per_Sec
FROM rates WINDOW w AS (ORDER BY Time_ns, Frame_Number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""))
def _(spark, d):
    out = ordered.capture_features(V.packets(spark, d))
    out = round_to(round_to(round_to(out, 6, "Running_Avg_Length", "Moving_Avg_Length"), 4, "Rolling_Std_Length"), 2, "Rolling_Packet_Rate")
    return round_to(out, 1, "Rolling_Bytes_Per_Sec").select(
        "Frame_Number", "IAT", "Running_Avg_Length", "Moving_Avg_Length", "Rolling_Std_Length", "Rolling_Packet_Rate", "Rolling_Bytes_Per_Sec")


@query("p07_instant_rates", S.with_(CAPTURE, "SELECT Frame_Number, Instant_Packet_Rate, Instant_Bytes_Per_Sec FROM rates"))
def _(spark, d):
    return ordered.capture_features(V.packets(spark, d)).select("Frame_Number", "Instant_Packet_Rate", "Instant_Bytes_Per_Sec")


@query("w07_global_row_number", S.with_(S.PACKETS, "SELECT Frame_Number, row_number() OVER (ORDER BY Time_ns, Frame_Number) AS rn FROM packets"))
def _(spark, d):
    rows = V.packets(spark, d).select("Frame_Number", "Time_ns")
    return ordered.numbered(rows, [F.col("Time_ns"), F.col("Frame_Number")], "rn").select("Frame_Number", "rn")


# --- flows -----------------------------------------------------------------------------
@query("f01_canonical_key", S.with_(S.KEYED, """
SELECT Frame_Number, ip1 AS Canonical_IP1, ip2 AS Canonical_IP2, p1 AS Canonical_Port1, p2 AS Canonical_Port2, Is_Forward FROM keyed"""))
def _(spark, d):
    return FL.canonical_key(V.feature_packets(spark, d)).select("Frame_Number", *FL.KEY[:4], "Is_Forward")


@query("f02_flow_key_ordered_ports", S.with_(S.FEATURES, """
SELECT Frame_Number, CASE WHEN f THEN concat(Source, '_', Destination, '_', Source_Port, '_', Destination_Port, '_', Protocol)
       ELSE concat(Destination, '_', Source, '_', Destination_Port, '_', Source_Port, '_', Protocol) END AS FlowKey, CAST(f AS INT) AS IsFwd
FROM (SELECT *, Source < Destination OR (Source = Destination AND Source_Port <= Destination_Port) AS f
      FROM (SELECT * REPLACE (CASE WHEN Frame_Number % 5 = 0 THEN Source ELSE Destination END AS Destination) FROM feature_packets))"""))
def _(spark, d):
    rows = V.feature_packets(spark, d).withColumn("Destination", F.when(F.col("Frame_Number") % 5 == 0, F.col("Source")).otherwise(F.col("Destination")))
    keyed = FL.canonical_key(rows, order_ports_on_equal_ip=True)
    return keyed.select("Frame_Number", F.concat_ws("_", *FL.KEY).alias("FlowKey"), F.col("Is_Forward").alias("IsFwd"))


@query("f03_f05_trace_packets", S.with_(S.TRACED, "SELECT Frame_Number, FlowID, iat_ns AS IAT_ns FROM traced"))
def _(spark, d):
    return FL.trace_packets(V.feature_packets(spark, d)).select("Frame_Number", FL.flow_id().alias("FlowID"), "IAT_ns")


@query("f06_flow37", S.with_(S.FLOWS, "SELECT " + S.rounded(fixed.FLOW37_COLUMNS, S.FLOW_DOUBLES) + " FROM flows"))
def _(spark, d):
    return round_to(FL.flow37(V.feature_packets(spark, d)), 6, *S.FLOW_DOUBLES)


@query("f07_f11_flow_rates", S.with_(S.FLOWS, """
SELECT FlowID, Flow_Duration, Backward_Packets, Packets_Per_Second, Bytes_Per_Second, Flow_Idle_Time, Flow_Active_Time,
       SYN_ACK_Ratio, FIN_ACK_Ratio, RST_Ratio FROM flows"""))
def _(spark, d):
    return flow_table(spark, d).select("FlowID", "Flow_Duration", "Backward_Packets", "Packets_Per_Second", "Bytes_Per_Second",
                                       "Flow_Idle_Time", "Flow_Active_Time", "SYN_ACK_Ratio", "FIN_ACK_Ratio", "RST_Ratio")


@query("f12_packets_with_flow_id", S.with_(S.TRACED, f"SELECT {TRACED_COLUMNS} FROM traced"))
def _(spark, d):
    return FL.packets_with_flow_id(V.feature_packets(spark, d)).select(*TRACED_COLUMNS.split(", "))


@query("f13_f14_directional_packets", S.with_(S.TRACED, """
SELECT Frame_Number, CASE WHEN Is_Forward = 1 THEN Length END AS Fwd_Len, CASE WHEN Is_Forward = 0 THEN Length END AS Bwd_Len,
       gap_ns::DOUBLE / 1000.0 AS Flow_IAT_us, CASE WHEN Is_Forward = 1 THEN dir_gap_ns::DOUBLE / 1000.0 END AS Fwd_IAT_us,
       CASE WHEN Is_Forward = 0 THEN dir_gap_ns::DOUBLE / 1000.0 END AS Bwd_IAT_us FROM traced"""))
def _(spark, d):
    return FL.trace_directional(V.feature_packets(spark, d)).select("Frame_Number", "Fwd_Len", "Bwd_Len", "Flow_IAT_us", "Fwd_IAT_us", "Bwd_IAT_us")


def _flow32_sql(traced: str = S.TRACED, length_digits: int = 3) -> str:
    fwd, bwd = "CASE WHEN Is_Forward = 1 THEN {} END", "CASE WHEN Is_Forward = 0 THEN {} END"
    z = lambda e: f"coalesce(({e})::DOUBLE, 0.0::DOUBLE)"
    dur = "greatest((max(Time_ns) - min(Time_ns))::DOUBLE / 1e9, 1e-6)"
    us = "::DOUBLE / 1000.0"
    mean = lambda e: z(f"sum({e})::DOUBLE / count({e})::DOUBLE / 1000.0")
    f_gap, b_gap = fwd.format("dir_gap_ns"), bwd.format("dir_gap_ns")
    exprs = {
        "Flow Duration": "(max(Time_ns) - min(Time_ns))::DOUBLE / 1000.0", "Total Fwd Packets": "sum(Is_Forward)::DOUBLE",
        "Total Backward Packets": "(count(*) - sum(Is_Forward))::DOUBLE",
        "Total Length of Fwd Packets": z(f"sum({fwd.format('Length')})"), "Total Length of Bwd Packets": z(f"sum({bwd.format('Length')})"),
        "Fwd Packet Length Max": z(f"max({fwd.format('Length')})"), "Fwd Packet Length Min": z(f"min({fwd.format('Length')})"),
        "Fwd Packet Length Std": z(f"stddev_samp({fwd.format('Length')})"),
        "Bwd Packet Length Max": z(f"max({bwd.format('Length')})"), "Bwd Packet Length Min": z(f"min({bwd.format('Length')})"),
        "Bwd Packet Length Std": z(f"stddev_samp({bwd.format('Length')})"),
        "Flow Bytes/s": f"sum(Length)::DOUBLE / {dur}", "Flow Packets/s": f"count(*)::DOUBLE / {dur}",
        "Flow IAT Mean": mean("gap_ns"), "Flow IAT Std": z(f"stddev_samp(gap_ns{us})"), "Flow IAT Max": f"max(gap_ns){us}", "Flow IAT Min": f"min(gap_ns){us}",
        "Fwd IAT Mean": mean(f_gap), "Fwd IAT Std": z(f"stddev_samp(({f_gap}){us})"), "Fwd IAT Min": z(f"min({f_gap}){us}"),
        "Bwd IAT Mean": mean(b_gap), "Bwd IAT Std": z(f"stddev_samp(({b_gap}){us})"), "Bwd IAT Min": z(f"min({b_gap}){us}"),
        "Fwd Packets/s": f"sum(Is_Forward)::DOUBLE / {dur}", "Bwd Packets/s": f"(count(*) - sum(Is_Forward))::DOUBLE / {dur}",
        "Min Packet Length": "min(Length)::DOUBLE", "Max Packet Length": "max(Length)::DOUBLE",
        "Packet Length Std": z("stddev_samp(Length)"), "Packet Length Variance": z("var_samp(Length)"),
        "FIN Flag Count": "sum(Flag_FIN)::DOUBLE", "PSH Flag Count": "sum(Flag_PSH)::DOUBLE", "ACK Flag Count": "sum(Flag_ACK)::DOUBLE",
    }
    assert list(exprs) == fixed.FLOW32_FEATURES
    digits = {n: length_digits if "Packet Length" in n else 3 for n in exprs if "Std" in n or n.endswith("Variance")}
    cols = [f'round({e}, {digits[n]}) AS "{n}"' if n in digits else f'{e} AS "{n}"' for n, e in exprs.items()]
    return S.with_(traced, f"""
SELECT FlowID AS Flow_ID, arg_min(Source, Time_ns * 10000000 + Frame_Number) AS Source_IP, arg_min(Destination, Time_ns * 10000000 + Frame_Number) AS Destination_IP,
       any_value(Protocol) AS Protocol, {', '.join(cols)} FROM traced GROUP BY FlowID""")


FLOW32 = _flow32_sql()
# Sums merged in another order than row by row: lengths are compared finer than the ties of three digits (a sixteenth of a unit).
FLOW32_FINE = _flow32_sql(length_digits=6)


@query("f15_f16_flow32", FLOW32)
def _(spark, d):
    out = FL.flow32(V.feature_packets(spark, d))
    return round_to(out, 3, *[c for c in fixed.FLOW32_FEATURES if "Std" in c or c.endswith("Variance")])


# The export holds copies of rows: equal in time and frame number, so they must fall into one flow whichever a window puts first.
COPIES_TOGETHER = S.FLOW_STEPS.replace("ROWS UNBOUNDED PRECEDING", "RANGE UNBOUNDED PRECEDING")
LENIENT = CLEAN + f""",
lenient AS (
SELECT coalesce(try_cast("No." AS BIGINT), -1) AS Frame_Number, coalesce(Source, '0.0.0.0') AS Source, coalesce(Destination, '0.0.0.0') AS Destination,
       CASE WHEN try_cast(Time AS DOUBLE) >= 0 THEN CAST(try_cast(Time AS DECIMAL(28,9)) * 1000000000 AS BIGINT) ELSE 0 END AS Time_ns,
       coalesce(Protocol, 'UNKNOWN') AS Protocol, CAST(coalesce(try_cast(Length AS DOUBLE), 0) AS INT) AS Length, coalesce(Info, '') AS Info FROM raw_rows),
ported AS (
SELECT *, {', '.join(f"coalesce(try_cast({S.INFO_PORT % i} AS INT), -1) AS {n}" for i, n in ((1, 'Source_Port'), (2, 'Destination_Port')))},
       {', '.join(f"CAST(contains(upper(Info), '{f}') AS INT) AS Flag_{f}" for f in ('FIN', 'PSH', 'ACK'))} FROM lenient),
keyed AS (
SELECT * EXCLUDE fwd, CASE WHEN fwd THEN Source ELSE Destination END AS ip1, CASE WHEN fwd THEN Destination ELSE Source END AS ip2,
       CASE WHEN fwd THEN Source_Port ELSE Destination_Port END AS p1, CASE WHEN fwd THEN Destination_Port ELSE Source_Port END AS p2, CAST(fwd AS INT) AS Is_Forward
FROM (SELECT *, Source < Destination OR (Source = Destination AND Source_Port <= Destination_Port) AS fwd FROM ported))""" + COPIES_TOGETHER


@query("e2_directional_capture", _flow32_sql(LENIENT))
def _(spark, d):
    out = capture_study.directional_capture(raw_named(spark, d))
    return round_to(out, 3, *[c for c in fixed.FLOW32_FEATURES if "Std" in c or c.endswith("Variance")])


@query("p12_p14_flow_projection", S.with_(S.FLOWS, """
SELECT FlowID, concat_ws('_', Source_IP, Destination_IP, Protocol) AS pair_name, 'Packet Length Std' AS metric_title FROM flows"""))
def _(spark, d):
    return flow_table(spark, d).select(
        "FlowID", F.concat_ws("_", "Source_IP", "Destination_IP", "Protocol").alias("pair_name"),
        SEL.title_case(F.lit("packet_length_std")).alias("metric_title"))


# --- joins and tracing -----------------------------------------------------------------
@query("j01_idle_left_join", S.with_(S.FLOWS, "SELECT FlowID, Flow_Idle_Time FROM flows"))
def _(spark, d):
    idle = FL.idle_times(FL.packets_with_flow_id(V.feature_packets(spark, d)))
    return SEL.attach_idle(flow_table(spark, d).select("FlowID", "Flow_Idle_Time"), idle)


@query("j03_packets_of_one_flow", S.with_(S.FLOWS, f"""
SELECT {TRACED_COLUMNS} FROM traced WHERE FlowID = (SELECT FlowID FROM flows ORDER BY Total_Packets DESC, FlowID LIMIT 1)"""))
def _(spark, d):
    busiest = SEL.top_flows(flow_table(spark, d), "Total_Packets", 1).first()["FlowID"]
    return SEL.packets_of_flow(FL.packets_with_flow_id(V.feature_packets(spark, d)), busiest).select(*TRACED_COLUMNS.split(", "))


@query("j04_packets_of_many_flows", S.with_(S.FLOWS, f"""
SELECT {TRACED_COLUMNS} FROM traced WHERE FlowID IN (SELECT FlowID FROM flows WHERE Total_Bytes % 3 = 0)"""))
def _(spark, d):
    ids = flow_table(spark, d).filter(F.col("Total_Bytes") % 3 == 0)
    return SEL.packets_of_flows(FL.packets_with_flow_id(V.feature_packets(spark, d)), ids).select(*TRACED_COLUMNS.split(", "))


@query("k07_chronological_sort", S.with_(S.TRACED, """
SELECT Frame_Number, FlowID, row_number() OVER (PARTITION BY FlowID ORDER BY Time_ns, Frame_Number) AS place FROM traced"""))
def _(spark, d):
    # global order over (flow, time, frame); the place in the flow is the distance to its first row
    rows = FL.packets_with_flow_id(V.feature_packets(spark, d)).select("Frame_Number", "FlowID", "Time_ns")
    numbered = ordered.numbered(rows, [F.col("FlowID"), F.col("Time_ns"), F.col("Frame_Number")], "rn")
    first = numbered.groupBy("FlowID").agg(F.min("rn").alias("first"))
    return numbered.join(first, "FlowID").select("Frame_Number", "FlowID", (F.col("rn") - F.col("first") + 1).alias("place"))
