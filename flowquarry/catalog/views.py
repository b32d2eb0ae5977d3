"""Views that turn the shared tables into packets, labelled flows and dirty exports.

Time in the packet view is compressed 3600-fold, so the 120 s timeout stands for five days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowquarry.functions import columns as C
from flowquarry.operators.packets import with_packet_features

EPOCH_MICROS = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from_events(events: DataFrame) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    user = F.concat(F.lit("10.0.0."), F.col("user_id") % 250)
    server = F.concat(F.lit("10.0.1."), F.col("user_id") % 4)
    port = (F.lit(1024) + F.col("user_id")).cast("string")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    # a column of its own: in the branches below it would be parsed for each of them
    events = events.withColumn("_kind", F.get_json_object("props", "$.k").cast("int") % 4)
    kind = F.col("_kind")
    flag = F.when(kind == 0, "SYN").when(kind == 1, "SYN, ACK").when(kind == 2, "PSH, ACK").otherwise("FIN, ACK")
    protocol = (
        F.when(F.col("event_type") == "view", "TCP").when(F.col("event_type") == "click", "UDP")
        .when(F.col("event_type") == "purchase", "TLSV1.2").when(F.col("event_type") == "signup", "DNS")
        .otherwise("ARP")
    )
    return events.select(
        F.col("event_id").alias("Frame_Number"),
        (F.floor(micros / 3600).cast("bigint") * 1000).alias("Time_ns"),
        F.when(even, user).otherwise(server).alias("Source"),
        F.when(even, server).otherwise(user).alias("Destination"),
        protocol.alias("Protocol"),
        (F.lit(40) + F.floor(F.col("value") * 10).cast("int")).alias("Length"),
        F.concat(F.when(even, F.concat(port, F.lit(" > 80"))).otherwise(F.concat(F.lit("80 > "), port)),
                 F.lit(" ["), flag, F.lit("]")).alias("Info"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def feature_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_packet_features(packets(spark, sf_dir))


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet view as a text export with planted faults: bad times and lengths, padded and
    missing names, invalid frame numbers, and a second copy of every fiftieth row."""
    base = packets(spark, sf_dir)
    n = F.col("Frame_Number")
    nanos = F.col("Time_ns")
    time = F.concat(F.floor(nanos / C.NANOS).cast("string"), F.lit("."), F.lpad((nanos % C.NANOS).cast("string"), 9, "0"))
    text = base.select(
        F.when(n % 67 == 0, "n/a").otherwise(n.cast("string")).alias("No."),
        F.when(n % 101 == 0, "invalid").when(n % 103 == 0, "-1.0").otherwise(time).alias("Time"),
        F.when(n % 59 == 0, F.lit(None)).when(n % 61 == 0, F.concat(F.lit(" "), "Source")).otherwise(F.col("Source")).alias("Source"),
        F.when(n % 71 == 0, "nan").otherwise(F.col("Destination")).alias("Destination"),
        F.when(n % 73 == 0, "").when(n % 79 == 0, " tcp ").when(n % 83 == 0, F.lit(None)).otherwise(F.col("Protocol")).alias("Protocol"),
        F.when(n % 107 == 0, "-50").when(n % 109 == 0, "70000").when(n % 113 == 0, "oops")
        .otherwise(F.col("Length").cast("string")).alias("Length"),
        F.when(n % 89 == 0, F.lit(None)).otherwise(F.col("Info")).alias("Info"),
        F.when(n % 97 == 0, F.lit(None)).otherwise("eth0").alias("Interface"),
        n.alias("_n"),
    )
    copies = F.when(F.col("_n") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return text.withColumn("_copy", F.explode(copies)).drop("_n", "_copy")


LABELLED_SQL = """
SELECT l_orderkey, l_linenumber,
       l_quantity AS f_packets, l_extendedprice AS f_bytes, l_discount AS f_iat,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_extendedprice / l_quantity END AS f_rate,
       CASE WHEN l_orderkey % 83 = 0 THEN -1.0 * l_tax - 1.0 ELSE l_tax END AS f_header,
       CASE l_returnflag WHEN 'N' THEN 'BENIGN'
            WHEN 'A' THEN CASE l_linenumber % 3 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'PortScan' ELSE 'FTP-Patator' END
            ELSE CASE l_linenumber % 2 WHEN 0 THEN ' Bot ' ELSE 'Web Attack - XSS' END END AS Label
FROM {lineitem}
"""
LABELLED_FEATURES = ["f_packets", "f_bytes", "f_iat", "f_rate", "f_header"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LABELLED_SQL.format(lineitem="{li}"), li=table(spark, sf_dir, "lineitem"))


#: Labels that the features explain, for the models: bounds on packets and gaps, one a family.
TRAFFIC_LABELS = {
    "f_packets >= 40 AND f_iat <= 0.04": "DDoS", "f_packets <= 6": "PortScan", "f_packets BETWEEN 7 AND 25 AND f_iat >= 0.09": " Bot ",
    "f_packets BETWEEN 33 AND 39 AND f_iat <= 0.02": "FTP-Patator", "f_packets BETWEEN 26 AND 32 AND f_iat BETWEEN 0.05 AND 0.08": "Web Attack - XSS",
}
TRAFFIC_ATTACK = "(" + " OR ".join(f"({x})" for x in TRAFFIC_LABELS) + ")"


def with_traffic_label(flows: DataFrame) -> DataFrame:
    cases = " ".join(f"WHEN {condition} THEN '{label}'" for condition, label in TRAFFIC_LABELS.items())
    return flows.withColumn("Label", F.expr(f"CASE {cases} ELSE 'BENIGN' END"))
