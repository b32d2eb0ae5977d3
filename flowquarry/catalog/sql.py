"""Building blocks of the check SQL: common table expressions for the derived views."""

from __future__ import annotations

from flowquarry import fixed
from flowquarry.catalog.views import LABELLED_SQL

PACKETS = """
packets AS (
SELECT event_id AS Frame_Number,
       ((epoch_us(ts) - 1704067200000000) // 3600) * 1000 AS Time_ns,
       CASE WHEN event_id % 2 = 0 THEN concat('10.0.0.', user_id % 250) ELSE concat('10.0.1.', user_id % 4) END AS Source,
       CASE WHEN event_id % 2 = 0 THEN concat('10.0.1.', user_id % 4) ELSE concat('10.0.0.', user_id % 250) END AS Destination,
       CASE event_type WHEN 'view' THEN 'TCP' WHEN 'click' THEN 'UDP' WHEN 'purchase' THEN 'TLSV1.2' WHEN 'signup' THEN 'DNS' ELSE 'ARP' END AS Protocol,
       40 + CAST(floor(value * 10) AS INT) AS Length,
       concat(CASE WHEN event_id % 2 = 0 THEN concat(1024 + user_id, ' > 80') ELSE concat('80 > ', 1024 + user_id) END, ' [',
              CASE CAST(json_extract_string(props, '$.k') AS INT) % 4 WHEN 0 THEN 'SYN' WHEN 1 THEN 'SYN, ACK' WHEN 2 THEN 'PSH, ACK' ELSE 'FIN, ACK' END, ']') AS Info
FROM events)"""

INFO_PORT = r"regexp_extract(Info, '(\d{1,5})\s*(?:→|>|->)\s*(\d{1,5})', %d)"
_FALLBACK = {
    side: "CASE Protocol " + " ".join(f"WHEN '{p}' THEN {v[side]}" for p, v in fixed.PROTOCOL_PORTS.items()) + " ELSE -1 END"
    for side in (0, 1)
}


def _port(side: int) -> str:
    found = INFO_PORT % (side + 1)
    return f"CASE WHEN {found} <> '' THEN CAST({found} AS INT) ELSE {_FALLBACK[side]} END"


FEATURES = PACKETS + f""",
feature_packets AS (
SELECT *, {_port(0)} AS Source_Port, {_port(1)} AS Destination_Port,
       {', '.join(f"CAST(contains(upper(Info), '{f}') AS INT) AS Flag_{f}" for f in fixed.TCP_FLAGS)},
       CASE WHEN Length <= 127 THEN 'SMALL' WHEN Length <= 512 THEN 'MEDIUM' ELSE 'LARGE' END AS Packet_Size_Category,
       CAST(Source < Destination AS INT) AS Direction
FROM packets)"""

KEYED = FEATURES + """,
keyed AS (
SELECT *, CASE WHEN Source <= Destination THEN Source ELSE Destination END AS ip1,
       CASE WHEN Source <= Destination THEN Destination ELSE Source END AS ip2,
       CASE WHEN Source <= Destination THEN Source_Port ELSE Destination_Port END AS p1,
       CASE WHEN Source <= Destination THEN Destination_Port ELSE Source_Port END AS p2,
       CAST(Source <= Destination AS INT) AS Is_Forward
FROM feature_packets)"""

#: From ``keyed`` to ``traced``: gaps, subflow numbers, flow ids.
FLOW_STEPS = """,
gaps AS (
SELECT *, coalesce(Time_ns - lag(Time_ns) OVER (PARTITION BY ip1, ip2, p1, p2, Protocol ORDER BY Time_ns, Frame_Number), 0) AS gap_ns,
       coalesce(Time_ns - lag(Time_ns) OVER (PARTITION BY ip1, ip2, p1, p2, Protocol, Is_Forward ORDER BY Time_ns, Frame_Number), 0) AS dir_gap_ns
FROM keyed),
numbered AS (
SELECT *, sum(CASE WHEN gap_ns > 120000000000 THEN 1 ELSE 0 END)
          OVER (PARTITION BY ip1, ip2, p1, p2, Protocol ORDER BY Time_ns, Frame_Number ROWS UNBOUNDED PRECEDING)::INT AS sub
FROM gaps),
traced AS (
SELECT *, concat(ip1, '_', ip2, '_', p1, '_', p2, '_', Protocol, '_F', sub) AS FlowID,
       CASE WHEN gap_ns > 120000000000 THEN 0 ELSE gap_ns END AS iat_ns
FROM numbered)"""
TRACED = KEYED + FLOW_STEPS

FLOWS = TRACED + f""",
flow_base AS (
SELECT FlowID, arg_min(Source, Time_ns * 10000000 + Frame_Number) AS Source_IP,
       arg_min(Destination, Time_ns * 10000000 + Frame_Number) AS Destination_IP,
       arg_min(Source_Port, Time_ns * 10000000 + Frame_Number) AS Source_Port,
       arg_min(Destination_Port, Time_ns * 10000000 + Frame_Number) AS Destination_Port,
       any_value(Protocol) AS Protocol,
       greatest(0.000001, (max(Time_ns) - min(Time_ns))::DOUBLE / 1e9) AS Flow_Duration,
       count(*) AS Total_Packets, sum(Is_Forward)::BIGINT AS Forward_Packets,
       (count(*) - sum(Is_Forward))::BIGINT AS Backward_Packets, sum(Length)::BIGINT AS Total_Bytes,
       sum(Length)::DOUBLE / count(*)::DOUBLE AS Avg_Packet_Length, median(Length)::DOUBLE AS Median_Packet_Length,
       min(Length) AS Min_Packet_Length, max(Length) AS Max_Packet_Length,
       coalesce(var_samp(Length), 0.0) AS Packet_Length_Var, coalesce(stddev_samp(Length), 0.0) AS Packet_Length_Std,
       sum(iat_ns)::DOUBLE / count(*)::DOUBLE / 1e9 AS Mean_IAT, median(iat_ns)::DOUBLE / 1e9 AS Median_IAT,
       min(iat_ns)::DOUBLE / 1e9 AS Min_IAT, max(iat_ns)::DOUBLE / 1e9 AS Max_IAT,
       coalesce(stddev_samp(iat_ns::DOUBLE / 1e9), 0.0) AS Std_IAT,
       sum(CASE WHEN iat_ns >= 1000000000 THEN iat_ns ELSE 0 END)::DOUBLE / 1e9 AS Flow_Idle_Time,
       {', '.join(f"sum(Flag_{f})::BIGINT AS {f}_Count" for f in fixed.TCP_FLAGS)}
FROM traced GROUP BY FlowID),
flows AS (
SELECT *, Total_Packets::DOUBLE / Flow_Duration AS Packets_Per_Second, Total_Bytes::DOUBLE / Flow_Duration AS Bytes_Per_Second,
       greatest(0.0::DOUBLE, Flow_Duration - Flow_Idle_Time) AS Flow_Active_Time,
       SYN_Count::DOUBLE / (ACK_Count::DOUBLE + 1e-6) AS SYN_ACK_Ratio, FIN_Count::DOUBLE / (ACK_Count::DOUBLE + 1e-6) AS FIN_ACK_Ratio,
       RST_Count::DOUBLE / (Total_Packets::DOUBLE + 1e-6) AS RST_Ratio
FROM flow_base)"""

# Everything else is the same IEEE arithmetic on exact integer sums in both engines.
FLOW_DOUBLES = ["Packet_Length_Var", "Packet_Length_Std", "Std_IAT"]

LABELLED = "labelled AS (" + LABELLED_SQL.format(lineitem="lineitem") + ")"


def with_(cte: str, body: str) -> str:
    return f"WITH {cte.strip()}\n{body.strip()}"


def rounded(cols: list[str], doubles: list[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' if c in doubles else f'"{c}"' for c in cols)
