"""Names, patterns and constants that results depend on.

Everything in this module is data. The values must equal the published ones for
results to agree, so they are written out plainly and kept in one place.
"""

# --- fixed values: packet export headers ------------------------------------------------
PACKET_COLUMNS = ["Frame_Number", "Time", "Source", "Destination", "Protocol", "Length", "Info"]
REQUIRED_COLUMNS = ["Time", "Length"]
RECOMMENDED_COLUMNS = ["Source", "Destination", "Protocol", "Info"]
HEADER_ALIASES = {
    "No.": "Frame_Number",
    "No": "Frame_Number",
    "Time": "Time",
    "Source": "Source",
    "Src": "Source",
    "ip.src": "Source",
    "Destination": "Destination",
    "Dst": "Destination",
    "ip.dst": "Destination",
    "Protocol": "Protocol",
    "Length": "Length",
    "len": "Length",
    "Info": "Info",
    "SrcPort": "Source_Port",
    "DstPort": "Destination_Port",
    "srcport": "Source_Port",
    "dstport": "Destination_Port",
}

# --- fixed values: packet features ------------------------------------------------------
PORT_PAIR_PATTERN = r"(\d{1,5})\s*(?:→|>|->)\s*(\d{1,5})"
TCP_FLAGS = ["SYN", "ACK", "FIN", "RST", "URG", "PSH", "ECE", "CWR"]
PROTOCOL_PORTS = {
    "HTTP": (80, 80),
    "HTTPS": (443, 443),
    "DNS": (53, 53),
    "MDNS": (5353, 5353),
    "SSDP": (1900, 1900),
    "DHCP": (67, 68),
    "NTP": (123, 123),
    "TLS": (443, 443),
    "TLSV1.2": (443, 443),
    "TLSV1.3": (443, 443),
    "SSL": (443, 443),
    "SSH": (22, 22),
    "FTP": (21, 21),
}
MAX_PACKET_LENGTH = 65535
SMALL_PACKET_MAX = 127
MEDIUM_PACKET_MAX = 512

# --- fixed values: the 37 columns of a flow ---------------------------------------------
FLOW37_COLUMNS = [
    "FlowID", "Source_IP", "Destination_IP", "Source_Port", "Destination_Port", "Protocol",
    "Flow_Duration", "Total_Packets", "Forward_Packets", "Backward_Packets", "Total_Bytes",
    "Avg_Packet_Length", "Median_Packet_Length", "Min_Packet_Length", "Max_Packet_Length",
    "Packet_Length_Var", "Packet_Length_Std", "Packets_Per_Second", "Bytes_Per_Second",
    "Mean_IAT", "Median_IAT", "Min_IAT", "Max_IAT", "Std_IAT", "Flow_Idle_Time", "Flow_Active_Time",
    "SYN_Count", "ACK_Count", "FIN_Count", "RST_Count", "URG_Count", "PSH_Count", "ECE_Count", "CWR_Count",
    "SYN_ACK_Ratio", "FIN_ACK_Ratio", "RST_Ratio",
]

# --- fixed values: the 32 directional flow features -------------------------------------
FLOW32_FEATURES = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Min",
    "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Min",
    "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "PSH Flag Count", "ACK Flag Count",
]

# --- fixed values: cleaning of labelled flow tables -------------------------------------
OVERFLOW_COLUMNS = ["Fwd Header Length", "Bwd Header Length", "Fwd Header Length.1", "min_seg_size_forward"]
NON_NEGATIVE_COLUMNS = [
    "Flow Duration", "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Min",
]

# --- fixed values: label families, first match wins -------------------------------------
BENIGN = "BENIGN"
FAMILY_RULES = [
    (["DoS"], "DoS"),
    (["DDoS"], "DDoS"),
    (["Patator", "Brute Force"], "Brute Force"),
    (["Web Attack", "Sql", "XSS"], "Web Attack"),
    (["Infiltration", "Infilteration"], "Infiltration"),
    (["Bot"], "Botnet"),
    (["PortScan"], "Port Scan"),
    (["Heartbleed"], "Heartbleed"),
]
OTHER_FAMILY = "Other"

# --- fixed values: investigation --------------------------------------------------------
THRESHOLD_DEFAULTS = {
    "pps_95th": 1000.0,
    "bps_95th": 100000.0,
    "iat_5th": 0.001,
    "pkts_95th": 38.0,
    "bytes_95th": 6947.0,
}
REPRESENTATIVE_CATEGORIES = [
    "packet_count", "byte_count", "packet_rate", "syn_heavy", "arp", "dns", "mdns", "udp_quic", "sslv2",
]
DETECTION_REPORT_COLUMNS = [
    "FlowID", "Source_IP", "Destination_IP", "Protocol",
    "RF_Prediction", "RF_Score", "ANN_Prediction", "ANN_Score",
    "Final_Status", "Final_Predicted_Class", "Model_Agreement", "Explanation",
]

# --- fixed values: meaning of the 78 numeric columns ------------------------------------
DEFAULT_MEANING = "Network flow measurement feature."
FEATURE_MEANINGS = {
    "Destination Port": "The destination port number of the network flow connection.",
    "Flow Duration": "Total duration of the network flow in microseconds.",
    "Total Fwd Packets": "Total number of packets sent in the forward direction.",
    "Total Backward Packets": "Total number of packets sent in the backward direction.",
    "Total Length of Fwd Packets": "Total size of packet payloads sent in the forward direction (bytes).",
    "Total Length of Bwd Packets": "Total size of packet payloads sent in the backward direction (bytes).",
    "Fwd Packet Length Max": "Maximum payload length of forward packets.",
    "Fwd Packet Length Min": "Minimum payload length of forward packets.",
    "Fwd Packet Length Mean": "Mean payload length of forward packets.",
    "Fwd Packet Length Std": "Standard deviation of payload length of forward packets.",
    "Bwd Packet Length Max": "Maximum payload length of backward packets.",
    "Bwd Packet Length Min": "Minimum payload length of backward packets.",
    "Bwd Packet Length Mean": "Mean payload length of backward packets.",
    "Bwd Packet Length Std": "Standard deviation of payload length of backward packets.",
    "Flow Bytes/s": "Number of flow payload bytes transferred per second.",
    "Flow Packets/s": "Number of flow packets transferred per second.",
    "Flow IAT Mean": "Mean Inter-Arrival Time between any two consecutive packets in the flow.",
    "Flow IAT Std": "Standard deviation of Inter-Arrival Time between packets in the flow.",
    "Flow IAT Max": "Maximum Inter-Arrival Time between packets in the flow.",
    "Flow IAT Min": "Minimum Inter-Arrival Time between packets in the flow.",
    "Fwd IAT Total": "Total Inter-Arrival Time of packets sent in the forward direction.",
    "Fwd IAT Mean": "Mean Inter-Arrival Time of packets sent in the forward direction.",
    "Fwd IAT Std": "Standard deviation of Inter-Arrival Time of forward packets.",
    "Fwd IAT Max": "Maximum Inter-Arrival Time of forward packets.",
    "Fwd IAT Min": "Minimum Inter-Arrival Time of forward packets.",
    "Bwd IAT Total": "Total Inter-Arrival Time of packets sent in the backward direction.",
    "Bwd IAT Mean": "Mean Inter-Arrival Time of packets sent in the backward direction.",
    "Bwd IAT Std": "Standard deviation of Inter-Arrival Time of backward packets.",
    "Bwd IAT Max": "Maximum Inter-Arrival Time of backward packets.",
    "Bwd IAT Min": "Minimum Inter-Arrival Time of backward packets.",
    "Fwd PSH Flags": "Number of forward packets with the PSH (Push) flag set.",
    "Bwd PSH Flags": "Number of backward packets with the PSH (Push) flag set.",
    "Fwd URG Flags": "Number of forward packets with the URG (Urgent) flag set.",
    "Bwd URG Flags": "Number of backward packets with the URG (Urgent) flag set.",
    "Fwd Header Length": "Total header bytes of packets in the forward direction.",
    "Bwd Header Length": "Total header bytes of packets in the backward direction.",
    "Fwd Packets/s": "Number of forward packets sent per second.",
    "Bwd Packets/s": "Number of backward packets sent per second.",
    "Min Packet Length": "Minimum payload length of any packet in the flow.",
    "Max Packet Length": "Maximum payload length of any packet in the flow.",
    "Packet Length Mean": "Mean payload length of all packets in the flow.",
    "Packet Length Std": "Standard deviation of packet payload lengths in the flow.",
    "Packet Length Variance": "Variance of packet payload lengths in the flow.",
    "FIN Flag Count": "Number of packets with the FIN (Finish) flag set.",
    "SYN Flag Count": "Number of packets with the SYN (Synchronize) flag set.",
    "RST Flag Count": "Number of packets with the RST (Reset) flag set.",
    "PSH Flag Count": "Number of packets with the PSH (Push) flag set.",
    "ACK Flag Count": "Number of packets with the ACK (Acknowledgment) flag set.",
    "URG Flag Count": "Number of packets with the URG (Urgent) flag set.",
    "CWE Flag Count": "Number of packets with the CWE (Congestion Window Reduced) flag set.",
    "ECE Flag Count": "Number of packets with the ECN-Echo (ECE) flag set.",
    "Down/Up Ratio": "Ratio of backward packets to forward packets in the flow.",
    "Average Packet Size": "Average payload size of packets in the flow.",
    "Avg Fwd Segment Size": "Average segment size observed in forward direction.",
    "Avg Bwd Segment Size": "Average segment size observed in backward direction.",
    "Fwd Header Length.1": "Duplicate feature of forward header length (redundant column).",
    "Fwd Avg Bytes/Bulk": "Average number of bytes transferred per bulk in forward direction.",
    "Fwd Avg Packets/Bulk": "Average number of packets transferred per bulk in forward direction.",
    "Fwd Avg Bulk Rate": "Average bulk transfer rate in forward direction.",
    "Bwd Avg Bytes/Bulk": "Average number of bytes transferred per bulk in backward direction.",
    "Bwd Avg Packets/Bulk": "Average number of packets transferred per bulk in backward direction.",
    "Bwd Avg Bulk Rate": "Average bulk transfer rate in backward direction.",
    "Subflow Fwd Packets": "Average number of packets in a forward subflow.",
    "Subflow Fwd Bytes": "Average number of bytes in a forward subflow.",
    "Subflow Bwd Packets": "Average number of packets in a backward subflow.",
    "Subflow Bwd Bytes": "Average number of bytes in a backward subflow.",
    "Init_Win_bytes_forward": "Total bytes sent in initial TCP window in forward direction (-1 if non-TCP).",
    "Init_Win_bytes_backward": "Total bytes sent in initial TCP window in backward direction (-1 if non-TCP).",
    "act_data_pkt_fwd": "Number of forward packets with at least 1 byte of TCP payload.",
    "min_seg_size_forward": "Minimum segment size observed in forward direction (bytes).",
    "Active Mean": "Mean time flow was active before going idle.",
    "Active Std": "Standard deviation of active duration.",
    "Active Max": "Maximum time flow was active before going idle.",
    "Active Min": "Minimum time flow was active before going idle.",
    "Idle Mean": "Mean time flow was idle before becoming active.",
    "Idle Std": "Standard deviation of idle duration.",
    "Idle Max": "Maximum time flow was idle before becoming active.",
    "Idle Min": "Minimum time flow was idle before becoming active.",
}
