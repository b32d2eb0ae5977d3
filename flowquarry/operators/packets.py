"""Packet-level features that need no neighbouring row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowquarry import fixed
from flowquarry.functions import columns as C


def with_ports(df: DataFrame) -> DataFrame:
    """Ports from columns, else from the info text, else from the protocol, else -1."""
    has_info = "Info" in df.columns
    if has_info:
        # The pair counts only when both numbers are present, which the pattern guarantees.
        df = df.withColumns({
            "_p1": C.port_from_info(F.col("Info"), 1),
            "_p2": C.port_from_info(F.col("Info"), 2),
        })
    ports = {}
    for side, name in ((1, "Source_Port"), (2, "Destination_Port")):
        port = C.whole_number(F.col(name)) if name in df.columns else F.lit(-1)
        if has_info:
            port = F.when(port == -1, F.col(f"_p{side}")).otherwise(port)
            port = F.when(port == -1, C.protocol_port(F.col("Protocol"), side)).otherwise(port)
        ports[name] = port
    return df.withColumns(ports).drop("_p1", "_p2")


def with_info_ports(df: DataFrame) -> DataFrame:
    """Ports from the info text only; -1 on both sides where it names none, whatever the protocol."""
    text = F.coalesce(F.col("Info").cast("string"), F.lit(""))
    return df.withColumns({"Source_Port": C.port_from_info(text, 1), "Destination_Port": C.port_from_info(text, 2)})


def with_flags(df: DataFrame, flags: list[str] | None = None, bracketed_only: bool = False) -> DataFrame:
    flags = flags or fixed.TCP_FLAGS
    if "Info" not in df.columns:
        return df.withColumns({f"Flag_{f}": F.lit(0) for f in flags})
    return df.withColumns({f"Flag_{f}": C.has_flag(F.col("Info"), f, bracketed_only) for f in flags})


def with_size_class(df: DataFrame) -> DataFrame:
    label = C.size_class(F.col("Length"))
    return df.withColumns({
        "Packet_Size_Category": label,
        "Size_Small": (label == "SMALL").cast("int"),
        "Size_Medium": (label == "MEDIUM").cast("int"),
        "Size_Large": (label == "LARGE").cast("int"),
    })


def with_direction(df: DataFrame) -> DataFrame:
    if "Source" in df.columns and "Destination" in df.columns:
        return df.withColumn("Direction", (F.col("Source") < F.col("Destination")).cast("int"))
    return df.withColumn("Direction", F.lit(1))


def with_packet_features(df: DataFrame, bracketed_only: bool = False) -> DataFrame:
    return with_direction(with_flags(with_ports(with_size_class(df)), bracketed_only=bracketed_only))
