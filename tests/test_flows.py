"""Flow construction: hand-made packets, boundaries, busy keys, partition counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowquarry import fixed
from flowquarry.operators import flows as FL
from flowquarry.options import FlowOptions

SCHEMA = "Frame_Number long, Time_ns long, Source string, Destination string, Source_Port int, Destination_Port int, Protocol string, Length int, " + ", ".join(
    f"Flag_{f} int" for f in fixed.TCP_FLAGS)


def packet(frame, seconds, source, target, sport, dport, length=64, protocol="TCP", syn=0, ack=0, fin=0):
    return (frame, round(seconds * 1e9), source, target, sport, dport, protocol, length, syn, ack, fin, 0, 0, 0, 0, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


A, B = "10.0.0.1", "10.0.0.2"


def test_two_flows_from_one_conversation(spark):
    rows = [packet(1, 0.0, A, B, 54321, 80, 64, syn=1), packet(2, 0.1, B, A, 80, 54321, 128, syn=1, ack=1), packet(3, 0.2, A, B, 54321, 80, 64, ack=1),
            packet(4, 200.2, A, B, 54321, 80, 64, ack=1)]
    out = {r.FlowID: r for r in FL.flow37(frame(spark, rows)).collect()}
    first = out["10.0.0.1_10.0.0.2_54321_80_TCP_F0"]
    assert len(out) == 2 and "10.0.0.1_10.0.0.2_54321_80_TCP_F1" in out
    assert (first.Total_Packets, first.Forward_Packets, first.Backward_Packets, first.Total_Bytes) == (3, 2, 1, 256)
    assert first.Flow_Duration == pytest.approx(0.2) and first.Packets_Per_Second == pytest.approx(15)
    assert first.Mean_IAT == pytest.approx(0.2 / 3) and first.Median_IAT == pytest.approx(0.1)
    last = out["10.0.0.1_10.0.0.2_54321_80_TCP_F1"]
    assert (last.Flow_Duration, last.Packet_Length_Std, last.Std_IAT) == (1e-6, 0.0, 0.0)


def test_gap_of_exactly_the_timeout_does_not_split(spark):
    rows = [packet(1, 0.0, A, B, 1, 2), packet(2, 120.0, A, B, 1, 2), packet(3, 240.000000001, A, B, 1, 2)]
    counts = sorted(r.Total_Packets for r in FL.flow37(frame(spark, rows)).collect())
    assert counts == [1, 2]


def test_first_packet_gives_the_direction(spark):
    row = FL.flow37(frame(spark, [packet(2, 0.0, B, A, 80, 99), packet(3, 0.0, A, B, 99, 80)])).first()
    assert (row.Source_IP, row.Source_Port, row.Destination_IP, row.Destination_Port) == (B, 80, A, 99)


def test_equal_addresses(spark):
    rows = frame(spark, [packet(1, 0.0, A, A, 9, 5), packet(2, 0.1, A, A, 5, 9)])
    assert FL.flow37(rows).count() == 2  # ports stay as they are
    assert FL.flow32(rows).count() == 1  # ports are ordered


def test_directional_table_keeps_the_silent_gap(spark):
    rows = frame(spark, [packet(1, 0.0, A, B, 1, 2), packet(2, 1.0, B, A, 2, 1), packet(3, 200.0, A, B, 1, 2), packet(4, 201.0, A, B, 1, 2)])
    out = {r["Flow_ID"][-2:]: r for r in FL.flow32(rows).collect()}
    assert out["F1"]["Flow IAT Max"] == pytest.approx(199e6)
    assert out["F1"]["Fwd IAT Mean"] == pytest.approx((200e6 + 1e6) / 2)
    assert out["F0"]["Bwd IAT Std"] == 0.0 and out["F0"]["Total Backward Packets"] == 1.0
    split = {r.FlowID[-2:]: r for r in FL.flow37(rows).collect()}
    assert split["F1"].Max_IAT == 1.0


def brute_flows(pdf, timeout_ns):
    out = {}
    for key, part in pdf.sort_values(["Time_ns", "Frame_Number"]).groupby(["a", "b", "pa", "pb", "Protocol"]):
        gap = part.Time_ns.diff().fillna(0)
        sub = (gap > timeout_ns).cumsum()
        for number, flow in part.groupby(sub):
            iat = flow.Time_ns.diff().fillna(0) / 1e9
            out["_".join(map(str, key)) + f"_F{number}"] = (len(flow), int(flow.Length.sum()), float(flow.Length.median()), float(iat.median()), float(iat.std(ddof=1)) if len(flow) > 1 else 0.0)
    return out


@pytest.mark.parametrize("partitions, cell, wide", [(1, 120.0, 10**6), (8, 1.0, 10**6), (8, 7.0, 50)])
def test_one_busy_key_holds_a_third_of_all_packets(spark, partitions, cell, wide):
    random = np.random.default_rng(5)
    n = 3000
    busy = random.random(n) < 0.34
    host = np.where(busy, 0, random.integers(1, 60, n))
    pdf = pd.DataFrame({"Frame_Number": np.arange(n), "Time_ns": random.integers(0, 2000 * 10**9, n), "a": A, "b": [f"10.0.1.{h}" for h in host], "pa": 5, "pb": 6,
                        "Protocol": "TCP", "Length": random.integers(40, 1500, n)})
    pdf.loc[pdf.Time_ns % 7 == 0, "Time_ns"] = 10**9  # many equal times
    forward = random.random(n) < 0.5
    rows = [(int(r.Frame_Number), int(r.Time_ns), r.a if f else r.b, r.b if f else r.a, 5 if f else 6, 6 if f else 5, "TCP", int(r.Length), *[0] * 8)
            for r, f in zip(pdf.itertuples(), forward)]
    got = FL.flow37(frame(spark, rows).repartition(partitions), FlowOptions(cell_seconds=cell, wide_flow_packets=wide)).collect()
    want = brute_flows(pdf, 120 * 10**9)
    assert {r.FlowID for r in got} == set(want)
    for r in got:
        assert (r.Total_Packets, r.Total_Bytes, r.Median_Packet_Length) == want[r.FlowID][:3]
        assert r.Median_IAT == pytest.approx(want[r.FlowID][3], abs=1e-12) and r.Std_IAT == pytest.approx(want[r.FlowID][4], rel=1e-9, abs=1e-9)


def test_empty_input(spark):
    assert FL.flow37(frame(spark, [])).count() == 0
    assert FL.flow32(frame(spark, [])).count() == 0


def test_timeout_must_be_positive(spark):
    with pytest.raises(ValueError):
        FL.flow37(frame(spark, []), FlowOptions(timeout_seconds=0))


def test_directional_program_takes_ports_from_the_text_alone(spark):
    from flowquarry.operators.packets import with_packet_features
    from flowquarry.operators import cleaning
    from flowquarry.plans import capture_study

    raw = spark.createDataFrame([
        ("1", "0.0", A, B, "DHCP", "300", "DHCP Discover"), ("2", "0.5", B, A, "DHCP", "310", "DHCP Offer"), ("n/a", "bad", A, B, "DHCP", "oops", None),
        ("4", "1.0", A, B, "TCP", "60", "5 > 80 [SYN]"), ("5", "1.5", B, A, "TCP", "60", "80 > 5 [FIN, ACK]")],
        "Frame_Number string, Time string, Source string, Destination string, Protocol string, Length string, Info string")
    out = {r["Flow_ID"]: r for r in capture_study.directional_capture(raw).collect()}
    dhcp, tcp = out[f"{A}_{B}_-1_-1_DHCP_F0"], out[f"{A}_{B}_5_80_TCP_F0"]
    assert len(out) == 2 and (dhcp["Total Fwd Packets"], dhcp["Total Backward Packets"], dhcp["Min Packet Length"]) == (2.0, 1.0, 0.0)
    assert (tcp["FIN Flag Count"], tcp["ACK Flag Count"], tcp["Flow Duration"]) == (1.0, 1.0, 500_000.0)
    defaults = with_packet_features(cleaning.clean_packets_lenient(raw)).filter("Protocol = 'DHCP'")
    assert defaults.filter("Source_Port = 67 OR Source_Port = 68").count() == 3  # the other program fills in the protocol's ports
    assert capture_study.directional_capture(raw.limit(0)).count() == 0


def test_flow_table_moves_the_packets_of_small_keys_once(spark, folder):
    rows = [packet(i, i * 0.5, *((A, B, 5, 6) if i % 3 else (B, A, 6, 5)), length=40 + i) for i in range(40)]
    frame(spark, rows).write.mode("overwrite").parquet(folder)
    plan = FL.flow37(spark.read.parquet(folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("wide", [0, 3, 7, 10**6])
def test_small_and_busy_keys_give_the_same_flows(spark, wide):
    random = np.random.default_rng(7)
    rows = []
    for i in range(160):
        host, port = int(random.integers(1, 4)), int(random.choice([7, 7, 7, 8, 9]))
        ends = (A, f"10.0.1.{host}", 5, port) if random.random() < 0.5 else (f"10.0.1.{host}", A, port, 5)
        rows.append(list(packet(i, float(random.integers(0, 900)), *ends, length=int(random.integers(40, 1500)), syn=i % 2)))
    for i in range(0, 160, 9):
        rows[i][1] = None  # no time
    for i in range(0, 160, 11):
        rows[i][7] = None  # no length
    rows += [list(packet(900 + i, 50.0, None, A, 1, 2)) for i in range(4)]  # no source: its address becomes UNKNOWN
    for row in rows[-2:]:
        row[6] = None  # no protocol either
    every = FlowOptions(wide_flow_packets=0)
    want = {r.FlowID: r for r in FL.flow37(frame(spark, rows), every).collect()}
    got = {r.FlowID: r for r in FL.flow37(frame(spark, rows).repartition(3), FlowOptions(wide_flow_packets=wide)).collect()}
    assert set(got) == set(want) and len(got) > 20
    for name, flow in want.items():
        for mine, theirs in zip(got[name], flow, strict=True):
            assert mine == (pytest.approx(theirs, rel=1e-9, nan_ok=True) if isinstance(theirs, float) else theirs)
