"""Top lists of all criteria in one scan."""

from flowquarry import fixed
from flowquarry.operators import selection as SEL

SCHEMA = "FlowID string, Protocol string, Total_Packets long, Total_Bytes long, Packets_Per_Second double, SYN_Count long, place int"
PROTOCOLS = ["TCP", "UDP", "ARP", "DNS", "MDNS", "QUIC", "SSLV2", None]


def flows():
    return [(f"f{i:03}", PROTOCOLS[i * i % 8], i % 7, None if i % 5 == 0 else i * 31 % 97, float(i % 3), i % 4, -1) for i in range(150)]


def lists(rows, n):
    def best(rows, metric):
        return sorted(rows, key=lambda r: (r[metric] is None, -(r[metric] or 0), r[0]))[:n]

    def of(*names):
        return sorted(r for r in rows if r[1] in names)[:n]

    return [best(rows, 2), best(rows, 3), best(rows, 4), best([r for r in rows if r[1] == "TCP"], 5), of("ARP"), of("DNS"), of("MDNS"), of("UDP", "QUIC"), of("SSLV2")]


def test_lists_and_their_union_keep_the_order(spark):
    rows = flows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = [(name, i, j + 1, r[0]) for i, (name, part) in enumerate(zip(fixed.REPRESENTATIVE_CATEGORIES, lists(rows, 12), strict=True)) for j, r in enumerate(part)]
    got = SEL.top_lists(df, 12)
    assert sorted((r.priority, r.place, r.criterion, r.FlowID) for r in got.collect()) == sorted((i, j, name, f) for name, i, j, f in want)
    union = list(dict.fromkeys(f for _, _, _, f in want))
    assert [r.FlowID for r in SEL.representative_flows(df, "all", 12).collect()] == union and len(union) < len(want)
    for i, name in enumerate(fixed.REPRESENTATIVE_CATEGORIES):
        assert [r.FlowID for r in SEL.representative_flows(df, name.upper(), 12).collect()] == [f for _, k, _, f in want if k == i]


def test_one_scan_limited_before_the_shuffle(spark, folder):
    spark.createDataFrame(flows(), SCHEMA).write.mode("overwrite").parquet(folder)
    plan = SEL.representative_flows(spark.read.parquet(folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan
    assert SEL.representative_flows(spark.read.parquet(folder).limit(0)).count() == 0
