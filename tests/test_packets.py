"""Loader, cleaner and packet features on hand-made packets with exact expected values."""

import os

import pytest
from pyspark.sql import functions as F

from flowquarry.catalog import packet_queries
from flowquarry.functions import columns as C
from flowquarry.operators import cleaning, ordered, packets as P
from flowquarry.sources import readers, writers

EXPORT = '''"No.","Time","Source","Destination","Protocol","Length","Info"
"1","0.000000000","10.0.0.1","10.0.0.2","TCP","66","54321 → 80 [SYN] Seq=0"
"2","0.100000000","10.0.0.2","10.0.0.1","TCP","66","80 → 54321 [SYN, ACK] Seq=0"
"3","0.200000000","10.0.0.1","10.0.0.2","TCP","1500","54321 → 80 [ACK] Seq=1"
'''


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path


def test_export_is_read_with_standard_names(spark, folder):
    rows = readers.read_packets(spark, write(folder, "a.csv", EXPORT))
    assert rows.columns == ["Frame_Number", "Time", "Source", "Destination", "Protocol", "Length", "Info"]
    assert rows.count() == 3
    ported = P.with_ports(cleaning.clean_packets(rows)).orderBy("Frame_Number").collect()
    assert [(r.Source_Port, r.Destination_Port) for r in ported] == [(54321, 80), (80, 54321), (54321, 80)]


def test_missing_empty_and_incomplete_inputs(spark, folder):
    with pytest.raises(FileNotFoundError):
        readers.read_packets(spark, os.path.join(folder, "none.csv"))
    with pytest.raises(ValueError):
        readers.read_packets(spark, write(folder, "empty.csv", ""))
    with pytest.raises(ValueError, match="Length"):
        readers.read_packets(spark, write(folder, "b.csv", "Time,Source\n1,a\n"))


def test_delimiter_encoding_and_uneven_lines(spark, folder):
    path = write(folder, "c.csv", "Time;Length;Info\n1;10;caf\xe9\n2;20\n3;30;x;y\n4;40;\"a;b\"\n", "latin-1")
    assert readers.detect_delimiter(spark, path) == ";"
    assert readers.detect_encoding(spark, path) == "ISO-8859-1"
    rows = readers.read_packets(spark, path).orderBy("Time").collect()
    assert [(r.Time, r.Info) for r in rows] == [("1", "caf\xe9"), ("2", None), ("4", "a;b")]


def test_aliases_and_merge(spark, folder):
    one = write(folder, "d.csv", "ip.src,ip.dst,Time,len\na,b,1,10\n")
    two = write(folder, "e.csv", EXPORT)
    merged = readers.merge_packets(spark, [one, two], limit=2)
    assert merged.count() == 3
    row = merged.filter(F.col("Source") == "a").first()
    assert (row.Destination, row.Length, row.Info) == ("b", "10", None)


def test_windows_1252_text(spark):
    row = spark.createDataFrame([("Web Attack \x96 XSS",)], "t string").select(readers.from_windows_1252(F.col("t"))).first()
    assert row[0] == "Web Attack – XSS"


def test_repeated_headers_get_numbers():
    assert cleaning.numbered_repeats([" Fwd Header Length", "Fwd Header Length", "Label"]) == ["Fwd Header Length", "Fwd Header Length.1", "Label"]


def test_kind_dispatch(spark, folder):
    assert readers.read_any(spark, write(folder, "f.csv", EXPORT))[0] == "packets"
    with pytest.raises(ValueError, match="features missing"):
        readers.read_any(spark, write(folder, "g.csv", "a,b\n1,2\n"))


def test_cleaner(spark):
    raw = spark.createDataFrame(
        [("0.0", "a", "b", " tcp ", "64", "i"), ("0.0", "a", "b", " tcp ", "64", "i"), ("-1.0", "a", "b", "TCP", "64", "i"),
         ("0.5", "a", "b", "TCP", "-50", "i"), ("invalid", "a", "b", "TCP", "100", "i")],
        "Time string, Source string, Destination string, Protocol string, Length string, Info string")
    kept = cleaning.clean_packets(raw).collect()
    assert [(r.Time_ns, r.Protocol, r.Length) for r in kept] == [(0, "TCP", 64)]
    report = cleaning.cleaning_report(raw).first().asDict()
    assert report == {"initial_row_count": 5, "duplicate_rows_removed": 1, "malformed_rows_removed": 2,
                      "impossible_values_removed": 1, "missing_values_handled": 0, "final_row_count": 1}
    assert cleaning.clean_packets_lenient(raw).count() == 5


def test_counters_of_a_write_are_those_of_the_report(spark, folder):
    schema = "Frame_Number string, Time string, Source string, Destination string, Protocol string, Length string, Info string, Extra string"
    rows = [(str(i % 90), ["0.5", "bad", "-1", "7.25", None][i % 5], "a", None, " tcp ", ["64", "-50", "x", "70000", "1500", None][i % 6], None, None if i % 4 else "e") for i in range(400)]
    rows += [("1", "0.5", "a", "b", "TCP", "64", "i", None)] * 300  # a large group of copies
    raw = spark.createDataFrame(rows, schema).repartition(6)
    report = cleaning.clean_to_table(raw, f"{folder}/cleaned")
    assert report.first() == cleaning.cleaning_report(raw).first() and report.columns == cleaning.cleaning_report(raw).columns
    written = spark.read.parquet(f"{folder}/cleaned")
    want = cleaning.clean_packets(raw)
    assert written.columns == want.columns and written.exceptAll(want).count() == want.exceptAll(written).count() == 0
    assert 0 < report.first().final_row_count == written.count() < 400 and report.first().duplicate_rows_removed >= 299
    empty = cleaning.clean_to_table(raw.limit(0), f"{folder}/empty")
    assert set(empty.first()) == {0} and spark.read.parquet(f"{folder}/empty").count() == 0


def test_times_keep_nanoseconds_and_reject_nan(spark):
    rows = spark.createDataFrame([("12.000000001",), ("nan",), ("inf",), ("1e-3",), (" 7 ",)], "t string")
    assert [r[0] for r in rows.select(C.time_ns(F.col("t"))).collect()] == [12_000_000_001, None, None, 1_000_000, 7_000_000_000]


def test_packet_features(spark):
    rows = spark.createDataFrame(
        [(1, 0, "10.0.0.1", "10.0.0.2", "TCP", 64, "54321 → 80 [SYN] Seq=0"), (2, 500_000_000, "10.0.0.2", "10.0.0.1", "TCP", 200, "80 > 54321 [SYN, ACK]"),
         (3, 1_500_000_000, "10.0.0.1", "8.8.8.8", "DNS", 1000, "1234 -> 53 Standard query packet")],
        "Frame_Number long, Time_ns long, Source string, Destination string, Protocol string, Length int, Info string")
    out = P.with_packet_features(rows).orderBy("Frame_Number").collect()
    assert [r.Packet_Size_Category for r in out] == ["SMALL", "MEDIUM", "LARGE"]
    assert [(r.Source_Port, r.Destination_Port) for r in out] == [(54321, 80), (80, 54321), (1234, 53)]
    assert [(r.Flag_SYN, r.Flag_ACK) for r in out] == [(1, 0), (1, 1), (0, 1)]  # "packet" counts as ACK
    assert P.with_flags(rows, bracketed_only=True).filter("Flag_ACK = 1").count() == 1
    assert [r.Direction for r in out] == [1, 0, 1]
    timed = ordered.capture_features(rows, block_rows=20).orderBy("Frame_Number").collect()
    assert [r.IAT for r in timed] == [0.0, 0.5, 1.0]
    assert timed[0].Instant_Packet_Rate == 1e6 and timed[2].Running_Avg_Length == pytest.approx(1264 / 3)


@pytest.mark.parametrize("partitions, block", [(1, 1000), (8, 37), (8, 11)])
def test_capture_windows_do_not_depend_on_blocks(spark, partitions, block):
    import numpy as np
    import pandas as pd

    n = 500
    random = np.random.default_rng(3)
    pdf = pd.DataFrame({"Frame_Number": np.arange(n), "Time_ns": np.sort(random.integers(0, 10**9, n)), "Length": random.integers(40, 1500, n)})
    rows = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(partitions)
    got = ordered.capture_features(rows, block_rows=block).orderBy("Frame_Number").toPandas()
    iat = pdf.Time_ns.diff().fillna(0) / 1e9
    rate = 1 / iat.replace(0, np.nan).fillna(1e-6)
    assert np.allclose(got.IAT, iat)
    assert np.allclose(got.Running_Avg_Length, pdf.Length.expanding().mean())
    assert np.allclose(got.Moving_Avg_Length, pdf.Length.rolling(10, min_periods=1).mean())
    assert np.allclose(got.Rolling_Std_Length, pdf.Length.rolling(10, min_periods=1).std().fillna(0))
    assert np.allclose(got.Rolling_Packet_Rate, rate.rolling(10, min_periods=1).mean())


def test_sinks_round_trip(spark, folder):
    df = spark.createDataFrame([("a", ["x", "y"])], "k string, tags array<string>")
    path = writers.write_csv(df, os.path.join(folder, "out"))
    assert spark.read.options(header=True).csv(path).first().tags == "x, y"
    writers.write_summary(spark, {"n": 1, "t": df.selectExpr("count(*) AS rows")}, os.path.join(folder, "sum"))
    assert '"rows": 1' in spark.read.text(os.path.join(folder, "sum")).first()[0]


def test_labelled_files_hold_mixed_labels_of_even_size(spark, folder):
    rows = spark.range(4000).selectExpr("id AS l_orderkey", "CAST(1 AS INT) AS l_linenumber", "2.0D AS l_quantity", "4.0D AS l_extendedprice", "0.1D AS l_discount",
                                        "0.2D AS l_tax", "'N' AS l_returnflag")
    rows.write.parquet(f"{folder}/lineitem.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = packet_queries._labelled_csv(spark, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.text(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4000 + len(sizes) and len(sizes) == 4 and max(sizes) < 1500
