import os

from pyspark.sql import functions as F

from flowquarry.operators import cleaning, isolation, selection, statistics as ST
from flowquarry.sources import readers


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
        file.write(text)


def test_directory_joins_files_by_their_own_headers(spark, folder):
    _write(folder, "a.csv", "Flow Duration,Total Fwd Packets,Label\n999,7,BENIGN\n")
    _write(folder, "b.csv", "Total Fwd Packets,Label,Flow Duration\n8,DoS Hulk,998\n")
    _write(folder, "c.csv", "Label,Flow Duration\nBENIGN,1\n")
    _write(folder, "README.txt", "x,y\n1,2\n")
    rows = readers.read_directory(spark, folder)
    got = {r["_file_name"]: (r["Flow Duration"], r["Total Fwd Packets"], r["Label"]) for r in rows.collect()}
    assert got == {"a.csv": (999.0, 7.0, "BENIGN"), "b.csv": (998.0, 8.0, "DoS Hulk"), "c.csv": (1.0, None, "BENIGN")}
    assert {r.file_name: r.compatible for r in readers.header_compatibility(spark, folder).collect()} == {"a.csv": True, "b.csv": False, "c.csv": False}


def test_lenient_length_survives_overflow(spark):
    rows = spark.createDataFrame([("1", "0.5", "a", "b", "TCP", "99999999999", ""), ("2", "x", None, "b", None, "60", None)],
                                 ["Frame_Number", "Time", "Source", "Destination", "Protocol", "Length", "Info"])
    assert [r.Length for r in cleaning.clean_packets_lenient(rows).orderBy("Frame_Number").collect()] == [0, 60]


def test_histogram_leaves_out_what_is_not_finite(spark):
    rows = spark.createDataFrame([(v,) for v in [0.0, 1.0, 10.0, float("inf"), float("nan"), None, -3.0]], "v double")
    assert sorted((r.bin, r.n) for r in ST.histogram(rows, F.col("v"), bins=2).collect()) == [(0, 3), (1, 1)]
    assert sum(r.n for r in ST.histogram(rows, F.col("v"), bins=2, log_scale=True).collect()) == 2


def test_hash_sample_is_exact_stable_and_spread(spark):
    rows = spark.range(20_000, numPartitions=16).withColumnRenamed("id", "k")
    taken = selection.hash_sample(rows, 15_000, ["k"])
    assert taken.count() == 15_000 and taken.rdd.getNumPartitions() > 4
    again = selection.hash_sample(rows.repartition(3), 15_000, ["k"])
    assert taken.join(again, "k", "left_anti").isEmpty()
    assert selection.hash_sample(rows, 30_000, ["k"]).count() == 20_000 and selection.hash_sample(rows, 0, ["k"]).isEmpty()


def test_svm_verdicts_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, float((i * 7919) % 101) / 50 - 1, float((i * 104729) % 97) / 40 - 1) for i in range(3_000)], "key bigint, a double, b double")
    one, eight = (isolation.one_class_svm(rows.repartition(n), ["a", "b"], ["key"]).filter("OneClassSVM_Pred = -1").select("key") for n in (1, 8))
    assert one.join(eight, "key", "left_anti").isEmpty() and 120 <= one.count() <= 151
