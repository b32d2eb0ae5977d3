import hashlib
import importlib.util
import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, no_documents
from pyspark.sql import functions as F

from flowquarry.llm import ann, chat, quality_cnn, queries

SF = "/root/testdata/sf0.01"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")


def turns(rows):
    return sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.role is not None, (r.role or "").encode(), r.text is not None, (r.text or "").encode()))


def test_chat_reads_back_exactly(spark):
    rng = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|im_end|>\n", "\n", "hi ", "é", "<", "|", "\\"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool\nx%0A", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))), "extra", True) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(1, 0, "user", None, "", False), (1, 0, "user", None, "", False), (None, None, None, None, None, None), (2, None, "assistant", "early", "", True), (1 << 60, 0, "user", "a", "", True), ((1 << 60) + 1, 0, "user", "b", "", True)]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segment string, loss boolean")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(talks)).collect()}
    groups = {}
    for r in talks.collect():
        groups.setdefault(r.conv_id, []).append(r)
    assert got.keys() == groups.keys()
    for key, own in groups.items():
        own = turns(own)
        whole = "".join(f"{r.role or ''}\n{r.text or ''}\n" for r in own)
        loss = "".join(r.text or "" for r in own if r.role == "assistant")
        assert got[key].n_turns == len(own) and got[key].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[key].loss_chars == len(loss) and got[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[key].formatted_chars >= len(whole)
    assert chat.read_back(chat.format_conversations(talks.limit(0))).count() == 0


def test_state_machine_flags_order(spark):
    talks = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (4, 0, "user", "u"), (4, 1, "user", "u"), (4, 2, "assistant", "a")]
    rows = chat.read_back(chat.format_conversations(spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert {r.conv_id: r.in_order for r in rows} == {1: True, 2: False, 3: False, 4: False}


def test_loss_is_read_from_the_mask(spark):
    talks = spark.createDataFrame([(1, 0, "system", "s<|im_end|>"), (1, 1, "user", "<|u"), (1, 2, "assistant", "a<\\\\|b"), (1, 3, "user", ""), (1, 4, "assistant", "é")], "conv_id bigint, turn bigint, role string, text string")
    both = chat.Template(loss_roles=("assistant", "system"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for template, roles in ((chat.Template(), {"assistant"}), (both, {"assistant", "system"})):
        segments = chat.format_conversations(talks, template)
        text = "".join(r.text for r in talks.orderBy("turn").collect() if r.role in roles)
        read = chat.read_back(segments, template).first()
        assert (read.loss_chars, read.loss_sha256) == (len(text), sha(text))
        flags = [(r.turn_no, r.part) for r in segments.collect() if r.loss]
        assert flags == [(r.turn, 1) for r in talks.orderBy("turn").collect() if r.role in roles]
        wrong = chat.read_back(segments.withColumn("loss", ~F.col("loss")), template).first()
        assert wrong.loss_sha256 != read.loss_sha256 and wrong.turns_sha256 == read.turns_sha256
        none = chat.read_back(segments.withColumn("loss", F.lit(False)), template).first()
        assert (none.loss_chars, none.loss_sha256) == (0, sha(""))


def test_network_gradients_match_differences():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (5, 40, 300, 700)]
    labels, weights = np.array([0, 1, 0, 1], dtype=np.float32), np.array([1, 2, 1, 1], dtype=np.float32)
    net = quality_cnn.Network.start(2)
    for field in ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias"):
        setattr(net, field, getattr(net, field).astype(np.float64))

    def loss():
        p = quality_cnn.score_texts(net, net.tables(), texts)
        return -(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weights.sum()
    slopes = quality_cnn._gradients(net, texts, labels, weights)
    for part, slope in zip(net.parts(), slopes, strict=True):
        for at in np.argsort(-np.abs(slope).ravel())[:3]:
            spot = np.unravel_index(at, slope.shape)
            part[spot] += 1e-5
            up = loss()
            part[spot] -= 2e-5
            down = loss()
            part[spot] += 1e-5
            assert abs((up - down) / 2e-5 - slope[spot]) < 0.02 * abs(slope[spot]) + 1e-4


def test_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 255, n).astype(np.uint8)) for n in (0, 1, 6, 127, 128, 133, 134, 900, 40_000, 90_000, 3)]
    net = quality_cnn.Network.start(1)
    together = quality_cnn.score_texts(net, net.tables(), texts)
    assert np.allclose(together, [quality_cnn.score_texts(net, net.tables(), [t])[0] for t in texts])


def test_scoring_holds_a_bounded_run_of_texts(monkeypatch):
    texts = [f"{i} words and more " * 4_000 for i in range(60)] + [None, "", "one long text " * 200_000, "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    net, whole, runs = quality_cnn.Network.start(1), quality_cnn.score_texts, []
    monkeypatch.setattr(quality_cnn, "score_texts", lambda net, tables, data: runs.append(data) or whole(net, tables, data))
    out = pa.Table.from_batches(quality_cnn.scored_runs(iter([batch, batch.slice(0, 0)]), net, 0.5, ["score", "predicted"]))
    assert [t for run in runs for t in run] == [(t or "").encode() for t in texts] and len(runs) > 3
    assert all(len(run) == 1 or sum(map(len, run[:-1])) <= 1 << 20 for run in runs)
    assert out["text"].to_pylist() == texts and np.allclose(out["score"], whole(net, net.tables(), [t for run in runs for t in run]))


def test_quality_cases(spark):
    docs, labels = documents(spark), spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(0, 1, 0), (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id bigint, quality int, toxic int")
    out = quality_cnn.score_quality(docs, labels, fit_rows=20)
    assert out.columns[:len(docs.columns) - 0] == docs.columns and out.count() == docs.count()
    assert all(0 <= r.quality_score <= 1 and r.quality_predicted == int(r.quality_score >= 0.5) for r in out.collect())
    assert {r.s for r in quality_cnn.score_quality(docs, labels.limit(0)).select(F.col("quality_score").alias("s")).collect()} == {0.5}
    assert quality_cnn.score_quality(no_documents(spark), labels).count() == 0
    held = {r.doc_id: r.h for r in docs.select("doc_id", quality_cnn.held_out(F.col("doc_id")).alias("h")).collect() if r.doc_id is not None}
    assert held == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in held}


@has_data
def test_quality_on_held_out_rows(spark):
    rows = queries.QUERIES["op4_byte_cnn_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.95


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, 24)) * rng.uniform(0.3, 2, size=(900, 1))
    data[7:60] = data[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [1.0] * 23), (2080, [float("nan")] * 24), (2100, [None] + [1.0] * 23), (2120, [float("inf")] + [1.0] * 23), (None, [1.0] * 24)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    table = table.withColumns({"rank": F.lit("x"), "asked": F.lit(1), "score": F.lit(0)})
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == set(range(0, 900, 20))
    hits = 0
    for query, found in got.items():
        scores = data @ data[query]
        scores[query] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(scores, 9)))[:20]
        assert [x[0] for x in sorted(found)] == list(range(1, 21)) and all(abs(scores[v] - s) < 1e-9 for _, v, s in found)
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    few = ann.nearest(spark.createDataFrame(rows[:5], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [int(x) for x in np.lexsort((np.arange(5), -np.where(np.arange(5) == 0, -np.inf, data[:5] @ data[0])))[:4]]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@has_data
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "pii", "mixing", "packing"]
    packed = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns)
    assert packed.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty()
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert full.where("n <> m or n > 1024").isEmpty()
    deduplicated = corpus_pipeline.near_dup_stage(spark, documents(spark), SF)
    assert deduplicated.columns == documents(spark).columns and deduplicated.where("doc_id is not null").groupBy("doc_id", "text").count().where("count > 1").isEmpty()
    assert corpus_pipeline.near_dup_stage(spark, docs, SF).columns == columns


def test_entry_without_this_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "flowquarry.llm", None)
    monkeypatch.delitem(sys.modules, "flowquarry.llm.queries", raising=False)
    place = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_alone", place)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    names = module.queries()
    assert names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names) and not set(module.oracle_sql()) - set(names)
