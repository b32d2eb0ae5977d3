from collections import Counter

import numpy as np
import pytest
from cases import DOCS, documents
from test_near_dup import brute

from flowquarry.llm import near_dup


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 0, "", "", 0, 0, 0.0) for i, t in enumerate(texts)], DOCS)


def found(docs, percent=85):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, percent).collect())


def crowd(rng, size, shared, own):
    passage = [f"passage{i}" for i in range(shared)]
    texts = [" ".join(passage + [f"own{k}x{i}" for i in range(own)]) for k in range(size)]
    for k in range(0, size, 9):  # some are near copies of their neighbours
        words = texts[k].split()
        words[int(rng.integers(shared, len(words)))] = f"new{k}"
        texts[(k + 1) % size] = " ".join(words)
    return texts


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_alike_sets_share_a_rare_shingle(percent):
    rng = np.random.default_rng(percent)
    counts = rng.integers(0, 5, near_dup.SLOTS)
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64)
        a, b = (np.unique(pool[rng.random(len(pool)) < rng.uniform(0.85, 1)]) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * len(np.union1d(a, b)):
            assert len(np.intersect1d(near_dup.rare_shingles(a, counts, percent), near_dup.rare_shingles(b, counts, percent)))


def test_unlike_texts_with_a_common_passage(spark):
    docs = table(spark, crowd(np.random.default_rng(3), 150, 200, 60))
    assert found(docs) == brute(docs.collect())


@pytest.mark.parametrize(("few", "block"), [(16, 512), (1, 7), (1, 512)])
def test_rare_shingles_alone_lose_no_link(spark, monkeypatch, few, block):
    monkeypatch.setattr(near_dup, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    words = [f"t{i}" for i in range(300)]
    chain = [" ".join(words[k * 9:k * 9 + 150]) for k in range(10)]
    docs = documents(spark).unionByName(table(spark, chain + crowd(np.random.default_rng(5), 60, 120, 40)).withColumn("doc_id", near_dup.F.col("doc_id") + 500))
    assert found(docs) == brute(docs.collect())


def test_an_id_that_names_several_classes(spark, monkeypatch):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(i, text(f"own{i}x")) for i in range(8)] + [(i, f"{text('same')} end{i}") for i in range(8)]
    for rounds in (2, 0):
        monkeypatch.setattr(near_dup, "PIVOT_ROUNDS", rounds)
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert len(got) == 16 and {r.component_id for r in got} == {0}
