"""DBSCAN in many blocks: as brute force, also with copies and null keys, and without a table of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import blocks, density
from test_models import brute_dbscan

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def crowd():
    """A dense cloud, a ring around it, loose points, and many copies of some of them."""
    random = np.random.default_rng(4)
    turn = random.uniform(0, 2 * np.pi, 200)
    ring = np.stack([5 * np.cos(turn), 5 * np.sin(turn), np.zeros(200)], axis=1) + random.normal(0, 0.05, (200, 3))
    x = np.vstack([random.normal(0, 0.6, (1_200, 3)), ring, random.uniform(-9, 9, (100, 3))]).round(4)
    return np.vstack([x, x[::7], np.repeat(x[-3:], 4, axis=0)])


def table(spark, x, keys):
    return spark.createDataFrame([(k, i, *map(float, r)) for k, (i, r) in zip(keys, enumerate(x))], "key long, place int, a double, b double, c double").repartition(5)


@pytest.mark.parametrize("block", [150, 10_000])
def test_blocks_equal_brute_force_and_keep_few_pairs(spark, monkeypatch, crowd, block):
    kept, cut = {}, density.cut_lineage

    def watched(df):
        out = cut(df)
        if out.columns == ["a", "b", "wa", "wb"]:
            kept["rows"] = out.count()
        return out

    monkeypatch.setattr(density, "cut_lineage", watched)
    monkeypatch.setattr(density, "BLOCK_POINTS", block)
    monkeypatch.setattr(density, "CHUNK_POINTS", 32)
    got = dict(density.dbscan(table(spark, crowd, range(len(crowd))), COLS, "key").select("place", "DBSCAN_Cluster").collect())
    want = brute_dbscan(crowd, 0.8, 5)
    assert [got[i] for i in range(len(crowd))] == list(want) and set(want) >= {-1, 0, 1}
    near = ((crowd[:, None] - crowd[None]) ** 2).sum(-1) <= 0.64
    assert kept["rows"] < 12 * len(crowd) < near.sum() / 10


def test_keys_may_be_missing_or_repeat(spark, monkeypatch, crowd):
    monkeypatch.setattr(density, "BLOCK_POINTS", 300)
    want = brute_dbscan(crowd, 0.8, 5)
    rows = density.dbscan(table(spark, crowd, [None if i % 3 else i // 9 for i in range(len(crowd))]), COLS, "key").collect()
    pairs = {(int(want[r.place]), r.DBSCAN_Cluster) for r in rows}
    assert len(rows) == len(crowd) and len(pairs) == len(set(want.tolist())) == len({b for _, b in pairs}) and (-1, -1) in pairs


def test_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], "key long, a double, b double, c double")
    assert density.dbscan(empty, COLS, "key").collect() == []


def test_cuts_of_equal_values_end():
    same = np.zeros((500, 2))
    assert blocks.cut_tree(same, 10) == [(-1, 0, 0, 0)]
    half = np.vstack([same, np.ones((100, 2)), np.full((1, 2), 2.0)])
    tree = blocks.cut_tree(half, 50)
    found = blocks.region_of(tree, half)
    assert len(set(found)) == 3 and all(len(set(found[part])) == 1 for part in (slice(0, 500), slice(500, 600)))


def test_groups_of_long_chains():
    random = np.random.default_rng(2)
    groups, pairs = blocks.Groups(2_000), np.stack([np.arange(1_999), np.arange(1, 2_000)])
    groups.join(pairs[::-1, random.permutation(1_999)][:, :1_500])
    groups.join(pairs)
    assert (groups.roots(np.arange(2_000)) == 0).all()


@pytest.mark.parametrize("least", [2, 5, 40])
def test_two_sides_know_all_pairs(least):
    random = np.random.default_rng(9)
    x = np.vstack([random.normal(0, 0.5, (150, 3)), random.uniform(-4, 4, (150, 3))])
    weight = random.integers(1, 4, 300)
    sides = [np.arange(0, 300, 2), np.arange(1, 300, 2)]
    links, pairs, seen = blocks.compare(x, x @ blocks.rotation(x), weight, sides, 0.7, least, 16)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.7 * 0.7
    near &= (np.arange(300)[:, None] + np.arange(300)) % 2 == 1
    total = weight + near @ weight
    sure = total >= least
    assert ((seen >= least) == sure).all() and (seen[~sure] == total[~sure]).all()
    assert {tuple(sorted(p)) for p in pairs.T.tolist()} == {(i, j) for i, j in zip(*np.nonzero(np.triu(near))) if not (sure[i] and sure[j])}
    linked, real = blocks.Groups(300), blocks.Groups(300)
    linked.join(links)
    real.join(np.array(np.nonzero(near & np.outer(sure, sure))))
    assert (linked.roots(np.arange(300)) == real.roots(np.arange(300))).all()
