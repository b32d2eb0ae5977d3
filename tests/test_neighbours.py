"""Nearest-neighbour mutual information against brute force over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import neighbours
from flowquarry.operators.neighbours import digamma, neighbour_information

GAMMA = 0.5772156649015329


def psi(n):
    return -GAMMA + sum(1.0 / i for i in range(1, int(n)))


def brute(values, classes, k):
    points = [(v, c) for v, c in zip(values, classes) if v is not None and math.isfinite(v) and c is not None]
    sizes = {c: sum(d == c for _, d in points) for _, c in points}
    points = [(v, c) for v, c in points if sizes[c] > 1]
    if not points:
        return 0.0
    total = 0.0
    for i, (v, c) in enumerate(points):
        own = sorted(abs(u - v) for j, (u, d) in enumerate(points) if j != i and d == c)
        r = own[min(k, len(own)) - 1]

        def inside(u):
            return u == v if r == 0 else v - r < u < v + r

        s = 1 + (own.count(0.0) if r == 0 else sum(x < r for x in own))
        m = max(s, sum(inside(u) for u, _ in points))
        total += psi(s) - psi(sizes[c]) - psi(m)
    return max(0.0, psi(len(points)) + total / len(points))


def test_digamma_of_counts(spark):
    got = spark.range(1, 400).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - psi(r.id)) < 1e-12 for r in got)


@pytest.mark.parametrize("block_rows", [4, 1_000_000])
def test_information_equals_brute_force(spark, block_rows):
    random = np.random.default_rng(11)
    n = 240
    classes = [None if i % 60 == 59 else "lonely" if i == 5 else "rare" if i in (7, 8) else "ab"[int(random.random() < 0.35)] for i in range(n)]
    shift = np.array([2.0 if c == "a" else 0.0 for c in classes])
    apart = (random.normal(size=n) + shift).tolist()
    steps = random.integers(0, 6, n).astype(float).tolist()
    holes = [None if i % 7 == 0 else float("nan") if i % 11 == 0 else float("inf") if i % 13 == 0 else -0.0 if i % 17 == 0 else float(random.integers(-3, 40)) / 4 for i in range(n)]
    rows = [(c, a, s, h, 5.0, None) for c, a, s, h in zip(classes, apart, steps, holes)]
    rows += rows[:20]  # repeated rows count again
    df = spark.createDataFrame(rows, "f string, `_y` double, `a b` double, v double, n double, nothing double")
    got = {r.feature: r.neighbour_information for r in neighbour_information(df, ["_y", "a b", "v", "n", "nothing"], F.col("f"), 3, block_rows).collect()}
    for name, place in (("_y", 1), ("a b", 2), ("v", 3), ("n", 4), ("nothing", 5)):
        assert abs(got[name] - brute([r[place] for r in rows], [r[0] for r in rows], 3)) < 1e-9, name
    assert got["_y"] > 0.2 and abs(got["n"]) < 1e-9 and got["nothing"] == 0.0 and len(got) == 5


def test_information_of_an_empty_table_is_zero(spark):
    empty = spark.createDataFrame([], "y string, x double")
    assert [tuple(r) for r in neighbour_information(empty, ["x"], F.col("y")).collect()] == [("x", 0.0)]


def test_radii_against_all_distances_without_arrays(spark):
    rng = random.Random(5)
    counts = Counter((f, y, float(rng.choice([rng.randint(-4, 4), rng.randint(0, 60) / 8]))) for f in ("a", "b") for y in (0, 1, 2) for _ in range((2, 5, 70)[y]))
    sizes = Counter()
    for (f, y, _), n in counts.items():
        sizes[f, y] += n
    cells = spark.createDataFrame([(f, v, y, n, sizes[f, y]) for (f, y, v), n in counts.items()], "f string, v double, _y int, n bigint, c bigint")
    for block_rows in (4, 50_000):
        found = neighbours._radii(cells, 3, block_rows)
        assert "array_sort" not in found._jdf.queryExecution().toString()
        rows = found.collect()
        assert len(rows) == len(counts)
        for r in rows:
            distances = sorted(abs(v - r.v) for (f, y, v), n in counts.items() if (f, y) == (r.f, r._y) for _ in range(n - (v == r.v)))
            radius = distances[min(3, len(distances)) - 1]
            assert r.r == radius and r.s == (r.n if radius == 0 else 1 + sum(d < radius for d in distances))
