"""Isolation forest (Liu, Ting and Zhou 2008) and one-class SVM on random features.

Each tree draws its few rows from the whole table, as the method has it; the SVM is fitted on all
rows. The fitted model is a small table (trees x nodes, or one weight vector) whose size does not
depend on the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flowquarry.operators.quantiles import percentile_row
from flowquarry.session import cut_lineage, store_scratch

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def _with_double(df: DataFrame, name: str) -> StructType:
    return StructType([*df.schema.fields, StructField(name, DoubleType())])


def average_path(n: int) -> float:
    """Average depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(rows: np.ndarray, random: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    pending = [(rows, 0, -1, 0)]
    while pending:
        part, depth, parent, side = pending.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][side] = number
        low, high = part.min(axis=0), part.max(axis=0)
        open_columns = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(open_columns) == 0:
            nodes.append([number, -1, 0.0, -1, -1, depth + average_path(len(part))])
            continue
        column = int(random.choice(open_columns))
        cut = float(random.uniform(low[column], high[column]))
        nodes.append([number, column, cut, -1, -1, 0.0])
        goes_left = part[:, column] <= cut
        pending.append((part[~goes_left], depth + 1, number, 4))
        pending.append((part[goes_left], depth + 1, number, 3))
    return [tuple(n) for n in nodes]


def isolation_trees(df: DataFrame, cols: list[str], keys: list[str], trees: int = 100, rows: int = 256, seed: int = 42) -> DataFrame:
    """Node table of the forest. Each tree sees ``rows`` rows drawn from the whole table by its own hash of the keys.

    A row enters a tree when its hash for that tree is below a threshold that lets through a little more than ``rows``
    rows; the least hashes of those are used. So what is gathered is a few hundred rows a tree, whatever the table's size.
    """
    size = df.count()
    share = min(1.0, (rows + 6 * math.sqrt(rows)) / max(1, size))
    limit = int(share * (1 << 52))
    mark = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.shiftrightunsigned(F.xxhash64(mark, t), 12).alias("h"), t.alias("t"))), lambda x: x["h"] <= limit)
    base = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols if c not in keys])
    drawn = base.withColumn("_d", F.explode(draws))
    order = Window.partitionBy("tree").orderBy("_h", *cols)
    picked = drawn.select(F.col("_d.t").alias("tree"), F.col("_d.h").alias("_h"), *cols).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= rows)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf.sort_values("_r")[cols].to_numpy(dtype=float)
        grown = _grow(data, np.random.default_rng([seed, tree]), math.ceil(math.log2(max(2, len(data)))))
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    return cut_lineage(picked.groupBy("tree").applyInPandas(build, NODE_SCHEMA))


def isolation_scores(df: DataFrame, nodes: DataFrame, cols: list[str], rows: int = 256, name: str = "IsoForest_Score") -> DataFrame:
    """Anomaly score in (0, 1] per row. The node table (trees x 2 rows at most) goes to the tasks as arrays."""
    table = nodes.orderBy("tree", "node").toPandas()
    forest = [t.sort_values("node")[["feature", "threshold", "left", "right", "path"]].to_numpy() for _, t in table.groupby("tree")]
    norm = average_path(rows)

    def add_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[cols].to_numpy(dtype=float)
            total = np.zeros(len(x))
            everyone = np.arange(len(x))
            for tree in forest:
                at = np.zeros(len(x), dtype=int)
                while True:
                    feature = tree[at, 0].astype(int)
                    moving = feature >= 0
                    if not moving.any():
                        break
                    value = x[everyone, np.where(moving, feature, 0)]
                    step = np.where(value <= tree[at, 1], tree[at, 2], tree[at, 3]).astype(int)
                    at = np.where(moving, step, at)
                total += tree[at, 4]
            yield batch.assign(**{name: np.power(2.0, -total / max(1, len(forest)) / norm)})

    return df.mapInPandas(add_score, _with_double(df, name))


def isolation_forest(df: DataFrame, cols: list[str], keys: list[str], trees: int = 100, rows: int = 256,
                     contamination: float = 0.05, seed: int = 42, name: str = "IsoForest_Pred") -> DataFrame:
    """-1 for the ``contamination`` share with the highest scores, else 1."""
    nodes = isolation_trees(df, cols, keys, trees, rows, seed)
    sample_rows = min(rows, df.count())
    scored = store_scratch(isolation_scores(df, nodes, cols, max(2, sample_rows), "_score"), "isolation")
    cut = percentile_row(scored, {"s": -F.col("_score")}, [contamination])["s"][0]
    verdict = F.lit(1) if cut is None else F.when(-F.col("_score") < cut, -1).otherwise(1)
    return scored.withColumn(name, verdict).drop("_score")


def one_class_svm(df: DataFrame, cols: list[str], keys: list[str], nu: float = 0.05, features: int = 256,
                  rounds: int = 30, seed: int = 42, name: str = "OneClassSVM_Pred") -> DataFrame:
    """-1 outside the learnt region, else 1. Fitted on all rows.

    The rbf kernel is approximated by random Fourier features (Rahimi and Recht 2007) with
    gamma = 1 / (columns x variance). Every round is one pass: batches return the sum of the features of rows below the
    margin, these are summed in Spark per feature, and ``features`` numbers come to the driver for one subgradient step.
    The offset is the exact nu quantile of the scores of all rows.
    """
    d = len(cols)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)], *[F.avg(F.col(f"`{c}`") * F.col(f"`{c}`")).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    if not moments["n"]:
        return df.withColumn(name, F.lit(1))
    variance = float(np.mean([moments[f"q{i}"] for i in range(d)]) - np.mean([moments[f"m{i}"] for i in range(d)]) ** 2)
    gamma = 1.0 / (d * variance) if variance > 0 else 1.0
    random = np.random.default_rng(seed)
    directions = random.normal(0.0, math.sqrt(2.0 * gamma), (d, features))
    phases = random.uniform(0.0, 2.0 * math.pi, features)
    scale = math.sqrt(2.0 / features)

    def lifted(batch: pd.DataFrame) -> np.ndarray:
        return scale * np.cos(batch[cols].to_numpy(dtype=float) @ directions + phases)

    def below_margin(weights: np.ndarray, rho: float):
        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, below = np.zeros(features), 0
            for batch in batches:
                z = lifted(batch)
                under = z @ weights < rho
                total += z[under].sum(axis=0)
                below += int(under.sum())
            yield pd.DataFrame({"i": np.arange(features + 1), "v": np.append(total, float(below))})
        return add_up

    w, rho = np.zeros(features), 1.0  # every row is below the margin at first, so w starts at the mean
    for step in range(rounds):
        sums = dict(rows.mapInPandas(below_margin(w, rho), "i int, v double").groupBy("i").agg(F.sum("v")).collect())
        total = np.array([sums.get(i, 0.0) for i in range(features)])
        rate = 1.0 if step == 0 else 1.0 / (1.0 + step)
        below = sums.get(features, 0.0) / moments["n"]
        w = (1 - rate) * w + rate * total / (nu * moments["n"]) if step else total / moments["n"]
        rho = float(w @ w) if step == 0 else rho - rate * (below / nu - 1.0) * abs(rho)

    def add_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(_score=lifted(batch) @ w)

    scored = store_scratch(df.mapInPandas(add_score, _with_double(df, "_score")), "svm")
    offset = percentile_row(scored, {"s": F.col("_score")}, [nu])["s"][0]
    return scored.withColumn(name, F.when(F.col("_score") < offset, -1).otherwise(1)).drop("_score")
