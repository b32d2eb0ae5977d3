"""Density clustering (DBSCAN) over all rows, exact.

* Identical points are folded into one point with a weight.
* Space is cut into regions by the middles of leading principal axes, until a region holds about ``BLOCK_POINTS`` points; one
  that holds more is dealt into several blocks. Cuts come from some of the points, as those of a range partitioning do; they
  decide where points are compared, not what comes out.
* A tile compares a block with itself or with another one whose box is within eps. Of two blocks only the points within eps of
  the other's box travel, so a point is copied once for each block near it, not for each grid cell or chunk.
* Tiles keep no table of all pairs. A point with enough weight around it within a tile is core, and core points only need to
  be linked to their group; what is stored are these links and the few pairs of each point that is not yet known as core.
* Clusters are connected components by minimum-label propagation with pointer jumping; each
  round is checkpointed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from flowquarry.operators import blocks
from flowquarry.operators.ordered import numbered
from flowquarry.session import cut_lineage, drop_scratch, scratch_path

#: Points that are compared at once, points of a block, points that cuts are chosen from, and most tasks for the tiles.
CHUNK_POINTS, BLOCK_POINTS, CUT_POINTS, MOST_TASKS = 256, 65_536, 50_000, 10_000


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id of each component. ``edges`` has (a, b).

    Labels only fall, so the search ends by itself, after about the logarithm of the longest path.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select("id", F.col("id").alias("component")))
    while True:
        # smallest label among neighbours; min combines map-side, so a hub is no hot spot
        seen = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_near"))
        lowered = labels.join(seen, "id", "left").select("id", "component", F.least("component", F.coalesce("_near", "component")).alias("_new"))
        lowered = cut_lineage(lowered)
        # pointer jumping: take the label of the label
        target = lowered.select(F.col("id").alias("_new"), F.col("_new").alias("_jump"))
        jumped = cut_lineage(lowered.join(target, "_new", "left").select(
            "id", F.least("_new", F.coalesce("_jump", "_new")).alias("component"), F.col("component").alias("_old")
        ))
        changed = jumped.filter(F.col("component") != F.col("_old")).limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels


def adjacent_cells(cells: DataFrame, axes: int) -> DataFrame:
    """Pairs (``_g``, ``cell``) of occupied grid cells that differ by at most one step on each axis, every unordered pair once."""
    steps = F.explode(F.array(*[F.lit(v).cast("bigint") for v in (-1, 0, 1)]))
    pairs = None
    for k in range(1, axes + 1):
        found = cells.select(F.slice("_g", 1, k).alias("_g")).distinct()
        if pairs is None:
            ways = found.withColumn("_before", F.slice("_g", 1, 0))
        else:
            parts = found.withColumn("_parent", F.slice("_g", 1, k - 1))
            ways = parts.join(pairs.withColumnsRenamed({"_g": "_parent", "cell": "_before"}), "_parent").drop("_parent")
        ways = ways.withColumn("_step", steps).select("_g", F.concat("_before", F.array(F.element_at("_g", k) + F.col("_step"))).alias("cell"))
        pairs = cut_lineage(ways.filter(F.col("_g") <= F.col("cell")).join(found.withColumnRenamed("_g", "cell"), "cell", "left_semi"))
    return pairs


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def _folded(plain: DataFrame, key: str, turn: np.ndarray, tree: list[tuple]) -> DataFrame:
    """The distinct points: weight, least key, coordinates as bytes, and region."""
    d, axes = len(turn), max(1, max(n[0] for n in tree) + 1)
    found = plain.groupBy("_x").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("w"))
    found = found.select(F.monotonically_increasing_id().alias("id"), "w", "_first", *_marks(), "_x")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(batch.column("_x").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)
            offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * d))
            plain = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x)])
            region = pa.array(blocks.region_of(tree, x @ turn[:, :axes]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], plain, region], names=[*batch.schema.names[:-1], "x", "region"])

    return found.mapInArrow(deal, StructType([*found.schema.fields[:-1], StructField("x", BinaryType()), StructField("region", IntegerType())]))


def _marks() -> list:
    """Two differently seeded hashes that stand for the coordinates."""
    return [F.xxhash64(F.lit(seed), F.col("_x")).alias(f"_m{seed}") for seed in (1, 2)]


def _boxes(points: DataFrame, turn: np.ndarray) -> dict[int, tuple]:
    """Points, least and greatest rotated coordinates of each region."""
    d = len(turn)

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, region = _matrix(batch.column("x"), d) @ turn, batch.column("region").to_numpy()
            for r in np.unique(region):
                inside = at[region == r]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, r), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, len(inside)), pa.int64()),
                                                  pa.array(inside.min(axis=0)), pa.array(inside.max(axis=0))], names=["region", "axis", "n", "low", "high"])

    found = points.select("region", "x").mapInArrow(extent, "region int, axis int, n long, low double, high double")
    boxes: dict[int, tuple] = {}
    for r in sorted(found.groupBy("region", "axis").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()):
        boxes.setdefault(r["region"], (r["n"], [], []))[1].append(r["low"])
        boxes[r["region"]][2].append(r["high"])
    return {r: (n, np.array(low), np.array(high)) for r, (n, low, high) in boxes.items()}


def _tiles(points: DataFrame, turn: np.ndarray, boxes: dict[int, tuple], eps: float, block_points: int) -> tuple[DataFrame, int]:
    """(tile, side, id, w, x): every point in the tile of its block, and in one for each other block it is within eps of."""
    d = len(turn)
    parts = {r: math.ceil(n / block_points) for r, (n, _, _) in boxes.items()}
    every = [(r, k) for r in boxes for k in range(parts[r])]
    # per block: the tile, the side it has there, and the box its points have to be near; None for all of them
    goes: dict[tuple, list] = {b: [] for b in every}
    low, high = (np.array([boxes[r][side] for r, _ in every]).reshape(len(every), d) for side in (1, 2))
    tiles = 0
    for i, (r, k) in enumerate(every):
        goes[r, k].append((tiles, 0, None))
        tiles += 1
        for j in (np.flatnonzero(blocks.box_gap(low[i], high[i], low[i + 1:], high[i + 1:]) <= blocks.reach(eps)) + i + 1).tolist():
            goes[r, k].append((tiles, 0, every[j][0]))
            goes[every[j]].append((tiles, 1, r))
            tiles += 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, region = _matrix(batch.column("x"), d) @ turn, batch.column("region").to_numpy()
            ids = batch.column("id").to_numpy()
            for r in np.unique(region).tolist():
                for k in range(parts[r]):
                    inside = np.flatnonzero((region == r) & ((ids ^ (ids >> 33)) % parts[r] == k))
                    gaps: dict[int, np.ndarray] = {}
                    for tile, side, other in goes[r, k]:
                        chosen = inside
                        if other is not None:
                            if other not in gaps:
                                gaps[other] = blocks.box_gap(at[inside], at[inside], boxes[other][1], boxes[other][2]) <= blocks.reach(eps)
                            chosen = inside[gaps[other]]
                        if len(chosen):
                            some = batch.take(pa.array(chosen))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), tile), pa.int32()), pa.array(np.full(len(chosen), side), pa.int32()),
                                                              some.column("id"), some.column("w"), some.column("x")], names=["tile", "side", "id", "w", "x"])

    return points.select("id", "w", "x", "region").mapInArrow(deal, "tile int, side int, id long, w long, x binary"), tiles


def _compared(turn: np.ndarray, eps: float, min_points: int, most: int):
    """Links and pairs of a tile as (a, b, wa, wb); b is null where wb is the weight found around a point that has enough."""
    d = len(turn)

    def compare(tile: pa.Table) -> pa.Table:
        x = np.concatenate([_matrix(chunk, d) for chunk in tile.column("x").chunks])
        side, ids, weight = (tile.column(c).to_numpy() for c in ("side", "id", "w"))
        sides = [np.flatnonzero(side == s) for s in (0, 1) if (side == s).any()]
        if len(sides) == 1 and side[0] != 0 or not len(x):
            sides = [np.zeros(0, dtype=np.int64)]
        links, pairs, seen = blocks.compare(x, x @ turn, weight, sides, eps, min_points, most)
        a, b = np.concatenate([links, pairs], axis=1)
        known = np.flatnonzero(seen >= min_points)
        none = pa.nulls(len(known), pa.int64())
        return pa.table({
            "a": np.concatenate([ids[a], ids[known]]), "b": pa.concat_arrays([pa.array(ids[b], pa.int64()), none]),
            "wa": np.concatenate([weight[a], weight[known]]), "wb": np.concatenate([weight[b], (seen - weight)[known]]),
        })

    return compare


def dbscan(df: DataFrame, cols: list[str], key: str, eps: float = 0.8, min_points: int = 5, name: str = "DBSCAN_Cluster",
           max_axes: int = 6, cell_limit: int = 2_000) -> DataFrame:
    """Cluster number per row, -1 for noise. Border points go to their lowest-numbered cluster.

    Blocks are cut along the leading ``max_axes`` principal axes; at most ``cell_limit`` and ``CHUNK_POINTS`` points are compared
    with as many at once. Coordinates travel as one column of bytes.
    """
    spark = df.sparkSession
    plain = df.withColumn("_x", F.array(*[F.col(f"`{c}`").cast("double") + 0.0 for c in cols]))
    rows = df.count()
    some = plain.select("_x").sample(min(1.0, CUT_POINTS / max(1, rows)), 42).toPandas()["_x"]
    sample = np.array([list(x) for x in some], dtype=float).reshape(len(some), len(cols))
    turn = blocks.rotation(sample)
    tree = blocks.cut_tree(sample @ turn[:, :max_axes], BLOCK_POINTS * min(1.0, CUT_POINTS / max(1, rows)))

    path = scratch_path(spark, "points")
    _folded(plain, key, turn, tree).write.parquet(path)
    points = spark.read.parquet(path)
    tiles, n = _tiles(points, turn, _boxes(points, turn), eps, BLOCK_POINTS)
    tasks = max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, n))
    compare = _compared(turn, eps, min_points, max(1, min(cell_limit, CHUNK_POINTS)))
    near = cut_lineage(tiles.repartition(tasks, "tile").groupBy("tile").applyInArrow(compare, "a long, b long, wa long, wb long"))

    pairs = near.filter(F.col("b").isNotNull())
    outside = near.select(F.col("a").alias("id"), F.col("wb").alias("n")).unionByName(pairs.select(F.col("b").alias("id"), F.col("wa").alias("n")))
    outside = outside.groupBy("id").agg(F.sum("n").alias("_out"))
    judged = cut_lineage(points.select("id", "w", "_first", "_m1", "_m2").join(outside, "id", "left").select(
        "id", "_first", "_m1", "_m2", (F.col("w") + F.coalesce("_out", F.lit(0)) >= min_points).alias("core")))
    drop_scratch(spark, path)

    core = judged.filter("core").select("id")
    crossing = pairs.select("a", "b").join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi")
    labels = connected_components(core, crossing)

    # Clusters get 0, 1, 2, ... by their smallest member.
    members = labels.join(judged.select("id", "_first"), "id").groupBy("component").agg(
        F.max(F.col("_first").isNull()).alias("_open"), F.min("_first").alias("_first"))
    clusters = numbered(members, [F.desc("_open"), F.col("_first"), F.col("component")], "_c").select("component", "_c")
    core_cluster = cut_lineage(labels.join(clusters, "component").select("id", (F.col("_c") - 1).cast("int").alias("cluster")))

    loose = judged.filter(~F.col("core")).select("id")
    touching = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(loose.withColumnRenamed("id", "a"), "a", "left_semi")
    by_pair = touching.join(core_cluster.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    border = loose.join(by_pair, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    point_cluster = core_cluster.unionByName(border)
    found = judged.select("id", "_m1", "_m2").join(point_cluster, "id").select("_m1", "_m2", F.col("cluster").alias(name))
    return plain.withColumns({f"_m{seed}": mark for seed, mark in zip((1, 2), _marks())}).drop("_x").join(found, ["_m1", "_m2"]).drop("_m1", "_m2")
