"""Nearest neighbours by inner product: learned binary codes, multi-index hashing, reranking of the vectors themselves.

Vectors are lengthened by one component so that the largest inner product is the smallest angle. A rotation learned on a
bounded sample turns them into codes of BITS signs. In each block of vectors every substring of the code is indexed: for
each value it may take, which vectors lie within the substring's share of the radius. By the pigeonhole principle a code
within the radius of a query's is within that share in one substring at least, so the union of the lists holds every such
code. Those within the radius are ranked by inner product in double precision.

The radius is set so that it holds nearly all true neighbours of a bounded sample of queries, found by comparing those few
with every vector. Queries that find too few are searched again with the whole code length as radius. Queries meet
vectors block by block, by the numbers of a block of vectors and a group of queries, so memory is that of two blocks and
no row is collected by a key that grows.

Cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part;
rows without vec_id neither; a vec_id that repeats among the queries is asked once, with its least vector, and rows of the
query's own vec_id are not its neighbours; equal vectors are ranked by vec_id; fewer candidates than asked for are all
returned; an empty table gives an empty table; only vec_id and embedding are read, so other columns do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowquarry.session import scratch_path

BITS, PARTS = 64, 8
FIT_ROWS, FIT_QUERIES, HELD = 20_000, 64, 0.98
BLOCK, GROUP = 8_192, 4_096
NEIGHBOURS = 20
DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors whose angle to a query orders them by inner product."""
    scaled = vectors / longest
    return np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))[:, None]], axis=1)


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 30) -> np.ndarray:
    """Principal axes (or a random lift, with fewer dimensions than bits), then the rotation nearest to its own signs."""
    rng = np.random.default_rng(3)
    width = sample.shape[1]
    if width >= bits:
        axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :bits]
    else:
        axes = np.linalg.qr(rng.normal(size=(bits, width)))[0].T
    flat = sample @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (left @ right).T
    return axes @ turn


def codes_of(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """PARTS bytes per vector."""
    return np.packbits(vectors @ rotation > 0, axis=1)


class BlockIndex:
    """Multi-index of the codes of one block: per substring and value, the vectors within its share of the radius."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius, self.whole = codes, radius, codes.view(np.uint64)[:, 0]
        share, more = divmod(radius, PARTS)
        self.lists = []
        for part in range(PARTS):
            reach = share if part <= more else share - 1
            self.lists.append(np.packbits(DISTANCE[:, codes[:, part]] <= reach, axis=1))

    def within(self, code: np.ndarray) -> np.ndarray:
        """Places of all codes within the radius."""
        union = self.lists[0][code[0]].copy()
        for part in range(1, PARTS):
            union |= self.lists[part][code[part]]
        found = np.flatnonzero(np.unpackbits(union, count=len(self.codes)))
        return found[np.bitwise_count(self.whole[found] ^ code.view(np.uint64)[0]) <= self.radius]


def _best(ids: np.ndarray, scores: np.ndarray, number: int) -> np.ndarray:
    if len(ids) > 4 * number:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - number)[len(scores) - number])
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:number]]


FOUND = "query_id bigint, vec_id bigint, score double"


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _search(vectors: DataFrame, queries: DataFrame, rotation: np.ndarray, longest: float, radius: int, number: int, rows: int, asked: int) -> DataFrame:
    """The best of each block for each query; ``rows`` and ``asked`` set the numbers of blocks and groups."""
    blocks, groups = max(1, -(-rows // BLOCK)), max(1, -(-asked // GROUP))
    left = vectors.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("bigint")), "part": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    right = queries.withColumns({"part": F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"), "block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))})

    def search(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, data = have["vec_id"].to_numpy(), _stack(have["embedding"])
        index = BlockIndex(codes_of(lengthened(data, longest), rotation), radius)
        wanted, points = ask["vec_id"].to_numpy(), _stack(ask["embedding"])
        turned = codes_of(np.concatenate([points / np.linalg.norm(points, axis=1)[:, None], np.zeros((len(points), 1))], axis=1), rotation)
        out = []
        for query, point, code in zip(wanted, points, turned, strict=True):
            near = index.within(code)
            near = near[ids[near] != query]
            scores = data[near] @ point
            best = _best(ids[near], scores, number)
            out.append(pd.DataFrame({"query_id": np.full(len(best), query), "vec_id": ids[near][best], "score": scores[best]}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number).select("query_id", "rank", "vec_id", "score")


def fit_radius(vectors: DataFrame, sample: list[tuple[int, list[float]]], rotation: np.ndarray, longest: float, number: int, held: float = HELD) -> int:
    """Radius that holds the share ``held`` of the true neighbours of the sampled queries, over all vectors."""
    ids, points = np.array([x[0] for x in sample]), np.array([x[1] for x in sample], dtype=np.float64)
    codes = codes_of(np.concatenate([points / np.linalg.norm(points, axis=1)[:, None], np.zeros((len(points), 1))], axis=1), rotation).view(np.uint64)[:, 0]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            have, data = frame["vec_id"].to_numpy(), _stack(frame["embedding"])
            own = codes_of(lengthened(data, longest), rotation).view(np.uint64)[:, 0]
            scores = data @ points.T
            for j, query in enumerate(ids):
                others = np.flatnonzero(have != query)
                best = others[_best(have[others], scores[others, j], number)]
                yield pd.DataFrame({"query_id": query, "vec_id": have[best], "score": scores[best, j], "distance": np.bitwise_count(own[best] ^ codes[j]).astype("int32")})

    near = vectors.mapInPandas(compare, FOUND + ", distance int")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    rows = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number).groupBy("distance").count().collect()  # at most BITS + 1 rows
    seen = np.zeros(BITS + 1)
    for distance, count in rows:
        seen[distance] = count
    return int(np.searchsorted(np.cumsum(seen), held * seen.sum())) if seen.sum() else BITS


def nearest(table: DataFrame, is_query: Column, number: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``number`` nearest found to each row where ``is_query`` holds."""
    spark = table.sparkSession
    sound = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asked")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    width = sound.agg(F.mode(F.size("embedding"), deterministic=True)).first()[0]
    sound = sound.where(F.size("embedding") == F.lit(width))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    vectors, queries = sound.select("vec_id", "embedding"), sound.where("asked").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows, longest = sound.agg(F.count("*"), F.max(length)).first()
    asked = queries.count()
    if not rows or not asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    longest = float(longest)
    fit = np.array([r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").collect()], dtype=np.float64)
    rotation = learn_rotation(lengthened(fit, longest))
    sample = [(r["vec_id"], r["embedding"]) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_QUERIES).collect()]
    radius = fit_radius(vectors, sample, rotation, longest, number)
    path = scratch_path(spark, "neighbours")
    _search(vectors, queries, rotation, longest, radius, number, rows, asked).write.parquet(path)
    found = spark.read.parquet(path)
    counts = found.groupBy(F.col("query_id").alias("q")).count()
    short = queries.join(counts, queries["vec_id"] == counts["q"], "left").where(F.coalesce("count", F.lit(0)) < min(number, rows - 1)).select("vec_id", "embedding")
    few = short.count() if radius < BITS else 0
    if not few:
        return found
    again = _search(vectors, short, rotation, longest, BITS, number, rows, few)
    return found.join(short, found["query_id"] == short["vec_id"], "left_anti").unionByName(again)
