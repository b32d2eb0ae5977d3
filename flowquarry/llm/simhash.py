"""Near-duplicate documents by 64-bit SimHash fingerprints and a hierarchical index in Gray order.

A text is lower-cased (ASCII), cut into words and four-word shingles, repeats included (fewer words: the whole sequence;
none: fingerprint zero). A bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64 values. Documents
link if their fingerprints differ in ``DISTANCE`` bits or fewer.

The index holds distinct fingerprints. They are dealt ``DISTANCE + 1`` times, each time rotated so that another segment
of bits leads: two linked fingerprints agree in one segment at least, so the top nodes are the patterns of the leading
segment and only members of one top node are compared. Below a top node codes stand in the order of their Gray rank,
in which neighbours differ in few bits; every ``FANOUT`` of them share a node that holds the bits all of them have in
common, and so on upwards. The search runs down pairs of nodes: the differences between common bits accumulate towards
the leaves, and a pair with more than ``DISTANCE`` of them goes with all its members. A pair whose members cannot differ in
more bits than that is linked whole, and pairs already in one component are not looked at again, so a dense group gives as
many links as members, not all its pairs. A top node of more than ``CROWD`` codes is cut into blocks of neighbouring Gray
ranks by range partitioning; pairs of blocks are pruned by their common bits in the same way and compared as tasks of
their own, so no task holds more than two blocks.

Cases: null and empty texts have fingerprint zero, which links like any other; long texts are read whole, in blocks of
shingles; equal rows share a fingerprint; rows that share a doc_id with different texts are documents of their own; a null
doc_id is never the smallest, and a component of nulls alone has a null id; an empty table gives an empty table; only
doc_id and text are read, so other columns do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowquarry.llm.forest import Forest
from flowquarry.llm.near_dup import components
from flowquarry.session import scratch_path, store_scratch

WORDS, SEED, BITS = 4, 42, 64
DISTANCE = 4
FANOUT = 8
#: Codes of a top node beyond which it is cut into blocks of about so many.
CROWD = 32_768
#: Node pairs and codes looked at together in a task, and shingles hashed together.
PAIRS, GATHERED, SHINGLES = 1 << 19, 1 << 16, 1 << 16
U = np.uint64


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(sizes) - 1
    starts = stops - sizes + 1
    joined = b" ".join(words)
    ends = stops[WORDS - 1:] if len(words) >= WORDS else stops[-1:]
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), SHINGLES):
        part = ends[at:at + SHINGLES]
        firsts = starts[at:at + len(part)]
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(firsts.tolist(), part.tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and code, the fingerprint as a signed number. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(x.as_py()) for x in batch["text"]), U, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, code bigint")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit from the top, width) of the segments that lead in turn."""
    edges = [BITS * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray order."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def of_rank(rank: np.ndarray) -> np.ndarray:
    """The codes that stand at given places of the Gray order."""
    return rank ^ (rank >> U(1))


def turned(code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Codes rotated to the right by so many bits."""
    right = bits.astype(U) % U(BITS)
    return (code >> right) | (code << ((U(BITS) - right) % U(BITS)))


def dealt(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, turn, rank): each code once under every top node it belongs to, with its Gray rank when that segment leads."""
    parts = []
    for number, (first, width) in enumerate(segments(distance)):
        code = F.col("code")
        led = code if first == 0 else F.shiftleft(code, first).bitwiseOR(F.shiftrightunsigned(code, BITS - first))
        node = F.shiftrightunsigned(led, BITS - width).bitwiseOR(F.lit(number << 32).cast("bigint"))
        parts.append(F.struct(node.alias("node"), F.lit(first).alias("turn"), gray_rank(led).alias("rank")))
    return codes.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


class GrayIndex:
    """Hierarchy over codes sorted by (group, Gray rank): each level's nodes hold the bits their members have in common."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        self.starts, self.both, self.any = [], [codes], [codes]
        while True:
            new = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            place = np.arange(len(groups)) - np.repeat(new, np.diff(np.append(new, len(groups))))
            starts = np.flatnonzero(place % FANOUT == 0)
            self.starts.append(np.append(starts, len(groups)))
            self.both.append(np.bitwise_and.reduceat(self.both[-1], starts))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], starts))
            groups = groups[starts]
            if (groups[1:] != groups[:-1]).all():
                break
        self.roots = groups

    def spread(self, forest: Forest) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least and greatest component below each node, by level."""
        low, high = [forest.label], [forest.label]
        for starts in self.starts:
            low.append(np.minimum.reduceat(low[-1], starts[:-1]))
            high.append(np.maximum.reduceat(high[-1], starts[:-1]))
        return low, high

    def first_code(self, level: int, nodes: np.ndarray) -> np.ndarray:
        for starts in self.starts[:level][::-1]:
            nodes = starts[nodes]
        return nodes

    def search(self, distance: int, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """For each code the first place of its component under links of at most ``distance`` bits.

        ``pairs`` are root nodes to be compared; by default each with itself.
        """
        forest, top = Forest(len(self.both[0])), len(self.starts)
        every = np.arange(len(self.roots))
        todo = [(top, *(pairs or (every, every)))]
        while todo:
            level, left, right = todo.pop()
            if len(left) > PAIRS:
                todo += [(level, left[at:at + PAIRS], right[at:at + PAIRS]) for at in range(0, len(left), PAIRS)][::-1]
                continue
            low, high = self.spread(forest)
            one = np.minimum(low[level][left], low[level][right]) == np.maximum(high[level][left], high[level][right])
            one &= (left != right) | (low[level][left] == high[level][left])
            fixed_l, fixed_r = (~(self.both[level][x] ^ self.any[level][x]) for x in (left, right))
            apart = self.both[level][left] ^ self.both[level][right]
            near = np.bitwise_count(apart & fixed_l & fixed_r) <= distance
            whole = near & (np.bitwise_count(apart | ~fixed_l | ~fixed_r) <= distance) & ~one
            if whole.any():
                firsts = [self.first_code(level, x[whole]) for x in (left, right)]
                lasts = [self.first_code(level, x[whole] + 1) for x in (left, right)]
                for a, b, stop in ((firsts[0], firsts[0], lasts[0]), (firsts[0], firsts[1], lasts[1])):
                    size = stop - b
                    at = np.repeat(b - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    forest.join(np.repeat(a, size), at)
            go = near & ~whole & ~one
            if level == 0 or not go.any():
                continue
            left, right, starts = left[go], right[go], self.starts[level - 1]
            wide = starts[right + 1] - starts[right]
            count = (starts[left + 1] - starts[left]) * wide
            for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1)[::-1]:
                number = count[part]
                at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                across = np.repeat(wide[part], number)
                a = np.repeat(starts[left[part]], number) + at // across
                b = np.repeat(starts[right[part]], number) + at % across
                kept = a < b if level == 1 else a <= b
                todo.append((level - 1, a[kept], b[kept]))
        return forest.label


LINKS = "a bigint, b bigint"


def _links(groups: np.ndarray, turn: np.ndarray, rank: np.ndarray, distance: int) -> pa.RecordBatch:
    """One link from each code to the first of its component, for rows sorted by (group, rank)."""
    ranks = rank.astype(np.int64, copy=False).view(U)
    index = GrayIndex(groups, of_rank(ranks))
    label = index.search(distance)
    codes = turned(of_rank(ranks), turn).view(np.int64)
    tied = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(codes[label[tied]]), pa.array(codes[tied])], ["a", "b"])


def _within_nodes(rows: DataFrame, distance: int) -> DataFrame:
    """Links within top nodes, from rows in one partition per node, sorted by node and rank; some nodes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rest = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            held.append(np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "turn", "rank")]))
            if sum(x.shape[1] for x in held) < GATHERED:
                continue
            node, turn, rank = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if cut:
                yield _links(node[:cut], turn[:cut], rank[:cut], distance)
            held = [np.stack([node[cut:], turn[cut:], rank[cut:]])]
        rest = np.concatenate(held, axis=1) if held else rest
        if len(rest[0]):
            yield _links(*rest, distance)

    return rows.repartition("node").sortWithinPartitions("node", "rank").select("node", "turn", "rank").mapInArrow(run, LINKS)


def _between_blocks(rows: DataFrame, number: int, distance: int, crowd: int) -> DataFrame:
    """Links within crowded top nodes, by pairs of blocks of neighbouring Gray ranks that common bits do not rule out."""
    code = F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", 1))
    ranged = rows.repartitionByRange(-(-number // crowd), "node", "rank").select("*", F.spark_partition_id().alias("block"), code.alias("led"))
    blocks = store_scratch(ranged, "simhash-blocks")
    seen = blocks.groupBy("node", "block").agg(F.bit_and("led").alias("both"), F.bit_or("led").alias("any"))
    fixed = seen.select("node", "block", "both", F.bitwise_not(F.col("both").bitwiseXOR(F.col("any"))).alias("fixed"))
    other = fixed.select(F.col("node").alias("of"), F.col("block").alias("high"), F.col("both").alias("their"), F.col("fixed").alias("theirs"))
    differ = F.bit_count(F.col("both").bitwiseXOR(F.col("their")).bitwiseAND(F.col("fixed")).bitwiseAND(F.col("theirs")))
    pairs = (fixed.join(other, (F.col("node") == F.col("of")) & (F.col("block") <= F.col("high"))).where(differ <= distance)
             .select("node", F.col("block").alias("low"), "high"))
    sides = pairs.select("node", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        return _links(np.zeros(len(frame), dtype=np.int64), frame["turn"].to_numpy(np.int64), frame["rank"].to_numpy(), distance).to_pandas()

    return blocks.join(sides, ["node", "block"]).select("node", "low", "high", "turn", "rank").groupBy("node", "low", "high").applyInPandas(compare, LINKS)


def linked_codes(codes: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join exactly the distinct ``code`` values within ``distance`` bits of one another, directly or not."""
    rows = dealt(codes, distance)
    crowds = store_scratch(rows.groupBy("node").agg(F.count("*").alias("number")).where(F.col("number") > crowd), "simhash-crowds")
    number = crowds.agg(F.sum("number")).first()[0]
    if not number:
        return _within_nodes(rows, distance)
    calm = rows.join(crowds, "node", "left_anti")
    return _within_nodes(calm, distance).unionByName(_between_blocks(rows.join(crowds.select("node"), "node", "left_semi"), number, distance, crowd))


def simhash_groups(docs: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: doc_id, code (signed), component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    marked = store_scratch(fingerprints(docs), "simhash-codes")
    classes = store_scratch(marked.groupBy("code").agg(F.min("doc_id").alias("least")), "simhash-classes")
    path = scratch_path(spark, "simhash-links")
    linked_codes(classes.select("code"), distance, crowd).write.parquet(path)
    labels = components(spark.read.parquet(path).distinct())
    tied = labels.join(classes, labels["id"] == classes["code"])
    least = tied.groupBy("component").agg(F.min("least").alias("reached"))
    reached = labels.join(least, "component").select(F.col("id").alias("linked"), "reached")
    named = classes.join(reached, classes["code"] == reached["linked"], "left").select(
        F.col("code").alias("of"), F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("reached")).alias("component_id"))
    return marked.join(named, marked["code"] == named["of"]).select("doc_id", "code", "component_id")
