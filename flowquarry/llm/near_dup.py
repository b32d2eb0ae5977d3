"""Near-duplicate documents by SetSketch registers: banding, a joint likelihood estimate, then exact verification.

A document's set is its distinct five-word shingles (ASCII lower case; fewer words: the whole sequence as one; no words:
empty and never linked). A register is the smallest of exponential hash values of the set, truncated to a power of
``BASE``, so that registers of unions are maxima and equal registers tell of similar sets. Documents with equal sets
form a class at once. Classes that agree on a band of registers share a bucket; a bucket names as pivot the member that
meets most others over all its buckets, and members are paired with it, so a group of any size gives as many pairs as
members. Pairs whose likeliest Jaccard value is far below the threshold go; the others are confirmed on the full sets.
A second round takes a pivot outside the first one's component. What stands in buckets that then still hold several
components is joined on rare shingles: sets as alike as asked for share one of their first shingles in any order that all
sets use, so each gives only as many as it may lack and one more, rarest first, and sets of unlike components that share
one of those are estimated and confirmed like other pairs. Texts that have a common passage but no more thus never meet.
The order comes from a table of ``SLOTS`` counters; it decides how few sets meet, not which links are found.

Cases: null and empty texts get an empty set, no links, and stay; equal rows are one class; rows that share a doc_id with
different texts count as one node; a null doc_id never becomes a class's id unless all its rows have none; an empty table
gives an empty table; only doc_id and text are read, so other columns do not clash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowquarry.llm.forest import Forest
from flowquarry.session import drop_scratch, scratch_path

WORDS = 5
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: A pair at the threshold shares no band with this chance at most; lower thresholds get more bands for it.
MISSED = 1.2e-5
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Pairs are verified if the estimate is above the threshold less this: about five standard errors.
SLACK = 0.15
PIVOT_ROUNDS = 2
#: Members of a block, about, of the sets that share a rare shingle, and counters that tell rare from frequent.
BLOCK, SLOTS = 512, 1 << 20
#: Members of a shingle up to which all are paired at once, and shingles of a membership table.
FEW, COLUMNS = 16, 8_192
#: Pieces in which the counters are added up, and pairs estimated at a time.
PIECES, PAIRS = 64, 8_192
CHUNK_BYTES = 1 << 20
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=4)
def _tables(registers: int = REGISTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    octets = rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
    factors = rng.integers(0, 1 << 31, registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = rng.integers(0, 1 << 32, registers, dtype=np.uint32)
    return octets, factors, offsets


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for x in (base, inverse):
        steps = np.full(size, x, dtype=U)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=U))
    return out[0], out[1]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    size = 1 << max(21, (len(raw) + 1).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(_tables()[0][raw] * power[:len(raw)], out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(U)), starts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, from whole texts in chunks of about a megabyte."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    held = 0
    for text in [*texts, None]:
        if chunk and (held > CHUNK_BYTES or len(out) + len(chunk) == len(texts)):
            out += _chunk_sets(chunk)
            chunk, held = [], 0
        if len(out) + len(chunk) < len(texts):
            data = (text or "").encode().lower()
            chunk.append(data)
            held += len(data)
    return out


def _chunk_sets(chunk: list[bytes]) -> list[np.ndarray]:
    hashes, starts = _word_hashes(b"\n".join(chunk) + b"\n")
    sizes = np.fromiter(map(len, chunk), np.int64, len(chunk)) + 1
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    spread = U(0xD6E8FEB86659FD93)
    whole = np.zeros(max(0, len(hashes) - WORDS + 1), dtype=U)
    for j in range(WORDS):
        whole = whole * spread + hashes[j:j + len(whole)]
    whole = _mix(whole + U(WORDS))
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= WORDS:
            rows = np.sort(whole[a:b - WORDS + 1])
            keep = np.ones(len(rows), dtype=bool)
            np.not_equal(rows[1:], rows[:-1], out=keep[1:])
            out.append(rows[keep])
        elif b > a:
            value = np.zeros(1, dtype=U)
            for x in hashes[a:b]:
                value = value * spread + x
            out.append(_mix(value + U(b - a)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def band_count(percent: int) -> int:
    """Bands that a threshold needs."""
    meet = (percent / 100) ** ROWS
    return BANDS if meet >= 1 else max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-meet)))


def set_minima(values: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Smallest hash of a set for each register, as 32-bit numbers."""
    _, factors, offsets = _tables(registers)
    low = np.full(registers, 0xFFFFFFFF, dtype=np.uint32)
    narrow = (values >> U(32)).astype(np.uint32)
    for at in range(0, len(narrow), 512):
        table = narrow[at:at + 512, None] * factors
        table ^= table >> np.uint32(15)
        table *= np.uint32(0x2C1B3C6D)
        table += offsets
        np.minimum(low, table.min(axis=0), out=low)
    return low


def registers_of(minima: np.ndarray) -> np.ndarray:
    """Registers floor(1 - log_b(h)), h the smallest exponential value of rate RATE, within 0 and TOP."""
    least = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def jaccard_estimates(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, steps: int = 101) -> np.ndarray:
    """Likeliest Jaccard values of pairs (rows), from which register is larger and the known set sizes."""
    above, below = (left > right).sum(axis=1), (left < right).sum(axis=1)
    equal = left.shape[1] - above - below
    u = n_left / (n_left + n_right)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, steps)[None, :] * most[:, None]

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    score = above[:, None] * np.log(up + tiny) + below[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.clip(1 - up - down, 0, 1) + tiny)
    return grid[np.arange(len(grid)), score.argmax(axis=1)]


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about a megabyte of text or a single longer one, so that one run's texts and sets are held at a time."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    number = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, stop - start)


SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, registers binary"


def sketches(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """Per row: size and 128-bit digest of its set, registers. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            sets = shingle_sets(batch["text"].to_pylist())
            registers = registers_of(np.array([set_minima(x, bands * ROWS) for x in sets]))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array([len(x) for x in sets], pa.int64()), *_digests(sets),
                pa.array([x.tobytes() for x in registers], pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "registers"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Keys of the bands of registers (rows), one column a band."""
    bands = registers.shape[1] // ROWS
    keys = np.zeros((len(registers), bands), dtype=U)
    for j in range(ROWS):
        keys = _mix(keys + registers.reshape(len(registers), bands, ROWS)[:, :, j].astype(U) + U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return _mix(keys + np.arange(bands, dtype=U)).view(np.int64)


def buckets(classes: DataFrame) -> DataFrame:
    """(id, bucket) of each class: one row a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch["registers"].to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["class_id"].to_numpy(), keys.shape[1])), pa.array(keys.ravel())], ["id", "bucket"])

    return classes.where("class_id is not null").select("class_id", "registers").mapInArrow(run, "id bigint, bucket bigint").distinct()


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """The 128-bit digest of each set, in two halves."""
    return tuple(pa.array(np.array([_mix(x ^ U(salt)).sum(dtype=U) for x in sets], dtype=U).view(np.int64)) for salt in (0, 0xA5A5A5A5A5A5A5A5))


def full_sets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the digest of its set and the whole set as sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            sets = shingle_sets(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *_digests(sets), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "set_a", "set_b", "members"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, set_a bigint, set_b bigint, members binary")


class _Scratch:
    """Narrow tables in the shared folder between jobs; those that are read no more are removed."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            drop_scratch(self.spark, self.paths.pop(id(table))[1])


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component) of all ids in ``links`` (a, b): the smallest id reachable. ``known`` adds earlier labels.

    Labels take the least of their neighbours, then that of their label, until nothing changes: the number of rounds
    follows the logarithm of the longest path, not the size of a group.
    """
    scratch = _Scratch(links.sparkSession)
    edges = links.select("a", "b")
    if known is not None:
        edges = edges.unionByName(known.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    edges = scratch.keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.keep(edges.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("component")), "labels")
    while True:
        near = (edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near")))
        closer = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("of"), F.col("component").alias("theirs"))
        stepped = closer.join(jump, closer["component"] == jump["of"], "left").select("id", "was", F.least("component", "theirs").alias("component"))
        newer = scratch.keep(stepped, "labels")
        scratch.drop(labels)
        labels = newer
        if labels.where("component <> was").isEmpty():
            scratch.drop(edges)
            return labels.select("id", "component")


def _likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow and whose registers suggest the similarity asked for."""

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                left, right = (np.frombuffer(b"".join(frame[c]), dtype=np.uint16).reshape(len(frame), -1) for c in ("registers_a", "registers_b"))
                seen = jaccard_estimates(left, right, frame["n_a"].to_numpy(float), frame["n_b"].to_numpy(float))
                yield frame.loc[seen >= percent / 100 - SLACK, ["a", "b"]]

    of = lambda x: classes.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}"))
    sized = F.col("n_a").between(F.col("n_b") * percent / 100, F.col("n_b") * 100 / percent)
    return pairs.join(of("a"), "a").join(of("b"), "b").where(sized).mapInPandas(likely, "a bigint, b bigint").distinct()


def _exact_pairs(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for left, right in zip(frame["members_a"], frame["members_b"], strict=True):
                both = np.sort(np.frombuffer(left + right, dtype=U))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared) and shared > 0)
            yield frame.loc[np.array(keep, dtype=bool), ["a", "b"]]

    named = lambda x: sets.select(F.col("id").alias(x), F.col("members").alias(f"members_{x}"))
    return near.join(named("a"), "a").join(named("b"), "b").mapInPandas(exact, "a bigint, b bigint").distinct()


def _slots(values: np.ndarray) -> np.ndarray:
    return (_mix(values) >> U(65 - SLOTS.bit_length())).astype(np.int64)


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles fall into each of SLOTS counters: a number of values that does not grow with the sets.

    A task's counters end at 65,535, for more than that is frequent in any case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for members in batch["members"]:
                np.add.at(total, _slots(np.frombuffer(members.as_py(), dtype=U)), 1)
        if total.any():
            pieces = np.minimum(total, 65_535).astype(np.uint16).reshape(PIECES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES)), pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "numbers"])

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS // PIECES, dtype=np.int64)
        for frame in frames:
            for numbers in frame["numbers"]:
                total += np.frombuffer(numbers, dtype=np.uint16)
        yield pd.DataFrame({"piece": [key[0]], "numbers": [np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()]})

    kind = "piece bigint, numbers binary"
    counted = sets.select("members").mapInArrow(run, kind).groupBy("piece").applyInPandas(add, kind).collect()
    counts = np.zeros((PIECES, SLOTS // PIECES), dtype=np.int32)
    for piece, numbers in counted:
        counts[piece] = np.frombuffer(numbers, dtype=np.int32)
    return counts.ravel()


def rare_shingles(values: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set of which every set alike enough has at least one among its own, first in the order of counts."""
    most = len(values) - (percent * len(values) + 99) // 100 + 1
    return values[np.lexsort((values, counts[_slots(values)]))[:most]]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of two lists of sorted sets, by products of membership tables of COLUMNS shingles."""
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)))
    for at in range(0, len(known), COLUMNS):
        part = known[at:at + COLUMNS]
        tables = []
        for sets in (left, right):
            table = np.zeros((len(sets), len(part)), dtype=np.float32)
            for row, values in enumerate(sets):
                low, high = np.searchsorted(values, [part[0], part[-1]], side="left")
                inside = values[low:high + 1]
                place = np.minimum(np.searchsorted(part, inside), len(part) - 1)
                table[row, place[part[place] == inside]] = 1
            tables.append(table)
        total += tables[0] @ tables[1].T
    return total


def _blocks_of(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return tuple(frame[frame["block"] == frame[c].iloc[0]].reset_index(drop=True) for c in ("low", "high"))


def _rarely_linked(crossed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all alike sets of unlike components among ``crossed`` (id, component).

    Shingles with the same members count once. The few members of a shingle are paired at once; those of a frequent one
    are compared in tasks by pairs of blocks: first by registers, which leaves the members with a likely partner they do
    not meet in an earlier shingle, then these by full sets. No step returns more rows than members.
    """
    counts = slot_counts(sets)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = [rare_shingles(np.frombuffer(x.as_py(), dtype=U), counts, percent).view(np.int64) for x in batch["members"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rare, pa.list_(pa.int64()))], ["id", "rare"])

    scratch = _Scratch(sets.sparkSession)
    rare = sets.select("id", "members").mapInArrow(first, "id bigint, rare array<bigint>")
    met = scratch.keep(rare.join(crossed, "id").select("id", "component", F.explode("rare").alias("shingle")).distinct(), "rare")
    mixed = met.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("number"),
                                       F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("also")).where("least < most")
    once = mixed.groupBy("number", "who", "also").agg(F.min("shingle").alias("shingle")).select("shingle", "number")
    dealt = scratch.keep(met.join(once, "shingle"), "dealt")
    scratch.drop(met)
    some = dealt.where(F.col("number") <= FEW)
    few = (some.select("shingle", F.col("id").alias("a"), F.col("component").alias("of_a")).join(some.select("shingle", F.col("id").alias("b"), F.col("component").alias("of_b")), "shingle")
           .where("a < b and of_a <> of_b").select("a", "b").distinct())
    blocks = F.ceil(F.col("number") / BLOCK)
    often = dealt.where(F.col("number") > FEW)
    keyed = (often.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
             .select("shingle", "id", "component", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
             .select("shingle", "id", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    known = (classes.join(often.groupBy(F.col("id").alias("class_id")).agg(F.array_sort(F.collect_list("shingle")).alias("shingles")), "class_id")
             .select(F.col("class_id").alias("id"), "n_shingles", "registers", "shingles"))

    def hopeful(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = _blocks_of(frame)
        here, found = frame["shingle"].iloc[0], [set(), set()]
        sizes, of, ids = ([x[c].to_numpy() for x in (left, right)] for c in ("n_shingles", "component", "id"))
        i, j = np.nonzero((of[0][:, None] != of[1][None, :]) & (100 * sizes[1][None, :] >= percent * sizes[0][:, None]) & (100 * sizes[0][:, None] >= percent * sizes[1][None, :]))
        registers = [np.frombuffer(b"".join(x["registers"]), dtype=np.uint16).reshape(len(x), -1) if len(x) else None for x in (left, right)]
        before = [[{s for s in x if s < here} for x in part["shingles"]] for part in (left, right)]
        for at in range(0, len(i), PAIRS):
            a, b = i[at:at + PAIRS], j[at:at + PAIRS]
            likely = jaccard_estimates(registers[0][a], registers[1][b], sizes[0][a].astype(float), sizes[1][b].astype(float)) >= percent / 100 - SLACK
            for x, y in zip(a[likely].tolist(), b[likely].tolist(), strict=True):
                if before[0][x].isdisjoint(before[1][y]):
                    found[0].add((ids[0][x], of[0][x], left["block"].iloc[x]))
                    found[1].add((ids[1][y], of[1][y], right["block"].iloc[y]))
        rows = [(here, *key, frame["low"].iloc[0], frame["high"].iloc[0]) for key in found[0] | found[1]]
        return pd.DataFrame(rows, columns=["shingle", "id", "component", "block", "low", "high"]).astype("int64")

    kind = "shingle bigint, id bigint, component bigint, block bigint, low bigint, high bigint"
    hoped = scratch.keep(keyed.join(known, "id").groupBy("shingle", "low", "high").applyInPandas(hopeful, kind), "hopeful")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = _blocks_of(frame)
        members = [[np.frombuffer(x, dtype=U) for x in part["members"]] for part in (left, right)]
        forest, ids = Forest(len(left) + len(right)), np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
        if len(left) and len(right):
            shared = shared_counts(*members)
            union = np.array([len(x) for x in members[0]])[:, None] + np.array([len(x) for x in members[1]])[None, :] - shared
            i, j = np.nonzero((100 * shared >= percent * union) & (shared > 0))
            forest.join(i, len(left) + j)
        a, b = forest.links()
        return pd.DataFrame({"a": ids[a], "b": ids[b]}).astype("int64")

    many = hoped.join(sets.select("id", "members"), "id").groupBy("shingle", "low", "high").applyInPandas(compare, "a bigint, b bigint").where("a <> b")
    return _exact_pairs(_likely_pairs(few, classes, percent), sets, percent).unionByName(many).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (least doc_id with an equal set), component_id, kept."""
    spark = docs.sparkSession
    scratch = _Scratch(spark)
    sketched = scratch.keep(sketches(docs, band_count(percent)), "sketches")
    filled = sketched.where("n_shingles > 0")
    classes = scratch.keep(filled.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes")
    known = scratch.keep(sketched.select("doc_id", "n_shingles", "set_a", "set_b"), "known")
    scratch.drop(sketched)
    banded = buckets(classes)
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("number")).where("number > 1")
    met = scratch.keep(banded.join(crowded, "bucket"), "met")
    # how many others a member meets over all its buckets: the middle of a group meets most
    degrees = scratch.keep(met.groupBy("id").agg(F.sum("number").alias("degree")), "degrees")
    shared = scratch.keep(met.join(degrees, "id").select("bucket", "id", "number", "degree"), "shared")
    scratch.drop(met)
    labels = scratch.keep(degrees.select("id", F.col("id").alias("component")), "labels")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(degrees.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates()
    sets = scratch.keep(full_sets(texts).withColumnRenamed("doc_id", "id"), "sets")
    links, pivots, before = None, None, ()
    for turn in range(PIVOT_ROUNDS + 1):
        placed = shared.join(labels, "id")
        if pivots is not None:  # another pivot, outside the component of the last
            placed = placed.join(pivots, "bucket", "left")
            free = F.coalesce(F.col("component") != F.col("pivot_component"), F.lit(True))
        else:
            free = F.lit(True)
        rank = F.when(free, F.struct(F.col("degree").alias("degree"), (-F.col("id")).alias("order"), "id", "component"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max(rank).alias("pivot"))
        mixed = scratch.keep(mixed.where("least < most").select("bucket", F.col("pivot.id").alias("pivot"), F.col("pivot.component").alias("of_pivot")), "mixed")
        if mixed.isEmpty():
            break
        if turn == PIVOT_ROUNDS:
            crossed = scratch.keep(shared.join(labels, "id").join(mixed.select("bucket"), "bucket", "left_semi").select("id", "component").distinct(), "crossed")
            found = _rarely_linked(crossed, classes, sets, percent)
        else:
            pairs = placed.join(mixed, "bucket").where("component <> of_pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
            near = scratch.keep(_likely_pairs(pairs.distinct(), classes, percent), "pairs")
            found = _exact_pairs(near, sets, percent)
        links_now = scratch.keep(found, "links")
        links = links_now if links is None else links.unionByName(links_now)
        merged = components(links)
        newer = scratch.keep(labels.drop("component").join(merged, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
        scratch.drop(labels, *before)
        labels, before = newer, (mixed,)
        pivots = mixed.join(labels.select(F.col("id").alias("pivot"), F.col("component").alias("pivot_component")), "pivot").select("bucket", "pivot_component")
    named = known.join(classes.select("set_a", "set_b", "class_id"), ["set_a", "set_b"], "left")
    reached = named.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "class_id", "doc_id"))
    return reached.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), alone.alias("component_id"),
                          F.col("doc_id").eqNullSafe(alone).alias("kept"))
