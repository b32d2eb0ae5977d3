"""Packing of documents into sequences: combinations that fill a sequence exactly first, then best fit.

A plan is made for the counts of piece lengths, at most one count per length up to the sequence size, so it is as large
for a thousand documents as for a trillion. For each length, longest first, the gap it leaves is looked up among single,
pair and triple sums of the lengths still available, and combinations that fill it exactly are consumed in bulk. What is
left is packed by best fit, longest first, in bulk as well. Pieces of a length are numbered by counts per bucket and by
rows in a bucket, and the plan says which numbers of a length go where.

Cases: a null text counts as empty; an empty document is its end mark alone; longer documents than a sequence are cut
into full pieces, the first of which holds the remainder; equal rows are rows of their own; an empty table gives an empty
table; only doc_id and text are read, so other columns do not clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowquarry.llm.token_prefix import byte_pairs
from flowquarry.session import scratch_path

SEQUENCE = 1024
END_ID = 2
#: Pieces of one length in a bucket, about.
BUCKET_ROWS = 20_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, tie bigint"


def pieces_of(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and a hash ``tie`` of the document and its place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, end = byte_pairs(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = pairs.ids(text or "") + end
                total = len(ids) // 4
                edges = [0, *range(total % size or size, total + 1, size)] if total > size else [0, total]
                whole = zlib.crc32(ids)
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((key, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b]) if len(edges) > 2 else whole, (whole * 2654435761 + piece * 40503) % (1 << 31)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "tie"]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def _exact_partners(gap: int, have: np.ndarray, number: int, least: int) -> list[int] | None:
    """``number`` (1 to 3) available lengths of at least ``least`` that sum to the gap, longest first."""
    if number == 1:
        return [gap] if gap >= least and have[gap] else None
    lengths = np.flatnonzero(have[:gap])
    lengths = lengths[lengths >= least]
    if number == 2:
        rest = gap - lengths
        fits = (rest >= least) & (rest <= lengths) & (have[rest] > 0) & ((rest != lengths) | (have[lengths] > 1))
        return [int(lengths[fits][-1]), int(gap - lengths[fits][-1])] if fits.any() else None
    for a in lengths[::-1]:
        if 3 * a < gap:
            break
        have[a] -= 1
        pair = _exact_partners(int(gap - a), np.where(np.arange(len(have)) <= a, have, 0), 2, least) if gap - a > 1 else None
        have[a] += 1
        if pair:
            return [int(a), *pair]
    return None


def _one_plan(counts: np.ndarray, size: int, partners: int, least: int) -> list[tuple[list[int], int]]:
    have = counts.astype(np.int64).copy()
    plan: list[tuple[list[int], int]] = []

    def consume(pattern: list[int]) -> None:
        number = min(int(have[x]) // pattern.count(x) for x in set(pattern))
        for x in pattern:
            have[x] -= number
        plan.append((pattern, number))

    if have[size]:
        consume([size])
    for number in range(1, partners + 1):
        for length in range(size - 1, 0, -1):
            while have[length]:
                have[length] -= 1
                found = _exact_partners(size - length, have, number, least if number > 1 else 1)
                have[length] += 1
                if found is None:
                    break
                consume(sorted([length, *found], reverse=True))
    # best fit of what is left: open[g] holds patterns with a gap of g
    open_: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(size - 1, 0, -1):
        left = int(have[length])
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = size // length
                for n, bins in ((each, left // each), (left % each, 1)):
                    if n and bins:
                        open_.setdefault(size - n * length, []).append(([length] * n, bins))
                break
            pattern, bins = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            fill = min(gap // length, left)
            used = min(bins, left // fill)
            if used < bins:
                open_.setdefault(gap, []).append((pattern, bins - used))
            open_.setdefault(gap - fill * length, []).append((pattern + [length] * fill, used))
            left -= used * fill
    return plan + [x for rows in open_.values() for x in rows]


def packing_plan(counts: np.ndarray, size: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) with how many sequences each fills; ``counts[l]`` pieces have length l.

    Exact fills that use up all short pieces leave gaps that nothing fits, so plans with combinations of one to three
    partners, and with short pieces kept back, are made and the one with the fewest sequences is taken.
    """
    tries = [_one_plan(counts, size, partners, size // share) for partners, share in ((3, size), (3, 16), (3, 8), (3, 5), (2, size), (2, 8), (1, 1))]
    return min(tries, key=lambda plan: sum(number for _, number in plan))


def plan_rows(plan: list[tuple[list[int], int]], lengths: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first piece numbers of its ranges, their first sequence, their offset, and slots per sequence."""
    taken = np.zeros(lengths + 1, dtype=np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, number in plan:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((int(taken[length]), sequence, offset))
            taken[length] += number
            offset += length
        sequence += number
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for k, rows in found.items()}


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (read several times). Moves two narrow shuffles of the pieces.

    To the driver go one count per length; the plan sent to tasks has a few rows per length.
    """
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, number in rows:
        counts[length] = number
    where = plan_rows(packing_plan(counts, size), size)
    most = int(counts.max(initial=0))
    buckets = max(1, -(-most // BUCKET_ROWS), spark.sparkContext.defaultParallelism)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(buckets)))
    # numbers of a length before a bucket: at most ``size`` rows a bucket
    by_length = Window.partitionBy("of_length").orderBy("of_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (dealt.groupBy(F.col("length").alias("of_length"), F.col("bucket").alias("of_bucket")).count()
              .select("of_length", "of_bucket", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("before")))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "tie", "start")
    numbered = dealt.withColumn("nth", F.row_number().over(inside) - 1)
    numbered = numbered.join(before, (F.col("length") == F.col("of_length")) & (F.col("bucket") == F.col("of_bucket")))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
            lengths, numbers = frame["length"].to_numpy(), frame["number"].to_numpy()
            for length in np.unique(lengths):
                firsts, sequences, offsets = where[int(length)]
                rows = np.flatnonzero(lengths == length)
                at = np.searchsorted(firsts, numbers[rows], side="right") - 1
                sequence[rows] = sequences[at] + numbers[rows] - firsts[at]
                offset[rows] = offsets[at]
            yield frame.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    return numbered.mapInPandas(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenizes once into a table in the shared folder, then packs it."""
    path = scratch_path(docs.sparkSession, "pieces")
    pieces_of(docs, tokenizer, size, end_id).write.parquet(path)
    return pack(docs.sparkSession.read.parquet(path), size)
