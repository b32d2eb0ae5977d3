"""Fill-in-the-middle transformation by displacement scatter, and its inverse.

A text is cut into tokens (a word with the white space before it; white space at the end is one of its own). Two seeded
cuts divide it into prefix, middle and suffix, which are put out in the order prefix-suffix-middle (psm) or
suffix-prefix-middle (spm) behind marks, or the text stays plain. Texts are handled as the bytes of a batch: a scan finds
the cuts, a difference array over the batch holds at the start of each segment by how much its bytes move, its running sum
is the displacement of every byte, and one scatter writes the output. ``restore`` finds the marks in an output, and a
gather along the displacements found from them gives back the text; it sees the output and the form only.

Cases: a null text counts as empty and is plain; a null doc_id is seeded as the empty string; a text that holds a mark is
plain, so every output can be read back; long texts are read whole, a batch being cut into runs of rows of about
``RUN_BYTES``; repeated rows give repeated rows; an empty table gives an empty table; only doc_id and text are read, so
other columns do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = 3
SEED, PLAIN_FROM, SPM_BELOW = 42, 50, 80
#: Bytes of text transformed together; a longer text makes a run of its own.
RUN_BYTES = 1 << 22
PLAIN, PSM, SPM = 0, 1, 2
FORMS = pa.array(["plain", "psm", "spm"])


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, row after the last, the bytes of their texts and where each starts and the last ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, side="right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _displaced(offsets: np.ndarray, starts: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
    """Displacement of every byte of a run: at the place of each segment's first byte the change against the byte before.

    ``starts`` and ``moves`` hold one array a segment, in reading order; empty segments are passed over.
    """
    begin = np.stack(starts, axis=1).ravel()
    move = np.stack(moves, axis=1).ravel()
    filled = np.diff(np.append(begin, offsets[-1])) > 0
    begin, move = begin[filled], move[filled]
    steps = np.zeros(offsets[-1], dtype=np.int64)
    steps[begin] = np.diff(move, prepend=0)
    return np.cumsum(steps)


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words end, the number of words before each text's start and after the last, and whether white space ends a text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    following = np.ones(len(data), dtype=bool)
    following[:-1] = space[1:]
    stops = offsets[1:]
    stops = stops[stops > offsets[:-1]]
    following[stops - 1] = True
    ends = np.flatnonzero(~space & following) + 1
    tail = np.zeros(len(offsets) - 1, dtype=bool)
    tail[offsets[1:] > offsets[:-1]] = space[stops - 1]
    return ends, np.searchsorted(ends, offsets, side="right"), tail


def transform_run(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, form, code points of prefix and middle, output bytes and their offsets, for a run and its four draws a row."""
    ends, before, tail = token_ends(data, offsets)
    start, stop = offsets[:-1], offsets[1:]
    n_words = np.diff(before)
    n = n_words + tail
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)

    def place(units: np.ndarray) -> np.ndarray:
        at = start.copy()
        words = (units > 0) & (units <= n_words)
        at[words] = ends[(before[:-1] + units - 1)[words]]
        return np.where(units > n_words, stop, at)

    first, second = place(cuts[:, 0]), place(cuts[:, 1])
    marked = np.zeros(len(start), dtype=bool)
    marked[mark_places(data, offsets)[2]] = True
    plain = (n == 0) | marked | (draws[:, 2] % 100 >= PLAIN_FROM)
    form = np.where(plain, PLAIN, np.where(draws[:, 3] % 100 < SPM_BELOW, SPM, PSM))
    out_offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) + np.where(plain, 0, 3 * MARK))])
    shift, spm = out_offsets[:-1] - start, form == SPM
    prefix, middle, suffix = first - start, second - first, stop - second
    # where the marks and segments of a row go, from the start of its output
    at_prefix = np.where(plain, 0, np.where(spm, suffix + 2 * MARK, MARK))
    at_middle = np.where(plain, prefix, prefix + suffix + 3 * MARK)
    at_suffix = np.where(plain, prefix + middle, np.where(spm, MARK, prefix + 2 * MARK))
    moves = [shift + at_prefix, shift + at_middle - prefix, shift + at_suffix - prefix - middle]
    out = np.empty(out_offsets[-1], dtype=np.uint8)
    out[np.arange(len(data)) + _displaced(offsets, [start, first, second], moves)] = data
    for mark, at in ((PREFIX, at_prefix), (MIDDLE, at_middle), (SUFFIX, at_suffix)):
        spots = (out_offsets[:-1] + at - MARK)[~plain]
        for i, octet in enumerate(mark.encode()):
            out[spots + i] = octet
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return n, form, points[first] - points[start], points[second] - points[first], out, out_offsets


def mark_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the marks of a run of texts start, their letters, and the rows they are in."""
    spots = np.flatnonzero(data[:-2] == ord("<")) if len(data) >= MARK else np.zeros(0, dtype=np.int64)
    letters = data[spots + 1]
    rows = np.searchsorted(offsets, spots, side="right") - 1
    good = (data[spots + 2] == ord(">")) & np.isin(letters, np.frombuffer(b"PSM", dtype=np.uint8)) & (spots + MARK <= offsets[rows + 1])
    return spots[good], letters[good], rows[good]


def restore_run(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts from which a run of outputs was made."""
    start, stop = offsets[:-1], offsets[1:]
    moved = form != PLAIN
    spots, letters, rows = mark_places(data, offsets)
    at = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at[mark] = start.copy()
        of_mark = letters == ord(mark[1])
        at[mark][rows[of_mark]] = spots[of_mark]
    spm = form == SPM
    size = stop - start
    prefix = np.where(moved, np.where(spm, at[MIDDLE], at[SUFFIX]) - at[PREFIX] - MARK, size)
    middle = np.where(moved, stop - at[MIDDLE] - MARK, 0)
    out_offsets = np.concatenate([[0], np.cumsum(size - np.where(moved, 3 * MARK, 0))])
    begin = out_offsets[:-1]
    first, second = begin + prefix, begin + prefix + middle
    sources = [np.where(moved, at[PREFIX] + MARK, start) - begin, at[MIDDLE] + MARK - first, at[SUFFIX] + MARK - second]
    return data[np.arange(out_offsets[-1]) + _displaced(out_offsets, [begin, first, second], sources)], out_offsets


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, tokens, form, code points of prefix and middle (null if plain), output. One pass, no shuffle."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.stack([batch[f"h{i}"].to_numpy() for i in (1, 2, 3, 4)], axis=1)
            for a, b, data, offsets in _runs(batch["text"]):
                n, form, prefix, middle, out, out_offsets = transform_run(data, offsets, hashes[a:b])
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"][a:b], pa.array(n), FORMS.take(pa.array(form)), pa.array(prefix, pa.int64(), mask=plain),
                    pa.array(middle, pa.int64(), mask=plain), _texts(out, out_offsets)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *draws).mapInArrow(run, SCHEMA)


def restore(made: DataFrame) -> DataFrame:
    """Adds ``restored``, the text rebuilt from output and form, to rows of ``fill_in_middle``."""
    schema = StructType([*made.schema.fields]).add("restored", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pc.index_in(batch["form"], FORMS).fill_null(PLAIN).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in _runs(batch["output"]):
                text, text_offsets = restore_run(data, offsets, codes[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(text, text_offsets)], [*part.schema.names, "restored"])

    return made.mapInArrow(run, schema)
