"""Quality of documents by a byte-level convolutional network in numpy.

Bytes are embedded, FILTERS learned filters of WIDTH bytes run over the whole text, and each is max-pooled over chunks of
two blocks that overlap by one block. The mean, largest and smallest pooled response over all chunks of a document, and
its length, go through one hidden layer to one probability. For scoring, embedding and filters are folded into one table per place in
the filter, so a response is a sum of table rows.

The network is fitted on a bounded sample: at most ``fit_rows`` labelled documents (half of each label if there are as
many), chosen by a hash of their id, weighted back to the labels' shares. Every document is scored, over its whole text; a task
holds the responses of about a megabyte of text, or of a single longer text, at a time.

Cases: null and empty texts are scored as a few zero bytes; repeated labels of a document count as their least; labels
other than 0 and 1 are not used; a null doc_id is not held out and not learned from; without usable labels of both kinds
every score is the share of label 1, or 0.5 without labels; repeated rows are scored alike; an empty table gives an empty
table; only doc_id and text of the documents are read, so other columns do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowquarry.llm.near_dup import pieces

WIDTH, DEPTH, FILTERS, HIDDEN, BLOCK = 6, 8, 32, 16, 128
FIT_ROWS = 1_600
EPOCHS, BATCH, RATE = 14, 32, 0.01
BUFFER = 1 << 15


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(draw(0.5, 256, DEPTH), draw(0.3, WIDTH, DEPTH, FILTERS), draw(0.0, FILTERS), draw(0.1, 3 * FILTERS + 1, HIDDEN), draw(0.0, HIDDEN), draw(0.3, HIDDEN), draw(0.0, 1))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def tables(self) -> np.ndarray:
        """One row of FILTERS numbers for each place and byte."""
        return np.einsum("bd,wdf->wbf", self.embed, self.filters)


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts end to end, each padded to WIDTH; first response of each block; number of blocks of each text."""
    padded = [t if len(t) >= WIDTH else t.ljust(WIDTH, b"\0") for t in texts]
    sizes = np.array([len(t) for t in padded])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    blocks = -(-(sizes - WIDTH + 1) // BLOCK)
    starts = np.repeat(first, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    return np.frombuffer(b"".join(padded), dtype=np.uint8), starts, blocks


def _responses(tables: np.ndarray, data: np.ndarray) -> np.ndarray:
    count = len(data) - WIDTH + 1
    out = tables[0][data[:count]]
    held = np.empty_like(out)
    for place in range(1, WIDTH):
        np.take(tables[place], data[place:place + count], axis=0, out=held, mode="clip")
        out += held
    return out


def _block_peaks(tables: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each block, and the number of blocks of each text; memory is one buffer."""
    found, numbers = [], []
    for text in texts:  # long texts go through the buffer piece by piece, cut at block edges
        number = 0
        for at in range(0, max(1, len(text) - WIDTH + 1), BUFFER):
            data, starts, blocks = _layout([text[at:at + BUFFER + WIDTH - 1]])
            found.append(np.maximum.reduceat(_responses(tables, data), starts, axis=0))
            number += int(blocks[0])
        numbers.append(number)
    return np.concatenate(found), np.array(numbers)


def _grouped_peaks(tables: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for many texts, short ones together in one buffer."""
    peaks, numbers = [], []
    group: list[bytes] = []
    held = 0
    for text in [*texts, None]:
        if group and (text is None or held + len(text) > BUFFER):
            data, starts, blocks = _layout(group)
            tail = np.zeros(WIDTH, dtype=np.uint8)
            all_ = _responses(tables, np.concatenate([data, tail]))
            ends = np.repeat(np.cumsum([max(len(t), WIDTH) for t in group]) - WIDTH + 1, blocks)
            stops = np.minimum(starts + BLOCK, ends)
            cuts = np.stack([starts, stops], axis=1).ravel()  # what lies between texts falls into every second range
            peaks.append(np.maximum.reduceat(all_, cuts, axis=0)[::2])
            numbers.append(blocks)
            group, held = [], 0
        if text is None:
            break
        if len(text) > BUFFER // 2:
            a, b = _block_peaks(tables, [text])
            if group:
                group_text = group
                c, d = _grouped_peaks(tables, group_text)
                peaks.append(c)
                numbers.append(d)
                group, held = [], 0
            peaks.append(a)
            numbers.append(b)
        else:
            group.append(text)
            held += max(len(text), WIDTH)
    return np.concatenate(peaks), np.concatenate(numbers)


def _document_features(chunks: np.ndarray, number: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Mean, largest and smallest pooled response, and the logarithm of the length."""
    length = np.log1p(np.fromiter(map(len, texts), np.float32, len(texts)))[:, None] / 4
    firsts = np.concatenate([[0], np.cumsum(number)[:-1]])
    mean = np.add.reduceat(chunks, firsts, axis=0) / number[:, None]
    return np.concatenate([mean, np.maximum.reduceat(chunks, firsts, axis=0), np.minimum.reduceat(chunks, firsts, axis=0), length], axis=1)


def _chunk_peaks(peaks: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of two neighbouring blocks (a single block is a chunk); chunks per text."""
    owner = np.repeat(np.arange(len(numbers)), numbers)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    lone = np.flatnonzero(numbers[owner] == 1)
    index = np.sort(np.concatenate([pair, lone]))
    right = np.where(numbers[owner[index]] == 1, index, np.minimum(index + 1, len(owner) - 1))
    return np.maximum(peaks[index], peaks[right]), np.maximum(numbers - 1, 1)


def _head(net: Network, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner = np.maximum(features @ net.hidden + net.hidden_bias, 0)
    return inner, 1 / (1 + np.exp(-np.clip(inner @ net.out + net.out_bias[0], -30, 30)))


def score_texts(net: Network, tables: np.ndarray, texts: list[bytes]) -> np.ndarray:
    peaks, numbers = _grouped_peaks(tables, texts)
    chunks, number = _chunk_peaks(peaks, numbers)
    return _head(net, _document_features(np.maximum(chunks + net.bias, 0), number, texts))[1].astype(np.float64)


def _peak_places(seen: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Row of the largest response in each range, for each filter."""
    full = len(starts) - 1
    last = seen[starts[-1]:stops[-1]].argmax(axis=0)[None] + starts[-1]
    if not full:
        return last
    return np.concatenate([seen[:full * BLOCK].reshape(full, BLOCK, -1).argmax(axis=1) + starts[:full, None], last])


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    tables = net.tables()
    rows, places, numbers = [], [], []
    for text in texts:
        data, starts, blocks = _layout([text])
        seen = _responses(tables, data)
        stops = np.append(starts[1:], len(seen))
        at = _peak_places(seen, starts, stops)
        value = np.take_along_axis(seen, at, axis=0)
        if len(at) > 1:
            at = np.where(value[:-1] >= value[1:], at[:-1], at[1:])
            value = np.maximum(value[:-1], value[1:])
        rows.append(value)
        places.append(data[at[:, :, None] + np.arange(WIDTH)])
        numbers.append(len(at))
    pooled, bytes_, number = np.concatenate(rows), np.concatenate(places), np.array(numbers)
    active = pooled + net.bias
    chunks = np.maximum(active, 0)
    features = _document_features(chunks, number, texts)
    inner, score = _head(net, features)
    slope = ((score - labels) * weights / weights.sum()).astype(np.float32)
    d_inner = slope[:, None] * net.out * (inner > 0)
    d_features = d_inner @ net.hidden.T
    firsts = np.concatenate([[0], np.cumsum(number)[:-1]])
    owner = np.repeat(np.arange(len(number)), number)
    mean, top, low = np.split(d_features[:, :-1], 3, axis=1)
    d_chunks = (mean / number[:, None])[owner]
    for part, best in ((top, np.maximum.reduceat(chunks, firsts, axis=0)), (low, np.minimum.reduceat(chunks, firsts, axis=0))):
        is_best = chunks == best[owner]
        share = np.add.reduceat(is_best.astype(np.float32), firsts, axis=0)
        d_chunks = d_chunks + is_best * (part / share)[owner]
    d_chunks = (d_chunks * (active > 0)).astype(np.float32)
    letters = net.embed[bytes_]  # chunks x filters x width x depth
    d_filters = np.einsum("cf,cfwd->wdf", d_chunks, letters)
    d_letters = np.einsum("cf,wdf->cfwd", d_chunks, net.filters)
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, bytes_.ravel(), d_letters.reshape(-1, DEPTH))
    return [d_embed, d_filters, d_chunks.sum(axis=0), features.T @ d_inner, d_inner.sum(axis=0), inner.T @ slope, np.array([slope.sum()])]


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Network:
    """Adam over shuffled batches of whole texts; the same rows give the same network."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            step += 1
            pace = RATE * (0.5 if epoch > epochs * 0.6 else 1) * (0.4 if epoch > epochs * 0.85 else 1)
            for part, slope, a, b in zip(net.parts(), _gradients(net, [texts[i] for i in rows], labels[rows], weights[rows]), first, second, strict=True):
                a += 0.1 * (slope - a)
                b += 0.01 * (slope * slope - b)
                part -= (pace * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """At most ``fit_rows`` training texts with labels and weights; only they come to the driver."""
    known = (labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality")))
    shares = {int(r["quality"]): r["count"] for r in known.groupBy("quality").count().collect()}
    picked = None
    for label in (0, 1):
        some = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2)
        picked = some if picked is None else picked.unionByName(some)
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
            .groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").collect())
    truth = np.array([r["quality"] for r in rows], dtype=np.float32)
    drawn = {x: max(1, int((truth == x).sum())) for x in (0, 1)}
    weights = np.array([shares.get(int(x), 1) / drawn[int(x)] for x in truth], dtype=np.float32)
    return [(r["text"] or "").encode() for r in rows], truth, weights


def scored_runs(batches: Iterator[pa.RecordBatch], net: Network | None, share: float, added: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with score and prediction added, in runs of about a megabyte of text; every score is ``share`` without a network."""
    tables = net.tables() if net else None
    for batch in (piece for whole in batches for piece in pieces(whole)):
        data = [(t or "").encode() for t in batch["text"].to_pylist()]
        score = score_texts(net, tables, data) if net else np.full(len(data), share)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                                         [*batch.schema.names, *added])


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, prefix: str = "quality") -> DataFrame:
    """``docs`` with columns <prefix>_score and <prefix>_predicted added at the end (columns of those names are replaced)."""
    added = [f"{prefix}_score", f"{prefix}_predicted"]
    texts, truth, weights = fit_sample(docs, labels, fit_rows)
    share = float((truth * weights).sum() / weights.sum()) if len(truth) else 0.5
    net = fit(texts, truth, weights) if 0 < truth.sum() < len(truth) else None
    kept = [c for c in docs.columns if c not in added]
    source = docs.select(*kept)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in source.schema)}, {added[0]} double, {added[1]} int"

    return source.mapInArrow(lambda batches: scored_runs(batches, net, share, added), schema)
