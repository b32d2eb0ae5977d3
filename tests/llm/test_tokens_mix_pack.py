import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import documents, no_documents
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowquarry.llm import mixing, packing, token_prefix

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("abenstr  \n\t'1,.-éß中😀<|> ")), max_size=25) | st.text(max_size=15))
def test_every_prefix_counts_as_the_tokenizer_says(text):
    pairs = token_prefix.byte_pairs(PATH)
    assert np.frombuffer(pairs.ids(text), "<u4").tolist() == ids(text)
    assert pairs.prefix_counts(text).tolist() == [len(ids(text[:i])) for i in range(1, len(text) + 1)]


@pytest.mark.parametrize("text", ["don't we're we'll", "a  b   c", "-" * 700, "ab" * 400, "x<|endoftext|>y<|endoft", "  lead", "trail  ", "\x1c\x85  a"])
def test_prefixes_of_odd_texts(text):
    assert token_prefix.byte_pairs(PATH).prefix_counts(text).tolist() == [len(ids(text[:i])) for i in range(1, len(text) + 1)]


def test_token_prefixes(spark):
    docs = documents(spark)
    got = token_prefix.token_prefixes(docs, PATH, budget=20).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(ids(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    texts = {(r.doc_id, len((r.text or "").encode())): r.text or "" for r in docs.collect()}
    for r in got:
        text = texts[r.doc_id, r.n_bytes]
        assert token_prefix.tokens_at(r.prefix_deltas, len(text)) == r.n_tokens
        assert r.cut_chars == max((i for i in range(len(text) + 1) if i == 0 or token_prefix.tokens_at(r.prefix_deltas, i) <= 20), default=0) or len(text) > 500
    assert token_prefix.token_prefixes(no_documents(spark), PATH).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held = {}
    while True:
        free = [s for s in names if s not in held]
        left = sum(sizes.values()) - sum(held.values())
        over = {s: most * sizes[s] for s in free if left * weight[s] / sum(weight[x] for x in free) > most * sizes[s]}
        if not over:
            return held | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        held |= over


def test_mixing_targets_and_takes(spark):
    docs = documents(spark).unionByName(documents(spark, 2)).withColumn("source", F.when(F.col("doc_id") == 1, "tiny").otherwise(F.col("source")))
    got = mixing.mix(mixing.document_sizes(docs), block=4).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in docs.collect())
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want, took = targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.full_copies * r.size + r.cut_words
        took[r.source] += r.taken
    for source, target in want.items():
        assert abs(took[source] - target) <= 6
    again = mixing.mix(mixing.document_sizes(docs.repartition(5)), block=4).collect()
    assert Counter(got) == Counter(again)
    assert mixing.mix(mixing.document_sizes(no_documents(spark))).count() == 0


def test_small_sources_reach_their_targets(spark):
    sizes = [(1, "a", 33), (2, "b", 10), (3, "b", 0), (4, "c", 50), (5, "c", 15), (6, "d", 100_000)]
    got = mixing.mix(spark.createDataFrame(sizes, "doc_id bigint, source string, size bigint"), weights=(1,)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert {r.source: r.target for r in got if r.source != "d"} == {"a": 99.0, "b": 30.0, "c": 195.0}
    assert all(abs(r.taken - r.target) <= mixing.BLOCK_WORDS / 2 for r in got) and {r.source: r.taken for r in got if r.source != "d"} == {"a": 96, "b": 30, "c": 192}


def test_seats_are_the_highest_quotients(spark):
    votes = [(str(i), float(v), i / 40) for i, v in enumerate([53, 24, 23, 10, 10, 10, 1, 0.5, 200, 200])]
    got = {r.p: r.seats for r in mixing.sainte_lague(spark.createDataFrame(votes, "p string, votes double, tie double"), "votes", 57).collect()}
    best = sorted(((v * (1 + t * 1e-9)) / (2 * k + 1), p) for p, v, t in votes for k in range(60))[-57:]
    assert got == {p: sum(q == p for _, q in best) for p, _, _ in votes}


def test_mixed_documents_hold_what_was_taken(spark):
    docs = documents(spark).withColumn("n_chars", F.length("text").cast("bigint"))
    taken = mixing.mix(mixing.document_sizes(docs)).agg(F.sum("taken")).first()[0]
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(len(r.text.encode().split()) for r in rows) == taken
    whole = {r.text for r in docs.collect()}
    cut = [r for r in rows if r.text not in whole]
    assert all(any((w or "").startswith(r.text) for w in whole) for r in cut) and all(r.n_chars == len(r.text) for r in rows)
    assert mixing.mix_documents(no_documents(spark)).count() == 0


def test_packing_is_gapless_and_exact(spark):
    docs = documents(spark)
    got = packing.pack_documents(docs, PATH, size=64).collect()
    want = Counter()
    for r in docs.collect():
        all_ids = ids(r.text) + [2]
        first = len(all_ids) % 64 or 64
        edges = [0, *range(first, len(all_ids) + 1, 64)] if len(all_ids) > 64 else [0, len(all_ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(all_ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.1 * -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack_documents(no_documents(spark), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=20))
def test_plan_uses_every_piece_once(counts):
    have = np.zeros(41, dtype=np.int64)
    for k, v in counts.items():
        have[k] = v
    used = np.zeros(41, dtype=np.int64)
    for pattern, number in packing.packing_plan(have, 40):
        assert sum(pattern) <= 40 and number > 0
        for x in pattern:
            used[x] += number
    assert (used == have).all()
