from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import DOCS, documents, no_documents
from pyspark.sql import functions as F

from flowquarry.llm import simhash


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) for bit in range(64)]
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def slow_groups(codes, distance=4):
    group = list(range(len(codes)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                group[top(i)] = top(j)
    return [top(i) for i in range(len(codes))]


def slow_components(rows):
    codes = [slow_fingerprint(r.text) for r in rows]
    groups, members = slow_groups(codes), defaultdict(list)
    for r, g in zip(rows, groups, strict=True):
        members[g].append(r.doc_id)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in members.items()}
    return Counter((r.doc_id, f"{c:016x}", least[g]) for r, c, g in zip(rows, codes, groups, strict=True))


def found(df):
    return Counter((r.doc_id, r.f, r.component_id) for r in df.withColumn("f", F.lower(F.lpad(F.hex("code"), 16, "0"))).collect())


def test_same_groups_as_brute_force(spark):
    docs = documents(spark)
    assert found(simhash.simhash_groups(docs)) == slow_components(docs.collect())
    assert simhash.simhash_groups(no_documents(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "one two three four five"), (None, None), (None, "other words stand here now")], "doc_id bigint, text string")
    assert {r.component_id for r in simhash.simhash_groups(nulls).collect()} == {None}


def test_near_texts_and_empty_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(100, ""), (50, None), (60, " \n"), (70, "x")]
    for n in range(12):
        words = [f"d{n}w{i}" for i in range(400)]
        for k in range(6):
            own = list(words)
            own[int(rng.integers(400))] = f"new{n}{k}"
            rows.append((1000 - n * 10 - k, " ".join(own)))
    docs = spark.createDataFrame([(i, t, None, None, None, 0, "", "", 0, 0, 0.0) for i, t in rows], DOCS)
    want = slow_components(docs.collect())
    assert found(simhash.simhash_groups(docs)) == want
    assert len({c for _, _, c in want}) < len(rows) / 2


def crowd(rng, size, bits):
    """Codes around some centres, so that links, near misses and dense groups all occur."""
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2)
    out = rng.integers(0, 1 << 63, size // 4, dtype=np.uint64).tolist()
    while len(out) < size:
        code = int(rng.choice(centres))
        for bit in rng.choice(64, int(rng.integers(0, bits + 1)), replace=False):
            code ^= 1 << int(bit)
        out.append(code)
    return sorted(set(out))


def partition_of(pairs, codes):
    group = {c: c for c in codes}

    def top(c):
        while group[c] != c:
            c = group[c]
        return c
    for a, b in pairs:
        group[top(a)] = top(b)
    return Counter(frozenset(c for c in codes if top(c) == t) for t in {top(c) for c in codes})


@pytest.mark.parametrize(("bits", "size", "limit"), [(3, 300, 10 ** 9), (5, 500, 10 ** 9), (7, 500, 10 ** 9), (5, 500, 40), (3, 400, 25)])
def test_links_of_codes_also_in_blocks(spark, bits, size, limit):
    codes = crowd(np.random.default_rng(size + bits), size, bits)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.linked_codes(spark.createDataFrame([(c,) for c in signed], "code bigint"), crowd=limit).collect()
    plain = lambda c: c % (1 << 64)
    groups = slow_groups(codes)
    assert all((plain(a) in codes) and (plain(b) in codes) for a, b in links)
    assert partition_of([(plain(a), plain(b)) for a, b in links], codes) == partition_of([(c, codes[g]) for c, g in zip(codes, groups, strict=True)], codes)


def test_index_prunes_and_links_whole_groups():
    rng = np.random.default_rng(9)
    rank = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    codes = simhash.of_rank(rank)
    label = simhash.GrayIndex(np.zeros(3000, dtype=np.int64), codes).search(24)
    got = slow_groups(codes[:200].tolist(), 24)
    inside = simhash.GrayIndex(np.zeros(200, dtype=np.int64), codes[:200]).search(24)
    assert len(label) == 3000 and len(set(zip(got, inside.tolist(), strict=True))) == len(set(got)) == len(set(inside.tolist()))
    dense = np.arange(16, dtype=np.uint64) ^ (np.arange(16, dtype=np.uint64) >> np.uint64(1))
    assert not simhash.GrayIndex(np.zeros(16, dtype=np.int64), dense).search(4).any()


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES", 64)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text)
