import itertools
import re

import pytest
from cases import documents, no_documents

from flowquarry.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int, part string"


def failed(row, rows):
    text = row.text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    smaller = [r for r in rows if (r.text or "") == text and r.doc_id is not None and (row.doc_id is None or r.doc_id < row.doc_id)]
    flags = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), bool(smaller)]
    return {c for c, f in zip("ABCDE", flags, strict=True) if f}


def slow_audit(docs, labels):
    rows = docs.collect()
    good, toxic = ({r.doc_id for r in labels.collect() if r.doc_id is not None and r[c] == 1} for c in ("quality", "toxic"))
    out = set()
    known = [(r.source or "", r.doc_id, failed(r, rows)) for r in rows]
    for part in {p for p, _, _ in known}:
        own = [(d, f) for p, d, f in known if p == part]
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, c in enumerate(order, 1):
                gone = [(d, f) for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                fails = sum(c in f for _, f in own)
                lines.append(("".join(order), step, c, len(left), len(gone), fails - len(gone), sum(f == {c} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        for line in lines:
            out.add((part, line[0], line[1], *line[3:], sum(x[4] for x in lines if x[2] == line[2])))
    return out


def test_same_as_every_order_one_by_one(spark):
    docs = documents(spark)
    long = " ".join(f"w{i}" for i in range(230))
    more = [(200 + i, t, None, s, None, 1, "x", "y", 2, 3, 0.5) for i, (t, s) in enumerate([(long, "s0"), (long, "s1"), (long + " # B", None), (long.upper(), "s0"), ("a " * 250, "s1"), (long.upper(), "s2"), ("", "s1"), (None, "s0")])]
    docs = docs.unionByName(spark.createDataFrame([*more, (None, long, None, "s9", None, 1, "x", "y", 2, 3, 0.5)], docs.schema))
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "z") for i in range(0, 210, 2)] + [(3, 0, 1, "z"), (3, 1, 0, "z"), (None, 1, 1, "z"), (5, None, None, None), (None, None, 1, "")], LABELS)
    got = filter_audit.audit(filter_audit.masks(docs, labels)).collect()
    want = slow_audit(docs, labels)
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 600 * len({w[0] for w in want})
    assert got[0].asDict().keys() == {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"}
    assert filter_audit.audit(filter_audit.masks(no_documents(spark), labels)).count() == 0
    assert filter_audit.audit(filter_audit.masks(docs, labels.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("letters", ["A", "ABC", "ABCDE"])
def test_intervals_cover_each_order_once(letters):
    ends = filter_audit.interval_ends(letters)
    every = filter_audit.orders(letters)
    for mask in range(1, 1 << len(letters)):
        for rank, order in enumerate(every):
            first = next(i for i, c in enumerate(order, 1) if mask >> letters.index(c) & 1)
            for step in range(1, len(letters) + 1):
                assert sum(sign for m, s, r, sign in ends if m == mask and s == step and r <= rank) == (step == first)
