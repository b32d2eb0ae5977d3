from collections import Counter

import numpy as np
import pyarrow as pa
from cases import DOCS, documents, no_documents

from flowquarry.llm import near_dup


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows, percent=85):
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(top(i), []).append(r.doc_id)
    out = []
    for i, r in enumerate(rows):
        known = [d for d in members[top(i)] if d is not None]
        least = min(known, default=None)
        out.append((r.doc_id, len(sets[i]), least, r.doc_id == least))
    return Counter(out)


def test_same_groups_as_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = near_dup.near_duplicates(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute(rows)
    assert near_dup.near_duplicates(no_documents(spark)).count() == 0


def test_chains_and_large_groups_lose_no_link(spark):
    words = [f"t{i}" for i in range(400)]
    chain = [" ".join(words[k * 12:k * 12 + 200]) for k in range(12)]  # each like the next, the ends unlike
    rng = np.random.default_rng(4)
    crowd = []
    for _ in range(60):
        own = list(words)
        own[int(rng.integers(0, 400))] = f"new{rng.integers(1 << 30)}"
        crowd.append(" ".join(own))
    rows = [(i, t, None, None, None, 0, "", "", 0, 0, 0.0) for i, t in enumerate(chain + crowd)]
    docs = spark.createDataFrame(rows, DOCS)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()) == brute(docs.collect())


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    seen = []
    for share in (0.3, 0.7, 0.9):
        for _ in range(30):
            n = int(rng.integers(100, 1500))
            pool = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = int(n * share)
            a, b = pool[:cut + (n - cut) // 2], np.concatenate([pool[:cut], pool[cut + (n - cut) // 2:]])
            ra, rb = (near_dup.registers_of(near_dup.set_minima(x)) for x in (a, b))
            assert (np.maximum(ra, rb) == near_dup.registers_of(near_dup.set_minima(np.union1d(a, b)))).all()
            seen.append(near_dup.jaccard_estimates(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0] - share)
    assert abs(np.mean(seen)) < 0.02 and np.std(seen) < 0.07


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101 + i) for i in range(50)]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 151)}


def test_pipeline_links_pairs_from_80_percent(spark):
    import corpus_pipeline

    texts = []
    for n, (size, step) in enumerate([(200, 17), (200, 20), (200, 22), (180, 20), (200, 23), (200, 10), (400, 40), (90, 9), (36, 4)] * 4):  # (size - step) / (size + step) alike
        words = [f"p{n}x{i}" for i in range(size + step + 4)]
        texts += [" ".join(words[:size + 4]), " ".join(words[step:])]
    docs = spark.createDataFrame([(i, t, None, None, None, 0, "", "", 0, 0, 0.0) for i, t in enumerate(texts)], DOCS)
    want = {d for d, _, _, kept in brute(docs.collect(), 80) if kept}
    assert len(want) == len(texts) - 32 and {r.doc_id for r in corpus_pipeline.near_dup_stage(spark, docs, "").collect()} == want
    assert near_dup.band_count(85) == near_dup.BANDS and (1 - 0.8 ** near_dup.ROWS) ** near_dup.band_count(80) < 1.3e-5


def test_pipeline_keeps_one_row_of_each_group_without_ids(spark):
    import corpus_pipeline

    text = lambda name: " ".join(f"{name}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("a")), (None, text("a").upper()), (None, text("b")), (7, text("b")), (9, text("b")), (None, text("c")), (None, " "), (None, " "), (4, " "), (5, " "), (None, None),
            (3, text("d")), (3, text("e")), (8, text("d")), (8, text("d")), (10, text("e")), (11, text("f")), (11, text("g")), (11, text("g"))]
    docs = spark.createDataFrame([(i, t, None, None, None, 0, "", "", 0, 0, 0.0) for i, t in rows], DOCS)
    got = Counter((r.doc_id, (r.text or "none").lower()) for r in corpus_pipeline.near_dup_stage(spark, docs, "").collect())
    by_name = Counter(t[0] for _, t in got.elements())
    assert got[3, text("d")] == got[3, text("e")] == got[11, text("f")] == got[11, text("g")] == 1  # unlike texts of one id all stay
    assert by_name["a"] == by_name["b"] == by_name["c"] == by_name["d"] == by_name["e"] == 1 and got[7, text("b")] == got[None, text("c")] == 1
    assert {k: n for k, n in got.items() if k[1] in (" ", "none")} == {(None, " "): 1, (4, " "): 1, (5, " "): 1, (None, "none"): 1}


def test_pipeline_keeps_rows_with_columns_that_have_no_order(spark):
    import corpus_pipeline

    rows = [(1, "one two three four five six", {"a": 1}, "x"), (1, "one two three four five six", {"a": 2}, "y"), (2, "one two three four five six", None, "z"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string,int>, `row` string")
    got = corpus_pipeline.near_dup_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert corpus_pipeline.near_dup_stage(spark, docs.limit(0), "").count() == 0


def test_texts_of_a_batch_are_taken_in_bounded_pieces(spark):
    texts = ["a b c d e f " * 10_000, None, "", "x y", *["u v w x y z " * 2_000] * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    runs = [x["text"].to_pylist() for x in near_dup.pieces(batch)]
    assert [t for run in runs for t in run] == texts
    assert all(len(run) == 1 or sum(len(t or "") for t in run[:-1]) <= near_dup.CHUNK_BYTES for run in runs) and len(runs) > 2
    assert not list(near_dup.pieces(batch.slice(0, 0)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    assert [r.n_shingles for r in near_dup.sketches(docs).collect()] == [len(shingles(t)) for t in texts]
