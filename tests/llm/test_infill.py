import hashlib
import random
import re

from cases import documents, no_documents
from pyspark.sql import functions as F

from flowquarry.llm import infill

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(doc_id, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = UNITS.findall(text)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(docs):
    made = infill.fill_in_middle(docs)
    assert rows(infill.restore(made)) == sorted((slow(r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_same_as_cut_by_cut(spark):
    check(documents(spark))
    assert infill.restore(infill.fill_in_middle(no_documents(spark))).count() == 0


def test_awkward_texts(spark, monkeypatch):
    rng = random.Random(7)
    bits = ["<", "P>", "<P", "S>", "<M", ">", "é", "😀", " ", "\n", "\t", " ", "word", "<S>", "x", "\x1f", "\x00", "<P>"]
    texts = ["".join(rng.choice(bits[:-5] if i % 4 else bits) for _ in range(rng.randint(0, 14))) for i in range(500)]
    texts += [None, "", " ", "\n\n ", "a", " a ", "<P", "P>", "<", "long " * 4000, "é" * 9000]
    table = spark.createDataFrame([(i if i % 50 else None, t, "z", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, output string, n int")
    check(table.repartition(3))
    monkeypatch.setattr(infill, "RUN_BYTES", 40)
    data = [t or "" for t in texts]
    import pyarrow as pa
    runs = list(infill._runs(pa.array([None, *data, None])[1:-1]))
    assert [a for a, *_ in runs] == [0, *[b for _, b, *_ in runs[:-1]]] and b"".join(d.tobytes() for _, _, d, _ in runs) == "".join(data).encode()


def test_restore_reads_output_and_form_alone(spark):
    docs = documents(spark)
    made = infill.fill_in_middle(docs).select("form", "output").withColumns({"restored_by": F.lit(1)})
    got = sorted(r.restored for r in infill.restore(made).collect())
    assert got == sorted(r.text or "" for r in docs.collect())
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
