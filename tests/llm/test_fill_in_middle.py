import hashlib
import random
import re

from pyspark.sql import functions as F

from shelfwise.llm import fill_in_middle as fim
from tests.llm.brute import edge_docs, no_docs


def plain(doc_id, text):
    """The contract, step by step."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, d = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs):
    made = fim.transform(docs)
    rows = made.withColumn("back", fim.restore(F.col("form"), F.col("output"))).collect()
    want = sorted(((str(r.doc_id), *plain(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    got = sorted(((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=repr)
    assert got == want
    return rows


def test_edges_and_empty(spark):
    rows = check(edge_docs(spark))
    assert {r.form for r in rows} >= {"plain"} and rows[0].asDict().keys() >= {"doc_id", "n", "form", "output"}
    assert fim.transform(no_docs(spark)).count() == 0


def test_random_texts_and_marks(spark):
    random.seed(5)
    pool = ["\n", "\r\n", "a", "é", "😀", " ", "$1", "\\", "<", "P>", "<M", ">", "x\n", " ", "\x85"]
    texts = [(i, "".join(random.choice(pool) for _ in range(random.randrange(12)))) for i in range(600)]
    texts += [(1000, "a<P>b"), (1001, "<S>"), (1002, "x\ny<M>"), (1003, "\n"), (1004, "\n\n\n")]
    rows = check(spark.createDataFrame(texts, "doc_id long, text string"))
    by_id = dict(texts)
    assert all(r.back == by_id[r.doc_id] for r in rows)
    assert {r.form for r in rows} == {"plain", "spm", "psm"}


def test_very_long_texts(spark):
    """Neither many short lines nor one endless line exhaust the stack."""
    texts = [(1, "ab\n" * 400_000), (2, "x" * 2_000_000), (3, "\n" * 300_000), (4, ("y" * 5000 + "\n") * 200)]
    assert all(r.back == dict(texts)[r.doc_id] for r in check(spark.createDataFrame(texts, "doc_id long, text string")))


def test_rates(spark):
    docs = spark.range(400).selectExpr("id doc_id", "concat('a\\nb\\nc\\n', id) text")
    assert {r.form for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    some = [r.form for r in fim.transform(docs, rate=50, spm_rate=100).collect()]
    assert set(some) == {"plain", "spm"} and 120 < some.count("plain") < 280
    words = fim.transform(docs, unit=r"(?:\S++\s*+|\s++)")
    assert all(r.n == 4 for r in words.collect())
