import hashlib
import struct

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from shelfwise.llm import quality_rules, secret_scan
from tests.llm.brute import WORD, near_groups

D = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_join", "secret_scan", "source_mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    ranks = secret_scan.load_ranks(P.path(secret_scan.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps.append((before, docs.collect()))
        if name != "byte_bpe":
            assert docs.columns == columns

    before, after = steps[0]
    kept = {r.doc_id for r in quality_rules.judge(spark.createDataFrame(before)).collect() if r.kept}
    assert 0 < len(kept) < len(before) and sorted(after) == sorted(r for r in before if r.doc_id in kept)

    before, after = steps[1]
    before = sorted(before)
    root = near_groups([(r.doc_id, r.text) for r in before])
    assert sorted(after) == [r for i, r in enumerate(before) if root[i] == i]

    before, after = steps[2]
    clean = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        spans = secret_scan.find_spans(r.text, enc.encode_ordinary)
        assert clean[r.doc_id].text == secret_scan.redact(r.text, spans) and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)

    before, after = steps[3]
    rows = {r.doc_id: r for r in before}
    assert all(rows[r.doc_id] == r for r in after)
    size = lambda x: sum(len(WORD.findall(r.text)) for r in x)
    assert 1.3 * size(before) < size(after) < 1.7 * size(before)
    assert max(sum(r.doc_id == i for r in after) for i in rows) <= 2

    before, after = steps[4]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in before:
        ids = enc.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(r.text.encode())))
    assert sorted(map(tuple, after)) == sorted(want)
