"""Each stage on its predecessor's result, against plain loops."""
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_substring_dedup import brute as cut
from tracewell.llm import line_crf, quality, shared

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def settings(spark):
    shared.configure(spark)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    labels = spark.read.parquet(f"{SMOKE}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "n-gram Jaccard join", "substring dedup", "packing"]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        held[name] = (docs, shared.stage(stage(spark, docs, SMOKE), "test-stage"))
        docs = held[name][1]
        if name != "packing":
            assert docs.dtypes == held[name][0].dtypes
    rows = lambda frame: {r.doc_id: r.text for r in frame.collect()}

    before, after = held["quality rules"]
    kept = {r.doc_id for r in quality.score(before, quality.train(before, labels)).where("kept").collect()}
    assert rows(after) == {i: t for i, t in rows(before).items() if i in kept}

    raw = before
    before, after = held["quality classifier"]
    kept = {r.doc_id for r in line_crf.score(before, line_crf.train(raw, labels)).where("score >= 0.3").collect()}
    assert rows(after) == {i: t for i, t in rows(before).items() if i in kept}

    before, after = held["n-gram Jaccard join"]
    found = brute.components([(i, i, t) for i, t in rows(before).items()], 5, 80)
    assert set(rows(after)) == {least for n, least in found.values()} | {i for i, (n, _) in found.items() if not n}

    before, after = held["substring dedup"]
    want = {i: k for i, n, gone, k in cut(list(rows(before).items()), 50) if not gone or gone < n}
    assert rows(after) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = held["packing"]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    ids = {}
    for r in sorted(after.collect(), key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in rows(before).items()}

    whole = corpus_pipeline.run(spark, SMOKE)
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in whole.collect()) == sorted((r.doc_id, r.start, bytes(r.ids)) for r in after.collect())


def test_odd(spark, odd_docs, no_docs, tmp_path):
    """Strange and empty tables pass through every stage, extra columns included."""
    folder = str(tmp_path)
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1), (14, 1), (3, 0)], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = shared.stage(stage(spark, docs, folder), "test-odd")
    for _, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, odd_docs, folder).columns == odd_docs.columns
