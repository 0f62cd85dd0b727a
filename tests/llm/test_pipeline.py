"""The pipeline's stages against brute force, each over what the stage before kept."""

import os
from collections import Counter
from fractions import Fraction

import pytest
from test_jaccard import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def naive_stages(spark, docs, check):
    """Runs the stages and holds each against its definition."""
    from strandlake.llm import langid, toxicity
    from strandlake.llm.common import crc_bucket

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = left, stage(spark, left, SF).cache()
        assert after.columns == docs.columns
        if name == "language ID":
            model = langid.train(before, ~(crc_bucket("doc_id", 4) == 2))
            decide = lambda r: (lambda p: p[0] != "und" and p[1] >= 0.3)(model.predict(r.text))
        elif name == "toxicity":
            weights, bias = toxicity.train(before, labels, ~(crc_bucket("doc_id", 5) == 0))
            decide = lambda r: weights[toxicity.features(r.text)].astype(float).sum() + bias < 0
        else:
            texts = before.collect()
            groups = brute([(k, r.text) for k, r in enumerate(texts)], 5, Fraction(4, 5))
            least = {}
            for k, r in enumerate(texts):
                if r.doc_id is not None:
                    root = groups[k][1] if groups[k][0] else ("alone", k)
                    least[root] = min(least.get(root, r.doc_id), r.doc_id)
            ids = set(least.values()) | {None}
            decide = lambda r: r.doc_id in ids
        assert rows_of(after) == Counter(tuple(r) for r in before.collect() if decide(r)), name
        check(name, before, after)
        left = after
    return left


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    gone = {}
    left = naive_stages(spark, docs, lambda name, before, after: gone.update({name: before.count() - after.count()}))
    assert gone["toxicity"] and gone["n-gram Jaccard join"] and left.count()
    packed = corpus_pipeline.run(spark, SF).collect()
    sizes = {r.doc_id: r.doc_tokens for r in packed}
    assert set(sizes) == {r.doc_id for r in left.select("doc_id").collect()} and sum(r.length for r in packed) == sum(sizes.values())


def test_odd_rows(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = odd_docs.select(*docs.columns)
    left = naive_stages(spark, odd, lambda *_: None)
    last = corpus_pipeline.STAGES[-1][1](spark, left, SF).collect()
    assert Counter(r.doc_id for r in last if not r.start) == Counter(r.doc_id for r in left.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_release(spark, tmp_path):
    from strandlake.llm import common

    frame = common.materialize(spark.range(5), "numbers")
    folder = frame.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and frame.count() == 5
    common.release(spark)
    assert not os.path.isdir(folder)
