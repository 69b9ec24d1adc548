"""The pipeline's rule for near copies: five words, similarity 0.8 or more, against all pairs."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from spandrel.llm.common import table  # noqa: E402
from tests.llm.brute import Groups, shingles  # noqa: E402

DATA = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)["ngram_jaccard"]


def kept(rows):
    sets, groups = [(i, shingles(t, 5)) for i, t in rows], Groups()
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                groups.join(i, j)
    return sorted(i for i, _ in rows if groups.find(i) == i)


def test_a_long_addition_is_a_near_copy(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [
        (1, " ".join(words)),
        (2, " ".join(words + [f"x{k}" for k in range(40)])),  # 196 of 236 shingles
        (3, " ".join(words + [f"y{k}" for k in range(60)])),  # 196 of 256
        (4, " ".join(w if k % 50 else "z" for k, w in enumerate(words))),
    ]
    out = STAGE(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(r.doc_id for r in out.collect()) == kept(rows) == [1, 3]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stage_equals_all_pairs(spark):
    docs = table(spark, DATA, "documents")
    want = kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in STAGE(spark, docs, DATA).collect()) == want
