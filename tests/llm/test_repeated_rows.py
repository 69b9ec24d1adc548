"""Operator 5 where rows stand more than once."""

import numpy as np

from spandrel.llm import neighbours
from tests.llm.test_vectors import vectors


def test_repeated_rows_take_one_place(spark):
    x = np.random.default_rng(2).normal(size=(120, 8)).astype("f4").astype("f8")
    once = list(enumerate(x.tolist()))
    near = int(np.argsort(-(x @ x[0]))[0]) or int(np.argsort(-(x @ x[0]))[1])
    df = vectors(spark, once + once + [once[near]] * 20)
    got = neighbours.nearest(df, df.where("vec_id < 3"), 20).orderBy("query_id", "rank").collect()
    for q in range(3):
        s = x @ x[q]
        s[q] = -np.inf
        own = [r for r in got if r.query_id == q]
        assert [r.rank for r in own] == list(range(1, 21))
        assert [r.vec_id for r in own] == np.argsort(-s)[:20].tolist()
