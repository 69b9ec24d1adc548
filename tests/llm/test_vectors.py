"""Operators 5 and 7 against brute force."""

import math

import numpy as np
import pytest

from spandrel.llm import descent, neighbours
from tests.llm.brute import Groups

SCHEMA = "vec_id long, embedding array<float>, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], "s") for i, x in rows], SCHEMA)


def sample(n=900, d=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * r.uniform(0.5, 2, size=(n, 1))
    for k in range(0, n, 30):  # groups of near copies, one large
        m = 12 if k else 200
        x[k : k + m] = x[k] + 0.08 * np.linalg.norm(x[k]) * r.normal(size=(len(x[k : k + m]), d)) / math.sqrt(d)
    x[5:9] = x[4]
    return x.astype("f4").astype("f8")


def test_nearest(spark):
    x = sample()
    rows = list(enumerate(x.tolist())) + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None] * 8), (9004, [1.0]), (None, [1.0] * 16), (9005, [])]
    df = vectors(spark, rows)
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, shard=300, block=20).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 20))
    hit = 0
    for q, own in found.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        for _, v, s in own:
            assert v != q and s == pytest.approx(float(x[q] @ x[v]), rel=1e-12)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({v for _, v, _ in own} & set(np.argsort(-s)[:20].tolist()))
    assert hit / (20 * len(found)) >= 0.95


def test_few_candidates(spark):
    df = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 1.0])])
    got = neighbours.nearest(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.5)]
    assert neighbours.nearest(df.limit(0), df.limit(0), 20).collect() == []
    alone = df.where("vec_id = 0")
    assert neighbours.nearest(alone, alone, 20).collect() == []


def test_stopping_test_keeps_its_promise():
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.ProjectedIndex(x, np.arange(6000), leaf=64)
    found, _ = index.search(x[:100], np.arange(100), 10, confidence=0.95)
    s = x[:100] @ x.T
    s[np.arange(100), np.arange(100)] = -9
    best = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), best.tolist(), strict=True)]) >= 0.9
    assert neighbours.chi_square(np.array([7.344]), 8)[0] == pytest.approx(0.5, abs=1e-3)


def recall_and_share(x, step, m=neighbours.DIMENSIONS):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.ProjectedIndex(x, np.arange(len(x)), neighbours.Projection(x.shape[1], 1.0, m))
    at = np.arange(0, len(x), step)
    found, _ = index.search(x[at], at, 20)
    s = x[at] @ x.T
    s[np.arange(len(at)), at] = -9
    best = np.argsort(-s, axis=1)[:, :20]
    return np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), best.tolist(), strict=True)]), index.verified / len(at) / len(x)


def test_the_walk_stops_early():
    r = np.random.default_rng(6)
    centres = r.normal(size=(100, 64))
    recall, share = recall_and_share(centres[r.integers(0, 100, 16_000)] + 0.5 * r.normal(size=(16_000, 64)), 160)
    assert recall >= 0.9 and share < 0.1
    recall, share = recall_and_share(r.normal(size=(16_000, 24)), 160)
    assert recall >= 0.9 and share < 0.3
    recall, share = recall_and_share(r.normal(size=(16_000, 64)), 160)  # nothing is near anything here
    assert recall >= 0.9 and share < 0.6


def test_equal_vectors_are_ordered_by_id(spark):
    x = np.random.default_rng(4).normal(size=64).astype("f4").astype("f8")
    rows = [(i, x.tolist()) for i in range(900)] + [(1000 + i, (-x).tolist()) for i in range(40)]
    df = vectors(spark, rows)
    got = neighbours.nearest(df, df.where("vec_id in (0, 1000)"), 20, shard=100).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [*range(1, 21), *range(1001, 1021)]


def test_cells_and_their_boxes():
    r = np.random.default_rng(5)
    p = r.normal(size=(4000, 6))
    cells, p = neighbours.Cells(p[:500], 6, 4), p[500:]
    at = cells.of(p)
    assert set(at) == set(range(16))
    assert (neighbours.gaps(p, cells.low[at], cells.high[at]) == 0).all()
    reach = np.array([neighbours.gaps(x, cells.low, cells.high) for x in p])
    assert (reach.argmin(1) == at).all() and ((reach == 0).sum(1) == 1).all()


def brute(rows, threshold=0.9):
    good = [(i, np.array(x, float)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    groups, links = Groups(), {}
    u = np.array([x / np.linalg.norm(x) for _, x in good])
    c = u @ u.T >= threshold
    for k, (i, _) in enumerate(good):
        links[i] = int(c[k].sum()) - 1
        for j in np.flatnonzero(c[k]):
            groups.join(i, good[j][0])
    return {i: (links.get(i, 0), groups.find(i)) for i, _ in rows if i is not None}


def test_near_copies(spark):
    x = sample()
    rows = list(enumerate(x.tolist())) + [(9000, None), (9001, [0.0] * 16), (9002, [float("inf")] * 16), (None, [1.0] * 16)]
    got = descent.near_copies(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    own = {r.vec_id: r for r in got if r.vec_id is not None}
    found, all_links = sum(r.n_links for r in own.values()), sum(n for n, _ in want.values())
    assert 0.98 * all_links <= found <= all_links
    assert sum(own[i].component_id == c for i, (_, c) in want.items()) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in own.values())
    assert (own[9001].n_links, own[9001].component_id, own[9001].kept) == (0, 9001, True)


def test_copies_and_empty_tables(spark):
    df = vectors(spark, [(i, [1.0, 2.0]) for i in range(30)] + [(50, [2.0, 4.0]), (51, [-1.0, 0.0])])
    got = {r.vec_id: (r.n_links, r.component_id) for r in descent.near_copies(df).collect()}
    assert got[0] == (30, 0) and got[50] == (30, 0) and got[51] == (0, 51)
    assert descent.near_copies(df.limit(0)).collect() == []
    assert [r.n_links for r in descent.near_copies(vectors(spark, [(1, None)])).collect()] == [0]
