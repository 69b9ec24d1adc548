"""Operator 7 where links are few and far between: nothing leads from one to another."""

import numpy as np
import pytest

from spandrel.llm import descent
from tests.llm.test_vectors import brute, vectors


def pairs(n, linked, d=64, seed=7):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(linked):
        off = r.normal(size=d)
        off -= off @ x[k] * x[k]
        cosine = r.uniform(0.905, 0.95)
        x[n - 1 - k] = cosine * x[k] + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off)
    return [(i, v) for i, v in enumerate(x.astype("f4").astype("f8").tolist())]


def compare(spark, rows, **options):
    got = {r.vec_id: (r.n_links, r.component_id) for r in descent.near_copies(vectors(spark, rows), **options).collect()}
    want = brute(rows)
    assert sum(n for n, _ in want.values()) > 0
    assert got == want


def test_isolated_pairs(spark):
    compare(spark, pairs(8000, 60))


def test_few_links(spark):
    compare(spark, pairs(6000, 4, seed=9))


def test_many_parts_and_crowds(spark):
    """More than ten parts of vectors: isolated pairs, groups of a few, and groups that outgrow every list."""
    assert descent.partitions(7000, 64, 0.9) > descent.TABLES
    rows = pairs(7000, 40, seed=8)
    r = np.random.default_rng(4)
    x = np.array([v for _, v in rows])
    for first, size, wide in ((100, 12, 0.2), (300, 45, 0.2), (500, 220, 0.2), (1000, 150, 0.45)):
        x[first : first + size] = x[first] + wide * r.normal(size=(size, 64)) / 8
    compare(spark, list(enumerate(x.astype("f4").astype("f8").tolist())))


def test_a_poor_audit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(descent, "_audit", lambda *a: (8, 10))
    with pytest.raises(RuntimeError):
        descent.near_copies(vectors(spark, pairs(300, 5)), rounds=1)


def test_repeated_ids_with_different_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (1, b), (1, c), (2, a), (3, b), (4, [0.0, 1.0, 0.1]), (5, c), (6, None), (6, a)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in descent.near_copies(vectors(spark, rows)).collect())
    # a: rows of 1, 2, 6; b: rows of 1, 3 and its link 4; c: rows of 1, 5
    want = [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False)]
    assert got == want + [(5, 1, 1, False), (6, 0, 6, True), (6, 2, 1, False)]
