"""Operator 13 against whole-number arithmetic by definition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from spandrel.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, "other") for i, x in rows], SCHEMA)


def by_definition(rows):
    x = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[k] for _, v in x) for k in range(d)]
    y = [[n * v[k] - s[k] for k in range(d)] for _, v in x]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    return n, s, [sum(c * c for c in r) for r in y], v


def compare(spark, rows, extra=()):
    n, s, deviation, v = by_definition(rows)
    got = whitening.whiten(frame(spark, [*rows, *extra])).collect()
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(8, len(s))
    assert len(got) == n * k
    own = {(r.vec_id, r.component): r for r in got}
    for c in range(1, k + 1):
        want = np.array([[float(Fraction(n * (math.floor(1024 * a) + 100000) - t, n)) for a, t in zip(x, s, strict=True)] for _, x in rows]) @ q[:, c - 1] / math.sqrt(e[c - 1])
        mine = np.array([own[i, c].whitened for i, _ in rows])
        sign = 1 if abs(mine - want).max() < abs(mine + want).max() else -1
        assert np.abs(mine - sign * want).max() < 1e-7
        assert all(own[i, c].explained == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9) for i, _ in rows)
    for (i, _), want in zip(rows, deviation, strict=True):
        assert own[i, 1].deviation_text == str(want)
        assert own[i, 1].deviation == (want if want < 1 << 63 else None)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-6


def sample(n=300, d=12, scale=1.0):
    r = np.random.default_rng(5)
    return [(i, (scale * np.array(x)).tolist()) for i, x in enumerate(r.normal(size=(n, d)) @ np.diag(np.arange(1, d + 1)) + 3)]


def test_by_definition(spark):
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0, 2.0])]
    compare(spark, sample() + [(800, [0.0] * 12)], odd)
    compare(spark, sample(40, 3))


def test_large_entries(spark):
    compare(spark, sample(60, 5, 1e9))
    compare(spark, sample(60, 5, 1e14))  # products of 128 bits and more


def test_limits_of_a_long(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    top, low = 2**63 - 1, -(2**63) + 100000
    x = [[top, 101024], [low, 102048], [100000, 103072]]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i + 1: str(sum((3 * a - b) ** 2 for a, b in zip(v, s, strict=True))) for i, v in enumerate(x)}
    assert {r.vec_id: r.deviation_text for r in got} == want
    assert all(r.deviation is None for r in got if len(r.deviation_text) > 19)


def test_repeated_rows_null_ids_and_little_variance(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [2.0, 4.5, 0.5]), (3, [0.0, 1.0, 0.5])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (3, 1), (3, 2)]  # the third dimension has no variance
    w = np.array([[r.whitened for r in got if r.component == c] for c in (1, 2)])
    assert np.abs(w @ w.T / 4 - np.eye(2)).max() < 1e-9
    assert whitening.whiten(frame(spark, rows[:2])).collect() == []
    assert whitening.whiten(frame(spark, rows).limit(0)).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("bits", [3, 19, 20, 21, 39, 61])
def test_products_are_exact(bits):
    r = np.random.default_rng(bits)
    z = r.integers(-(1 << bits), (1 << bits) + 1, size=(200, 6))
    z[0] = 1 << bits
    z[1] = -(1 << bits)
    want = z.astype(object).T @ z.astype(object)
    assert (whitening.recombine(whitening.products(z, 1 << bits)) == want).all()
    held = whitening.limbs(z, 1 << bits)
    assert all(abs(x).max() <= 1 << (whitening.LIMB - 1) for x in held)


def test_full_blocks_are_exact():
    z = np.full((whitening.BLOCK, 2), -(1 << 19))
    assert (whitening.recombine(whitening.products(z, 1 << 19)) == whitening.BLOCK << 38).all()
