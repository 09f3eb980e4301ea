from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import floor
from operator import mul

import numpy as np
import pytest

from colonnade.llm import whitening
from colonnade.llm.bidiagonal import bidiagonalised, leading_directions, squared_singular_values
from colonnade.llm.whitening import op11_embedding_whitening, whitened
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def factors():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 40, 120):
        yield "random", rng.standard_normal((n, n))
        yield "graded", np.linalg.qr(rng.standard_normal((n + 3, n)) * np.logspace(0, -12, n), mode="r")
        yield "upper", np.triu(rng.standard_normal((n, n)))
        yield "zero", np.zeros((n, n))
        yield "equal values", 3.0 * np.eye(n)
        thin = rng.standard_normal((n, max(1, n // 2)))
        yield "low rank", thin @ rng.standard_normal((max(1, n // 2), n))
        left, right = (np.linalg.qr(rng.standard_normal((n, n)))[0] for _ in range(2))
        yield "clusters", left @ np.diag([5, 5, 5 - 1e-11, 5 - 1e-6, *np.ones(n)][:n]) @ right


@pytest.mark.parametrize("kind, m", list(factors()))
def test_solver(kind, m):
    n, most = len(m), min(4, len(m))
    values, vectors = leading_directions(m, 4)
    expect = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(np.sqrt(values), expect, rtol=0, atol=1e-13 * max(1e-300, expect[0]) * max(10, n))
    assert np.abs(vectors.T @ vectors - np.eye(most)).max() < 1e-13
    assert np.abs(m.T @ (m @ vectors) - vectors * values[:most]).max(initial=0) <= 1e-13 * max(10, n) * values[0]


def test_small_values_are_relatively_accurate():
    a, b = np.logspace(0, -90, 31), 0.5 * np.logspace(0, -90, 31)[:30]
    got = np.sqrt(squared_singular_values(a, b))
    whole = lambda xs: reduce(mul, (Fraction(float(x)) for x in xs))
    assert abs(float(whole(got) / whole(a)) - 1) < 1e-12  # the determinant
    u = bidiagonalised(np.diag(a) + np.diag(b, 1))
    assert np.allclose(np.abs(u[0]), a) and np.allclose(np.abs(u[1]), b)


def plain(rows, components=4):
    """Deviations by whole numbers; directions by a symmetric eigensolver over all distinct vectors."""
    valid = [(i, tuple(floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({x for _, x in valid})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1][:, :components]
    out = []
    for i, x in valid:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        w = (np.array(x, float) - np.array([s / n for s in sums])) @ v / np.sqrt(e[:components])
        out += [(i, k + 1, n, deviation, w[k], e[k] / e.sum()) for k in range(v.shape[1])]
    return out


def matches(got, expect):
    got = sorted(got, key=lambda r: (str(r[0]), r[1], r[3], abs(r[4])))
    expect = sorted(expect, key=lambda r: (str(r[0]), r[1], r[3], abs(r[4])))
    assert [(r[0], r[1], r[2], int(r[3])) for r in got] == [r[:4] for r in expect]
    a, b = np.array([r[4] for r in got]), np.array([r[4] for r in expect])
    for c in {r[1] for r in got}:
        own = np.array([r[1] == c for r in got])
        sign = np.sign((a[own] * b[own]).sum())
        assert np.abs(a[own] - sign * b[own]).max() < 1e-8
    assert np.allclose([r[5] for r in got], [r[5] for r in expect], rtol=1e-10)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 7)) * [3, 2, 1.5, 1, 0.5, 0.1, 0.0] + 0.2
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i % 5][1], None) for i in range(200)]  # a few vectors many times
    rows += [(2000, None, 1), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (2002, [float("nan")] * 7, 1), (2003, [float("-inf")] * 7, 1), (None, [0.5, -0.0, 1e-9, -1e-9, 3.0, 0.0, 0.0], 1)]
    return rows


def test_against_an_eigensolver(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "ENTRIES", 100)
    monkeypatch.setattr(whitening, "TALL", 2)
    frame = spark.createDataFrame(vectors, SCHEMA).repartition(7)
    from pyspark.sql import functions as F

    got = [tuple(r) for r in whitened(frame.withColumns({c: F.lit("x") for c in ("id", "_vector", "n", "component", "whitened")})).collect()]
    matches(got, plain([(r[0], r[1]) for r in vectors]))
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-10


def test_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [tuple(r) for r in op11_embedding_whitening(spark, SF).collect()]
    matches(got, plain(rows))
    assert got[0][6] < 1e-10


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(np.random.default_rng(2).standard_normal((40, 3)) * [1e4, 1e7, 1e9])]
    got = whitened(spark.createDataFrame(rows, SCHEMA)).where("component = 1").collect()
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, d) for i, c, _, d, _, _ in plain([r[:2] for r in rows], 1)}
    y = np.array([[2**60, -(2**60) + 12345, 3], [-(2**59), 1, -1]])
    assert [int(v) for v in whitening._squares(y).to_pylist()] == [sum(int(c) ** 2 for c in r) for r in y]
    huge = whitened(spark.createDataFrame([(1, [1e38, 0.0], 0), (2, [-1e38, 0.0], 0)], SCHEMA)).collect()
    assert len(huge) == 4 and all(r.deviation is None or r.deviation >= 0 for r in huge)


def test_degenerate_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitened(frame([])).count() == 0
    assert whitened(frame([(1, None, 0), (2, [], 0)])).count() == 0
    one = whitened(frame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, None, None) for c in (1, 2, 1, 2)]
    line = whitened(frame([(1, [1.0, 5.0, 0.0], 0), (2, [2.0, 5.0, 0.0], 0), (3, [4.0, 5.0], 0)])).collect()  # the last is shorter
    assert {r.component for r in line} == {1, 2, 3} and {r.n for r in line} == {3}
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-12
    assert [round(r.explained, 12) for r in line[:3]] == [1, 0, 0]
