"""Whitening against a dense eigendecomposition of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tonearm.llm import whitening
from tonearm.llm.whitening import leading, minres, packed, whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def _check(spark, rows, schema=SCHEMA, wanted=16, names=("vec_id", "embedding")):
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = whitened(df, wanted).collect()
    good = [(r[0], r[1]) for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    x = {i: [math.floor(64 * float(np.float32(c) if "float" in schema else c)) + 1_000_000 for c in v] for i, v in good}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    c = np.array([[float(Fraction(n * v[j] - sums[j], n)) for j in range(d)] for v in fit])
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(wanted, int((values > 1e-12 * values[0]).sum()))
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == len(good) * k
    trace = values.sum()
    for m in range(1, k + 1):
        gaps = np.abs(np.delete(values, m - 1) - values[m - 1]).min() if d > 1 else values[0]
        w = {i: float((np.array([float(Fraction(n * v[j] - sums[j], n)) for j in range(d)]) @ axes[:, m - 1]) / math.sqrt(values[m - 1])) for i, v in x.items()}
        big = max(w, key=lambda i: abs(w[i]))
        sign = 1 if w[big] * by[big, m].whitened > 0 else -1
        for i, v in x.items():
            r = by[i, m]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
            assert r.explained == pytest.approx(values[m - 1] / trace, rel=1e-9) and r.identity_error < 1e-9
            if gaps > 1e-6 * values[0]:
                assert sign * r.whitened == pytest.approx(w[i], abs=1e-6)
    return got


def test_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=24) * np.linspace(2, 0.3, 24)], 1) for i in range(300)]
    rows += [(400, rows[0][1], 1), (401, None, 1), (402, [], 1), (403, [float("nan")] * 24, 1), (404, [1.0] * 23 + [None], 1), (405, [float("inf")] + [0.0] * 23, 1)]
    got = _check(spark, rows)
    by = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(by[0, m] == by[400, m] for m in range(1, 17))


def test_few_rows_and_dimensions(spark):
    rows = [(i, [1.0 * i, 2.0 * i, 0.0], 0) for i in range(5)]
    assert {r.component for r in _check(spark, rows)} == {1}
    _check(spark, [(i, [0.5 * i], 0) for i in range(4)])
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    assert whitened(df).count() == 0 and whitened(df.limit(0)).count() == 0


def test_odd_rows(spark):
    """Null and repeated ids, a vector of another length, a clashing column, entries of any size."""
    rng = np.random.default_rng(4)
    rows = [(None if i < 2 else i // 2, [float(v) for v in rng.normal(size=4)], i, "x") for i in range(40)] + [(99, [1.0, 2.0], 0, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n string")
    got = whitened(df).collect()
    assert len(got) == 40 * 4 and sum(r.vec_id is None for r in got) == 8 and all(r.vec_id != 99 for r in got)
    huge = spark.createDataFrame([(i, [1e300 * (i % 2), float(i), -1e12 * i]) for i in range(6)], "vec_id long, embedding array<double>")
    rows = whitened(huge).collect()
    assert rows and all(math.isfinite(r.whitened) and r.deviation is None for r in rows)


def test_many_sums_are_added_in_two_stages(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT", 1)
    rng = np.random.default_rng(5)
    _check(spark, [(i, [float(v) for v in rng.normal(size=6)], 1) for i in range(90)])


@pytest.mark.parametrize("d,scale", [(64, 0.0), (130, 0.0), (200, 40.0)])
def test_leading_pairs(d, scale):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(3000, d)) * (np.exp(-np.arange(d) / scale) if scale else 1.0)
    v, calls = c.T @ c / len(c), []
    values, axes = leading(lambda u: (calls.append(1), v @ u)[1], d, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.abs(values - want).max() < 1e-13 * want[0] * 10 and np.abs(axes.T @ axes - np.eye(16)).max() < 1e-13
    assert np.linalg.norm(v @ axes - axes * values, axis=0).max() < 1e-13 * want[0] and len(calls) < 110


def test_equal_eigenvalues_and_rank():
    for diagonal in ([5.0] * 20 + [1.0] * 100, [3.0, 3.0, 1.0] + [0.0] * 150, [2.0], [1.0] * 64):
        values, axes = leading(lambda u: np.array(diagonal)[:, None] * u, len(diagonal), 16)
        assert values.tolist() == pytest.approx([v for v in diagonal if v][:16]) and np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-13


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(40, 40))
    v = v @ v.T
    q = np.linalg.qr(rng.normal(size=(40, 5)))[0]
    p, theta = np.eye(40) - q @ q.T, np.array([10.0, 30.0, 55.0])
    right = p @ rng.normal(size=(40, 3))
    t = minres(lambda u: v @ u, q, theta, right, steps=80, goal=1e-10)
    for j in range(3):
        assert np.linalg.norm(p @ (v - theta[j] * np.eye(40)) @ t[:, j] - right[:, j]) < 1e-6 * np.linalg.norm(right[:, j])
    assert np.abs(q.T @ t).max() < 1e-10


def test_packing():
    for x, size in (([-128, 127], 1), ([128], 2), ([40_000], 4), ([1 << 40], 8)):
        raw = packed(np.array(x))
        assert raw[0] == size and len(raw) == 1 + size * len(x)


def test_products_with_rounding_errors():
    """Sums over very many rows are less exact than one sum; the method stops at what they allow."""
    rng = np.random.default_rng(9)
    c = rng.normal(size=(3000, 120))
    v, calls = c.T @ c / len(c), []
    rough = lambda u: (calls.append(1), v @ u * (1 + 1e-13 * np.random.default_rng(len(calls)).normal(size=u.shape)))[1]
    values, axes = leading(rough, 120, 16)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:16]).max() < 1e-11 and len(calls) < 400
    assert np.linalg.norm(v @ axes - axes * values, axis=0).max() < 1e-10
