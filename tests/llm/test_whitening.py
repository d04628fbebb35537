"""Whitening against numpy over all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import whitening

NAN = float("nan")


def _rows(spark, vectors):
    return spark.createDataFrame([(n, v) for n, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def _brute(x, k, weight=None):
    """n, deviation, whitened and explained, vector by vector."""
    x = np.array(x, dtype=object)
    fit = x if weight is None else x[weight]
    n, s = len(fit), fit.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    centred = (np.array((n * x - s).tolist(), float)) / n
    base = np.array((n * fit - s).tolist(), float) / n
    v = base.T @ base / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, centred @ u / np.sqrt(e), e / np.trace(v)


def _check(found, x, brute, k):
    n, deviation, white, explained = brute
    got = {(r.id, r.component): r for r in found}
    assert len(got) == len(x) * k
    signs = [np.sign(got[i, c + 1].whitened * white[i, c]) for c in range(k) for i in [int(np.abs(white[:, c]).argmax())]]
    for i in range(len(x)):
        for c in range(k):
            r = got[i, c + 1]
            assert r.n == n and r.deviation == deviation[i]
            assert r.whitened == pytest.approx(signs[c] * white[i, c], abs=1e-8)
            assert r.explained == pytest.approx(explained[c], rel=1e-9)
            assert 0 <= r.identity_error < 1e-9


@pytest.mark.parametrize("hot", [whitening.HOT_ROWS, 3])
def test_equals_numpy(spark, monkeypatch, hot):
    monkeypatch.setattr(whitening, "HOT_ROWS", hot)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 10)).astype(np.float32) * np.arange(1, 11, dtype=np.float32)
    vectors = [*base, *[base[0]] * 30, *[base[1]] * 5, np.full(10, -2.5, np.float32)]
    x = [[int(np.floor(float(c) * 1024)) + 100_000 for c in v] for v in vectors]
    rows = _rows(spark, [v.tolist() for v in vectors])
    _check(whitening.whiten(rows).collect(), x, _brute(x, 8), 8)
    if hot == 3:
        once = [n for n, v in enumerate(x) if v not in x[:n]]
        _check(whitening.whiten(rows, components=3, weights="one").collect(), x, _brute(x, 3, once), 3)


def test_odd_rows(spark):
    good = [[1.0, 2.0], [2.0, 5.0], [4.0, 1.0], [1.0, 2.0]]
    odd = [None, [1.0, None], [NAN, 1.0], [float("inf"), 0.0], [], [1.0, 2.0, 3.0], [1.0]]
    rows = _rows(spark, [*good, *odd]).withColumns({c: F.lit("x") for c in ("x", "key", "weight", "copies", "nth", "id", "n")})
    x = [[int(c * 1024) + 100_000 for c in v] for v in good]
    _check(whitening.whiten(rows).collect(), x, _brute(x, 2), 2)
    assert whitening.whiten(rows.where("false")).count() == 0
    assert whitening.whiten(_rows(spark, odd[:5])).count() == 0
    assert whitening.whiten(_rows(spark, [[1.0, 2.0]] * 3)).count() == 0
    one_axis = whitening.whiten(_rows(spark, [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])).collect()
    assert {r.component for r in one_axis} == {1}


def test_deviations_beyond_a_long_are_null(spark):
    far = whitening.whiten(_rows(spark, [[3.0e9, 1.0], [0.0, 2.0], [0.0, 1.0]])).collect()
    assert {r.deviation for r in far} == {None}
    near = whitening.whiten(_rows(spark, [[1.0e6, 1.0], [0.0, 2.0], [0.0, 1.0]])).collect()
    x = np.array([[1_024_100_000, 101_024], [100_000, 102_048], [100_000, 101_024]], dtype=object)
    assert {r.id: r.deviation for r in near} == dict(enumerate(((3 * x - x.sum(0)) ** 2).sum(1)))
