"""Whitening against a dense eigensolver and exact fractions."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from foliomill.llm import whitening


def plain(rows, k=4):
    """{(place of the row, component): (n, deviation, whitened up to sign, explained)}."""
    xs = [[math.floor(256 * float(c)) for c in v] for _, v in rows]
    fit = sorted({tuple(x) for x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for at, x in enumerate(xs):
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        y = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)])
        for j in range(min(k, d)):
            e, u = values[d - 1 - j], vectors[:, d - 1 - j]
            out[at, j + 1] = (n, deviation, float(y @ u) / math.sqrt(e) if e > 1e-9 else None, e / values.sum())
    return out


def test_factoring():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 2), (5, 3), (24, 24), (33, 20)):
        a = rng.normal(size=(d, rank)) * np.geomspace(1, 1e-5, rank)
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert factor.shape[1] <= d and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-14 * np.abs(v).max())
        assert np.allclose(np.triu(factor, 1), 0)
        values, components = whitening.principal(v)
        assert np.allclose(components @ components.T, np.eye(len(values)), atol=1e-12)
        assert np.allclose(values[:rank], np.linalg.eigvalsh(v)[::-1][: len(values)][:rank], rtol=1e-6, atol=1e-14)
        assert np.allclose((components.T * values) @ components, v, atol=1e-13 * np.abs(v).max())
    assert [len(x[0]) for x in whitening.rounds(5)] == [2] * 5
    assert len({tuple(sorted(p)) for i, j in whitening.rounds(8) for p in zip(i.tolist(), j.tolist(), strict=True)}) == 28
    values, components = whitening.principal(np.zeros((3, 3)))
    assert len(values) == 0 and components.shape == (0, 3)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    want = plain(rows)
    got = whitening.whiten(table.repartition(5)).collect()
    place = {v: i for i, (v, _) in enumerate(rows)}
    assert len(got) == len(want)
    signs = {}
    for r in got:
        n, deviation, white, explained = want[place[r.vec_id], r.component]
        assert (r.n, r.deviation, r.deviation_text) == (n, deviation, str(deviation))
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9
        if abs(white) > 1e-3:
            signs.setdefault(r.component, math.copysign(1, white * r.whitened))
        assert r.whitened == pytest.approx(white * signs.get(r.component, 1), abs=1e-8)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (2, [1.0, 3.0]), (None, [-7.0, 0.0]), (4, [0.001, -0.001])] + [(9, [0.25, 0.25])] * 20
    bad = [(5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (10, []), (11, [1.0, 2.0, 3.0]), (12, [-inf, nan])]
    frame = spark.createDataFrame([(i, v, "x", "n") for i, v in good + bad], "vec_id long, embedding array<double>, x string, n string").repartition(3)
    got = whitening.whiten(frame).collect()
    want = plain(good)
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation) for r in got) == sorted((good[at][0] or 0, j, n, dev) for (at, j), (n, dev, _, _) in want.items())
    assert {abs(round(r.whitened, 9)) for r in got} == {abs(round(w, 9)) for _, _, w, _ in want.values()}


def test_no_variance_large_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 4
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0, 3.0])], schema)).orderBy("vec_id", "component").collect()
    assert [(round(r.explained, 12), r.whitened is None) for r in line] == [(1.0, False), (0.0, True)] * 2
    assert abs(line[0].whitened) == pytest.approx(1.0)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [0.0, 0.0])], schema)).where("component = 1").collect()
    assert [r.deviation for r in huge if r.vec_id < 3] == [None, None] and all(int(r.deviation_text) >= 0 for r in huge)
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
