import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.llm import whitening as W

VECTORS = "vec_id long, embedding array<double>, label int"


def faddeev(m):
    """Coefficients of det(x - m) from the constant one up, by traces of powers."""
    d = len(m)
    coefficients, part = [1], [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        part = [[sum(m[i][t] * part[t][j] for t in range(d)) + coefficients[-1] * (i == j) for j in range(d)] for i in range(d)]
        whole = [[sum(m[i][t] * part[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        coefficients.append(-sum(whole[i][i] for i in range(d)) // k)
    return coefficients[::-1]


def plain(rows, most=4):
    """Whole vectors, count, exact deviations and numpy's whitening of clean rows."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, mean = len(fit), fit.mean(0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    white = {i: (np.array(x) - mean) @ vectors[:, :k] / np.sqrt(values[:k]) for i, x in kept}
    sums = [sum(int(c) for c in column) for column in fit.T]
    deviations = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    return n, k, white, deviations, values / values.sum()


def by_row(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


@pytest.mark.parametrize(("d", "count"), [(1, 5), (3, 40), (7, 300)])
def test_against_plain_whitening(spark, d, count):
    draw = random.Random(d)
    rows = [(i, [draw.gauss(0, 1 + 3 * j) for j in range(d)]) for i in range(count)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(2 * count)]  # most rows are copies of one
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5)
    got = by_row(W.whitened(frame.withColumns({"x": F.lit(1), "w0": F.lit("a"), "prime": F.lit(2)})))
    n, k, white, deviations, shares = plain(rows)
    assert set(got) == {i for i, _ in rows}
    first = rows[0][0]
    signs = [math.copysign(1, got[first][c].whitened * white[first][c - 1]) for c in range(1, k + 1)]
    for i, cells in got.items():
        assert sorted(cells) == list(range(1, k + 1))
        for c, r in cells.items():
            assert (r.n, r.deviation, r.deviation_text) == (n, deviations[i], str(deviations[i]))
            assert r.whitened * signs[c - 1] == pytest.approx(white[i][c - 1], abs=1e-8)
            assert r.explained == pytest.approx(shares[c - 1], rel=1e-9) and r.identity_error < 1e-9


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, -0.0]), (2, [1.0, 0.5]), (None, [-3.0, 2.25]), (2, [1.0, 0.5])]
    bad = [(5, None), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [-inf, nan]), (10, []), (11, [1.0]), (12, [1.0, 2.0, 3.0])]
    rows = W.whitened(spark.createDataFrame([(i, v, None) for i, v in good + bad], VECTORS)).collect()
    assert sorted((str(r.vec_id), r.component) for r in rows) == sorted((str(i), c) for i, _ in good for c in (1, 2))
    assert {r.n for r in rows} == {3}
    for none in ([], bad[:6], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert W.whitened(spark.createDataFrame([(i, v, 0) for i, v in none], VECTORS)).collect() == []


def test_equal_variances_and_huge_entries(spark):
    corners = [(2 * i + s, [float(sign * (j == i)) for j in range(5)]) for i in range(5) for s, sign in ((0, 1), (1, -1))]
    rows = W.whitened(spark.createDataFrame([(i, v, 0) for i, v in corners], VECTORS)).collect()
    assert len(rows) == 40 and all(r.explained == pytest.approx(0.2) and r.identity_error < 1e-9 for r in rows)
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 7.0]), (4, [1e10, -1e10])]
    got = by_row(W.whitened(spark.createDataFrame([(i, v, 0) for i, v in huge], VECTORS)))
    whole = [[max(min(math.floor(256 * c), 2**63 - 1), -(2**63)) for c in v] for _, v in huge]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    for (i, _), x in zip(huge, whole, strict=True):
        assert got[i][1].deviation is None and got[i][1].deviation_text == str(sum((4 * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
        assert got[i][1].identity_error < 1e-4


def test_polynomial_and_roots_are_exact(spark):
    draw = random.Random(1)
    for d in (1, 2, 5, 9):
        x = [[draw.randrange(-40, 40) for _ in range(d)] for _ in range(max(1, d - 2))]  # singular where d > 2
        m = [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]
        poly = W.characteristic(spark, m, block=2)
        assert poly == faddeev(m)
        roots, shift = W.largest_roots(poly, d, 200)
        found = [r for r, times in roots for _ in range(times)]
        values = sorted((v for v in np.linalg.eigvalsh(np.array(m, float)) if v > 1e-6), reverse=True)
        assert [float(Fraction(r, 1 << shift)) for r in found] == pytest.approx(values, rel=1e-9)
    diagonal = [[v * (i == j) for j in range(4)] for i, v in enumerate((6, 2, 6, 0))]
    roots, shift = W.largest_roots(faddeev(diagonal), 4, 64)
    assert [(r >> shift, times) for r, times in roots] == [(6, 2), (2, 1)]
    (y,) = W.null_vectors([[2, 1], [1, 2]], 3, 0, 1, 60)
    assert abs(float(y[0] - y[1])) < 1e-50


def test_products_of_large_whole_numbers():
    x = np.array([[2**62, -3], [5, 2**40], [-(2**63), 1], [7, 8]], np.int64)
    rows = [[int(v) for v in r] for r in x]
    assert W.exact_products(x).tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(2)] for i in range(2)]
