"""Whitening: eigenvectors against plain double precision, the query against brute force."""

import math

import numpy as np
import pytest

from newsloom.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def symmetric(rng, values):
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


def test_products_keep_twice_the_digits():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((9, 40)) * np.exp2(rng.integers(-20, 20, (9, 1))), rng.standard_normal((40, 7))
    high, low = whitening.product(a, b)
    for i in range(9):
        for j in range(7):
            from fractions import Fraction

            exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a[i].tolist(), b[:, j].tolist()))
            error = abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact)
            assert error <= Fraction(1, 2**90) * sum(abs(Fraction(x) * Fraction(y)) for x, y in zip(a[i].tolist(), b[:, j].tolist()))


@pytest.mark.parametrize("d", [1, 2, 16, 64, 200])
def test_eigenvectors_of_spread_values(d):
    rng = np.random.default_rng(d)
    a = symmetric(rng, np.linspace(1, 50, d))
    a = (a + a.T) / 2
    values, vectors = whitening.eigenvectors(a)
    want, basis = np.linalg.eigh(a)
    assert np.abs(values - want[::-1]).max() < 1e-12
    assert np.abs(np.abs(np.sum(vectors * basis[:, ::-1], axis=0)) - 1).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-14
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12


@pytest.mark.parametrize("values", [
    [1.0] * 8, [3, 3, 3, 2, 2, 1, 1e-9, 1e-9], [1 + i * 1e-9 for i in range(12)], [1, 1 + 1e-13, 5, 5 + 1e-6, 5 + 2e-6, 1e6],
    [1e8, 1, 1e-4, 1.1e-4, 1.2e-4, 0, 0], [0.0] * 5, [7.0, 0.0, 0.0],
])
def test_clustered_values(values):
    a = symmetric(np.random.default_rng(len(values)), np.asarray(values, dtype=float))
    a = (a + a.T) / 2
    got, vectors = whitening.eigenvectors(a)
    size = max(1e-300, np.abs(a).max())
    assert np.abs(got - np.sort(values)[::-1]).max() <= 4e-15 * size * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-14
    assert np.abs(vectors.T @ a @ vectors - np.diag(got)).max() <= 4e-15 * size * len(values)


def test_close_values_are_still_told_apart():
    """A gap of 1e-8: float32 sees one cluster, the sub-solve and the sweeps find its vectors."""
    n = 30
    exact = np.diag([1 + i * 1e-8 for i in range(n)])
    turn = np.eye(n)
    turn[:2, :2] = [[0.6, 0.8], [-0.8, 0.6]]
    values, vectors = whitening.eigenvectors(turn.T @ exact @ turn)
    assert np.abs(np.abs(vectors[:, ::-1].T @ turn.T) - np.eye(n)).max() < 1e-6
    assert np.abs(np.diff(values) + 1e-8).max() < 1e-14


def brute(vectors):
    """Per row deviation and whitened coordinates, by plain numpy."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = np.asarray(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.asarray([[float((n * a - b)) / n for a, b in zip(row, s)] for row in fit])
    v = centred.T @ centred / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    rows = np.asarray([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    return n, [sum(int(n * a - b) ** 2 for a, b in zip(row, s)) for row in x], rows @ basis / np.sqrt(values), values / np.trace(v)


def check(rows, given):
    n, deviation, white, explained = brute([v for _, v in given])
    by_row = {}
    for r in rows:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    for c in range(white.shape[1]):
        got = np.asarray([by_row[i][c + 1]["whitened"] for i, _ in given])
        sign = 1 if got @ white[:, c] > 0 else -1
        assert np.abs(sign * got - white[:, c]).max() < 1e-6
    for (i, _), d in zip(given, deviation):
        for c, r in by_row[i].items():
            assert r["n"] == n and r["deviation"] == d and r["identity_error"] < 1e-10
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-9


def test_query_equals_brute_force(spark):
    rows = queries.op13_embedding_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    given = [(r["vec_id"], r["embedding"]) for r in table if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    assert len(rows) == 16 * len(given)
    check(rows, given)


SCHEMA = "vec_id long, embedding array<double>, n string, x string, vector string, i string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "n", "x", "v", "i") for i, v in rows], SCHEMA).repartition(3)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    copies = [(100 + i, good[i % 3][1]) for i in range(30)]  # repeated vectors count once in the fit
    odd = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    out = whitening.whiten(table(spark, good + copies + odd)).collect()
    assert {r["vec_id"] for r in out} == {i for i, _ in good + copies} and len(out) == 5 * 70
    check(out, good + copies)
    again = whitening.whiten(table(spark, [*good, good[0], (None, good[1][1])])).collect()
    assert sum(r["vec_id"] == 0 for r in again) == 10 and sum(r["vec_id"] is None for r in again) == 5


def test_large_entries_are_exact_or_null(spark):
    out = whitening.whiten(table(spark, [(1, [1e5, 0.0]), (2, [-1e5, 1.0]), (3, [0.0, 5.0])])).collect()
    x = [[6_400_000 + 10**6, 10**6], [10**6 - 6_400_000, 10**6 + 64], [10**6, 10**6 + 320]]
    s = [sum(c) for c in zip(*x)]
    assert {r["vec_id"]: r["deviation"] for r in out} == {i + 1: sum((3 * a - b) ** 2 for a, b in zip(row, s)) for i, row in enumerate(x)}
    far = whitening.whiten(table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r["deviation"] for r in far if r["vec_id"] == 1} == {None} and all(math.isfinite(r["whitened"]) for r in far)


def test_few_directions_and_nothing(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert [r["component"] for r in line] == [1, 1, 1] and {round(abs(r["whitened"]), 9) for r in line} == {0.0, round(math.sqrt(1.5), 9)}
