"""Whitening against a dense eigensolver and exact whole numbers."""

from __future__ import annotations

import numpy as np
import pytest

from salesaudit.llm.whitening import leading_components, minres, numerators, squares, whitened

SCHEMA = "vec_id long, embedding array<float>, label int, x int, component int, n int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)


def _numbers(vectors):
    return [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]


def _check(found, kept, components):
    """``found`` rows against plain Python and numpy for the (id, vector) list ``kept``."""
    x = _numbers([v for _, v in kept])
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    d = np.array([[n * c - s for c, s in zip(row, sums, strict=True)] for row in x], dtype=float) / n
    values, vectors = np.linalg.eigh(d.T @ d / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    expected = d @ vectors / np.sqrt(values)
    by_id = {}
    for row in found:
        by_id.setdefault(row["vec_id"], {}).setdefault(row["component"], []).append(row)
    assert set(by_id) == {i for i, _ in kept} and len(found) == n * components
    got = np.array([[by_id[i][c][0]["whitened"] for c in range(1, components + 1)] for i, _ in kept])
    sign = np.sign((got * expected).sum(axis=0))
    assert np.abs(got * sign - expected).max() < 1e-8
    for (i, _), row in zip(kept, x, strict=True):
        exact = sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True))
        assert {int(r["deviation"]) for rs in by_id[i].values() for r in rs} == {exact}
    trace = (d * d).sum() / n
    for c in range(components):
        assert found and {r["explained"] for rs in by_id.values() for r in rs[c + 1]} == {by_id[kept[0][0]][c + 1][0]["explained"]}
        assert by_id[kept[0][0]][c + 1][0]["explained"] == pytest.approx(values[c] / trace, rel=1e-10)
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] < 1e-10


def test_matches_a_dense_solver_and_leaves_faulty_rows_out(spark):
    rng = np.random.default_rng(1)
    scale = np.linspace(3, 0.5, 12)
    rows = [(i, (rng.standard_normal(12) * scale).astype(np.float32).tolist()) for i in range(300)]
    rows.append((None, rows[0][1]))  # a NULL id stays
    kept = list(rows)
    bad = [(1000, None), (1001, []), (1002, [float("nan")] + [0.0] * 11), (1003, [float("inf")] + [0.0] * 11), (1004, [None] + [0.0] * 11), (1005, [1.0] * 11)]
    _check(whitened(_table(spark, rows + bad)).collect(), kept, 8)


def test_fewer_dimensions_than_components_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(3).astype(np.float32).tolist()) for i in range(40)]
    found = whitened(_table(spark, rows + rows[:5])).collect()
    assert len(found) == 45 * 3 and {row["component"] for row in found} == {1, 2, 3}
    _check(whitened(_table(spark, rows)).collect(), rows, 3)


def test_tables_without_variance(spark):
    assert whitened(_table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitened(_table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitened(_table(spark, [(1, None)])).count() == 0
    empty = whitened(_table(spark, [(1, None)]).limit(0))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # variance in one of three dimensions: one component
    flat = whitened(_table(spark, [(i, [1.0, float(i), -2.0]) for i in range(9)])).collect()
    assert {row["component"] for row in flat} == {1} and flat[0]["explained"] == pytest.approx(1)


@pytest.mark.parametrize("kind", ["spread", "close", "equal", "low rank", "zero"])
def test_components_reach_double_precision(kind):
    rng = np.random.default_rng(5)
    dim = 150
    basis = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    values = {
        "spread": np.logspace(0, 6, dim),
        "close": 1e4 + np.arange(dim) * 3.0,
        "equal": np.r_[np.ones(dim - 5), np.full(5, 9.0)],
        "low rank": np.r_[np.zeros(dim - 3), 5.0, 6.0, 7.0],
        "zero": np.zeros(dim),
    }[kind]
    matrix = (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return matrix @ block

    found, vectors = leading_components(product, dim, 8)
    assert np.abs(found - np.sort(values)[::-1][:8]).max() <= 1e-11 * max(values.max(), 1)
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() <= 1e-12 * max(values.max(), 1)
    assert max(passes) <= 12 and len(passes) < 400


def test_minres_solves_each_column():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    right = rng.standard_normal((20, 4))
    right[:, 2] = 0
    x = minres(lambda v: a @ v - v * np.array([0.0, 0.5, 1.0, 40.0]), right, 60, 1e-13)
    for column, shift in enumerate([0.0, 0.5, 1.0, 40.0]):
        rest = (a - shift * np.eye(20)) @ x[:, column] - right[:, column]
        assert np.linalg.norm(rest) <= 1e-8


def test_whole_numbers_stay_exact_beyond_64_bits():
    x = np.array([[2**52, 5], [7, -(2**51)]], dtype=np.int64)
    sums, n = [2**52 + 7, 5 - 2**51], 2
    d = numerators(x, 2**40, [s * 2**39 for s in sums])
    assert d.tolist() == [[2**40 * int(c) - s * 2**39 for c, s in zip(row, sums, strict=True)] for row in x.tolist()]
    assert squares(d).tolist() == [sum(v * v for v in row) for row in d.tolist()]
    assert squares(numerators(x % 1000, n, [1, 2])).tolist() == [sum((n * int(c) - s) ** 2 for c, s in zip(row, (1, 2), strict=True)) for row in (x % 1000).tolist()]
