"""Whitening: updates of a spectrum and the query, against numpy on the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import queries, whitening
from sluice.llm.whitening import Spectrum, secular_roots, updated


def test_updates_of_odd_matrices():
    """Repeated eigenvalues, vectors that touch few directions, and sizes far apart."""
    rng = np.random.default_rng(1)
    for _ in range(150):
        d = int(rng.integers(1, 9))
        values, basis, whole = np.zeros(d), np.eye(d), np.zeros((d, d))
        for i in range(25):
            vector = rng.integers(-2, 3, size=d) * 10.0 ** rng.integers(-3, 4)
            if i % 5 == 0:
                vector = np.zeros(d)
                vector[rng.integers(d)] = 3
            values, basis = updated(values, basis, vector)
            whole += np.outer(vector, vector)
        assert np.abs(basis.T @ basis - np.eye(d)).max() < 1e-12
        assert np.abs(basis * values @ basis.T - whole).max() <= 1e-12 * np.abs(whole).max()
        assert (np.diff(values) >= 0).all()


def test_secular_roots_interlace():
    poles = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-7, 50.0])
    weights = np.array([1e-3, 2.0, 1e-12, 5.0, 1e-6])
    nearest, offset = secular_roots(poles, weights)
    away = (poles[:, None] - poles[nearest]) - offset
    f = 1 + (weights[:, None] / away).sum(0)
    assert (np.abs(f) <= 1e-12 * (1 + np.abs(weights[:, None] / away).sum(0))).all()
    roots = poles[nearest] + offset
    assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all() and roots[-1] <= poles[-1] + weights.sum()


@pytest.mark.parametrize("block", [1, 3, 64, 1000])
def test_spectra_of_parts(block):
    rng = np.random.default_rng(block)
    x = rng.integers(-300, 300, size=(400, 12)) + 1_000_000
    x[:, 3] = x[:, 4]
    x[:, 7] = 5
    parts = []
    for rows in np.array_split(x, 3):
        parts.append(Spectrum(12))
        for i in range(0, len(rows), block):
            parts[-1].add(rows[i:i + block])
    parts[0].merge(parts[1])
    parts[0].merge(parts[2])
    centred = x - x.mean(0)
    want = centred.T @ centred
    got = parts[0].basis * parts[0].values @ parts[0].basis.T
    assert parts[0].n == 400 and parts[0].sums == list(x.sum(0))
    assert np.abs(got - want).max() < 1e-9 * np.abs(want).max()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {c: F.lit("clash") for c in ("x", "n", "component", "whitened", "_at")})


def plain(rows, count=16):
    """(vec_id, deviation) of each row, their whitened values, and the explained parts."""
    good = [(i, v) for i, v, _ in rows if v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in good])
    each = np.unique(x, axis=0)
    n, sums = len(each), each.sum(0)
    centred = (each * n - sums) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    keep = (values > 1e-11 * values[0]).sum() if values[0] > 0 else 0
    keep = min(keep, count)
    deviations = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums)) for row in x]
    return n, [i for i, _ in good], deviations, ((x * n - sums) / n) @ basis[:, :keep] / np.sqrt(values[:keep]), values / values.sum()


def check(spark, tmp_path, rows):
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_whitening(spark, str(tmp_path)).collect()
    n, ids, deviations, white, explained = plain(rows)
    k = white.shape[1]
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
    assert all(r["identity_error"] < 1e-9 for r in got)
    sign = np.ones(k)
    first = {r["component"]: r["whitened"] for r in got if r["vec_id"] == ids[0]}
    for j in range(k):
        sign[j] = np.sign(first[j + 1] * white[0, j]) or 1.0
    want = sorted(((i is None, i or 0), j + 1, d, float(w[j] * sign[j]), float(explained[j]))
                  for i, d, w in zip(ids, deviations, white) for j in range(k))
    have = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["component"], r["deviation"], r["whitened"], r["explained"]) for r in got)
    for a, b in zip(have, want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-8) and a[4] == pytest.approx(b[4], rel=1e-8)


def test_query_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=6) * (1 + np.arange(6))], 0) for i in range(150)]
    rows += [(200 + i, rows[0][1], 1) for i in range(90)]  # copies count once in the fit
    rows += [(300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] + [0.0] * 5, 0),
             (304, [], 0), (305, [1.0, 2.0], 0), (None, rows[1][1], None), (7, rows[2][1], 0)]
    check(spark, tmp_path, rows)


def test_dimensions_without_variance(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        a, b = (float(c) for c in rng.integers(-50, 50, size=2))
        rows.append((i, [a, b, a, 3.0, 0.0, a], 0))
    check(spark, tmp_path, rows)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]):
        got = whitening.components(vectors(spark, rows), ["vec_id"])
        assert got.count() == 0 and "identity_error" in got.columns


def test_huge_entries_and_deviations():
    model = whitening.Whitening(10 ** 6, [0, 0], np.eye(2), np.ones(2), 2.0)
    assert model.deviations(np.array([[10 ** 9, 0], [3, 4]])).to_pylist() == [None, 25 * 10 ** 12]


def test_huge_entries_take_no_part(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [1.5]), (3, [-0.01])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["x"]) for r in whitening.quantised(df).collect()] == [(2, [1_000_096]), (3, [999_999])]
