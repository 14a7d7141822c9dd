"""op11 against numpy's own eigensolver and Python integers."""

import math

import numpy as np
import pytest
from llm_cases import clashing

from valorum.llm import whitening
from valorum.llm.queries import QUERIES

VEC = "vec_id long, embedding array<float>, label int"


def grid(vectors):
    return np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000


def check(rows, ids, vectors, components):
    """Every contract column of the rows against the definition."""
    x = grid(vectors)
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    want = {i: sum(int(v) ** 2 for v in (n * a - s)) for i, a in zip(ids, x)}
    got = {}
    for r in rows:
        assert r.n == n and r.deviation == want[r.vec_id] and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(e[r.component - 1] / (centred**2).sum() * n, rel=1e-9)
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
    assert set(got) == set(ids) and all(sorted(v) == list(range(1, len(e) + 1)) for v in got.values())
    w = np.array([[got[i][c + 1] for c in range(len(e))] for i in ids])
    truth = centred @ q / np.sqrt(e)
    sign = np.sign((w * truth).sum(0))
    assert np.abs(w - truth * sign).max() < 1e-6
    assert np.abs(w.T @ w / n - np.eye(len(e))).max() < 1e-9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_equals_definition(spark, sf):
    folder = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    got = QUERIES["op11_spectrum_slicing"](spark, folder).collect()
    check(got, [r.vec_id for r in table], [r.embedding for r in table], 32)


def test_inertia_counts_equal_eigenvalues():
    rng = np.random.default_rng(5)
    for d in [1, 2, 3, 8, 20] * 10:
        a = rng.integers(-2, 3, (d, d)).astype(float)
        a = a + a.T
        for shift in (0.37, -1.21, 2.9):
            assert whitening.positive(a - shift * np.eye(d)) == (np.linalg.eigvalsh(a) > shift).sum()
    assert whitening.positive(np.zeros((4, 4))) == 0
    assert whitening.positive(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1  # no diagonal pivot


@pytest.mark.parametrize("values", [[5, 5, 5, 3, 3] + [1] * 15, [1] * 20, [1e6, 1, 1e-3], [2, 2 - 1e-13, 1, 0.5, 0.5], [7], [3, 3 - 1e-9, 3 - 2e-9, 1]])
def test_clusters_and_wide_spectra(values):
    q, _ = np.linalg.qr(np.random.default_rng(6).normal(size=(len(values), len(values))))
    v = (q * np.array(values, float)) @ q.T
    e, x = whitening.leading((v + v.T) / 2, 32)
    assert len(e) == len(values) and np.abs(e - values).max() < 1e-13 * max(values) * len(values)
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12
    assert np.abs(v @ x - x * e).max() < 1e-13 * max(values) * len(values)
    some, _ = whitening.leading((v + v.T) / 2, 2)
    assert some == pytest.approx(values[:2])


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [(i, [float(c) for c in rng.normal(size=6)], 0) for i in range(60)]
    good += [(3, good[3][1], 0), (3, good[3][1], 0), (None, good[8][1], 1)] + [(100 + i, [0.0] * 6, 0) for i in range(30)]  # zeros take part
    bad = [(200, None, 0), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (202, [math.nan] + [1.0] * 5, 0),
           (203, [1.0] * 5 + [math.inf], 0), (204, [1.0, 2.0], 0), (205, [], 0), (206, [3e38] + [1.0] * 5, 0)]
    df = clashing(spark.createDataFrame(good + bad, VEC).repartition(5))
    got = whitening.whiten(df, 4).collect()
    assert len(got) == 4 * len(good)
    unique = [r for r in got if r.vec_id not in (None, 3)]
    assert {r.vec_id for r in unique} == {i for i, _, _ in good} - {None, 3}
    assert sum(r.vec_id == 3 for r in got) == 12 and sum(r.vec_id is None for r in got) == 4
    x = grid([v for _, v, _ in good])
    for r in got:
        if r.vec_id is not None:
            own = grid([next(v for i, v, _ in good if i == r.vec_id)])[0]
            assert r.deviation == sum(int(v) ** 2 for v in (len(x) * own - x.sum(0)))
    again = whitening.whiten(df.repartition(2), 4).collect()
    key = lambda r: (r.vec_id is None, r.vec_id or 0, r.component)
    assert [(r.deviation, r.explained) for r in sorted(got, key=key)] == [(r.deviation, r.explained) for r in sorted(again, key=key)]


def test_few_rows_and_constant_dimensions(spark):
    assert whitening.whiten(spark.createDataFrame([], VEC)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], VEC)).count() == 0  # no variance, no component
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0], 0), (2, [1.0, 4.0, 0.0], 0)], VEC)).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), r.explained) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(np.float32(c)) for c in rng.normal(size=3) * [1, 1e6, 1e12]], 0) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(data, VEC).repartition(3), 1).collect()
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v, _ in data]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        exact = sum((50 * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        assert r.deviation == (exact if exact < 1 << 63 else None)
    model = whitening.fit(spark.createDataFrame(data, VEC), 3)
    assert model.sums == tuple(s)


def test_more_rows_do_not_reach_the_driver(spark):
    model = whitening.fit(spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(100)], VEC), 2)
    plan = whitening.transform(spark.createDataFrame([], VEC), model)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and model.values.shape == (1,)
