"""Feature-sign search against coordinate descent, the dual dictionary by its gap and by block descent."""

import numpy as np
import pytest

from strandline.operators import dictionary, encoding


@pytest.mark.parametrize("atoms,dim,lam", [(6, 3, 0.15), (40, 12, 0.05), (64, 64, 0.3)])
def test_feature_sign_equals_coordinate_descent(atoms, dim, lam):
    rng = np.random.default_rng(atoms)
    basis = rng.normal(size=(dim, atoms))
    basis /= np.linalg.norm(basis, axis=0)
    a = basis.T @ basis + 2e-3 * np.eye(atoms)
    b = -rng.normal(size=(50, dim)) @ basis
    got, rounds = dictionary.feature_sign(a, b, lam)
    want = encoding.l1_quadratic(a, b, lam)
    assert np.abs(got - want).max() < 1e-9 and rounds < 200
    g = got @ a + b  # the conditions of a minimum
    assert (np.abs(g[got == 0]) <= lam + 1e-8).all() and np.allclose(g[got != 0], -lam * np.sign(got[got != 0]), atol=1e-8)


def test_feature_sign_on_chosen_coordinates_and_edges():
    rng = np.random.default_rng(2)
    basis = rng.normal(size=(5, 9))
    a, b = basis.T @ basis + 1e-3 * np.eye(9), -rng.normal(size=(30, 5)) @ basis
    on = rng.random(b.shape) < 0.4
    got, _ = dictionary.feature_sign(a, b, 0.1, on)
    assert np.abs(got - encoding.l1_quadratic(a, b, 0.1, on)).max() < 1e-9 and (got[~on] == 0).all()
    assert dictionary.feature_sign(a, np.zeros((3, 9)), 0.1)[0].any() == 0
    assert dictionary.feature_sign(a, np.zeros((0, 9)), 0.1)[0].shape == (0, 9)


def test_equal_atoms_share_nothing_twice():
    a = np.array([[1.0, 1.0], [1.0, 1.0]]) + 1e-6 * np.eye(2)
    got, _ = dictionary.feature_sign(a, np.array([[-2.0, -2.0], [3.0, 3.0]]), 0.5)
    g = got @ a + np.array([[-2.0, -2.0], [3.0, 3.0]])
    assert (np.abs(g) <= 0.5 + 1e-8).all()


@pytest.mark.parametrize("atoms,dim,rows", [(5, 3, 200), (256, 32, 3000)])
def test_dual_has_no_gap(atoms, dim, rows):
    rng = np.random.default_rng(atoms)
    s = rng.normal(size=(atoms, rows)) * (rng.random((atoms, rows)) < 0.1)
    x = rng.normal(size=(dim, rows)) * 2
    before = rng.normal(size=(dim, atoms))
    ss, xs = s @ s.T, x @ s.T
    b, gap = dictionary.dual_basis(ss, xs, before)
    value = lambda b: 0.5 * ((x - b @ s) ** 2).sum()
    assert (np.linalg.norm(b, axis=0) <= 1 + 1e-9).all() and abs(gap) < 1e-6 * max(1.0, value(b))
    other = b + 1e-3 * rng.normal(size=b.shape)
    other /= np.maximum(1, np.linalg.norm(other, axis=0))
    assert value(b) <= value(other)


def test_bound_that_does_not_bind_is_least_squares():
    rng = np.random.default_rng(1)
    s = rng.normal(size=(4, 100)) * 50
    x = rng.normal(size=(3, 4)) * 0.1 @ s
    b, gap = dictionary.dual_basis(s @ s.T, x @ s.T, np.zeros((3, 4)))
    assert np.allclose(b, x @ s.T @ np.linalg.inv(s @ s.T), atol=1e-6) and abs(gap) < 1e-4


def test_unused_atoms_stay():
    before = np.eye(3)
    ss = np.diag([2.0, 0.0, 3.0])
    xs = np.array([[1.0, 0, 0], [0, 0, 9], [0, 0, 0]])
    b, _ = dictionary.dual_basis(ss, xs, before)
    assert (b[:, 1] == before[:, 1]).all() and np.allclose(b[:, 0], [0.5, 0, 0]) and np.allclose(b[:, 2], [0, 1, 0])
    assert (dictionary.dual_basis(np.zeros((3, 3)), np.zeros((3, 3)), before)[0] == before).all()


def test_learning_lowers_the_objective(spark):
    rng = np.random.default_rng(3)
    true = rng.normal(size=(4, 6))
    true /= np.linalg.norm(true, axis=0)
    x = (true @ (rng.normal(size=(6, 300)) * (rng.random((6, 300)) < 0.3))).T
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(3)
    seen = []
    b = encoding.learn_basis(df, ["a", "b", "c", "d"], 6, 0.02, rounds=12, history=seen)
    values = [h["objective"] for h in seen]
    assert all(q <= p + 1e-9 for p, q in zip(values, values[1:], strict=False)) and values[-1] < 0.85 * values[0]
    assert max(abs(h["gap"]) for h in seen) < 1e-6 and (np.linalg.norm(b, axis=0) <= 1 + 1e-9).all()


def test_signs_of_some_rows_serve_all():
    """Same codes as the search of every row, which few rows need."""
    rng = np.random.default_rng(4)
    basis = rng.normal(size=(3, 5))
    basis /= np.linalg.norm(basis, axis=0)
    a, b = basis.T @ basis + 2e-4 * np.eye(5), -rng.random((5000, 3)) @ basis
    b[17] = np.nan
    want, searched, known = dictionary.feature_sign(a, b, 0.15)[0], [], []
    find = dictionary.feature_sign
    dictionary.feature_sign = lambda a, b, *v, **k: searched.append(len(b)) or find(a, b, *v, **k)
    try:
        got = np.concatenate([dictionary.by_signs(a, part, 0.15, known) for part in (b[:3000], b[3000:])])
    finally:
        dictionary.feature_sign = find
    assert np.abs(got - want).max() < 1e-9 and sum(searched) < 500


def test_codes_stay_in_the_task_that_sums_them(spark, monkeypatch):
    """A round of the dictionary is one Python step: no code goes out and in again."""
    steps = []
    rows = spark.createDataFrame(np.random.default_rng(2).random((50, 2)).tolist(), "a double, b double")
    real = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *v, **k: steps.append(1) or real(self, *v, **k))
    encoding.learn_basis(rows, ["a", "b"], 3, rounds=2)
    assert len(steps) == 2
