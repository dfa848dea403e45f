"""Feature selection, tangent maps and dictionaries over all rows against plain numpy."""

import numpy as np
import pytest

from vektral.operators import classifiers as C
from vektral.operators import selection as SE
from vektral.operators import windows as W

SCHEMA = "sample_id long, cls int, feat array<double>"


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))], SCHEMA).repartition(3)


def information(a, b):
    out = 0.0
    for u in np.unique(a):
        for v in np.unique(b):
            p = np.mean((a == u) & (b == v))
            if p:
                out += p * np.log(p / (np.mean(a == u) * np.mean(b == v)))
    return out


def test_relevant_features_skip_what_repeats(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(1, 4, 400)
    x = np.column_stack([y + rng.normal(0, 0.6, 400), rng.normal(size=400), (y == 2) + rng.normal(0, 0.3, 400), rng.normal(size=400), np.zeros(400)])
    x = np.column_stack([x, x[:, 0] * 2])  # a copy
    got = SE.relevant_features(frame(spark, x, y), 6)
    level = 1 + (x > x.mean(0) + x.std(0)) - (x < x.mean(0) - x.std(0)).astype(int)
    chosen = []
    for _ in range(6):
        score = [-np.inf if j in chosen else information(y, level[:, j]) - (np.mean([information(level[:, i], level[:, j]) for i in chosen]) if chosen else 0) for j in range(6)]
        chosen.append(int(np.argmax(np.round(score, 12))))
        assert abs(got[len(chosen) - 1][1] - max(score)) < 1e-9
    assert [j for j, _ in got] == chosen and {chosen[0], chosen[1]} == {0, 2} and chosen.index(5) >= 3
    assert SE.relevant_features(frame(spark, x, y).limit(0), 3) == []


def test_tangent_map_is_the_dense_form(spark):
    rng = np.random.default_rng(4)
    t = rng.random((200, 2))
    x = np.column_stack([t[:, 0], t[:, 1], 0.1 * t[:, 0] ** 2, 0.05 * rng.normal(size=200), t.sum(1)])
    w, mean = SE.tangent_map(frame(spark, x, np.ones(200)), 2, 8)
    b = np.zeros((200, 200))
    for i in range(200):
        n = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:9]
        z = x[n] - x[n].mean(0)
        g = np.column_stack([np.full(9, 1 / 3), np.linalg.svd(z)[0][:, :2]])
        b[np.ix_(n, n)] += np.eye(9) - g @ g.T
    z = x - x.mean(0)
    values, vectors = np.linalg.eigh(z.T @ z)
    keep = values > 1e-10 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    want = root @ np.linalg.eigh(root.T @ (z.T @ b @ z) @ root)[1][:, :2]
    assert np.allclose(mean, x.mean(0))
    assert np.allclose(z @ w @ np.linalg.pinv(z @ w), z @ want @ np.linalg.pinv(z @ want), atol=1e-6)


@pytest.mark.parametrize("kind", ["ksvd", "mod"])
def test_dictionaries_recover_planted_atoms_from_all_rows(spark, kind):
    """Atoms of hidden parts, some of which only a few samples of a large table hold."""
    rng = np.random.default_rng(6)
    atoms = np.linalg.qr(rng.normal(size=(16, 6)))[0].T
    pick = np.concatenate((rng.integers(0, 5, 900), np.full(100, 5)))
    x = atoms[pick] * rng.uniform(1, 2, 1000)[:, None] + rng.normal(0, 0.01, (1000, 16))
    d, codes = C.learned_dictionary(frame(spark, x, pick + 1), 6, 1, 14, kind)
    assert np.allclose(np.linalg.norm(d, axis=0), 1)
    assert (np.abs(atoms @ d).max(1) > 0.99).all()
    got = codes.toPandas()
    assert len(got) == 1000 and all((np.array(v) != 0).sum() <= 1 for v in got.feat)


def test_z_scores_of_groups_nulls_and_constants(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), (None, 1.0), (None, 2.0), ("c", None), ("d", 5.0)]
    got = sorted((str(r.g), r.x is None or r.x, r.z) for r in W.z_scores(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect())
    want = {("a", 1.0): -(0.5**0.5), ("a", 3.0): 0.5**0.5, ("b", 2.0): 0.0, ("None", 1.0): -(0.5**0.5), ("None", 2.0): 0.5**0.5}
    assert len(got) == len(rows) and all(abs(z - want[g, x]) < 1e-12 for g, x, z in got if (g, x) in want)


def test_linear_maps_are_the_dense_forms(spark):
    from vektral.operators import manifolds as M

    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 6)) * [3, 2, 1, 1, 0.5, 0.2]
    ds, z = frame(spark, x, np.ones(150)), x - x.mean(0)
    d2 = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, axis=1, kind="stable")[:, :5]
    w, left = np.zeros((150, 150)), np.eye(150)
    for i, n in enumerate(near):
        w[i, n] = np.exp(-d2[i, n] / 2)
        c = (x[n] - x[i]) @ (x[n] - x[i]).T
        v = np.linalg.solve(c + np.eye(5) * (1e-5 * np.trace(c) + 1e-12), np.ones(5))
        left[i, n] -= v / v.sum()
    w = np.maximum(w, w.T)
    degree = np.diag(w.sum(1))
    for (got, mean), want in ((M.locality_preserving(ds, 5, 1.0, 3), M.generalized(z.T @ (degree - w) @ z, z.T @ degree @ z, 3)), (M.neighbourhood_preserving(ds, 5, 3), M.generalized(z.T @ left.T @ left @ z, z.T @ z, 3))):
        assert np.allclose(mean, x.mean(0))
        assert np.allclose(z @ got @ np.linalg.pinv(z @ got), z @ want @ np.linalg.pinv(z @ want), atol=1e-6)


def test_wide_galleries_have_the_codes_of_the_direct_form():
    from vektral.operators import learning as L

    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(8, 30)), rng.normal(size=(8, 3))
    a /= np.linalg.norm(a, axis=0)
    n, z, u = 30, np.zeros((30, 3)), np.zeros((30, 3))
    inverse = np.linalg.inv(a.T @ a + np.eye(n))
    for _ in range(4000):
        x = inverse @ (a.T @ b + z - u)
        z = np.sign(x + u) * np.maximum(np.abs(x + u) - 0.05, 0)
        u += x - z
    value = lambda z: (((a @ z - b) ** 2).sum(0) / 2 + 0.05 * np.abs(z).sum(0))
    assert np.allclose(value(L.lasso(a, b, 0.05)), value(z), rtol=0.02)
    x = C.nonnegative_least_squares(a, b, 5000)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope > -1e-5).all() and np.abs(slope * x).max() < 1e-5
