"""Mixtures of factor analysers against plain expectation maximisation, and their global coordinates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektral.operators import manifolds as M
from vektral.operators import mixtures as X

SCHEMA = "sample_id long, cls int, feat array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3)


def strip(n=240, seed=1):
    """A bent strip in four features, and how far along it each sample lies."""
    rng = np.random.default_rng(seed)
    t = np.sort(rng.random(n)) * 2.4
    x = np.column_stack([np.sin(t), np.cos(t), 0.3 * rng.random(n), np.zeros(n)])
    return x + 0.02 * rng.normal(size=x.shape), t


def plain_step(x, mix):
    """Log density before a step and the mixture after it, sample by sample with whole covariances."""
    k, d, q = mix.load.shape
    cov = [mix.load[j] @ mix.load[j].T + np.diag(mix.noise[j]) for j in range(k)]
    p = np.array([[mix.share[j] * np.exp(-0.5 * (v - mix.mean[j]) @ np.linalg.inv(cov[j]) @ (v - mix.mean[j])) / np.sqrt(np.linalg.det(2 * np.pi * cov[j])) for j in range(k)] for v in x])
    r = p / p.sum(1, keepdims=True)
    out = X.Mixture(r.mean(0), mix.load.copy(), mix.mean.copy(), mix.noise.copy())
    for j in range(k):
        beta = mix.load[j].T @ np.linalg.inv(cov[j])
        cross, second = np.zeros((d, q + 1)), np.zeros((q + 1, q + 1))
        for v, w in zip(x, r[:, j]):
            z = beta @ (v - mix.mean[j])
            e = np.append(z, 1)
            square = np.outer(e, e)
            square[:q, :q] += np.eye(q) - beta @ mix.load[j]
            cross += w * np.outer(v, e)
            second += w * square
        both = cross @ np.linalg.inv(second)
        out.load[j], out.mean[j] = both[:, :q], both[:, q]
        out.noise[j] = np.diag(sum(w * np.outer(v, v) for v, w in zip(x, r[:, j])) - both @ cross.T) / r[:, j].sum()
    return np.log(p.sum(1)).mean(), out


def test_steps_are_those_of_plain_maximisation(spark):
    x, _ = strip(90)
    x[:, 3] += np.random.default_rng(2).normal(0, 0.1, 90)
    start, none = X.mixture(frame(spark, x), 3, 2, steps=0)
    assert none == [] and start.load.shape == (3, 4, 2)
    got, history = X.mixture(frame(spark, x), 3, 2, steps=5, tolerance=0, start=start)
    want, densities = start, []
    for _ in range(5):
        density, want = plain_step(x, want)
        densities.append(density)
    assert np.allclose([h[0] for h in history], densities) and np.allclose([h[1] for h in history], 90)
    for a, b in ((got.share, want.share), (got.mean, want.mean), (got.load, want.load), (got.noise, want.noise)):
        assert np.allclose(a, b, atol=1e-7)


def test_density_rises_and_one_component_is_factor_analysis(spark):
    x, _ = strip(150)
    history = [h[0] for h in X.mixture(frame(spark, x), 4, 1, steps=12, tolerance=0)[1]]
    assert len(history) == 12 and all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 6)) + 0.5 * rng.normal(size=(300, 6)) + 3
    one, _ = X.mixture(frame(spark, x), 1, 2, steps=150, tolerance=1e-10)
    load, noise, mean = M.factor_analysis(frame(spark, x), 2, 3000, 1e-9)
    assert np.allclose(one.mean[0], mean, atol=1e-6)
    assert np.allclose(one.load[0] @ one.load[0].T + np.diag(one.noise[0]), load @ load.T + np.diag(noise), atol=2e-2)


@pytest.mark.parametrize("k", [0, 6])
def test_alignment_is_the_dense_form(spark, k):
    x, _ = strip()
    ds = frame(spark, x)
    mix, _ = X.mixture(ds, 5, 1, steps=15)
    w, shift = X.aligned(ds, mix, 2, k)
    _, r, z = mix.local(x)
    n, (c, q) = len(x), (5, 2)
    u = np.array([np.concatenate([r[i, j] * np.append(z[i, j], 1) for j in range(c)]) for i in range(n)])
    assert np.allclose(u, mix.features(x))
    cost = np.zeros((c * q, c * q))
    for i in range(n):
        if k:
            near = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[1 : k + 1]
            g = (x[near] - x[i]) @ (x[near] - x[i]).T
            a = np.linalg.solve(g + 1e-3 * np.trace(g) * np.eye(k), np.ones(k))
            rest = u[i] - a @ u[near] / a.sum()
            cost += np.outer(rest, rest)
            continue
        for a in range(c):
            for b in range(c):
                apart = np.zeros(c * q)
                apart[a * q : a * q + q] += np.append(z[i, a], 1)
                apart[b * q : b * q + q] -= np.append(z[i, b], 1)
                cost += 0.5 * r[i, a] * r[i, b] * np.outer(apart, apart)
    y = (u - shift) @ w
    assert np.allclose(y.T @ y / n, np.eye(2), atol=1e-6) and np.allclose(y.mean(0), 0, atol=1e-8)
    values, vectors = np.linalg.eigh(np.cov(u.T, bias=True))
    root = vectors[:, values > 1e-10 * values.max()] / np.sqrt(values[values > 1e-10 * values.max()])
    least = np.linalg.eigvalsh(root.T @ cost @ root)[:2]
    assert np.allclose(np.diag(w.T @ cost @ w), least, rtol=1e-4, atol=1e-6)
    rows = X.coordinates(ds.withColumn("share", F.lit("clash")), mix, w, shift).collect()
    assert np.allclose(np.array([r["feat"] for r in sorted(rows)]), y, atol=1e-8) and rows[0]["share"] == "clash"


def test_odd_rows(spark):
    x, _ = strip(60)
    odd = spark.createDataFrame([(900, 1, None), (901, 1, []), (902, None, [float("nan"), 0.0, 0.0, 0.0]), (903, 2, [None, 0.0, 0.0, 0.0])], SCHEMA)
    mix, history = X.mixture(frame(spark, x).unionByName(odd), 2, 1, steps=4, tolerance=0)
    same, again = X.mixture(frame(spark, x), 2, 1, steps=4, tolerance=0)
    assert np.allclose(history, again) and np.allclose(mix.load, same.load)
    w, shift = X.aligned(frame(spark, x).unionByName(odd), mix, 1)
    assert X.coordinates(frame(spark, x).unionByName(odd), mix, w, shift).count() == 60
    none, history = X.mixture(odd, 2, 1)
    assert history == [] and len(none.share) == 0
    alike, _ = X.mixture(frame(spark, np.ones((8, 3))), 3, 1, steps=3)
    assert np.isfinite(alike.local(np.ones((1, 3)))[0]).all()
