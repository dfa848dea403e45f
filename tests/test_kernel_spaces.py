"""Methods over all pairs beyond what fits the driver: the blocked passes against the dense ones."""

import numpy as np
import pytest
from tests.conftest import SMALL

from vektral.operators import discriminants as R
from vektral.operators import kernel_spaces as KS
from vektral.operators import learning as L
from vektral.operators import manifolds as M
from vektral.sources import tables as T


def matrix(df):
    rows = df.orderBy("sample_id").collect()
    return [r["sample_id"] for r in rows], np.array([r["feat"] for r in rows])


def signed(y, like):
    return y * np.sign((y * like).sum(0))


@pytest.mark.parametrize(("kernel", "wide"), [("gaussian", 256), ("gaussian", 40)])
def test_kernel_pca_by_blocks(spark, kernel, wide):
    s = T.samples(spark, SMALL)
    ids, dense = matrix(L.kernel_pca(s, 2, kernel))
    got, y = matrix(KS.principal(s, 2, kernel, size=60, wide=wide))
    assert got == ids and np.allclose(signed(y, dense), dense, atol=1e-6)


def test_kernel_pca_takes_any_number(spark):
    s = T.samples(spark, SMALL)
    assert L.kernel_pca(s, most=50).count() == s.count()


@pytest.mark.parametrize(("alpha", "wide"), [(0.1, 512), (5.0, 36)])
def test_kernel_discriminants_by_blocks(spark, alpha, wide):
    s = T.samples(spark, SMALL)
    ids, dense = matrix(R.kernel_discriminant(s, alpha=alpha))
    got, y = matrix(KS.discriminating(s, alpha=alpha, size=100, wide=wide))
    assert got == ids and np.allclose(signed(y, dense), dense, atol=1e-6)


@pytest.mark.parametrize("heavy", [True, False])
def test_stochastic_neighbours_by_blocks(spark, heavy):
    s = T.samples(spark, SMALL).select("sample_id", "feat")
    ids, dense = matrix(M.stochastic_neighbours(s, steps=6, heavy=heavy))
    start = np.random.default_rng(1).normal(0, 1e-4, (len(ids), 2))  # as the dense one starts
    placed = s.join(spark.createDataFrame([(i, [float(v) for v in y]) for i, y in zip(ids, start)], "sample_id long, y array<double>"), "sample_id")
    got, y = matrix(M._blocked_neighbours(placed, 2, 30.0, 30, 6, 200.0, heavy, size=100))
    assert got == ids and np.allclose(y, dense, rtol=1e-5, atol=1e-6 * np.abs(dense).max())
    assert M.stochastic_neighbours(s, steps=1, heavy=heavy, most=50).count() == len(ids)


def test_neighbourhood_components_by_blocks(spark):
    s = T.samples(spark, SMALL)
    w, mean = M.neighbourhood_components(s, 3, 8)
    v, centre = M.neighbourhood_components(s, 3, 8, most=50)
    assert np.allclose(mean, centre) and np.allclose(v @ v.T, w @ w.T, rtol=1e-6, atol=1e-8)  # but for signs of directions


def test_kernel_discriminants_settle_in_few_products(spark):
    """The map settles them in 5 products; the Krylov space took 19."""
    s = T.samples(spark, SMALL)
    ids, dense = matrix(R.kernel_discriminant(s))
    got, y = matrix(KS.discriminating(s, size=100, most_products=12))
    assert got == ids and np.allclose(signed(y, dense), dense, atol=1e-7)


def test_neighbourhood_weights_are_made_in_one_pass(spark, monkeypatch):
    """A step that is not taken, and the last one, make no gradient."""
    passes = []
    monkeypatch.setattr(M, "summed", lambda spark, names, give, add=M.summed: passes.append(give.__qualname__.split(".")[2]) or add(spark, names, give))
    M.neighbourhood_components(T.samples(spark, SMALL), 3, 2, most=50)
    assert passes == ["counted", "weights", "slope", "weights"]
