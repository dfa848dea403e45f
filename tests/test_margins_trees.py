"""Machines and spheres against an interior-point solver, forests and packings against plain walks, the metric of
large margins against its loss written out."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektral.operators import blocks as B
from vektral.operators import large_margin as LM
from vektral.operators import margins as MG
from vektral.operators import trees as TR
from vektral.operators.neighbours import neighbour_graph

SCHEMA = "sample_id long, cls int, feat array<double>"


def frame(spark, x, y, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), int(c), v.tolist()) for i, v, c in zip(ids, x, y)], SCHEMA).repartition(3)


def box_dual(gram, linear, cap, e, m, steps=60):
    """max linear'a - 1/2 a'(gram)a, 0 <= a <= cap, e'a = m, by primal-dual interior points; returns its value."""
    n = len(linear)
    a = np.minimum(cap / 2, cap)
    a, z, w, b = a, np.ones(n), np.ones(n), 0.0
    for _ in range(steps):
        if a @ z + (cap - a) @ w < 1e-11:
            break
        mu = 0.1 * (a @ z + (cap - a) @ w) / (2 * n)
        grad = gram @ a - linear + e * b - z + w
        left = gram + np.diag(z / a + w / (cap - a))
        right = -(grad + z - mu / a - w + mu / (cap - a))
        k = np.block([[left, e[:, None]], [e[None], np.zeros((1, 1))]])
        step = np.linalg.solve(k, np.append(right, m - e @ a))
        da, db = step[:n], step[n]
        dz, dw = mu / a - z - z / a * da, mu / (cap - a) - w + w / (cap - a) * da
        t = 1.0
        for v, d in ((a, da), (cap - a, -da), (z, dz), (w, dw)):
            neg = d < 0
            if neg.any():
                t = min(t, 0.95 * (-v[neg] / d[neg]).min())
        a, z, w, b = a + t * da, z + t * dz, w + t * dw, b + t * db
    return linear @ a - a @ gram @ a / 2


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(2)
    y = np.repeat([1, 2, 5], 50)
    centres = {1: [2, 0, 0, 0], 2: [0, 2, 0, 0], 5: [0, 0, 2, 1]}
    return np.array([rng.normal(centres[c], 1.0) for c in y]), y


@pytest.mark.parametrize(("rows", "tolerance"), [(1000, 1e-4), (80, 2e-3)])
def test_machines_reach_the_optimum(spark, groups, rows, tolerance):
    x, y = groups
    fit = MG.consensus_margins(frame(spark, x, y), "machine", c=0.5, block_rows=rows, tolerance=tolerance, epochs=100)
    assert fit.classes.tolist() == [1, 2, 5]
    for k, c in enumerate(fit.classes):
        s = np.where(y == c, 1.0, -1.0)
        z = x * s[:, None]
        best = box_dual(z @ z.T, np.ones(len(x)), np.full(len(x), 0.5), s, 0.0)
        w, b = fit.weights[k], fit.multiplier[k]
        value = w @ w / 2 + 0.5 * np.maximum(0, 1 - s * (x @ w + b)).sum()
        assert abs(value - fit.primal[k]) < 1e-8 * best and -1e-9 <= (value - best) / best < (tolerance if rows == 1000 else 2 * tolerance)  # two blocks are still on their way after 60 rounds


@pytest.mark.parametrize(("rows", "tolerance"), [(1000, 1e-4), (80, 2e-3)])
def test_spheres_reach_the_optimum(spark, groups, rows, tolerance):
    x, y = groups
    fit = MG.consensus_margins(frame(spark, x, y), "sphere", outside=0.2, block_rows=rows, tolerance=tolerance, epochs=100)
    centre, radius = MG.spheres(fit)
    for k, c in enumerate(fit.classes):
        own = x[y == c]
        cap = 1 / (0.2 * len(own))
        best = box_dual(2 * own @ own.T, (own**2).sum(1), np.full(len(own), cap), np.ones(len(own)), 1.0)
        value = radius[k] + cap * np.maximum(0, ((own - centre[k]) ** 2).sum(1) - radius[k]).sum()
        assert abs(value - best) / best < (tolerance if rows == 1000 else 2 * tolerance)  # two blocks are still on their way after 60 rounds
    members = MG.sphere_members(frame(spark, x, y), fit).toPandas()
    assert len(members) == len(x) and 0.1 < (members.d2 > members.r2).mean() < 0.25


def test_machines_tell_classes_apart_and_skip_odd_rows(spark, groups):
    x, y = groups
    odd = spark.createDataFrame([(900, 1, None), (901, 1, []), (902, 2, [1.0, None, 2.0, 3.0]), (903, 2, [1.0, float("nan"), 2.0, 3.0]), (904, None, [1.0, 1.0, 1.0, 1.0])], SCHEMA)
    ds = frame(spark, 3 * x, y)
    a, b = (MG.consensus_margins(t, "machine", tolerance=0.01, most_rounds=6) for t in (ds, ds.unionByName(odd).withColumn("block", F.lit("clash"))))
    assert np.array_equal(a.weights, b.weights)
    for recognise in (MG.machine_recognition, MG.sphere_recognition):
        got = recognise(ds, ds, tolerance=0.01, most_rounds=6).toPandas()
        assert (got.cls == got.predicted).mean() > 0.85, recognise
    assert MG.consensus_margins(ds.limit(0)).rounds == 0
    with pytest.raises(ValueError):
        MG.consensus_margins(ds.unionByName(spark.createDataFrame([(1, 1, [1.0])], SCHEMA)))


def kruskal(edges):
    up, out = {}, []

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a is not None and b is not None and w is not None and a != b):
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.append((a, b, w))
    return sorted(out)


def test_spanning_forest(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 80, 300), rng.integers(0, 80, 300), rng.integers(0, 12, 300))]
    edges += [(100, 101, 1.0), (101, 102, 1.0), (100, 102, 1.0), (7, 7, 0.0), (None, 3, 1.0), (4, 5, None)]
    edges += [(200, 200 + k, 2.0) for k in range(1, 60)]  # a hub
    edges += [(300 + k, 301 + k, float(k % 5)) for k in range(70)]  # a chain
    df = spark.createDataFrame(edges, "src long, dst long, d2 double").repartition(4)
    assert sorted(tuple(r) for r in TR.spanning_forest(df).collect()) == kruskal(edges)
    assert TR.spanning_forest(df.limit(0)).count() == 0
    assert TR.spanning_forest(df.filter("src = dst")).count() == 0


def test_spanning_dimension(spark):
    rng = np.random.default_rng(6)
    plane = rng.random((600, 2)) @ rng.normal(size=(2, 5))
    ds = frame(spark, plane, np.ones(600))
    lengths = sorted(tuple(r) for r in TR.spanning_lengths(ds, 6, 2).collect())
    n, length = lengths[-1]
    edges = [tuple(r) for r in neighbour_graph(ds, 6).select("src", "dst", "d2").collect()]
    assert n == 600 and len(lengths) == 3 and abs(length - sum(np.sqrt(w) for *_, w in kruskal(edges))) < 1e-9
    found = TR.spanning_dimension(ds).first().dimension
    assert 1.6 < found < 2.5
    assert TR.spanning_dimension(ds.limit(0)).first().dimension is None


def walk(spark, x, radius):
    ids = [r[0] for r in spark.range(len(x)).orderBy(TR.hash_order(F.col("id")), "id").collect()]
    picked = []
    for i in ids:
        if all(((x[i] - x[j]) ** 2).sum() >= radius**2 for j in picked):
            picked.append(i)
    return sorted(picked)


@pytest.mark.parametrize(("radius", "size"), [(0.2, 4096), (0.5, 50), (0.05, 64), (5.0, 4096)])
def test_packing_is_the_walk(spark, radius, size):
    rng = np.random.default_rng(7)
    x = np.round(rng.random((300, 2)), 2)  # many at exactly the radius
    x[100:140] = x[99]
    got = sorted(r[0] for r in TR.packing(frame(spark, x, np.ones(300)), radius, size).collect())
    assert got == walk(spark, x, radius)


def test_packing_edges(spark):
    odd = spark.createDataFrame([(1, 1, None), (2, 1, []), (3, 1, [float("nan")]), (4, 1, [1.0]), (5, 1, [1.0, 2.0]), (6, 1, [1.05])], SCHEMA)
    got = {r[0] for r in TR.packing(odd, 0.5).collect()}
    assert 5 in got and len(got & {4, 6}) == 1 and len(got) == 2
    assert TR.packing(odd.limit(0), 1.0).count() == 0
    rng = np.random.default_rng(1)
    square = frame(spark, rng.random((1500, 2)), np.ones(1500))
    assert 1.4 < TR.packing_dimension(square, 0.1, 0.3).first().dimension < 2.5


def test_within_is_exact_at_the_radius():
    x = np.array([[0.1, 0.2, 0.3]])
    y = x + np.array([[0.3, 0.0, 0.0], [0.0, 0.4, 0.0]])
    for k in range(2):
        d2 = ((x[0] - y[k]) ** 2).sum()
        assert not B.within(x, y, d2)[0, k] and B.within(x, y, np.nextafter(d2, 1))[0, k]


def margin_loss(x, y, targets, m, push=0.5):
    d = lambda i, j: (x[i] - x[j]) @ m @ (x[i] - x[j])
    pull = sum(d(i, j) for i, j in targets)
    hinges = sum(max(0, 1 + d(i, j) - d(i, k)) for i, j in targets for k in range(len(x)) if y[k] != y[i])
    return (1 - push) * pull + push * hinges


@pytest.mark.parametrize("size", [4096, 25])
def test_large_margins(spark, size):
    rng = np.random.default_rng(9)
    y = np.repeat([1, 2, 3], [40, 30, 2])
    x = np.column_stack([y * 1.0 + rng.normal(0, 0.3, len(y)), rng.normal(0, 3, (len(y), 2))])
    ds = frame(spark, x, y)
    got = sorted((r.sample_id, r["rank"], r.target_id) for r in LM.target_neighbours(ds, 3, size).collect())
    want = []
    for i in range(len(x)):
        others = sorted((((x[i] - x[j]) ** 2).sum(), j) for j in range(len(x)) if j != i and y[j] == y[i])[:3]
        want += [(i, k, j) for k, (_, j) in enumerate(others, 1)]
    assert got == sorted(want)
    fit = LM.large_margin_metric(ds, 3, steps=12, size=size)
    targets = [(i, j) for i, _, j in want]
    assert abs(fit.losses[0] - margin_loss(x, y, targets, np.eye(3))) < 1e-6 * fit.losses[0]
    m = fit.transform @ fit.transform.T
    assert abs(fit.losses[-1] - margin_loss(x, y, targets, m)) < 1e-6 * fit.losses[0]
    assert all(b < a for a, b in itertools.pairwise(fit.losses)) and fit.losses[-1] < 0.5 * fit.losses[0]
    assert m[0, 0] > 3 * m[1, 1]  # the component that tells the classes apart weighs most
    assert LM.large_margin_metric(ds.limit(0)).losses == []


def test_blocked_passes_meet_every_pair_once(spark):
    x = np.arange(200.0).reshape(100, 2)
    ds = frame(spark, x, np.ones(100))
    left, right = B.Blocks(ds, size=7), B.Blocks(ds.filter("sample_id < 30"), size=4)
    import pyarrow as pa

    def meet(known, one, other):
        return known + len(other[0])

    def finish(known, block):
        return pa.RecordBatch.from_arrays([pa.array(block[0]), pa.array(np.full(len(block[0]), known))], names=["sample_id", "n"])

    got = B.over_pairs(left, right, lambda block: 0, meet, finish, "sample_id long, n long", chunk=3).groupBy("sample_id").agg(F.sum("n").alias("n")).collect()
    assert len(got) == 100 and {r.n for r in got} == {30}
    left.forget()
    right.forget()


def test_neighbour_search_shuffles_each_vector_once(spark):
    """Blocks are files that tasks read: what a search shuffles doesn't grow with the number of pairs of blocks."""
    from pyspark.sql import functions as F

    from vektral.operators.neighbours import nearest

    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 7)), 2, axis=0)  # copies: ties go to the smaller id
    ds = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, feat array<double>")
    found = nearest(ds, ds, 3, block=10, skip_self=True)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    got = {(r["probe_id"], r["rank"]): r["gallery_id"] for r in found.collect()}
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    expected = np.stack([np.lexsort((np.arange(120), r))[:3] for r in d])
    assert got == {(i, k + 1): expected[i, k] for i in range(120) for k in range(3)}
    far = nearest(ds.filter(F.col("sample_id") < 3), ds, 200, block=10)
    assert far.count() == 3 * 120
