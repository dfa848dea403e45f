"""Every registered query against its SQL; learners against plain numpy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from vektral.operators import learning as L
from vektral.plans.registry import ORACLES, QUERIES
from vektral.sources import tables as T


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_queries_see_every_row(spark):
    s = T.samples(spark, SMALL)
    ids = {r["sample_id"] for r in s.select("sample_id").collect()}
    for name, column in {"neighbour_graph": "src", "heat_affinity": "src", "supervised_affinity": "sample_id", "connected_parts": "node", "distance_metrics": "a_id", "kernels": "a_id", "class_features_normalized": "sample_id"}.items():
        assert {r[0] for r in QUERIES[name](spark, SMALL).select(column).collect()} == ids, name
    first = {r["sample_id"] for r in s.filter("col_idx = 1").collect()}
    assert first == {r["node"] for r in QUERIES["hops"](spark, SMALL).filter("hops = 0").collect()}
    assert QUERIES["varying_features"](spark, SMALL).count() == 64
    # gallery and probes are the whole table
    n = dict(s.groupBy("cls").count().collect())
    probes = {c: sum(3 * k > 2 * m for k in range(1, m + 1)) for c, m in n.items()}
    assert Counter(r["cls"] for r in QUERIES["recognition"](spark, SMALL).collect()) == probes


@pytest.mark.parametrize("name", ["kernel_pca", "classical_scaling", "kernel_discriminants", "t_stochastic_neighbours", "symmetric_stochastic_neighbours"])
def test_embeddings_hold_every_sample(name, spark):
    got = QUERIES[name](spark, SMALL).select("sample_id").collect()
    assert sorted(r[0] for r in got) == sorted(r["sample_id"] for r in T.samples(spark, SMALL).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def _matrix(spark):
    rows = T.samples(spark, SMALL).orderBy("sample_id").collect()
    return np.array([r["feat"] for r in rows]), np.array([r["cls"] for r in rows])


def test_pca_is_the_svd(spark):
    x, _ = _matrix(spark)
    w, values, mean = L.pca(T.samples(spark, SMALL), 5)
    expected = np.linalg.svd(x - x.mean(0), compute_uv=False)[:5] ** 2
    assert np.allclose(values, expected) and np.allclose(mean, x.mean(0))
    y = np.array([r["feat"] for r in L.project(T.samples(spark, SMALL), w, mean).orderBy("sample_id").collect()])
    assert np.allclose(y, (x - mean) @ w)


def test_kmeans_is_a_fixed_point(spark):
    x, _ = _matrix(spark)
    centres, labels = L.kmeans(T.samples(spark, SMALL), 4)
    got = np.array([r["cluster"] for r in labels.orderBy("sample_id").collect()])
    d = ((x[:, None] - centres) ** 2).sum(2)
    assert (d.argmin(1) + 1 == got).mean() > 0.99


def test_sparse_solvers():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 60))
    a /= np.linalg.norm(a, axis=0)
    x = np.zeros(60)
    x[[3, 40]] = 2, -1
    assert np.flatnonzero(np.abs(L.matching_pursuit(a, a @ x, 2)) > 1e-6).tolist() == [3, 40]
    z = L.lasso(a, (a @ x)[:, None], 0.01)[:, 0]
    assert set(np.argsort(-np.abs(z))[:2]) == {3, 40}


def test_dataset_folder(spark, tmp_path):
    s = T.samples(spark, SMALL)
    T.save_dataset(s, str(tmp_path / "d"))
    assert T.load_dataset(spark, str(tmp_path / "d")).count() == s.count()
    assert not T.is_uniform(s)


def test_image_folder(spark, tmp_path):
    for cls in ("a10", "a2"):
        (tmp_path / cls).mkdir()
        for i in (10, 9):
            (tmp_path / cls / f"{i}.jpg").write_bytes(b"x")
    got = {(r["folder"], r["path"].rsplit("/", 1)[1]): (r["cls"], r["col_idx"]) for r in T.image_folder(spark, str(tmp_path)).collect()}
    assert got == {("a2", "9.jpg"): (1, 1), ("a2", "10.jpg"): (1, 2), ("a10", "9.jpg"): (2, 1), ("a10", "10.jpg"): (2, 2)}


def test_stages_fit_on_training_rows(spark):
    from pyspark.sql import functions as F

    from vektral.streaming.stages import Pipeline, Scaler

    s = T.samples(spark, SMALL).withColumn("split", F.when(F.col("col_idx") <= 20, "TR").otherwise("TE"))
    out = Pipeline(Scaler("zscore"), Scaler("minmax")).fit(s).transform(s)
    x = np.array([r["feat"] for r in out.filter("split = 'TR'").collect()])
    assert np.allclose(x.min(0), 0) and np.allclose(x.max(0), 1)


def test_stream_windows(spark, tmp_path):
    from vektral.streaming.stages import stream_windows

    spark.range(40).selectExpr("id as event_id", "id % 2 as user_id", "cast(id as double) as value").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("event_id long, user_id long, value double").parquet(str(tmp_path / "in"))
    q = stream_windows(events, "user_id", "value", 5, 3).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("w").collect())
    assert got[0] == (0, 1, 5, 20.0) and len(got) == 12


def test_high_pass_filter(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(4)], "k string, i int, v double")
    got = [r["v"] for r in T.high_pass_series(df, "k", "i", "v", [1.0, -1.0], [1.0, -0.5]).orderBy("i").collect()]
    assert np.allclose(got, [1.0, 0.5, 0.25, 0.125])


def test_robust_components_ignore_outliers(spark):
    from vektral.operators import discriminants as R

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) * [5, 1, 0.1, 0.1, 0.1]
    x[:5] = [20, 0, 0, 0, 30]  # tilt the plain component
    ds = spark.createDataFrame([(i, 1 + i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, cls int, feat array<double>")
    plain = L.pca(ds, 1)[0][:, 0]
    robust = R.correntropy_pca(ds, 1)[0][:, 0]
    assert abs(robust[0]) > 0.99 > abs(plain[0])


def test_discriminants_separate(spark):
    from vektral.operators import discriminants as R
    from vektral.operators import manifolds as M

    rng = np.random.default_rng(1)
    y = np.repeat([1, 2, 3], 40)
    x = rng.normal(size=(120, 6)) * [0.3, 0.3, 3, 3, 3, 3]
    x[:, 0] += 3 * (y == 2)
    x[:, 1] += 3 * (y == 3)
    ds = spark.createDataFrame([(i, int(k), [float(v) for v in r]) for i, (k, r) in enumerate(zip(y, x))], "sample_id long, cls int, feat array<double>")

    def separation(w):
        z = x @ w
        means = np.array([z[y == k].mean(0) for k in (1, 2, 3)])
        return (((z[:, None] - means) ** 2).sum(2).argmin(1) + 1 == y).mean()

    assert separation(L.lda(ds)) > 0.97
    assert separation(R.fisher(ds)[0]) > 0.97
    assert separation(R.direct_lda(ds, most_within=1e9)) > 0.9
    assert separation(R.robust_lda(ds, dims=2, alpha=0.1)) > 0.9
    assert separation(M.neighbourhood_components(ds, 2, 60)[0]) > 0.9


def test_whitening_and_reconstruction(spark):
    from vektral.operators import discriminants as R

    s = T.samples(spark, SMALL)
    w, mean = R.whitening(s)
    x, _ = _matrix(spark)
    z = (x - mean) @ w
    assert np.allclose(z.T @ z, np.eye(z.shape[1]), atol=1e-4)
    got = R.masked_reconstruction(s.select("sample_id", "cls", "feat"), list(range(64)), 64)
    back = np.array([r["feat"] for r in got.orderBy("sample_id").collect()])
    assert np.allclose(back, x, atol=1e-6)


def test_partial_least_squares_is_nipals(spark):
    from vektral.operators import discriminants as R

    x, y = _matrix(spark)
    w, mean = R.partial_least_squares(T.samples(spark, SMALL), 3)
    z, hot = x - x.mean(0), (y[:, None] == np.unique(y)).astype(float)
    hot -= hot.mean(0)
    scores = []
    for _ in range(3):
        v = np.linalg.svd(z.T @ hot, full_matrices=False)[0][:, 0]
        t = z @ v
        scores.append(t)
        z = z - np.outer(t, z.T @ t) / (t @ t)
        hot = hot - np.outer(t, hot.T @ t) / (t @ t)
    got = (x - mean) @ w
    for k in range(3):
        assert abs(np.corrcoef(got[:, k], scores[k])[0, 1]) > 0.999


def test_sparse_solvers_agree():
    from vektral.operators import classifiers as C

    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 60))
    a /= np.linalg.norm(a, axis=0)
    x = np.zeros(60)
    x[[3, 40, 7]] = 2, -1, 0.5
    b = (a @ x)[:, None]
    assert np.allclose(C.basis_pursuit(a, b)[:, 0], x, atol=1e-4)
    assert np.allclose(C.shrinkage(a, b, 0.01, 20000), L.lasso(a, b, 0.01, steps=20000), atol=0.05)
    assert np.allclose(C.nonnegative_least_squares(a[:, :20], a[:, :20] @ np.arange(20.0)[:, None], 20000)[:, 0], np.arange(20.0), atol=1e-3)


def test_dictionaries_rebuild(spark):
    from vektral.operators import classifiers as C

    rng = np.random.default_rng(2)
    atoms = rng.normal(size=(4, 12))
    x = np.stack([atoms[i % 4] * (1 + i % 3) for i in range(60)])
    ds = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, feat array<double>")
    for kind in ("ksvd", "mod"):
        d, codes = C.learned_dictionary(ds, 8, 1, 10, kind)
        z = np.array([r["feat"] for r in codes.orderBy("sample_id").collect()])
        assert np.linalg.norm(z @ d.T - x) / np.linalg.norm(x) < 0.2, kind


def test_nonnegative_factors_rebuild(spark):
    from vektral.operators import classifiers as C

    rng = np.random.default_rng(3)
    x = rng.random((80, 3)) @ rng.random((3, 10))
    ds = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, feat array<double>")
    h, codes = C.nonnegative_factors(ds, 3, 40)
    z = np.array([r["feat"] for r in codes.orderBy("sample_id").collect()])
    assert np.linalg.norm(z @ h - x) / np.linalg.norm(x) < 0.05


def test_learning_curve():
    from vektral.operators import classifiers as C

    n = np.array([10, 20, 40, 80, 160, 320])
    a, b, alpha = C.learning_curve(n, 0.1 + 2 * n**-0.7)
    assert abs(a - 0.1) < 0.01 and abs(b - 2) < 0.1 and abs(alpha - 0.7) < 0.03


def test_embeddings_keep_neighbours(spark):
    from vektral.operators import manifolds as M

    ds = L.manifold(spark, "twinpeaks", 400)
    x = np.array([r["feat"] for r in ds.orderBy("sample_id").collect()])
    near = M.neighbours(M.squared_distances(x), 8)
    for f in (M.tangent_alignment, M.hessian_embedding, M.landmark_isomap, M.sammon, M.stochastic_neighbours):
        y = np.array([r["feat"] for r in f(ds).orderBy("sample_id").collect()])
        assert y.shape == (400, 2) and np.isfinite(y).all()
        kept = np.mean([len(set(a) & set(b)) / 8 for a, b in zip(near, M.neighbours(M.squared_distances(y), 8))])
        assert kept > 0.3, (f.__name__, kept)


def test_image_resize_and_filters(spark):
    from vektral.operators import images as I

    w = np.array(I.resize_weights(8, 4))
    assert np.allclose(w.sum(1), 1) and np.allclose(np.array(I.resize_weights(5, 5)), np.eye(5))
    ds = spark.createDataFrame([(1, [3.0] * 64)], "sample_id long, feat array<double>")
    assert np.allclose(I.resized(ds, 8, 8, 1, 4, 4).first()["feat"], [3.0] * 16)
    assert np.allclose(I.frequency_filtered(ds, 8, 8, 0.2, 2, "high").first()["feat"], 0)
    assert np.allclose(I.frequency_filtered(ds, 8, 8, 0.2, 2, "low").first()["feat"], 3)


def test_noise_is_normal_and_repeatable(spark):
    from pyspark.sql import functions as F

    from vektral.operators import statistics as S

    r = spark.range(20000).select(S.gaussian_noise(F.col("id"), seed=4).alias("x"))
    row = r.agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(row["m"]) < 0.03 and abs(row["s"] - 1) < 0.03
    assert r.exceptAll(r).count() == 0


def test_parts_of_a_long_path_and_a_hub(spark):
    from vektral.operators import graphs as G

    path = [(i, i + 1) for i in range(1, 60)]
    hub = [(100, k) for k in range(101, 400)]
    edges = spark.createDataFrame([*path, *hub, (7, 7), (500, 500), (None, 3)], "src long, dst long")
    got = {r["node"]: r["part"] for r in G.connected_parts(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[k] == 100 for k in range(100, 400)) and got[500] == 500


def test_high_pass_design():
    sections = T.high_pass_sections(50, 0.4, 0.8)
    gain = lambda hz: np.prod([abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) for b, a in sections for z in [np.exp(-2j * np.pi * hz / 50)]])
    db = lambda hz: 20 * np.log10(gain(hz))
    assert max(db(f) for f in np.linspace(0.01, 0.4, 50)) <= -59.99
    assert -1.01 <= min(db(f) for f in np.linspace(0.8, 24.9, 200)) and max(db(f) for f in np.linspace(0.8, 24.9, 200)) < 0.01
    assert all(max(abs(np.roots(a))) < 1 for _, a in sections)


def test_image_denoising(spark):
    from vektral.operators import images as I

    rng = np.random.default_rng(5)
    clean = np.zeros((16, 16))
    clean[:, 8:] = 1
    noisy = clean + rng.normal(0, 0.15, clean.shape)
    ds = spark.createDataFrame([(1, [float(v) for v in noisy.T.ravel()])], "sample_id long, feat array<double>")
    for out in (I.total_variation(ds, 16, 16, 0.2, 300), I.nonlocal_means(ds, 16, 16, 3, 1, 0.3)):
        got = np.array(out.first()["feat"]).reshape(16, 16).T
        assert ((got - clean) ** 2).mean() < 0.6 * ((noisy - clean) ** 2).mean()


def test_brightness_keeps_hue(spark):
    from vektral.operators import images as I

    x = np.random.default_rng(6).integers(1, 256, (3, 16)).astype(float)
    ds = spark.createDataFrame([(1, x.ravel().tolist())], "sample_id long, feat array<double>")
    got = np.array(I.brightness_equalized(ds, 4, 4).first()["feat"]).reshape(3, 16)
    assert np.allclose(got / got.max(0), x / x.max(0)) and got.max() == 255


def test_autoencoder_rebuilds(spark):
    from vektral.operators import classifiers as C

    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6))
    ds = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, feat array<double>")
    encode, decode = C.autoencoder(ds, 4, 800)
    assert ((decode(encode(x)) - x) ** 2).sum() < 0.1 * ((x - x.mean(0)) ** 2).sum()


def test_ordinals_of_many_wide_rows(spark):
    """More rows than one partition holds, once merged and once not: every row, each number once, in order."""
    from vektral.operators.dataset import with_ordinal

    n = 300_000
    wide = spark.range(n, numPartitions=8).select(((F.col("id") * 7919) % n).alias("k"), F.array(*[F.lit(float(j)) for j in range(40)]).alias("feat"))
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            got = with_ordinal(wide, ["k"]).agg(F.count("*"), F.countDistinct("k"), F.sum((F.col("ordinal") == F.col("k") + 1).cast("long"))).first()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert tuple(got) == (n, n, n)


def test_nearest_of_copies_and_odd_rows(spark):
    """Copies in the order of their ids, whatever the block; vectors that hold no numbers take no part."""
    from vektral.operators.neighbours import nearest

    x = [0.1 * j for j in range(7)]
    gallery = [(i, x) for i in range(40)] + [(100 + i, [v + 1e-3 * (i + 1) for v in x]) for i in range(30)] + [(200, None), (201, [float("nan")] * 7), (202, [1.0])]
    ds = spark.createDataFrame(gallery, "sample_id long, feat array<double>")
    for block in (4096, 9):
        got = nearest(ds.filter("sample_id in (0, 25, 201, 202)"), ds, 3, block=block, skip_self=True).orderBy("probe_id", "rank").collect()
        assert [(r["probe_id"], r["gallery_id"]) for r in got] == [(0, 1), (0, 2), (0, 3), (25, 0), (25, 1), (25, 2)]


def test_places_of_a_class_in_many_runs(spark, monkeypatch):
    from vektral.sources import tables

    monkeypatch.setattr(tables, "RUN", 4)
    rows = spark.range(50).select((F.col("id") * 3 % 50).alias("i"), (F.col("id") % 2).alias("c"), F.array(F.lit(0.5)).alias("v"))
    got = tables.labelled(rows, "i", F.col("c"), "v").orderBy("cls", "col_idx").collect()
    for c in (0, 1):
        mine = [(r["sample_id"], r["col_idx"]) for r in got if r["cls"] == c]
        assert [x[0] for x in mine] == sorted(x[0] for x in mine) and [x[1] for x in mine] == list(range(1, len(mine) + 1))


def test_noise_by_place(spark):
    """The second and third training images get blocks of their own size, the first none."""
    from vektral.plans.registry import _bytes

    before = {r["sample_id"]: r["feat"] for r in _bytes(spark, SMALL).collect()}
    for r in QUERIES["slice_noisy"](spark, SMALL).collect():
        side = {1: 0, 2: 4, 4: 1}[r["col_idx"]]
        changed = [k for k in range(64) if r["feat"][k] != before[r["sample_id"]][k]]
        rows, columns = [k % 8 for k in changed], [k // 8 for k in changed]
        assert len(changed) <= side * side and all(r["feat"][k] in (0.0, 255.0) for k in changed)
        assert not changed or (max(rows) - min(rows) < side and max(columns) - min(columns) < side)


def test_batches_are_in_step(spark):
    from vektral.operators.preparing import BatchIterator

    inputs = spark.range(25).select(F.col("id").alias("sample_id"), F.array(F.col("id").cast("double")).alias("feat"))
    targets = inputs.withColumn("feat", F.transform("feat", lambda x: -x))
    it = BatchIterator(inputs, targets, 10, seed=3)
    first = []
    while not it.is_end():
        first.append(it.next())
    assert [len(b) for b in first] == [10, 10, 5] and it.next() == []
    rows = [r for b in first for r in b]
    assert sorted(r["sample_id"] for r in rows) == list(range(25)) and all(r["target"] == [-r["feat"][0]] for r in rows)
    again = BatchIterator(inputs, None, 4).sync(BatchIterator(inputs, targets, 10, seed=3))
    assert [r["sample_id"] for r in again.next()] == [r["sample_id"] for r in first[0]]
    second = it.next()  # the next epoch has another order
    assert [r["sample_id"] for r in second] != [r["sample_id"] for r in first[0]]
    assert [r["sample_id"] for r in it.clone().set_shuffle(None).set_batch_size(3).next()] == [0, 1, 2]


def test_image_files_come_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (6, 2 * 3 * 5)).astype(float)
    ds = spark.createDataFrame([(k, k % 2 + 9, k // 2 + 1, [float(v) for v in r]) for k, r in enumerate(x)], "sample_id long, cls int, col_idx int, feat array<double>")
    one = x.reshape(6, 30)
    assert T.save_images(ds, f"file://{tmp_path}/grey", 5, 6).count() == 6
    got = T.image_samples(spark, f"file://{tmp_path}/grey", grey=True).collect()
    assert {(r["cls"], r["col_idx"]): r["feat"] for r in got} == {(k % 2 + 1, k // 2 + 1): list(one[k]) for k in range(6)}
    rgb = ds.withColumn("feat", F.slice("feat", 1, 30))
    T.save_images(rgb, f"file://{tmp_path}/rgb", 2, 5, 3).collect()
    got = T.image_samples(spark, f"file://{tmp_path}/rgb").collect()
    assert {(r["cls"], r["col_idx"]): (r["h"], r["w"], r["ch"], r["feat"]) for r in got} == {(k % 2 + 1, k // 2 + 1): (2, 5, 3, list(one[k])) for k in range(6)}
    own = T.image_samples(spark, f"file://{tmp_path}/rgb", read=lambda data: (1, 1, 1, [float(len(data))])).collect()
    assert {r["feat"][0] for r in own} == {54.0 + 2 * 16}


def test_sinks_by_split_and_case(spark, tmp_path):
    from vektral.operators.dataset import damage_grid

    windows = spark.createDataFrame([("TR", 1, 1, 2.0), ("VAL", 2, 5, 3.0)], "split string, cls int, st int, total double")
    T.save_windows(windows, str(tmp_path / "w"), 4, 2)
    assert sorted(r["path"] for r in spark.read.parquet(str(tmp_path / "w")).collect()) == ["tr/1/1_4_2_1", "val/2/2_4_2_5"]
    T.save_cases(damage_grid(spark, [[1], [1, 2]], [0.9, 0.8], 3), str(tmp_path / "c"))
    assert {r["case_id"]: r["count"] for r in spark.read.parquet(str(tmp_path / "c")).groupBy("case_id").count().collect()} == {0: 1, 1: 2, 2: 4}
    for k in range(2):
        spark.range(40).select(F.lit(k).alias("key"), F.col("id").alias("at"), F.sin(F.col("id") * 2.5).alias("v")).write.parquet(str(tmp_path / f"s{k}"))
    sections = T.high_pass_sections(10.0, 0.2, 1.0)
    got = T.combined_files(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")], "key", "at", "v", sections).collect()
    assert len(got) == 80 and len({round(r["v"], 9) for r in got if r["at"] == 30}) == 1


def test_stream_windows_with_long_steps(spark, tmp_path):
    from vektral.streaming.stages import run_stream, stream_windows

    spark.range(57).select(F.col("id").alias("event_id"), F.lit("a").alias("k"), F.col("id").cast("double").alias("v")).repartition(5).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("event_id long, k string, v double").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    got = run_stream(stream_windows(events, "k", "v", 4, 10), str(tmp_path / "out")).collect()
    assert sorted((r["st"], r["en"], r["total"]) for r in got) == [(s, s + 3, float(sum(range(s - 1, s + 3)))) for s in (1, 11, 21, 31, 41, 51)]


def test_layers_come_apart(spark):
    """Sums of a gallery's sample and a few bright pixels: the pixels are found, and the class behind them."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 40))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    gallery = spark.createDataFrame([(k, k // 3, [float(v) for v in x]) for k, x in enumerate(base)], "sample_id long, cls int, feat array<double>")
    probes, spots = [], {}
    for k in range(12):
        spots[100 + k] = sorted(rng.choice(40, 3, replace=False).tolist())
        x = base[k].copy()
        x[spots[100 + k]] += 3.0
        probes.append((100 + k, k // 3, [float(v) for v in x]))
    probes = spark.createDataFrame(probes, "sample_id long, cls int, feat array<double>")
    parts = L.layered_codes(probes, [base.T, np.eye(40)], [0.01, 0.05]).filter("layer = 2").collect()
    assert {r["sample_id"]: sorted(np.argsort(r["part"])[-3:].tolist()) for r in parts} == spots
    got = L.layered_recognition(probes, gallery, np.eye(40)).collect()
    assert len(got) == 12 and all(r["predicted"] == r["cls"] for r in got)


def test_rounded_vectors_keep_the_sign_of_zero(spark, duck):
    from vektral.plans.registry import flat

    values = [-1e-9, 1e-9, -0.0, 0.0, -0.25, 0.1234565]
    got = flat(spark.createDataFrame([(1, values)], "sample_id long, feat array<double>")).first()["feat"]
    expected = [duck.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values]
    assert [(v, np.signbit(v)) for v in got] == [(v, np.signbit(v)) for v in expected]


def test_ranks_and_scaling_of_any_size(spark):
    """Quantiles and shuffled predictions sort no key in one task, class widths aren't dealt by class, nothing but
    small tables is broadcast, and scaling takes more rows than a driver's matrix may have."""
    from pyspark.sql import functions as F

    from vektral.operators import statistics as S

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = spark.range(400).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    q = S.quantiles(df, "g", "x", [0.25, 0.5])
    assert "g#" not in "".join(line for line in plan(q).splitlines() if "Window" in line)
    for r in q.collect():
        x = sorted((i * 37) % 101 for i in range(400) if i % 3 == r["g"])
        assert abs(r["x"] - np.interp(r["share"] * len(x) + 0.5, range(1, len(x) + 1), x)) < 1e-9
    p = S.permutation_accuracy(df, "id", "g", "y", 3)
    assert "replicate" not in "".join(line for line in plan(p).splitlines() if "Window" in line) and "strategy=merge" in plan(p)
    truth, predicted, got = [i % 3 for i in range(400)], [i % 2 for i in range(400)], dict(p.collect())
    order = lambda k: [r[0] for r in df.orderBy(F.xxhash64("id", F.lit(k), F.lit(1)), "id").select("y").collect()]
    for k in range(4):
        assert abs(got[k] - np.mean([a == b for a, b in zip(truth, order(k) if k else predicted)])) < 1e-12
    assert plan(S.class_widths(df, "g", "x")).count("strategy=broadcast") >= 2
    wide = spark.range(6000).select(F.col("id").alias("sample_id"), F.array(*[F.sin(F.col("id") * (k + 1.5)) * (k + 1) for k in range(3)]).alias("feat"))
    rows = L.classical_scaling(wide).orderBy("sample_id").collect()
    y, x = np.array([r["feat"] for r in rows]), np.array([r["feat"] for r in wide.orderBy("sample_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert len(rows) == 6000 and np.allclose(np.abs(y), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_galleries_of_any_size(spark):
    """Galleries beyond what the driver may collect: as the same codes over the whole matrix decide."""
    from pyspark.sql import functions as F

    from vektral.operators import classifiers as C

    def sectors(n):
        turn = (F.col("id") % 3) * 2.0 + F.col("id") / n * 0.5
        return spark.range(n).select(F.col("id").alias("sample_id"), (F.col("id") % 3 + 1).cast("int").alias("cls"), F.array(F.cos(turn), F.sin(turn), F.lit(0.01)).alias("feat"))

    def expected(n, code, unit):
        rows = sectors(n).orderBy("cls", "sample_id").collect()
        x, c = np.array([r["feat"] for r in rows]), np.array([r["cls"] for r in rows])
        y = np.array([r["feat"] for r in sectors(3).orderBy("sample_id").collect()])
        x, y = (v / np.linalg.norm(v, axis=1)[:, None] if unit else v for v in (x, y))
        out = []
        for v in y:
            z, part = code(x.T, v[:, None])
            out.append(min((((v[:, None] - part - x.T[:, c == k] @ z[c == k]) ** 2).sum(), k) for k in (1, 2, 3))[1])
        return out

    def layers(a, b):
        codes, parts = L._layers(b, [a, np.eye(3)[:, 2:]], [0.01, 0.05])
        return codes[0], parts[1]

    for got, want in (
        (lambda p: C.nonnegative_recognition(sectors(50_010), p), expected(50_010, lambda a, b: (C.nonnegative_least_squares(a, b), 0), False)),
        (lambda p: L.sparse_recognition(p, sectors(50_010)), expected(50_010, lambda a, b: (L.lasso(a, b, 0.01), 0), True)),
        (lambda p: L.layered_recognition(p, sectors(5_010), np.eye(3)[:, 2:]), expected(5_010, layers, False)),
    ):
        found = [got(sectors(3).filter(F.col("sample_id") == i)).first()["predicted"] for i in range(3)]
        assert found == want


def test_halves_are_rounded_as_in_sql(spark):
    """Values whose shortest decimals are under a half, but whose product with 10000 is one."""
    import duckdb

    from vektral.operators import images as I
    from vektral.plans.registry import flat

    x = [0.0] * 7 + [0.8506241176470588, 0.9350723529411764, 0.8465750980392156, 0.42268725490196074] + [1.0] * 7
    for values in (x, [-v for v in x]):
        ds = spark.createDataFrame([(1, values)], "sample_id long, feat array<double>")
        got = flat(ds.select("sample_id", I.truncated(F.col("feat"), 0.1, 0.1).alias("feat")), 4).first()["feat"]
        s = sorted(values)
        lo, hi = s[1], s[-2]
        assert got == [duckdb.execute("SELECT round((least(?, greatest(?, ?)) - ?) / (? - ?) * 255, 4)", [hi, lo, v, lo, hi, lo]).fetchone()[0] for v in values]
    far = [1e300, 1e306, -1e306, 1e20, 123456789012.34565, float("inf")]
    ds = spark.createDataFrame([(1, [*far, -0.00004, 0.00005, -0.00005])], "sample_id long, feat array<double>")
    assert flat(ds, 4).first()["feat"] == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 4)", [v]).fetchone()[0] for v in [*far, -0.00004, 0.00005, -0.00005]]
