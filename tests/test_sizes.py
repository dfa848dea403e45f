"""Queries whose work grew faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from vektral.operators import images as I


def test_illumination_sums_an_image_once(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (5, 24)).astype(float)
    x[0] = 0  # no pixel inside the light
    ds = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, feat array<double>")
    out = ds.select("sample_id", I.illumination(F.col("feat"), 6, 4, (2, 3), (3, 2), 0.7, 0.5).alias("feat")).orderBy("sample_id")
    light = np.array([np.exp(-0.5 * ((r - 2) ** 2 / 3 + (c - 3) ** 2 / 2)) for c in range(1, 5) for r in range(1, 7)])
    for row, v in zip(out.collect(), x):
        inside = v[(light >= 1 / 255) & (v != 0)]
        room = 255 - inside.mean() if len(inside) else 255
        want = np.clip(np.floor(v + 0.7 * room * light - np.where(light >= 1 / 255, 0, 127.5) + 0.5), 0, 255)
        assert np.array_equal(row["feat"], want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("aggregate(") < plan.index("round(")  # the mean stands outside the function of a pixel
    two = ds.select(I.illumination(F.concat("feat", "feat"), 6, 4, (2, 3), (3, 2)).alias("feat")).first()["feat"]
    assert len(two) == 48 and two[:24] != [] and None not in two  # the light falls on each channel


def test_kmeans_reads_blocks(spark, monkeypatch):
    from vektral.operators import blocks as B
    from vektral.operators import learning as L

    seen = []
    plain = B.summed
    monkeypatch.setattr(B, "summed", lambda spark, names, give: seen.append(len(names)) or plain(spark, names, give))
    x = np.random.default_rng(4).normal(size=(700, 3))
    ds = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, feat array<double>")
    start = np.array([x[0], x[1], [90.0, 90, 90]])  # the last has no samples
    centres, labels = L.kmeans(ds, 3, 40, start=start)
    assert seen and min(seen) > 1
    own = np.array([r["cluster"] for r in labels.orderBy("sample_id").collect()]) - 1
    assert np.array_equal(own, ((x[:, None] - centres) ** 2).sum(2).argmin(1)) and set(own) == {0, 1, 2}
    moved, _ = L.kmeans(ds, 3, 1, start=centres)
    assert np.allclose(moved, [x[own == j].mean(0) for j in range(3)])


def test_packing_meets_the_taken_only(spark, monkeypatch):
    from vektral.operators import trees as TR

    x = np.random.default_rng(6).normal(0, 0.01, (900, 3))
    x[:, 0] += np.arange(900) % 3 * 10  # three heaps far apart: one sample of each is taken
    ds = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, feat array<double>")
    monkeypatch.delattr(TR, "over_pairs", raising=False)  # no pass over all pairs of blocks
    got = sorted(r[0] for r in TR.packing(ds, 1.0, 64).collect())
    assert len(got) == 3 and sorted(i % 3 for i in got) == [0, 1, 2]
    apart = ds.withColumn("feat", F.array(F.col("sample_id").cast("double")))
    assert TR.packing(apart, 1.0, 200).count() == 900  # several rounds, all taken


def test_pairs_of_blocks_are_met_once_and_not_within_a_class(spark):
    from vektral.operators import blocks as B

    cls = [1] * 40 + [2] * 30 + [3] * 3 + [4] * 2
    ds = spark.createDataFrame([(i, c, [float(i), 1.0]) for i, c in enumerate(cls)], "sample_id long, cls int, feat array<double>")
    for size in (9, 40, 200):
        blocks = B.Blocks(ds, "cls", size=size, by="cls")

        def meet(one, others):
            met = np.zeros((75, 75), int)
            for b in others:
                met[np.ix_(one[0], (one if b is None else b)[0])] += 1
            return met

        met = B.summed_pairs(blocks, meet, 3)
        blocks.forget()
        both = met + met.T - np.diag(np.diag(met))
        assert both.max() <= 2 and (met.max() == 1)
        for i, j in zip(*np.nonzero(np.not_equal.outer(cls, cls))):
            assert met[i, j] or met[j, i]
        if size == 9:  # the two large classes fill their own blocks and are met by others only
            assert not met[:40, :40].any() and not met[40:70, 40:70].any()
    empty = B.Blocks(ds.limit(0), "cls", by="cls")
    assert B.summed_pairs(empty, meet) is None


def test_large_margins_far_from_the_origin(spark):
    """The loss keeps its digits where vectors are long beside their distances, and samples without a class, of another
    length or alone in their class change nothing."""
    from vektral.operators import large_margin as LM

    rng = np.random.default_rng(3)
    cls = np.repeat([1, 2, 3], [30, 29, 1])
    x = rng.normal(0, 0.5, (60, 3))
    near = [(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i and cls[j] == cls[i]), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:2]]
    d = ((x[:, None] - x) ** 2).sum(2)
    want = sum(0.5 * d[i, j] + 0.5 * np.maximum(0, 1 + d[i, j] - d[i][cls != cls[i]]).sum() for i, j in near)
    for shift in (0, 3000.0):
        rows = [(i, int(c), [float(v + shift) for v in r]) for i, (c, r) in enumerate(zip(cls, x))]
        rows += [(60, None, [0.0, 0.0, 0.0]), (61, 1, [1.0]), (62, 1, None)]
        fit = LM.large_margin_metric(spark.createDataFrame(rows, "sample_id long, cls int, feat array<double>"), 2, steps=1, size=8)
        assert abs(fit.losses[0] - want) < 1e-6 * want


def test_impostors_are_counted_for_both_samples_of_a_pair():
    from vektral.operators import large_margin as LM

    rng = np.random.default_rng(8)
    for far, kinds in ((1.0, (1, 2)), (1.0, (1, 1)), (300.0, (1, 2))):  # single precision, classes mixed, double
        sides, m = [], np.diag([1.0, 2.0, 0.5])
        for n, c in zip((13, 1030), kinds):
            x = rng.normal(size=(n, 3)) * far
            gaps = rng.normal(size=(n, 2, 3)) * far / 2
            gaps[0, 1] = 1e300  # has one target only
            own = np.full(n, c) if kinds[0] != kinds[1] else rng.integers(1, 3, n)
            sides.append((np.arange(n), np.concatenate((x, gaps.reshape(n, -1)), 1), {"cls": own}))
        one, other = (LM._Side(b, np.zeros(3), m, 2) for b in sides)
        here, there, total = LM._impostors(one, other)
        (x, y), (a, b) = (s[1][:, :3] for s in sides), (s[2]["cls"] for s in sides)
        diff = x[:, None] - y
        d, apart = np.einsum("ijk,kl,ijl->ij", diff, m, diff), a[:, None] != b
        mine, theirs = one.reach[:13], other.reach[:1030]
        left, right = (d[:, :, None] < mine[:, None]) & apart[:, :, None], (d[:, :, None] < theirs) & apart[:, :, None]
        assert np.abs(here[:13] - left.sum(1)).max() <= 1 and np.abs(there[:1030] - right.sum(0)).max() <= 1
        w = left.sum(2) + right.sum(2)
        assert np.allclose(total, np.einsum("ij,ijk,ijl->kl", w, diff, diff), rtol=1e-4) and w.sum() > 100


def test_image_files_are_read_once_in_few_tasks(spark, tmp_path):
    import functools
    import uuid

    from vektral.sources import tables as T

    x = np.random.default_rng(1).integers(0, 256, (40, 2 * 3 * 3)).astype(float)
    ds = spark.createDataFrame([(i, i % 3 + 9, i // 3 + 1, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, cls int, col_idx int, feat array<double>")
    path, calls = f"file://{tmp_path}/images", tmp_path / "calls"
    calls.mkdir()
    assert T.save_images(ds, path, 3, 2, 3).count() == 40
    (tmp_path / "images" / "9" / "_left").write_bytes(b"cut short")  # by an attempt that ended: no image
    assert not [p for p in tmp_path.glob("images/*/*") if not p.name.endswith(".bmp") and p.name != "_left"]

    def read(data):
        (calls / uuid.uuid4().hex).touch()
        return T.read_bitmap(data)

    got = T.image_samples(spark, path, read=read).collect()
    assert len(list(calls.iterdir())) == 40
    one = {(r["cls"], r["col_idx"]): (r["h"], r["w"], r["ch"], r["feat"]) for r in got}
    assert one == {(i % 3 + 1, i // 3 + 1): (3, 2, 3, list(r)) for i, r in enumerate(x)}
    # as Spark's image source decodes them, in colour and grey
    keys = ("cls", "col_idx", "h", "w", "ch", "feat")
    for grey in (False, True):
        plain = sorted(tuple(r[k] for k in keys) for r in T.image_samples(spark, path, grey=grey).collect())
        assert plain == sorted(tuple(r[k] for k in keys) for r in T.image_samples(spark, path, read=functools.partial(T.read_bitmap, grey=grey)).collect())
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)  # a partition a file
    try:
        assert "Coalesce" in T.image_samples(spark, path, read=read)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
