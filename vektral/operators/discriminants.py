"""Linear maps learned from class sums, and kernel and robust variants.

The plain ones need only the sums by class (learning.sums), which are of the size of the features.
Robust ones re-weigh the samples in passes over the data, each of which returns such sums again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import centred, gram_matrix, lda, pca, sums


Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def weighted_sums(ds: DataFrame, weigh: Weigh) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By class: sum of weights, weighted sum, weighted Gram matrix; weigh(x, cls) gives a batch's
    weights.  One pass; a task returns one set of sums per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
            cls = np.asarray(batch.column(0))
            w = weigh(x, cls)
            for k in np.unique(cls):
                part, wk = x[cls == k], w[cls == k]
                row = np.concatenate(([wk.sum()], wk @ part, ((wk[:, None] * part).T @ part).ravel()))
                total[int(k)] = total[int(k)] + row if int(k) in total else row
        for k, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()), pa.array(row)], names=["cls", "i", "x"])

    got = ds.select("cls", "feat").mapInArrow(run, "cls int, i int, x double").groupBy("cls", "i").agg(F.sum("x").alias("x")).collect()
    out = {}
    for k in sorted({r["cls"] for r in got}):
        v = np.array([x for _, x in sorted((r["i"], r["x"]) for r in got if r["cls"] == k)])
        d = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
        out[k] = (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return out


def _whole(s: dict) -> tuple:
    return tuple(sum(v[i] for v in s.values()) for i in range(3))


def top(m: np.ndarray, dims: int) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors[:, np.argsort(-values)[:dims]]


def whitening(ds: DataFrame, floor: float = 1e-10, epsilon: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(w, mean): projecting with them gives components of unit length (X'X = I) without correlation."""
    vectors, values, mean = pca(ds)
    keep = np.sqrt(values) > floor
    return vectors[:, keep] / (np.sqrt(values[keep]) + epsilon), mean


def fisher(ds: DataFrame, dims: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(w, mean): principal components up to samples - classes, discriminants inside them."""
    s = sums(ds)
    n = sum(v[0] for v in s.values())
    p, _, mean = pca(ds, max(1, n - len(s)))
    within = sum(g - np.outer(t, t) / c for c, t, g in s.values())
    between = sum(c * np.outer(t / c - mean, t / c - mean) for c, t, _ in s.values())
    sw, sb = p.T @ within @ p, p.T @ between @ p
    inv = np.linalg.inv(np.linalg.cholesky(sw + 1e-9 * np.trace(sw) / len(sw) * np.eye(len(sw))))
    return p @ inv.T @ top(inv @ sb @ inv.T, dims or len(s) - 1), mean


def direct_lda(ds: DataFrame, least_between: float = 1e-4, most_within: float = 5.0) -> np.ndarray:
    """Directions in which the class means differ, scaled to unit between-class scatter, then those of
    least within-class scatter."""
    s = sums(ds)
    n = sum(v[0] for v in s.values())
    mean = sum(v[1] for v in s.values()) / n
    h = np.stack([np.sqrt(c) * (t / c - mean) for c, t, _ in s.values()], 1) / np.sqrt(n)
    u, sv, _ = np.linalg.svd(h, full_matrices=False)
    keep = sv**2 > least_between * sv[0] ** 2
    z = u[:, keep] / sv[keep]
    within = sum(g - np.outer(t, t) / c for c, t, g in s.values()) / n
    values, vectors = np.linalg.eigh(z.T @ within @ z)
    keep = values < most_within * max(values[0], 1e-12) if (values < most_within).sum() == 0 else values < most_within
    return z @ vectors[:, keep] / np.sqrt(np.maximum(values[keep], 1e-12))


def correntropy_pca(ds: DataFrame, dims: int, steps: int = 30, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(w, mean): principal components whose samples are weighed by exp(-residual / 2 s2), so that
    outliers fade; s2 is the mean residual.  One pass a step."""
    w, _, mean = pca(ds, dims)
    plain = _whole(sums(ds))
    for _ in range(steps):

        def residual(x: np.ndarray, w: np.ndarray = w, mean: np.ndarray = mean) -> np.ndarray:
            z = x - mean
            return np.maximum(0, (z * z).sum(1) - ((z @ w) ** 2).sum(1))

        n, total, gram = plain
        c = gram - np.outer(mean, total) - np.outer(total, mean) + n * np.outer(mean, mean)
        s2 = max((np.trace(c) - np.trace(w.T @ c @ w)) / n, 1e-12)
        n, total, gram = _whole(weighted_sums(ds, lambda x, _, f=residual, s=s2: np.exp(-f(x) / (2 * s))))
        mean = total / n
        new = top(gram - n * np.outer(mean, mean), dims)
        moved = np.linalg.norm(new @ new.T - w @ w.T)
        w = new
        if moved < tolerance:
            break
    return w, mean


def robust_lda(ds: DataFrame, dims: int = 0, alpha: float = 0.5, steps: int = 20, tolerance: float = 1e-5, kind: str = "rotational") -> np.ndarray:
    """Discriminants whose within-class scatter counts a sample by 1 / its distance (rotational) or by
    exp(-distance2 / 2 s2) (correntropy) in the projected space; between minus alpha within."""
    s = sums(ds)
    n = sum(v[0] for v in s.values())
    mean = sum(v[1] for v in s.values()) / n
    means = {k: t / c for k, (c, t, _) in s.items()}
    between = sum(c * np.outer(means[k] - mean, means[k] - mean) for k, (c, _, _) in s.items()) / n
    w = lda(ds, dims=dims)
    w = np.linalg.qr(w)[0]
    order = sorted(means)
    centre = np.array([means[k] for k in order])
    for _ in range(steps):
        s2 = max(np.trace(w.T @ sum(g - np.outer(t, t) / c for c, t, g in s.values()) @ w) / n, 1e-12)

        def within(batch: np.ndarray, cls: np.ndarray, w: np.ndarray = w, s2: float = s2) -> np.ndarray:
            d2 = (((batch - centre[np.searchsorted(order, cls)]) @ w) ** 2).sum(1)
            return 1 / np.sqrt(np.maximum(d2, 1e-12)) if kind == "rotational" else np.exp(-d2 / (2 * s2))

        # weights are summed class by class, about the class's own mean
        scatter = np.zeros_like(between)
        total = 0.0
        for k, (c, t, g) in weighted_sums(ds, within).items():
            scatter += g - np.outer(means[k], t) - np.outer(t, means[k]) + c * np.outer(means[k], means[k])
            total += c
        new = top(between - alpha * scatter / max(total, 1e-12), w.shape[1])
        moved = np.linalg.norm(new @ new.T - w @ w.T)
        w = new
        if moved < tolerance:
            break
    return w


def masked_reconstruction(ds: DataFrame, known: list[int], dims: int) -> DataFrame:
    """Whole vectors from the components `known` (from 0): least squares over principal directions."""
    from .learning import project

    w, _, mean = pca(ds, dims)
    back = np.linalg.pinv(w[known])
    pick = np.zeros((len(mean), len(known)))
    pick[known, range(len(known))] = 1
    rows = project(ds, pick @ back.T @ w.T, mean)
    shift = F.array(*[F.lit(float(m)) for m in mean])
    return rows.withColumn("feat", F.zip_with("feat", shift, lambda x, m: x + m))


def partial_least_squares(ds: DataFrame, dims: int = 2, kind: str = "nipals") -> tuple[np.ndarray, np.ndarray]:
    """(w, mean): partial least squares of the features on one-hot classes: left singular vectors of
    their cross products (svd), or one vector at a time with deflation (nipals).  Needs sums only."""
    s = sums(ds)
    n, total, gram = _whole(s)
    mean = total / n
    gram = gram - n * np.outer(mean, mean)
    cross = np.stack([t - c * mean for c, t, _ in s.values()], 1)
    if kind == "svd":
        return np.linalg.svd(cross, full_matrices=False)[0][:, :dims], mean
    weights, loads = [], []
    for _ in range(dims):
        w = np.linalg.svd(cross, full_matrices=False)[0][:, 0]
        p = gram @ w / (w @ gram @ w)
        keep = np.eye(len(w)) - np.outer(p, w)
        cross, gram = keep @ cross, keep @ gram @ keep.T
        weights.append(w)
        loads.append(p)
    w, p = np.stack(weights, 1), np.stack(loads, 1)
    return w @ np.linalg.inv(p.T @ w), mean


def kernel_discriminant(ds: DataFrame, kernel: str = "gaussian", t: float = 1.0, degree: int = 2, alpha: float = 0.1, dims: int = 0, most: int = 5000) -> DataFrame:
    """Samples projected on regularised kernel discriminants; beyond `most` samples the matrix over all pairs is
    made block by block in the tasks."""
    from .kernel_spaces import discriminating
    from .learning import _embedding

    if ds.count() > most:
        return discriminating(ds, kernel, t, degree, alpha, dims)
    ids, k = gram_matrix(ds, kernel, t, degree)
    label = dict(ds.select("sample_id", "cls").collect())
    y = np.array([label[i] for i in ids])
    k = centred(k)
    classes = np.unique(y)
    hot = (y[:, None] == classes) / np.sqrt((y[:, None] == classes).sum(0))
    # responses that discriminants of the classes have: the class space without its mean
    q = np.linalg.qr(np.column_stack([np.ones(len(y)), hot]))[0][:, 1 : len(classes)]
    a = np.linalg.solve(k + alpha * np.eye(len(k)), q[:, : dims or len(classes) - 1])
    return _embedding(ds, ids, k @ a)
