"""Learners: sums over the samples are distributed, the solves are of the size of the features or
classes and run in numpy on the driver, projections run where the samples are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sums(ds: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By class: number, sum and Gram matrix X'X.  Each batch becomes one row per class; rows are
    summed by component, so only classes * dims * (dims + 1) numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
            c = np.asarray(batch.column(0))
            for k in np.unique(c):
                part = x[c == k]
                row = np.concatenate(([len(part)], part.sum(0), (part.T @ part).ravel()))
                total[int(k)] = total[int(k)] + row if int(k) in total else row
        for k, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()), pa.array(row)], names=["cls", "i", "x"])

    rows = ds.select("cls", "feat").mapInArrow(run, "cls int, i int, x double").groupBy("cls", "i").agg(F.sum("x").alias("x")).collect()
    out = {}
    for k in sorted({r["cls"] for r in rows}):
        v = np.array([x for _, x in sorted((r["i"], r["x"]) for r in rows if r["cls"] == k)])
        d = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
        out[k] = (int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return out


def added(rows: DataFrame, size: int) -> np.ndarray:
    """Sums by place of rows (v) of so many numbers, one a task."""
    got = rows.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["i"]] = r["v"]
    return out


def project(ds: DataFrame, w: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """feat becomes W' (x - mean)."""
    shift = np.zeros(len(w)) if mean is None else mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("feat")
            x = np.asarray(batch.column(at).flatten(), float).reshape(batch.num_rows, -1)
            y = (x - shift) @ w
            feat = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([feat if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return ds.mapInArrow(run, ds.schema)


def pca(ds: DataFrame, dims: int = 0, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, eigenvalues (of the centred X'X, not divided) and mean; relative values under 1e-10
    go, dims or the share of the sum limits the rest."""
    s = sums(ds)
    n, total, gram = (sum(v[i] for v in s.values()) for i in range(3))
    mean = total / n
    values, vectors = np.linalg.eigh(gram - n * np.outer(mean, mean))
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    keep = values > 1e-10 * values[0]
    values, vectors = values[keep], vectors[:, keep]
    if ratio:
        dims = int(np.searchsorted(np.cumsum(values) / values.sum(), ratio - 1e-12)) + 1
    return (vectors[:, :dims], values[:dims], mean) if dims else (vectors, values, mean)


def lda(ds: DataFrame, alpha: float = 0.1, dims: int = 0) -> np.ndarray:
    """Ridge-regularised discriminant directions of unit length, at most classes - 1."""
    s = sums(ds)
    n, total, gram = (sum(v[i] for v in s.values()) for i in range(3))
    mean = total / n
    between = sum(c * np.outer(t / c - mean, t / c - mean) for c, t, _ in s.values())
    scatter = gram - n * np.outer(mean, mean)
    root = np.linalg.cholesky(scatter + alpha * np.eye(len(mean)))
    inv = np.linalg.inv(root)
    values, vectors = np.linalg.eigh(inv @ between @ inv.T)
    w = inv.T @ vectors[:, np.argsort(-values)[: dims or len(s) - 1]]
    return w / np.linalg.norm(w, axis=0)


def kmeans(ds: DataFrame, k: int, iterations: int = 50, seed: int = 1, start: np.ndarray | None = None, cosine: bool = False) -> tuple[np.ndarray, DataFrame]:
    """(centres, (sample_id, cluster)) by Lloyd's steps, from the k least hashes of ids or given centres.

    Each step is one pass over files of blocks: a task returns its count and sum of each cluster, k * (dims + 1)
    numbers.
    Ties go to the smaller cluster.  A cluster that lost its samples restarts at the sample farthest
    from its centre.  With cosine, vectors and centres have unit length.
    """
    from .blocks import Blocks, fitting, read_block, summed

    rows = ds.select("sample_id", "feat")
    if start is None:
        first = rows.orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(k).collect()
        start = np.array([r["feat"] for r in first])
    centres, k = np.asarray(start, float), len(start)

    def assigned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors as compared, their clusters (from 0) and squared distances, in blocks."""
        if cosine:
            x, c = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-14) for v in (x, c))
        step, c2 = max(1, 4_000_000 // max(1, len(c))), (c * c).sum(1)
        found, far = [], []
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            x2 = (part * part).sum(1)
            d = x2[:, None] + c2 - 2 * part @ c.T
            own = d.argmin(1)
            # centres within the product's rounding error of the nearest are compared exactly
            error = 8 * np.finfo(float).eps * (c.shape[1] + 2) * (x2 + c2.max())
            for r in np.flatnonzero((d <= (d.min(1) + error)[:, None]).sum(1) > 1):
                own[r] = ((part[r] - c) ** 2).sum(1).argmin()
            found.append(own)
            far.append(((part - c[own]) ** 2).sum(1))
        return x, np.concatenate(found), np.concatenate(far)

    blocks = Blocks(rows, size=fitting(ds.count()))  # each step reads them
    names, folder = blocks.listed(), blocks.folder

    def step(c: np.ndarray) -> np.ndarray:
        def total(name: str) -> np.ndarray:
            x, own, _ = assigned(read_block(folder, name)[1], c)
            order = np.argsort(own, kind="stable")
            there, first = np.unique(own[order], return_index=True)
            out = np.zeros((k, c.shape[1] + 1))
            out[there, 0] = np.diff(np.append(first, len(own)))
            out[there, 1:] = np.add.reduceat(x[order], first, axis=0)
            return out

        def worst(name: str) -> tuple[float, list[float]]:
            x, _, d = assigned(read_block(folder, name)[1], c)
            return -float(d.max()), x[d.argmax()].tolist()

        total = summed(ds.sparkSession, names, total)
        new, empty = total[:, 1:] / np.maximum(total[:, :1], 1), np.flatnonzero(total[:, 0] == 0)
        if len(empty):
            outer = ds.sparkSession.sparkContext.parallelize(names, len(names)).map(worst).takeOrdered(len(empty))
            for j, (_, at) in zip(empty, outer):
                new[j] = at
            for j in empty[len(outer) :]:
                new[j] = c[j]
        return new

    for _ in range(iterations):
        new = step(centres)
        done = np.allclose(new, centres, atol=1e-9)
        centres = new
        if done:
            break

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = assigned(np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1), centres)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((own + 1).astype(np.int32))], names=["sample_id", "cluster"])

    blocks.forget()
    return centres, ds.select("sample_id", "feat").mapInArrow(label, "sample_id long, cluster int")


def kernel_values(x: np.ndarray, y: np.ndarray, kernel: str, t: float = 1.0, degree: int = 2) -> np.ndarray:
    """Kernel values between rows."""
    k = x @ y.T
    if kernel not in ("gaussian", "sqeuclidean"):
        return k**degree
    k *= -2
    k += (x * x).sum(1)[:, None]
    k += (y * y).sum(1)
    np.maximum(k, 0, out=k)
    if kernel == "gaussian":
        k *= -1 / (2 * t * t)
        np.exp(k, out=k)
    return k


def gram_matrix(ds: DataFrame, kernel: str, t: float = 1.0, degree: int = 2, most: int = 5000) -> tuple[list[int], np.ndarray]:
    """A kernel matrix on the driver, for at most `most` samples (an error beyond)."""
    rows = ds.select("sample_id", "feat").orderBy("sample_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"kernel methods take at most {most} samples")
    x = np.array([r["feat"] for r in rows])
    d2 = np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T)
    k = np.exp(-d2 / (2 * t * t)) if kernel == "gaussian" else d2 if kernel == "sqeuclidean" else (x @ x.T) ** degree
    return [r["sample_id"] for r in rows], k


def centred(k: np.ndarray) -> np.ndarray:
    row = k.mean(0)
    return k - row - row[:, None] + k.mean()


def _embedding(ds: DataFrame, ids: list[int], y: np.ndarray) -> DataFrame:
    return ds.sparkSession.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, y)], "sample_id long, feat array<double>")


def kernel_pca(ds: DataFrame, dims: int = 2, kernel: str = "gaussian", t: float = 1.0, degree: int = 2, most: int = 5000) -> DataFrame:
    """Projections on the principal components of the kernel's space; beyond `most` samples the matrix over all
    pairs is made block by block in the tasks and its eigenvectors are searched for by its products."""
    from .kernel_spaces import principal

    if ds.count() > most:
        return principal(ds, dims, kernel, t, degree)
    ids, k = gram_matrix(ds, kernel, t, degree)
    values, vectors = np.linalg.eigh(centred(k))
    order = np.argsort(-values)[:dims]
    return _embedding(ds, ids, vectors[:, order] * np.sqrt(np.maximum(values[order], 0)))


def classical_scaling(ds: DataFrame, dims: int = 2) -> DataFrame:
    """The centred matrix of squared distances is that of the centred vectors' products, so its eigenvectors are
    the projections on the principal components: no matrix over the samples is made."""
    rows = ds.select(F.col("sample_id").cast("long").alias("sample_id"), "feat")
    w, _, mean = pca(rows.withColumn("cls", F.lit(0)), dims)
    return project(rows, np.pad(w, ((0, 0), (0, dims - w.shape[1]))), mean)


def isomap(ds: DataFrame, k: int = 12, dims: int = 2) -> DataFrame:
    """Classical scaling of shortest paths over the neighbour graph; parts that aren't connected are
    put at the greatest finite distance."""
    ids, d2 = gram_matrix(ds, "sqeuclidean", most=2000)
    d = np.sqrt(d2)
    near = np.argsort(d, axis=1)[:, : k + 1]
    g = np.full_like(d, np.inf)
    np.put_along_axis(g, near, np.take_along_axis(d, near, 1), 1)
    g = np.minimum(g, g.T)
    for m in range(len(g)):
        np.minimum(g, g[:, m : m + 1] + g[m], out=g)
    g[np.isinf(g)] = g[np.isfinite(g)].max()
    values, vectors = np.linalg.eigh(-0.5 * centred(g * g))
    order = np.argsort(-values)[:dims]
    return _embedding(ds, ids, vectors[:, order] * np.sqrt(np.maximum(values[order], 0)))


def laplacian_eigenmaps(ds: DataFrame, k: int = 12, t: float = 1.0, dims: int = 2) -> DataFrame:
    ids, d2 = gram_matrix(ds, "sqeuclidean", most=2000)
    near = np.argsort(d2, axis=1)[:, 1 : k + 1]
    w = np.zeros_like(d2)
    np.put_along_axis(w, near, np.exp(-np.take_along_axis(d2, near, 1) / (2 * t * t)), 1)
    w = np.maximum(w, w.T)
    scale = 1 / np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(np.eye(len(w)) - scale[:, None] * w * scale)
    return _embedding(ds, ids, vectors[:, 1 : dims + 1] * scale[:, None])


def locally_linear(ds: DataFrame, k: int = 12, dims: int = 2) -> DataFrame:
    rows = ds.select("sample_id", "feat").orderBy("sample_id").limit(2001).collect()
    if len(rows) > 2000:
        raise ValueError("locally linear embedding takes at most 2000 samples")
    x = np.array([r["feat"] for r in rows])
    d2 = (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T
    near = np.argsort(d2, axis=1)[:, 1 : k + 1]
    w = np.zeros_like(d2)
    for i, nb in enumerate(near):
        z = x[nb] - x[i]
        c = z @ z.T
        c += np.eye(k) * (1e-5 * np.trace(c) + 1e-12)
        v = np.linalg.solve(c, np.ones(k))
        w[i, nb] = v / v.sum()
    m = np.eye(len(x)) - w
    values, vectors = np.linalg.eigh(m.T @ m)
    return _embedding(ds, [r["sample_id"] for r in rows], vectors[:, 1 : dims + 1] * np.sqrt(len(x)))


def lasso(a: np.ndarray, b: np.ndarray, penalty: float, rho: float = 1.0, steps: int = 1000) -> np.ndarray:
    """min 1/2 |Ax - b|^2 + penalty |x|_1 by alternating directions; columns of b are problems."""
    n = a.shape[1]
    if n <= len(a):
        inverse = np.linalg.inv(a.T @ a + rho * np.eye(n))
        solve = lambda v: inverse @ v
    else:  # the same through a matrix of the features' size
        inverse = np.linalg.inv(a @ a.T + rho * np.eye(len(a)))
        solve = lambda v: (v - a.T @ (inverse @ (a @ v))) / rho
    ab = a.T @ b
    z = np.zeros_like(ab)
    u = np.zeros_like(ab)
    for _ in range(steps):
        x = solve(ab + rho * (z - u))
        old = z
        z = np.sign(x + u) * np.maximum(np.abs(x + u) - penalty / rho, 0)
        u += x - z
        norm = np.sqrt(n) * 1e-4
        primal, dual = np.linalg.norm(x - z, axis=0), rho * np.linalg.norm(z - old, axis=0)
        if (primal < norm + 1e-2 * np.maximum(np.linalg.norm(x, axis=0), np.linalg.norm(z, axis=0))).all() and (dual < norm + 1e-2 * rho * np.linalg.norm(u, axis=0)).all():
            break
    return z


def matching_pursuit(d: np.ndarray, y: np.ndarray, atoms: int) -> np.ndarray:
    """Orthogonal matching pursuit of one signal."""
    chosen, r, x = [], y.astype(float), np.zeros(d.shape[1])
    while len(chosen) < atoms and r @ r >= 1e-6:
        k = int(np.argmax(np.abs(d.T @ r)))
        if k in chosen:
            break
        chosen.append(k)
        c = np.linalg.lstsq(d[:, chosen], y, rcond=None)[0]
        r = y - d[:, chosen] @ c
    x[chosen] = c if chosen else []
    return x


def sparse_recognition(probes: DataFrame, gallery: DataFrame, penalty: float = 0.01) -> DataFrame:
    """(sample_id, cls, predicted): each probe's class of least residual of its sparse code over the
    gallery, which tasks read from files; so many probes at a time as a code's size allows."""
    from .blocks import by_gallery

    def decide(x: np.ndarray, c: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        a, classes, step = (x / np.linalg.norm(x, axis=1)[:, None]).T, np.unique(c), max(1, 1_000_000 // len(c))

        def found(every: np.ndarray) -> np.ndarray:
            every, out = (every / np.linalg.norm(every, axis=1)[:, None]).T, []
            for lo in range(0, every.shape[1], step):
                y = every[:, lo : lo + step]
                code = lasso(a, y, penalty)
                out.append(classes[np.stack([((y - a[:, c == k] @ code[c == k]) ** 2).sum(0) for k in classes]).argmin(0)])
            return np.concatenate(out)

        return found

    return by_gallery(probes, gallery, decide)


def layered_codes(probes: DataFrame, dictionaries: list[np.ndarray], penalties: list[float], rounds: int = 20, most: int = 5000) -> DataFrame:
    """(sample_id, cls, layer, code, part): each probe as a sum of parts, one sparse over each dictionary (atoms
    are columns); in each round a layer codes what the others leave of the probe.  A gallery and a dictionary
    of what may hide it come apart so.  The dictionaries, at most `most` atoms together, go to every task."""
    if sum(d.shape[1] for d in dictionaries) > most:
        raise ValueError(f"the dictionaries take at most {most} atoms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.asarray(batch.column(2).flatten(), float).reshape(batch.num_rows, -1).T
                codes, parts = _layers(y, dictionaries, penalties, rounds)
                for k in range(len(dictionaries)):
                    lists = [pa.array(list(x.T), pa.list_(pa.float64())) for x in (codes[k], parts[k])]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(y.shape[1], k + 1, np.int32)), *lists], names=["sample_id", "cls", "layer", "code", "part"])

    return probes.select("sample_id", "cls", "feat").mapInArrow(run, "sample_id long, cls int, layer int, code array<double>, part array<double>")


def _layers(y: np.ndarray, dictionaries: list[np.ndarray], penalties: list[float], rounds: int = 20) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codes and parts of signals (columns), a matrix for each dictionary."""
    parts = [np.zeros_like(y) for _ in dictionaries]
    codes: list[np.ndarray] = [np.zeros((d.shape[1], y.shape[1])) for d in dictionaries]
    for _ in range(rounds):
        for k, (d, penalty) in enumerate(zip(dictionaries, penalties)):
            codes[k] = lasso(d, y - sum(parts[:k] + parts[k + 1 :], np.zeros_like(y)), penalty)
            parts[k] = d @ codes[k]
    return codes, parts


def layered_recognition(probes: DataFrame, gallery: DataFrame, hidden: np.ndarray, penalties: tuple[float, float] = (0.01, 0.05)) -> DataFrame:
    """(sample_id, cls, predicted): the class whose share of a probe's code over the gallery leaves the least of
    the probe, once what a second dictionary (of hidden parts) explains is taken away.  Tasks read the gallery
    from files; a code as long as the gallery stays in its task."""
    from .blocks import by_gallery

    def decide(x: np.ndarray, c: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        a, classes, step = x.T, np.unique(c), max(1, 1_000_000 // len(c))

        def found(every: np.ndarray) -> np.ndarray:
            out = []
            for lo in range(0, len(every), step):
                y = every[lo : lo + step].T
                codes, parts = _layers(y, [a, hidden], list(penalties))
                out.append(classes[np.stack([((y - parts[1] - a[:, c == k] @ codes[0][c == k]) ** 2).sum(0) for k in classes]).argmin(0)])
            return np.concatenate(out)

        return found

    return by_gallery(probes, gallery, decide)


def manifold(spark, kind: str, n: int) -> DataFrame:
    """Noise-free points of a synthetic surface: helix, twinpeaks or swiss."""
    t = F.col("id") / F.lit(float(n))
    if kind == "helix":
        a = t * 2 * np.pi
        p = [(2 + F.cos(8 * a)) * F.cos(a), (2 + F.cos(8 * a)) * F.sin(a), F.sin(8 * a)]
    elif kind == "twinpeaks":
        side = int(np.sqrt(n))
        x, y = 1 - 2 * (F.col("id") % side) / side, 1 - 2 * F.floor(F.col("id") / side) / side
        p = [x, y, F.sin(np.pi * x) * F.tanh(3 * y) * 10]
    else:
        a = 3 * np.pi / 2 * (1 + 2 * t)
        p = [a * F.cos(a), 30 * ((F.col("id") * 7919) % n) / n, a * F.sin(a)]
    return spark.range(n).select(F.col("id").alias("sample_id"), F.array(*[c.cast("double") for c in p]).alias("feat"))
