"""Embeddings of samples, and linear maps that keep what their neighbours say of them.

Those that need a matrix over all pairs of samples run in numpy on the driver and refuse more than `most`
samples; stochastic neighbours and neighbourhood components meet the pairs of more samples block by block in tasks.
The locality preserving and neighbourhood preserving maps take any number: they are summed up from the
neighbour graph.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, drop_folder, fitting, load_array, read_block, store_array, summed, vectors_of, whole
from .graphs import shared_folder
from .learning import _embedding, added
from .neighbours import affinity, around, neighbour_graph
from .statistics import gaussian_noise


def points(ds: DataFrame, most: int = 2000) -> tuple[list[int], np.ndarray]:
    rows = ds.select("sample_id", "feat").orderBy("sample_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"methods over all pairs take at most {most} samples")
    return [r["sample_id"] for r in rows], np.array([r["feat"] for r in rows])


def squared_distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    d = np.maximum(0, s[:, None] + s - 2 * x @ x.T)
    np.fill_diagonal(d, 0)
    return d


def neighbours(d2: np.ndarray, k: int) -> np.ndarray:
    d2 = d2.copy()
    np.fill_diagonal(d2, np.inf)
    return np.argsort(d2, axis=1, kind="stable")[:, :k]


def generalized(a: np.ndarray, b: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of least a w = l b w."""
    inv = np.linalg.inv(np.linalg.cholesky(b + 1e-9 * np.trace(b) / len(b) * np.eye(len(b))))
    values, vectors = np.linalg.eigh(inv @ a @ inv.T)
    return inv.T @ vectors[:, np.argsort(values)[:dims]]


def _centred(ds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and centred sum of squares of all vectors."""
    from .learning import sums

    n, total, gram = sums(ds.select(F.lit(0).alias("cls"), "feat"))[0]
    return total / n, gram - np.outer(total, total) / n


def locality_preserving(ds: DataFrame, k: int = 12, t: float = 1.0, dims: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(w, mean): linear directions that keep neighbours near.  Each edge of the neighbour graph adds its weighed
    products to two features x features sums, in the tasks; no matrix over the samples is made."""
    ds = ds.filter(whole())
    mean, square = _centred(ds)
    d = len(mean)
    edges = affinity(neighbour_graph(ds, k), "heat", t)  # both directions
    vector = lambda name, to: ds.select(F.col("sample_id").alias(name), F.col("feat").alias(to))
    both = edges.join(vector("src", "a"), "src").join(vector("dst", "b"), "dst").select("w", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, d, d))
        for batch in batches:
            if batch.num_rows:
                w = np.asarray(batch.column(0))[:, None]
                x, y = (np.asarray(batch.column(c).flatten(), float).reshape(-1, d) - mean for c in (1, 2))
                out[0] += (w * (x - y)).T @ (x - y) / 2
                out[1] += (w * x).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    spread, degree = added(both.mapInArrow(run, "v array<double>"), 2 * d * d).reshape(2, d, d)
    return generalized(spread, degree, dims), mean


def neighbourhood_preserving(ds: DataFrame, k: int = 12, dims: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(w, mean): linear directions in which neighbours rebuild a sample as they do in the data.  What its
    neighbours leave of each sample is summed up as features x features products in the tasks."""
    ds = ds.filter(whole())
    mean, square = _centred(ds)
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, d))
        for batch in batches:
            for row in batch.column(0):
                x = np.asarray(row.values, float).reshape(-1, d) - mean
                z = x[1:] - x[0]
                c = z @ z.T
                v = np.linalg.solve(c + np.eye(len(z)) * (1e-5 * np.trace(c) + 1e-12), np.ones(len(z)))
                left = x[0] - (v / v.sum()) @ x[1:]
                out += np.outer(left, left)
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    left = added(around(ds, k).mapInArrow(run, "v array<double>"), d * d).reshape(d, d)
    return generalized(left, square, dims), mean


def diffusion_map(ds: DataFrame, sigma: float = 1.0, steps: float = 1.0, dims: int = 2) -> DataFrame:
    ids, x = points(ds)
    k = np.exp(-squared_distances(x) / (2 * sigma * sigma))
    p = k.sum(0)
    k = k / np.outer(p, p) ** steps
    root = np.sqrt(k.sum(0))
    values, vectors = np.linalg.eigh(k / np.outer(root, root))
    first = vectors[:, -1]
    return _embedding(ds, ids, vectors[:, -2 : -dims - 2 : -1] / first[:, None] * values[-2 : -dims - 2 : -1])


def tangent_alignment(ds: DataFrame, k: int = 12, dims: int = 2) -> DataFrame:
    """Local tangent spaces aligned into one embedding."""
    ids, x = points(ds)
    near = neighbours(squared_distances(x), k)
    b = np.zeros((len(x), len(x)))
    for i, nb in enumerate(near):
        at = np.append(nb, i)
        z = x[at] - x[at].mean(0)
        u = np.linalg.svd(z, full_matrices=False)[0][:, :dims]
        g = np.column_stack([np.full(len(at), 1 / np.sqrt(len(at))), u])
        b[np.ix_(at, at)] += np.eye(len(at)) - g @ g.T
    return _embedding(ds, ids, np.linalg.eigh(b)[1][:, 1 : dims + 1] * np.sqrt(len(x)))


def hessian_embedding(ds: DataFrame, k: int = 12, dims: int = 2) -> DataFrame:
    """The null space of the local Hessians."""
    ids, x = points(ds)
    extra = dims * (dims + 1) // 2
    k = max(k, 1 + dims + extra)
    near = neighbours(squared_distances(x), k)
    b = np.zeros((len(x), len(x)))
    for i, nb in enumerate(near):
        z = x[nb] - x[nb].mean(0)
        u = np.linalg.svd(z, full_matrices=False)[0][:, :dims]
        second = np.stack([u[:, p] * u[:, q] for p in range(dims) for q in range(p, dims)], 1)
        h = np.linalg.qr(np.column_stack([np.ones(len(nb)), u, second]))[0][:, 1 + dims :]
        b[np.ix_(nb, nb)] += h @ h.T
    return _embedding(ds, ids, np.linalg.eigh(b)[1][:, 1 : dims + 1] * np.sqrt(len(x)))


def landmark_isomap(ds: DataFrame, k: int = 12, share: float = 0.2, dims: int = 2, seed: int = 1) -> DataFrame:
    """Paths from a share of the samples only; the others are placed by their paths to these."""
    ids, x = points(ds, 10000)
    near = neighbours(squared_distances(x), k)
    d = np.linalg.norm(x[near] - x[:, None], axis=2)
    marks = np.random.default_rng(seed).permutation(len(x))[: max(dims + 1, int(share * len(x)))]
    g = np.full((len(marks), len(x)), np.inf)
    g[range(len(marks)), marks] = 0
    while True:  # edges are relaxed until no path gets shorter
        old = g.copy()
        for j in range(near.shape[1]):
            np.minimum.at(g.T, near[:, j], (g + d[:, j]).T)
            g = np.minimum(g, g[:, near[:, j]] + d[:, j])
        if np.array_equal(old, g):
            break
    g[np.isinf(g)] = g[np.isfinite(g)].max()
    d2 = g * g
    mean = d2[:, marks].mean(0)
    core = -0.5 * (d2[:, marks] - mean - mean[:, None] + mean.mean())
    values, vectors = np.linalg.eigh(core)
    values, vectors = values[::-1][:dims], vectors[:, ::-1][:, :dims]
    return _embedding(ds, ids, (-0.5 * (d2 - mean[:, None])).T @ vectors / np.sqrt(np.maximum(values, 1e-12)))


def sammon(ds: DataFrame, dims: int = 2, steps: int = 200) -> DataFrame:
    """Stress with distances weighed by 1 / distance, lowered by majorisation."""
    ids, x = points(ds)
    d = np.sqrt(squared_distances(x))
    far = np.where(d > 0, d, 1e-9)
    weight = 1 / far
    np.fill_diagonal(weight, 0)
    v = np.linalg.pinv(np.diag(weight.sum(1)) - weight)
    z = x - x.mean(0)
    y = z @ np.linalg.svd(z, full_matrices=False)[2][:dims].T
    for _ in range(steps):
        now = np.sqrt(squared_distances(y))
        b = -weight * np.divide(d, now, out=np.zeros_like(d), where=now > 1e-12)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(1))
        new = v @ b @ y
        if np.abs(new - y).max() < 1e-9:
            break
        y = new
    return _embedding(ds, ids, y)


def proximity_embedding(ds: DataFrame, dims: int = 2, rounds: int = 50, seed: int = 1) -> DataFrame:
    """Random pairs moved, ever less, to the distance they have in the data."""
    ids, x = points(ds)
    rng = np.random.default_rng(seed)
    d = np.sqrt(squared_distances(x))
    d /= max(d.max(), 1e-12)
    y = rng.random((len(x), dims))
    for rate in np.linspace(1, 0.01, rounds * 4):
        order = rng.permutation(len(x))
        a, b = order[: len(x) // 2], order[len(x) // 2 : 2 * (len(x) // 2)]
        gap = y[a] - y[b]
        now = np.linalg.norm(gap, axis=1)
        move = (rate * 0.5 * (d[a, b] - now) / (now + 1e-7))[:, None] * gap
        y[a] += move
        y[b] -= move
    return _embedding(ds, ids, y)


def joint_probabilities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows whose entropy is log(perplexity), by bisection; symmetric, summing to 1."""
    n = len(d2)
    p, goal = np.zeros_like(d2), np.log(min(perplexity, max(n - 1, 1) * 0.99 + 1e-9))
    for i in range(n):
        row = np.delete(d2[i], i)
        row = row - row.min()
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            e = np.exp(-row * beta)
            total = e.sum()
            entropy = np.log(total) + beta * (row @ e) / total
            if abs(entropy - goal) < 1e-6:
                break
            if entropy > goal:
                low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i, np.arange(n) != i] = e / total
    p = (p + p.T) / (2 * n)
    return np.maximum(p, 1e-12)


def stochastic_neighbours(ds: DataFrame, dims: int = 2, perplexity: float = 30.0, first_dims: int = 30, steps: int = 400, rate: float = 200.0, heavy: bool = True, seed: int = 1, most: int = 2000) -> DataFrame:
    """t-distributed (heavy) or Gaussian symmetric stochastic neighbour embedding.  Beyond `most` samples the
    pairs are met block by block in the tasks, and the first places are made from hashes of the ids."""
    if ds.count() > most:
        noise = F.array(*[1e-4 * gaussian_noise(F.col("sample_id"), F.lit(j), seed=seed) for j in range(dims)])
        return _blocked_neighbours(ds.select("sample_id", "feat", noise.alias("y")), dims, perplexity, first_dims, steps, rate, heavy)
    ids, x = points(ds, most)
    z = x - x.mean(0)
    z = z @ np.linalg.svd(z, full_matrices=False)[2][:first_dims].T
    p = joint_probabilities(squared_distances(z), perplexity)
    y = np.random.default_rng(seed).normal(0, 1e-4, (len(x), dims))
    speed, gain = np.zeros_like(y), np.ones_like(y)
    for step in range(steps):
        goal = p * 4 if step < 100 else p
        d2 = squared_distances(y)
        num = 1 / (1 + d2) if heavy else np.exp(-d2)
        np.fill_diagonal(num, 0)
        q = np.maximum(num / num.sum(), 1e-12)
        pull = (goal - q) * (num if heavy else 1)
        np.fill_diagonal(pull, 0)
        gradient = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(0.01, np.where(np.sign(gradient) == np.sign(speed), gain * 0.8, gain + 0.2))
        speed = (0.5 if step < 250 else 0.8) * speed - (rate if heavy else rate / 20) * gain * gradient
        y = y + speed
        y -= y.mean(0)
    return _embedding(ds, ids, y)


def _blocked_neighbours(ds: DataFrame, dims: int, perplexity: float, first_dims: int, steps: int, rate: float, heavy: bool, size: int = 0) -> DataFrame:
    """stochastic_neighbours over (sample_id, feat, y) in passes over files of blocks.

    A sample's own width, and the sum of its weights, are a row's numbers: the probabilities of a block's pairs are
    made from them whenever they meet.  A step is two passes: one number, the sum of all nearness in the embedding,
    and then the gradients of the block's rows, whose new places are written as a file of the step."""
    from .learning import pca, project

    rows = ds.filter(whole())
    w, _, mean = pca(rows.select(F.lit(0).alias("cls"), "feat"), first_dims)
    blocks = Blocks(project(rows, w, mean).select("sample_id", F.concat("feat", "y").alias("feat")), size=size or fitting(rows.count()))
    names, at, spark = blocks.listed(), blocks.folder, blocks.spark
    work = f"{shared_folder(spark)}/places-{uuid.uuid4().hex}"
    wide = w.shape[1]
    n = int(summed(spark, names, lambda name: np.array([len(read_block(at, name)[0])]))[0])
    goal = np.log(min(perplexity, max(n - 1, 1) * 0.99 + 1e-9))

    def input_distances(name: str, other: str) -> np.ndarray:
        x, y = read_block(at, name)[1][:, :wide], read_block(at, other)[1][:, :wide]
        d = np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T)
        return d

    def widths(name: str) -> np.ndarray:
        """beta, least distance and sum of weights of each row, by the bisection of joint_probabilities."""
        x = read_block(at, name)[1]
        out = np.zeros((len(x), 3))
        for lo in range(0, len(x), 64):  # all distances of 64 rows at a time
            part = x[lo : lo + 64, :wide]
            d = []
            for other in names:
                y = read_block(at, other)[1][:, :wide]
                e = np.maximum(0, (part * part).sum(1)[:, None] + (y * y).sum(1) - 2 * part @ y.T)
                if other == name:
                    e[np.arange(len(part)), lo + np.arange(len(part))] = np.inf
                d.append(e)
            d = np.concatenate(d, 1)
            for r, row in enumerate(d):
                least = row.min()
                row = row[np.isfinite(row)] - least
                low, high, beta = 0.0, np.inf, 1.0
                for _ in range(60):
                    e = np.exp(-row * beta)
                    total = e.sum()
                    entropy = np.log(total) + beta * (row @ e) / total
                    if abs(entropy - goal) < 1e-6:
                        break
                    if entropy > goal:
                        low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
                    else:
                        high, beta = beta, (beta + low) / 2
                # the sum is that of the last weights, whose beta the loop may have moved on from
                out[lo + r] = (-np.log(e[np.argmax(row)]) / row.max() if 0 < row.max() and e[np.argmax(row)] > 0 else beta), least, total
        store_array(f"{work}/width", name, out)
        y = x[:, wide:]
        store_array(f"{work}/0", name, np.concatenate((y, np.zeros_like(y), np.ones_like(y)), 1))
        return np.zeros(1)

    summed(spark, names, widths)
    centre = np.zeros(dims)
    for step in range(steps):
        here, there = f"{work}/{step}", f"{work}/{step + 1}"

        def nearness(name: str, other: str, here: str = here, centre: np.ndarray = centre) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = (load_array(here, v)[:, :dims] - centre for v in (name, other))
            num = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
            np.maximum(num, 0, out=num)
            num = 1 / (1 + num) if heavy else np.exp(-num)
            if name == other:
                np.fill_diagonal(num, 0)
            return a, b, num

        total = float(summed(spark, names, lambda name, near=nearness: np.array([sum(near(name, other)[2].sum() for other in names)]))[0])

        def move(name: str, near=nearness, total: float = total, step: int = step, here: str = here, there: str = there, centre: np.ndarray = centre) -> np.ndarray:
            beta, least, own = (v[:, None] for v in load_array(f"{work}/width", name).T)
            gradient = 0.0
            for other in names:
                b2, l2, o2 = load_array(f"{work}/width", other).T
                d = input_distances(name, other)
                p = (np.exp((least - d) * beta) / own + np.exp((l2 - d) * b2) / o2) / (2 * n)
                p = np.maximum(p, 1e-12) * (4 if step < 100 else 1)
                a, b, num = near(name, other)
                pull = (p - np.maximum(num / total, 1e-12)) * (num if heavy else 1)
                if name == other:
                    np.fill_diagonal(pull, 0)
                gradient = gradient + 4 * (pull.sum(1)[:, None] * a - pull @ b)
            state = load_array(here, name)
            y, speed, gain = state[:, :dims] - centre, state[:, dims : 2 * dims], state[:, 2 * dims :]
            gain = np.maximum(0.01, np.where(np.sign(gradient) == np.sign(speed), gain * 0.8, gain + 0.2))
            speed = (0.5 if step < 250 else 0.8) * speed - (rate if heavy else rate / 20) * gain * gradient
            store_array(there, name, np.concatenate((y + speed, speed, gain), 1))
            return (y + speed).sum(0)

        centre = summed(spark, names, move) / n
        drop_folder(spark, here)
    last, shift = f"{work}/{steps}", centre
    out = vectors_of(blocks, names, lambda name: load_array(last, name)[:, :dims] - shift)
    drop_folder(spark, work)
    blocks.forget()
    return out


def neighbourhood_components(ds: DataFrame, dims: int = 2, steps: int = 100, rate: float = 0.1, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(w, mean): the linear map whose soft nearest neighbours are most often of the sample's class.  Beyond `most`
    samples the pairs are met block by block in the tasks."""
    if ds.count() > most:
        return _blocked_components(ds, dims, steps, rate)
    ids, x = points(ds, most)
    label = dict(ds.select("sample_id", "cls").collect())
    y = np.array([label[i] for i in ids])
    mean = x.mean(0)
    z = (x - mean) / (np.sqrt(((x - mean) ** 2).sum(1).mean()) + 1e-12)
    scale = np.sqrt(((x - mean) ** 2).sum(1).mean()) + 1e-12
    a = np.linalg.svd(z, full_matrices=False)[2][:dims].T
    same = y[:, None] == y
    best, best_a, gradient = -np.inf, a, 0
    for _ in range(steps):
        d2 = squared_distances(z @ a)
        np.fill_diagonal(d2, np.inf)
        p = np.exp(-(d2 - d2.min(1)[:, None]))
        p /= p.sum(1)[:, None]
        own = (p * same).sum(1)
        if own.sum() > best:
            w = own[:, None] * p - p * same
            w = w + w.T
            best, best_a, rate = own.sum(), a, rate * 1.1
            gradient = 2 * z.T @ (np.diag(w.sum(1)) - w) @ (z @ a)
        else:
            rate /= 2
        a = best_a + rate * gradient
    return best_a / scale, mean


def _blocked_components(ds: DataFrame, dims: int, steps: int, rate: float, size: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """neighbourhood_components in passes over files of blocks.  A task meets its block's rows with all others for the
    sums of their weights, which stay as a file, and, where a step is taken, again for their share of the
    gradient; a number and a features x dims sum leave it.  Pairs are met by tiles that fit a core's cache, whose
    rows are sorted by class, so that the weights of a class's own pairs are slices."""
    from .learning import pca

    ds = ds.select("sample_id", F.coalesce("cls", F.lit(-1)).alias("cls"), "feat").filter(whole())
    a, spread, mean = pca(ds.withColumn("cls", F.lit(0)), dims)
    blocks = Blocks(ds, "cls", size=size or fitting(ds.count()))
    names, folder, spark = blocks.listed(), blocks.folder, blocks.spark
    work = f"{shared_folder(spark)}/weights-{uuid.uuid4().hex}"

    def counted(name: str) -> np.ndarray:
        x = read_block(folder, name)[1]
        return np.array([len(x), ((x - mean) ** 2).sum()])

    n, square = summed(spark, names, counted)
    scale = np.sqrt(square / n) + 1e-12
    a = np.pad(a, ((0, 0), (0, dims - a.shape[1])))

    def sorted_block(name: str, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, x, o = read_block(folder, name)
        c = o["cls"]
        order = np.argsort(c, kind="stable")
        z = (x[order] - mean) / scale
        return z, z @ a, c[order]

    def tiles(name: str, za: np.ndarray, c: np.ndarray, a: np.ndarray, shift: np.ndarray):
        """Tiles of shift less the squared distances, -inf for a row itself: rows, what the other block is, its
        columns, the tile, and the slices whose pairs are of one class."""
        left = np.column_stack((2 * za, shift - (za * za).sum(1), np.full(len(za), -1.0)))
        for other in names:
            zo, ya, o = sorted_block(other, a)
            right = np.column_stack((ya, np.ones(len(ya)), (ya * ya).sum(1))).T
            for at in range(0, len(ya), 1024):
                columns = slice(at, min(at + 1024, len(ya)))
                beside = o[columns]
                for r in range(0, len(za), 64):
                    rows = slice(r, min(r + 64, len(za)))
                    g = left[rows] @ right[:, columns]
                    if other == name:
                        k = np.arange(max(r, at), min(rows.stop, columns.stop))
                        g[k - r, k - at] = -np.inf
                    own = c[rows]
                    ends = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
                    first, last = np.searchsorted(beside, own[ends[:-1]]), np.searchsorted(beside, own[ends[:-1]], "right")
                    same = [(slice(i, j), slice(p, q)) for i, j, p, q in zip(ends[:-1], ends[1:], first, last) if q > p]
                    yield rows, other, (zo, ya), columns, g, same

    def weights(a: np.ndarray) -> float:
        """The sum of the samples' shares of their own class; what the gradient needs of a row stays in a file."""

        def meet(name: str) -> np.ndarray:
            _, za, c = sorted_block(name, a)
            most, total, own = np.full(len(za), -np.inf), np.zeros(len(za)), np.zeros(len(za))
            for rows, _, _, _, g, same in tiles(name, za, c, a, np.zeros(len(za))):
                old = most[rows]
                new = np.maximum(old, g.max(1))
                base = np.where(np.isfinite(new), new, 0)
                fade = np.where(np.isfinite(old), np.exp(old - base), 0)
                g -= base[:, None]
                np.exp(g, out=g)
                mine = own[rows] * fade
                for i, j in same:
                    mine[i] += g[i, j].sum(1)
                total[rows], own[rows], most[rows] = total[rows] * fade + g.sum(1), mine, new
            share = own / np.maximum(total, 1e-300)
            shift = -np.where(np.isfinite(most), most, 0) - np.log(np.maximum(total, 1e-300))
            store_array(work, name, np.stack((share, shift)))
            return np.array([share.sum()])

        return float(summed(spark, names, meet)[0])

    def slope(a: np.ndarray) -> np.ndarray:
        """The gradient at a, whose weights have been made."""

        def meet(name: str) -> np.ndarray:
            z, za, c = sorted_block(name, a)
            share, shift = load_array(work, name)
            one, two = np.column_stack((za, np.ones(len(za)))), share[:, None] * np.column_stack((za, np.ones(len(za))))
            mine, gradient = np.zeros_like(one), np.zeros((z.shape[1], dims))
            theirs, at, known = np.zeros((0, 0)), None, None

            def take() -> np.ndarray:  # the other block's rows, by the weights that the own ones give them
                zo, ya = known
                return zo.T @ (theirs[:, -1:] * ya - theirs[:, :-1])

            for rows, other, block, columns, g, same in tiles(name, za, c, a, shift):
                if other != at:
                    gradient += take() if at is not None else 0.0
                    at, known = other, block
                    theirs, beside = np.zeros((len(block[1]), dims + 1)), np.column_stack((block[1], np.ones(len(block[1]))))
                np.exp(g, out=g)
                part = share[rows, None] * (g @ beside[columns])
                back = g.T @ two[rows]
                for i, j in same:
                    part[i] -= g[i, j] @ beside[columns][j]
                    back[j] -= g[i, j].T @ one[rows][i]
                mine[rows] += part
                theirs[columns] += back
            gradient += take() + z.T @ (mine[:, -1:] * za - mine[:, :-1])
            return gradient

        return 2 * summed(spark, names, meet)

    best, best_a, gradient = -np.inf, a, 0
    for step in range(steps):
        own = weights(a)
        if own > best:
            best, best_a, rate = own, a, rate * 1.1
            gradient = slope(a) if step < steps - 1 else 0
        else:
            rate /= 2
        a = best_a + rate * gradient
    drop_folder(spark, work)
    blocks.forget()
    return best_a / scale, mean


def factor_analysis(ds: DataFrame, dims: int = 2, steps: int = 200, tolerance: float = 1e-6, shared: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loadings, noise variances, mean) by expectation maximisation over the covariance matrix, which
    is all that leaves the data; shared: one noise variance (probabilistic principal components)."""
    from .learning import sums

    s = sums(ds)
    n, total, gram = (sum(v[i] for v in s.values()) for i in range(3))
    mean = total / n
    c = gram / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(c)
    load = vectors[:, ::-1][:, :dims] * np.sqrt(np.maximum(values[::-1][:dims], 1e-9))
    noise = np.maximum(np.diag(c) * 0.5, 1e-9)
    for _ in range(steps):
        inv = np.linalg.inv(load @ load.T + np.diag(noise))
        b = load.T @ inv
        second = np.eye(dims) - b @ load + b @ c @ b.T
        new = c @ b.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(c - new @ b @ c), 1e-9)
        if shared:
            noise = np.full_like(noise, noise.mean())
        moved = np.abs(new - load).max()
        load = new
        if moved < tolerance:
            break
    return load, noise, mean


def intrinsic_dimension(near: DataFrame, k: int) -> DataFrame:
    """(mle): the mean over samples of the inverse mean log ratio of the k-th to nearer neighbours'
    distances, from rows (probe_id, rank, gallery_id, d2) of a neighbour search."""
    last = near.filter(F.col("rank") == k).select("probe_id", F.col("d2").alias("_last"))
    ratio = 0.5 * F.ln(F.col("_last") / F.col("d2"))
    per = near.filter((F.col("rank") < k) & (F.col("d2") > 0)).join(last, "probe_id").groupBy("probe_id").agg((1 / F.avg(ratio)).alias("m"))
    return per.agg(F.avg("m").alias("mle"))


def correlation_dimension(near: DataFrame) -> DataFrame:
    """(dimension): growth of the number of neighbour pairs between their median and greatest distance."""
    marks = near.agg(F.percentile("d2", 0.5).alias("mid"), F.max("d2").alias("far"))
    within = near.join(F.broadcast(marks)).agg(F.count("*").alias("all"), F.sum((F.col("d2") <= F.col("mid")).cast("int")).alias("half"), F.first("mid").alias("mid"), F.first("far").alias("far"))
    return within.select((F.ln(F.col("all") / F.col("half")) / (0.5 * F.ln(F.col("far") / F.col("mid")))).alias("dimension"))


def surface(spark, kind: str, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Points of synthetic surfaces: broken swiss roll, three clusters, two crossing curves, or a
    ten-dimensional grid of five parameters."""
    u, v = ((F.col("id") * 7919) % n) / float(n), ((F.col("id") * 104729) % n) / float(n)
    if kind == "broken_swiss":
        t = 1.5 * np.pi * (1 + 2 * F.when(u < 0.5, u * 0.8).otherwise(0.6 + (u - 0.5) * 0.8))
        p = [t * F.cos(t), 30 * v, t * F.sin(t)]
    elif kind == "clusters":
        k = F.col("id") % 3
        p = [10 * F.when(k == j, F.lit(1.0)).otherwise(0.0) + F.sin(F.col("id") * (j + 1)) for j in range(3)]
    elif kind == "intersect":
        t = 2 * np.pi * u
        p = [F.cos(t), F.cos(t) * F.sin(t), 3 * v]
    elif kind == "difficult":
        q = [F.pmod(F.floor(F.col("id") / 3**j), F.lit(3)) / 2.0 for j in range(5)]
        p = [F.cos(q[0]), F.tanh(3 * q[1]), q[0] + q[2], q[3] * F.sin(q[1]), F.sin(q[0] + q[4]), q[4] * F.cos(q[1]), q[4] + q[3], q[1], q[2] * q[3], q[0]]
    else:
        raise ValueError(f"unknown surface {kind}")
    moved = [c.cast("double") + (noise * gaussian_noise(F.col("id"), F.lit(j), seed=seed) if noise else 0.0) for j, c in enumerate(p)]
    return spark.range(n).select(F.col("id").alias("sample_id"), F.array(*moved).alias("feat"))


def neighbour_dimension(near: DataFrame, first: int, last: int) -> DataFrame:
    """(dimension): the reciprocal slope of the log mean distance to the k-th neighbour over log k."""
    mean = near.filter(F.col("rank").between(first, last)).groupBy("rank").agg(F.ln(F.avg(F.sqrt("d2"))).alias("y")).withColumn("x", F.ln("rank"))
    return mean.agg((1 / F.regr_slope("y", "x")).alias("dimension"))


def eigen_dimension(ds: DataFrame, least: float = 0.025) -> int:
    """The number of principal variances of at least that share of the greatest."""
    from .learning import pca

    values = pca(ds)[1]
    return int((values >= least * values.max()).sum()) if len(values) else 0
