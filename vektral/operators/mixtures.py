"""Mixtures of factor analysers and the global coordinates that their local ones are joined to.

A step of the fit is one pass: a task sums, for each component, its samples and their products with the local
coordinates, components * features * (dims + 2) numbers, so nothing that grows with the samples leaves it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import whole
from .graphs import cut
from .learning import added, kmeans, sums
from .neighbours import around


@dataclass
class Mixture:
    """Components with a share, loadings (features x dims), a mean and a noise variance for each feature."""

    share: np.ndarray
    load: np.ndarray
    mean: np.ndarray
    noise: np.ndarray

    def local(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log density of each row, its responsibilities, and its coordinates in each component."""
        k, d, q = self.load.shape
        log, z = np.empty((len(x), k)), np.empty((len(x), k, q))
        for j in range(k):
            y = x - self.mean[j]
            weighted = y / self.noise[j]
            inner = self.inner(j)
            b = weighted @ self.load[j]
            z[:, j] = np.linalg.solve(inner, b.T).T
            spread = np.log(self.noise[j]).sum() + np.linalg.slogdet(inner)[1]
            log[:, j] = np.log(self.share[j]) - 0.5 * (d * np.log(2 * np.pi) + spread + (y * weighted).sum(1) - (b * z[:, j]).sum(1))
        top = log.max(1, keepdims=True)
        density = top[:, 0] + np.log(np.exp(log - top).sum(1))
        return density, np.exp(log - density[:, None]), z

    def inner(self, j: int) -> np.ndarray:
        """Precision of a component's coordinates, given a sample."""
        return np.eye(self.load.shape[2]) + self.load[j].T @ (self.load[j] / self.noise[j][:, None])

    def features(self, x: np.ndarray) -> np.ndarray:
        """Each row's coordinates in all components and a one for each, times its responsibilities."""
        _, r, z = self.local(x)
        return (r[:, :, None] * np.concatenate([z, np.ones((*r.shape, 1))], 2)).reshape(len(x), -1)


def _rows(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
    return np.asarray(batch.column(at).flatten(), float).reshape(batch.num_rows, -1)


def _one(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])


def mixture(ds: DataFrame, components: int, dims: int, steps: int = 50, tolerance: float = 1e-6, start: Mixture | None = None, seed: int = 1) -> tuple[Mixture, list[tuple[float, float]]]:
    """(mixture, history): fitted by expectation maximisation over all samples that have a whole vector, all of
    one size.  The history gives each step's mean log density before it, and the sum of all responsibilities;
    the steps end once the density rises by less than the tolerance.

    Without a start, means are centres of a few k-means steps, loadings and noise the main directions of the
    whole scatter and what these leave.  Noise stays above a millionth of the mean variance; a component that
    lost its samples keeps its place with a share near zero.  No samples give no components."""
    rows = cut(ds.filter(whole()).select("sample_id", "feat"))
    s = sums(rows.select(F.lit(0).alias("cls"), "feat"))
    if not s:
        return Mixture(np.zeros(0), np.zeros((0, 0, dims)), np.zeros((0, 0)), np.zeros((0, 0))), []
    n, total, gram = s[0]
    scatter = gram / n - np.outer(total / n, total / n)
    least = 1e-6 * max(float(np.trace(scatter)) / len(total), 1e-12)
    if start is None:
        centres, _ = kmeans(rows, components, 5, seed)
        values, vectors = np.linalg.eigh(scatter)
        load = vectors[:, ::-1][:, :dims] * np.sqrt(np.maximum(values[::-1][:dims], 0) / len(centres))
        noise = np.maximum(np.diag(scatter) - (load**2).sum(1), least)
        copies = lambda v: np.repeat(v[None], len(centres), 0)
        start = Mixture(np.full(len(centres), 1 / len(centres)), copies(load), centres, copies(noise))
    now, history = start, []
    k, d, q = now.load.shape
    size = d * (q + 1) + (q + 1) ** 2 + d
    for _ in range(steps):

        def run(batches: Iterator[pa.RecordBatch], now: Mixture = now) -> Iterator[pa.RecordBatch]:
            head, out = np.zeros(2), np.zeros((k, size))
            spread = [np.linalg.inv(now.inner(j)) for j in range(k)]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _rows(batch)
                density, r, z = now.local(x)
                head += density.sum(), r.sum()
                for j in range(k):
                    w = np.column_stack([z[:, j], np.ones(len(x))])
                    wr = w * r[:, j : j + 1]
                    second = w.T @ wr
                    second[:q, :q] += r[:, j].sum() * spread[j]
                    out[j] += np.concatenate([(x.T @ wr).ravel(), second.ravel(), (x * x).T @ r[:, j]])
            yield _one(np.concatenate([head, out.ravel()]))

        got = added(rows.select("feat").mapInArrow(run, "v array<double>"), 2 + k * size)
        history.append((float(got[0] / n), float(got[1])))
        if len(history) > 1 and history[-1][0] - history[-2][0] < tolerance:
            break
        new = Mixture(*(v.copy() for v in (now.share, now.load, now.mean, now.noise)))
        for j, v in enumerate(got[2:].reshape(k, size)):
            cross, second, square = v[: d * (q + 1)].reshape(d, q + 1), v[d * (q + 1) : -d].reshape(q + 1, q + 1), v[-d:]
            held = second[q, q]
            new.share[j] = max(held / n, 1e-12)
            if held < 1e-8:
                continue
            both = np.linalg.solve(second, cross.T).T
            new.load[j], new.mean[j] = both[:, :q], both[:, q]
            new.noise[j] = np.maximum((square - (both * cross).sum(1)) / held, least)
        now = new
    return now, history


def aligned(ds: DataFrame, mix: Mixture, dims: int, neighbours: int = 0, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(map, shift): global coordinates are (mix.features(x) - shift) @ map, with unit covariance over the samples.

    Without neighbours, components shall say the same of the samples that they share: what counts is the squared
    difference of two components' places for a sample, by both responsibilities.  With neighbours, a sample shall lie
    where the weights that rebuild it from so many nearest samples put it.  Either is a matrix of components * (dims +
    1) rows, summed in tasks; the directions of least sum are taken, the constant one left out, the greatest
    entry of each positive."""
    rows = ds.filter(whole())
    k, d, q = mix.load.shape
    m = k * (q + 1)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, gram, apart = 0, np.zeros(m), np.zeros((m, m)), np.zeros((m, m))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch)
            _, r, z = mix.local(x)
            w = np.concatenate([z, np.ones((*r.shape, 1))], 2)
            u = (r[:, :, None] * w).reshape(len(x), m)
            count, total, gram = count + len(x), total + u.sum(0), gram + u.T @ u
            for j in range(k):
                at = slice(j * (q + 1), (j + 1) * (q + 1))
                apart[at, at] += (w[:, j] * r[:, j : j + 1]).T @ w[:, j]
        yield _one(np.concatenate([[count], total, gram.ravel(), (apart - gram).ravel()]))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((m, m))
        for batch in batches:
            rest = []
            for row in batch.column(0):
                x = np.asarray(row.values, float).reshape(-1, d)
                if len(x) > 1:
                    away = x[1:] - x[0]
                    g = away @ away.T
                    w = np.linalg.solve(g + ridge * max(np.trace(g), 1e-12) * np.eye(len(g)), np.ones(len(g)))
                    u = mix.features(x)
                    rest.append(u[0] - w @ u[1:] / w.sum())
            if rest:
                out += np.array(rest).T @ np.array(rest)
        yield _one(out)

    got = added(rows.select("feat").mapInArrow(scatter, "v array<double>"), 1 + m + 2 * m * m)
    n, total, gram, cost = got[0], got[1 : m + 1], got[m + 1 : m + 1 + m * m].reshape(m, m), got[m + 1 + m * m :].reshape(m, m)
    if neighbours:
        cost = added(around(rows.select("sample_id", "feat"), neighbours).mapInArrow(rebuilt, "v array<double>"), m * m).reshape(m, m)
    shift = total / max(n, 1)
    values, vectors = np.linalg.eigh(gram / max(n, 1) - np.outer(shift, shift))
    good = values > 1e-10 * max(values.max(initial=0), 1e-300)
    root = vectors[:, good] / np.sqrt(values[good])
    w = root @ np.linalg.eigh(root.T @ ((cost + cost.T) / 2) @ root)[1][:, :dims]
    return w * np.where(w[np.abs(w).argmax(0), np.arange(w.shape[1])] < 0, -1, 1), shift


def coordinates(ds: DataFrame, mix: Mixture, w: np.ndarray, shift: np.ndarray) -> DataFrame:
    """feat becomes its global coordinates; any vector of the same size has some, so new samples need no new fit.
    Samples without a whole vector are left out, other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("feat")
            y = (mix.features(_rows(batch, at)) - shift) @ w if batch.num_rows else np.zeros((0, w.shape[1]))
            feat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([feat if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return ds.filter(whole()).mapInArrow(run, ds.schema)
