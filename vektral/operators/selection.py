"""Feature selection by mutual information, and linear maps from local tangents: sums of the features' size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import whole
from .learning import added, sums
from .neighbours import around


def level_counts(ds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(classes, counts): how often each class and each level of each feature meet each level of each other feature,
    in one matrix product of indicator columns: first the classes, then three levels a feature (under, within
    and over one standard deviation around the mean)."""
    s = sums(ds)
    if not s:
        return np.zeros(0, int), np.zeros((0, 0))
    n, total, gram = (sum(v[i] for v in s.values()) for i in range(3))
    classes, mean = np.array(list(s)), total / n
    spread = np.sqrt(np.maximum(np.diag(gram) / n - mean**2, 0))
    wide = len(classes) + 3 * len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((wide, wide))
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                level = 1 + (x > mean + spread) - (x < mean - spread).astype(int)
                one = np.concatenate([np.asarray(batch.column(0))[:, None] == classes, (level[:, :, None] == np.arange(3)).reshape(len(x), -1)], axis=1).astype(float)
                out += one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    return classes, added(ds.select("cls", "feat").mapInArrow(run, "v array<double>"), wide * wide).reshape(wide, wide)


def mutual_information(joint: np.ndarray) -> float:
    p = joint / joint.sum()
    a, b = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
    on = p > 0
    return float((p[on] * np.log(p[on] / (a @ b)[on])).sum())


def relevant_features(ds: DataFrame, count: int) -> list[tuple[int, float]]:
    """(feature from 0, score), in the order in which they are chosen: each the feature of greatest mutual information
    with the class, less its mean mutual information with those chosen before; ties to the smaller.  All samples
    with a class and a vector count; features are in three levels."""
    classes, counts = level_counts(ds.filter(F.col("cls").isNotNull() & (F.size("feat") > 0)))
    k = len(classes)
    d = (len(counts) - k) // 3
    place = lambda j: slice(k + 3 * j, k + 3 * j + 3)
    relevance = np.array([mutual_information(counts[:k, place(j)]) for j in range(d)])
    shared = np.array([[mutual_information(counts[place(i), place(j)]) for j in range(d)] for i in range(d)])
    chosen: list[tuple[int, float]] = []
    while len(chosen) < min(count, d):
        score = relevance - (shared[:, [j for j, _ in chosen]].mean(1) if chosen else 0)
        score[[j for j, _ in chosen]] = -np.inf
        best = int(np.flatnonzero(score >= score.max() - 1e-12)[0])
        chosen.append((best, float(score[best])))
    return chosen


def tangent_map(ds: DataFrame, dims: int, k: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(directions, mean) of the linear map that best keeps the samples' local tangent coordinates.

    A neighbourhood is a sample and its k nearest; what its dims main directions don't explain of it, as a
    matrix of its samples, is taken between their vectors at once, so that a task gives back features x
    features numbers and no matrix over the samples is made.  The directions of least sum against the scatter are
    the map.  Samples without a whole vector take no part."""
    ds = ds.filter(whole())
    s = sums(ds.select(F.lit(0).alias("cls"), "feat"))
    n, total, gram = s[0]
    mean, size = total / n, len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, size))
        for batch in batches:
            for row in batch.column(0):
                x = np.asarray(row.values, float).reshape(-1, size) - mean
                u = np.linalg.svd(x - x.mean(0), full_matrices=False)[0][:, :dims]
                g = np.column_stack([np.full(len(x), 1 / np.sqrt(len(x))), u])
                rest = x - g @ (g.T @ x)
                out += x.T @ rest
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    b = added(around(ds, k).mapInArrow(run, "v array<double>"), size * size).reshape(size, size)
    values, vectors = np.linalg.eigh(gram - n * np.outer(mean, mean))
    good = values > 1e-10 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    w = root @ np.linalg.eigh(root.T @ ((b + b.T) / 2) @ root)[1][:, :dims]
    return w * np.where(w[np.abs(w).argmax(0), np.arange(w.shape[1])] < 0, -1, 1), mean
