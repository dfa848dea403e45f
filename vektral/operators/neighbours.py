"""Distances between two sets of vectors, in blocks: recognition, neighbour graphs, affinities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block, Blocks, over_pairs
from .graphs import cut


def nearest(probes: DataFrame, gallery: DataFrame, k: int = 1, block: int = 4096, skip_self: bool = False, distance: Callable | None = None) -> DataFrame:
    """(probe_id, rank, gallery_id, d2): the k gallery samples of least squared Euclidean distance, ties
    to the smaller id.  Both sides are written once in blocks; a task takes a block of probes past blocks of the
    gallery, a matrix product each, and keeps k rows a probe over all of them, so neither side has to fit a task
    or a broadcast and none is copied by a shuffle.  Of a product all within its rounding error of the k-th are
    compared exactly, so copies keep the order of their ids.

    distance, a numpy function of a probe and a matrix of gallery rows, replaces the Euclidean one; d2 is then
    what it gives.

    Vectors that are null or empty or hold null or non-finite components take no part; probes meet
    gallery samples of their own length only."""
    right = Blocks(gallery, size=block)
    left = right if probes is gallery else Blocks(probes, size=min(block, 2048))

    def start(one: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(one[0])
        return np.zeros(n, int), np.zeros((n, k), np.int64), np.full((n, k), np.inf)  # how many, which, how far

    def meet(known: tuple, one: Block, other: Block) -> tuple:
        (xi, x, _), (yi, y, _) = one, other
        y2, error = (y * y).sum(1), 8 * np.finfo(float).eps * (y.shape[1] + 2)
        for lo in range(0, len(x), 256):
            q, (many, ids, far) = x[lo : lo + 256], (m[lo : lo + 256] for m in known)
            q2 = (q * q).sum(1)
            d = q2[:, None] + y2 - 2 * q @ y.T if distance is None else np.stack([distance(v, y) for v in q])
            doubt = error * (q2 + y2.max()) if distance is None else 0.0
            last = min(len(y), k + skip_self) - 1
            limit = np.where(many < k, np.inf, far[:, -1])
            if (many < k).any():
                limit = np.minimum(limit, np.partition(d, last, axis=1)[:, last])
            r, c = np.nonzero(d <= (limit + doubt)[:, None])
            if skip_self:
                other_one = yi[c] != xi[lo + r]
                r, c = r[other_one], c[other_one]
            if not len(r):
                continue
            some = [slice(i, i + 32768) for i in range(0, len(r), 32768)]
            exact = np.concatenate([((q[r[i]] - y[c[i]]) ** 2).sum(1) for i in some]) if distance is None else d[r, c]
            old_r, old_c = np.nonzero(np.arange(k) < many[:, None])
            row, to, size = np.append(old_r, r), np.append(ids[old_r, old_c], yi[c]), np.append(far[old_r, old_c], exact)
            order = np.lexsort((to, size, row))
            row, to, size = row[order], to[order], size[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, to, size, place = (v[place < k] for v in (row, to, size, place))
            ids[row, place], far[row, place] = to, size
            many[:] = np.bincount(row, minlength=len(q))
        return known

    def finish(known: tuple, one: Block) -> pa.RecordBatch:
        r, c = np.nonzero(np.arange(k) < known[0][:, None])
        return pa.RecordBatch.from_arrays([pa.array(one[0][r], pa.int64()), pa.array(known[1][r, c]), pa.array(known[2][r, c])], names=["probe_id", "gallery_id", "d2"])

    found = cut(over_pairs(left, right, start, meet, finish, "probe_id long, gallery_id long, d2 double"))
    for side in {left, right}:
        side.forget()
    order = Window.partitionBy("probe_id").orderBy("d2", "gallery_id")  # k rows for each 64 blocks
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("probe_id", F.col("rank").cast("int").alias("rank"), "gallery_id", "d2")


def recognize(probes: DataFrame, gallery: DataFrame, distance: Callable | None = None) -> DataFrame:
    """(sample_id, cls, predicted, d2) by the nearest gallery sample."""
    hit = nearest(probes, gallery, distance=distance).select(F.col("probe_id").alias("sample_id"), F.col("gallery_id").alias("_g"), "d2")
    named = gallery.select(F.col("sample_id").alias("_g"), F.col("cls").alias("predicted"))
    return probes.select("sample_id", "cls").join(hit, "sample_id").join(named, "_g").select("sample_id", "cls", "predicted", "d2")


def neighbour_graph(ds: DataFrame, k: int) -> DataFrame:
    """Symmetric edges (src, dst, d2) of the k nearest neighbours, self excluded."""
    one = nearest(ds, ds, k, skip_self=True).select(F.col("probe_id").alias("src"), F.col("gallery_id").alias("dst"), "d2")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2")).groupBy("src", "dst").agg(F.min("d2").alias("d2"))


def around(ds: DataFrame, k: int) -> DataFrame:
    """(x): for each sample its vector and those of its k nearest, nearest first, end to end."""
    near = nearest(ds, ds, k, skip_self=True).select(F.col("probe_id").alias("_p"), "rank", F.col("gallery_id").alias("sample_id"))
    own = ds.select(F.col("sample_id").alias("_p"), F.lit(0).alias("rank"), "sample_id")
    rows = own.unionByName(near).join(ds.select("sample_id", "feat"), "sample_id")
    return rows.groupBy("_p").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feat"))), lambda x: x["feat"])).alias("x")).select("x")  # k + 1 vectors


def affinity(edges: DataFrame, kind: str, t: float = 1.0) -> DataFrame:
    """Weights of neighbour edges: binary, heat exp(-d2 / 2t2), or cosine (of edges between unit vectors)."""
    w = {"binary": F.lit(1.0), "heat": F.exp(-F.col("d2") / (2 * t * t)), "cosine": 1 - F.col("d2") / 2}[kind]
    return edges.select("src", "dst", w.alias("w"))


def supervised_affinity(ds: DataFrame) -> DataFrame:
    """(sample_id, cls, w): samples of one class are tied with w = 1 / n_c.  The ties are given by their
    factors, a row for each sample, since the weights of a class are all the same; no pairs are made."""
    n = ds.groupBy("cls").agg(F.count("*").alias("n"))
    return ds.join(n, "cls").select("sample_id", "cls", (1 / F.col("n")).alias("w"))
