"""A metric of large margins: samples near their own class's nearest ones, others' farther by a margin."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, over_pairs, squared_distances, summed_pairs, whole
from .graphs import cut


def _size(ds: DataFrame) -> int:
    """Rows of a block: small inputs spread over the cores."""
    return min(4096, max(256, -(-ds.count() // 24)))


def target_neighbours(ds: DataFrame, k: int = 3, size: int | None = None) -> DataFrame:
    """(sample_id, target_id, rank): the k nearest samples of a sample's own class, ties to the smaller id; of
    classes of fewer samples all others.  Blocks hold few classes and meet those of the same ones only; they
    keep k candidates a sample, which Spark ranks."""
    blocks = Blocks(ds, "cls", size=size or _size(ds), by="cls")

    def start(block):
        return np.full((len(block[0]), k), np.inf), np.full((len(block[0]), k), np.iinfo(np.int64).max)

    def meet(known, one, other):
        (i, x, a), (j, y, b) = one, other
        best, who = known
        for lo in range(0, len(i), 256):
            d, error = squared_distances(x[lo : lo + 256], y)
            same = (a["cls"][lo : lo + 256, None] == b["cls"]) & (i[lo : lo + 256, None] != j)
            d = np.where(same, d, np.inf)
            bound = np.minimum(best[lo : lo + 256, -1], np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1] + error)
            for r in range(len(d)):
                c = np.flatnonzero(d[r] <= bound[r] + error[r])
                c = c[np.isfinite(d[r][c])]
                if len(c):
                    exact = np.concatenate((best[lo + r], ((x[lo + r] - y[c]) ** 2).sum(1)))
                    ids = np.concatenate((who[lo + r], j[c]))
                    first = np.lexsort((ids, exact))[:k]
                    best[lo + r], who[lo + r] = exact[first], ids[first]
        return best, who

    def finish(known, block):
        best, who = known
        row, col = np.nonzero(np.isfinite(best))
        return pa.RecordBatch.from_arrays([pa.array(block[0][row]), pa.array(who[row, col]), pa.array(best[row, col])], names=["sample_id", "target_id", "d2"])

    found = over_pairs(blocks, blocks, start, meet, finish, "sample_id long, target_id long, d2 double", same=True)
    rank = F.slice(F.array_sort(F.collect_list(F.struct("d2", "target_id"))), 1, k)  # k a slice of the blocks
    out = cut(found.groupBy("sample_id").agg(rank.alias("t")).select("sample_id", F.posexplode("t").alias("rank", "t")))
    blocks.forget()
    return out.select("sample_id", F.col("t.target_id").alias("target_id"), (F.col("rank") + 1).cast("int").alias("rank"))


@dataclass
class MarginMetric:
    """The map (dims x dims) under which distances are taken, and the loss after each step."""

    transform: np.ndarray
    losses: list[float]


def _tally(on: np.ndarray, axis: int, most: int = 1) -> np.ndarray:
    """Sums of small whole numbers (bytes up to most) along rows or columns, added as bytes while these hold them."""
    if axis:  # eight columns at once; their number is a multiple of eight and at most 2040
        words = np.add.reduce(on.view(np.uint64), axis=1)
        return words.view(np.uint8).reshape(len(on), 8).sum(1, dtype=np.int64)
    step = 255 // most
    return sum(np.add.reduce(on[lo : lo + step], axis=0, dtype=np.uint8).astype(np.int64) for lo in range(0, len(on), step))


class _Side:
    """A block under a metric: vectors from the middle, gaps to the targets, and how near (1 added) those are;
    rows are filled up to a multiple of eight by ones that are far from all."""

    def __init__(self, block, middle: np.ndarray, m: np.ndarray, k: int):
        _, wide, more = block
        n, dims = len(wide), len(m)
        full = -n % 8
        self.cls = np.asarray(more["cls"])
        self.x = np.pad(wide[:, :dims] - middle, ((0, full), (0, 0)))
        self.gaps = wide[:, dims:].reshape(n, k, dims)
        there = self.gaps[:, :, 0] < 1e299
        if not there.all():
            self.gaps = np.where(there[:, :, None], self.gaps, 0)
        flat = self.gaps.reshape(-1, dims)
        reach = 1 + np.einsum("ij,ij->i", flat @ m, flat).reshape(n, k)
        self.reach = np.pad(np.where(there, reach, -np.inf), ((0, full), (0, 0)), constant_values=-np.inf)
        self.mx = self.x @ m
        self.own = (self.mx * self.x).sum(1)
        self.far = np.where(np.arange(n + full) < n, self.own, 1e30)
        self.n, self.dims = n, dims
        self.one_class = self.cls[0] if (self.cls == self.cls[0]).all() else None

    def wide(self, kind) -> tuple[np.ndarray, np.ndarray]:
        """Two forms of the block: one's rows by another's are the squared distances."""
        one = np.ones(len(self.x))
        return np.column_stack((-2 * self.mx, self.far, one)).astype(kind), np.column_stack((self.x, one, self.far)).astype(kind)

    def pulled(self, counts: np.ndarray) -> np.ndarray:
        """Sum of the gaps' products with themselves, each as often as it has a hinge above 0."""
        g = self.gaps.reshape(-1, self.dims)
        return (g * counts[: self.n].reshape(-1, 1)).T @ g


def _impostors(one: _Side, other: _Side | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of two blocks, or of one (other is None): numbers of hinges above 0 for each sample and target of
    both, and the sum of (x - y)(x - y)' over these hinges.

    A pair's distance is made once for the hinges of both its samples.  It's in single precision where that is right to
    1e-4 of the margin: then only hinges that small can be taken for 0 or below, and what is summed is in
    double precision all the same."""
    both = other is not None
    other = other if both else one
    k, dims = one.reach.shape[1], one.dims
    kind = np.float32 if 4 * np.finfo(np.float32).eps * max(one.own.max(), other.own.max()) <= 1e-4 else np.float64
    left, right = one.wide(kind)[0], other.wide(kind)[1]
    mine, theirs = one.reach.astype(kind), np.ascontiguousarray(other.reach.T.astype(kind))
    beside = np.column_stack((other.x, np.ones(len(other.x))))
    apart = None
    if one.one_class is None or other.one_class is None or one.one_class == other.one_class:
        apart = np.zeros((len(one.x), len(other.x)), bool)
        apart[: one.n, : other.n] = one.cls[:, None] != other.cls
    here, there = np.zeros((len(one.x), k), np.int64), np.zeros((len(other.x), k), np.int64)
    sums = np.zeros((len(one.x), dims + 1))
    columns = np.zeros(len(other.x), np.int64)
    for lo in range(0, len(one.x), 256):
        s = slice(lo, lo + 256)
        for at in range(0, len(other.x), 1024):
            t = slice(at, at + 1024)
            d = left[s] @ right[t].T
            active = np.zeros(d.shape, np.uint8)
            for r in range(k):
                on = d < mine[s, r, None]
                if apart is not None:
                    on &= apart[s, t]
                here[s, r] += _tally(on, 1)
                active += on.view(np.uint8)
                if both:
                    on = d < theirs[r, t]
                    if apart is not None:
                        on &= apart[s, t]
                    there[t, r] += _tally(on.view(np.uint8), 0)
                    active += on.view(np.uint8)
            if active.any():
                sums[s] += active.astype(float) @ beside[t]
                columns[t] += _tally(active, 0, 2 * k)
    mixed = one.x.T @ sums[:, :dims]
    return here, there, (one.x * sums[:, dims:]).T @ one.x + (other.x * columns[:, None]).T @ other.x - mixed - mixed.T


def large_margin_metric(ds: DataFrame, k: int = 3, steps: int = 20, push: float = 0.5, rate: float = 0.0, size: int | None = None) -> MarginMetric:
    """The positive semidefinite metric M of least (1 - push) * pull + push * hinges: pull is the sum of the squared
    distances of samples from their target neighbours, a hinge is 1 + that distance less the distance
    from a sample of another class, where it is above 0.

    Each step is one pass over the unordered pairs of blocks of different classes: impostors are those within the largest
    margin of a sample, and only their share of the loss and a dims x dims sum leave the task; no table of pairs
    or triplets is made.  Distances are linear in M, so the sum of the hinges above 0 is their number and the product of M
    with their slope, and nothing but numbers is added up pair by pair.  M goes down the subgradient, loses its
    negative part, and the rate halves where the loss rises."""
    if not 1 <= k <= 127:
        raise ValueError("k is 1 to 127")
    dims = ds.filter(whole()).select(F.max(F.size("feat"))).first()[0] or 0
    if not dims:
        return MarginMetric(np.zeros((0, 0)), [])
    ds = ds.filter(F.col("cls").isNotNull() & whole() & (F.size("feat") == dims))
    size = size or _size(ds)
    targets = target_neighbours(ds, k, size)
    near = targets.join(ds.select(F.col("sample_id").alias("target_id"), F.col("feat").alias("t")), "target_id")
    near = near.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("t"))  # k vectors
    # the differences from the targets stand behind the vector; missing ones are 1e300
    vector = ds.select("sample_id", "cls", "feat").join(near, "sample_id", "left")
    gap = lambda r: F.coalesce(F.zip_with(F.get("t", F.lit(r))["t"], "feat", lambda a, b: a - b), F.array_repeat(F.lit(1e300), dims))
    rows = cut(vector.select("sample_id", "cls", F.concat("feat", *[gap(r) for r in range(k)]).alias("feat")))
    samples = Blocks(rows, "cls", size=size, by="cls")

    def sums(batches):
        n, total, products = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            wide = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            g = wide[:, dims:].reshape(-1, dims)
            g = g[g[:, 0] < 1e299]
            n, total, products = n + len(wide), total + wide[:, :dims].sum(0), products + g.T @ g
        every = np.concatenate(([n], total, products.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every), dtype=np.int32)), pa.array(every)], names=["i", "v"])

    every = np.zeros(1 + dims + dims * dims)
    for r in rows.select("feat").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        every[r["i"]] = r["v"]
    middle, pull = every[1 : 1 + dims] / max(1, every[0]), every[1 + dims :].reshape(dims, dims)

    def passed(m: np.ndarray) -> tuple[float, np.ndarray]:
        def meet(block, others):
            one = _Side(block, middle, m, k)
            counts, products, hinges = np.zeros(one.reach.shape, np.int64), np.zeros((dims, dims)), 0
            for b in others:
                other = b and _Side(b, middle, m, k)
                here, there, between = _impostors(one, other)
                counts += here
                products -= between
                if other:
                    products += other.pulled(there)
                    hinges += there.sum()
            return np.concatenate(([hinges + counts.sum()], (products + one.pulled(counts)).ravel()))

        got = summed_pairs(samples, meet)
        slope = push * got[1:].reshape(dims, dims) + (1 - push) * pull
        return push * got[0] + float((slope * m).sum()), slope  # a hinge is 1 and the product of M with its slope

    m = np.eye(dims)
    loss, grad = passed(m)
    rate = rate or 1 / max(np.linalg.norm(grad), 1e-12)
    losses = [loss]
    for _ in range(steps):
        values, vectors = np.linalg.eigh(m - rate * (grad + grad.T) / 2)
        new = (vectors * np.maximum(values, 0)) @ vectors.T
        after, slope = passed(new)
        if after < loss:
            small = loss - after <= 1e-6 * max(loss, 1e-12)
            m, loss, grad, rate = new, after, slope, rate * 1.5
            losses.append(loss)
            if small:
                break
        else:
            rate /= 2
    samples.forget()
    values, vectors = np.linalg.eigh(m)
    return MarginMetric(vectors * np.sqrt(np.maximum(values, 0)), losses)
