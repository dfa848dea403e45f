"""Approximate nearest neighbours: a forest of random-projection trees with a shared priority queue.

The rows are dealt to shards by a hash.  A shard grows its trees over all its rows, once, as a file of
the shared folder (a node splits its rows by a random direction between two of them, at the median).
Queries are dealt to blocks, files too, and a task takes one pair of a shard and a block after the other,
so neither side is copied by a shuffle.  A query's search begins at the roots of all trees: one queue
over all of them hands out the node with the greatest margin, an inner node gives its two children back
with the lesser of its own margin and theirs, and a leaf gives its rows, until enough candidates are met.
A child never goes before its parent, so leaves leave the queue in the order of their least margins (where these
are equal, by their places).  That order is made for many queries at once: one product gives all margins, a
pass over the levels the leaves'.
These are ranked by the exact measure on the original vectors in double precision.  How many candidates
are enough is found by an audit for each pair: queries searched by brute force in the shard; the number
doubles until the recall asked for is reached.  The shards' best are merged by a window per query.

Inner products are turned into angles by one more component that fills each row up to the greatest
norm of the shard.

Defined results: vectors that are null, empty, zero or hold null or non-finite components are neither
queries nor candidates; with fewer than k candidates all are returned; ties go to the smaller vec_id,
and equal vectors have equal scores wherever they stand; rows that repeat a vec_id are candidates of
their own, but none of a query of that vec_id; different vectors that share a vec_id are queries of their
own, with ranks of their own; a null vec_id is neither; a query is compared with vectors of its own
length; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import every_pair, forget_path, get_file, new_path, put_file, release, written
from .near_embeddings import PART, clean, matrix


class Forest:
    """Trees over the rows of v.  Inner nodes of all trees are numbered from 0, leaf k is node -1 - k."""

    ARRAYS = {"normals": np.float32, "offsets": np.float32, "children": np.int32, "roots": np.int32, "rows": np.int32, "ends": np.int64, "radius": np.float32}

    def __init__(self, v: np.ndarray, ids: np.ndarray, trees: int = 0, leaf: int = 64, seed: int = 17, grown: dict | None = None):
        self.v, self.ids = v, ids
        if grown:
            for name, kind in self.ARRAYS.items():
                setattr(self, name, np.frombuffer(grown[name], kind))
            self.normals, self.children = self.normals.reshape(-1, v.shape[1] + 1), self.children.reshape(-1, 2)
        else:
            self._grow(trees, leaf, np.random.default_rng(seed))
        with np.errstate(all="ignore"):
            self.far = np.sqrt(np.einsum("ij,ij->i", v, v).max(initial=0))
        self.lengths = np.diff(self.ends, prepend=0)
        self.levels, level = [], self.roots[self.roots >= 0]
        while len(level):
            self.levels.append(level)
            level = self.children[level].ravel()
            level = level[level >= 0]

    def _grow(self, trees: int, leaf: int, rng: np.random.Generator) -> None:
        size = np.abs(self.v).max(initial=0)
        v = self.v / (size or 1.0)  # very large and very small components neither overflow nor vanish
        norm2 = np.einsum("ij,ij->i", v, v)
        self.radius = np.array([np.sqrt(norm2.max(initial=0))])
        x = np.concatenate((v, np.sqrt(np.maximum(0.0, norm2.max(initial=0) - norm2))[:, None]), 1).astype(np.float32)
        normals, offsets, children, roots, leaves = [], [], [], [], []
        for _ in range(trees):
            todo = [(np.arange(len(x)), -1, 0)]
            while todo:
                rows, parent, side = todo.pop()
                split = self._split(x, rows, rng) if len(rows) > leaf else None
                if split is None:
                    node = -1 - len(leaves)
                    leaves.append(rows)
                else:
                    node = len(normals)
                    normals.append(split[0])
                    offsets.append(split[1])
                    children.append([0, 0])
                    todo += [(rows[~split[2]], node, 0), (rows[split[2]], node, 1)]
                if parent < 0:
                    roots.append(node)
                else:
                    children[parent][side] = node
        self.normals = np.array(normals, np.float32).reshape(-1, x.shape[1])
        self.offsets, self.children = np.array(offsets, np.float32), np.array(children, np.int32).reshape(-1, 2)
        self.roots, self.rows = np.array(roots, np.int32), np.concatenate(leaves).astype(np.int32)
        self.ends = np.cumsum([len(r) for r in leaves])

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator):
        for _ in range(3):
            a, b = x[rng.choice(rows, 2, replace=False)]
            normal = b - a
            size = np.linalg.norm(normal)
            if size < 1e-6:  # copies: another pair may differ
                normal, size = rng.normal(size=x.shape[1]).astype(x.dtype), 1.0
            normal = normal / (size if size else 1.0)
            along = x[rows] @ normal
            offset = float(np.median(along))
            right = along > offset
            if right.any() and not right.all():
                return normal, offset, right
        return None  # all alike: an oversized leaf, searched as a whole

    def stored(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.ARRAYS.items()}

    def _best(self, rows: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        # summed row by row: a product of matrices may round equal rows differently by their places
        score = (self.v[rows] * q).sum(1)
        score[self.ids[rows] == own] = -np.inf
        if len(rows) > 4 * k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            near = score >= least
            rows, score = rows[near], score[near]
        order = np.lexsort((self.ids[rows], -score))[:k]
        order = order[score[order] > -np.inf]
        return rows[order], score[order]

    def _queue(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf the greatest of the distances by which its way lies on the wrong side."""
        size = np.abs(q).max(1, initial=0)[:, None]
        points = np.concatenate((q / np.where(size > 0, size, 1.0), np.zeros((len(q), 1))), 1).astype(np.float32)
        points *= self.radius[0] / np.linalg.norm(points, axis=1, keepdims=True)  # as far out as the filled rows
        side = (self.normals @ points.T) - self.offsets[:, None]  # a row for each node: levels copy whole rows
        way = np.full((len(self.normals) + len(self.ends), len(q)), -np.inf, np.float32)  # leaf k stands at -1 - k
        for level in self.levels:
            way[self.children[level, 0]] = np.maximum(way[level], side[level])
            way[self.children[level, 1]] = np.maximum(way[level], -side[level])
        return way[len(self.normals) :][::-1].T

    def met(self, q: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query at least `enough` rows (or all) from the leaves with the greatest margins."""
        want = min(enough, len(self.v))
        if want == len(self.v):  # the queue runs empty
            yield from (np.arange(want) for _ in q)
            return
        step = max(1, (1 << 21) // (len(self.normals) + len(self.ends)))
        starts, place = self.ends - self.lengths, np.zeros(len(self.v), np.int64)
        for lo in range(0, len(q), step):
            for way in np.ascontiguousarray(self._queue(q[lo : lo + step])):
                few = 2 * len(self.roots) + 4 * want // max(1, int(self.lengths.mean()))
                while True:
                    some = np.argpartition(way, few)[:few] if few < len(way) else np.arange(len(way))
                    some = some[np.lexsort((some, way[some]))]
                    length = self.lengths[some]
                    ends = np.cumsum(length)
                    rows = self.rows[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[some] - ends + length, length)]
                    at = np.arange(len(rows))
                    place[rows[::-1]] = at[::-1]
                    fresh = place[rows] == at  # where a row is met first
                    count = np.cumsum(fresh)
                    if few >= len(way) or count[-1] >= want:
                        break
                    few *= 2
                met = np.zeros(len(self.v), bool)
                met[rows[: ends[np.searchsorted(count[ends - 1], want)]]] = True  # with the whole leaf that makes them enough
                yield np.flatnonzero(met)

    def candidates(self, q: np.ndarray, enough: int) -> np.ndarray:
        return next(self.met(q[None], enough))

    def search(self, q: np.ndarray, q_ids: np.ndarray, k: int, enough: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best of at least `enough` candidates for each query."""
        return [self._near(rows, score, x, int(i), k) for rows, score, x, i in zip(self.met(q, enough), self._products(q), q, q_ids)]

    def _products(self, q: np.ndarray) -> Iterator[np.ndarray]:
        step = max(1, (1 << 21) // max(1, len(self.v)))
        for lo in range(0, len(q), step):
            with np.errstate(all="ignore"):
                yield from q[lo : lo + step] @ self.v.T

    def _near(self, rows: np.ndarray, score: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the rows: those within a product's rounding error of the k-th are summed row by row."""
        with np.errstate(all="ignore"):
            error = 8 * np.finfo(float).eps * (len(q) + 2) * self.far * np.linalg.norm(q)
            score = score[rows]
            score[self.ids[rows] == own] = -np.inf
            if len(rows) > 4 * k and np.isfinite(error):
                rows = rows[score >= np.partition(score, len(score) - k)[len(score) - k] - 2 * error]
        return self._best(rows, q, own, k)

    def enough(self, q: np.ndarray, q_ids: np.ndarray, k: int, recall: float, audit: int = 32) -> int:
        """The number of candidates with which the audited queries reach the recall."""
        asked = np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int)
        full = [score for _, score in self.search(q[asked], q_ids[asked], k, len(self.v))]
        want = 16 * k
        while want < len(self.v):
            got = self.search(q[asked], q_ids[asked], k, want)
            hits = sum(int((g[1] >= f[-1]).sum()) if len(f) else 0 for g, f in zip(got, full))
            if hits >= recall * sum(map(len, full)):
                break
            want *= 2
        return want


def _keep(folder: str, kind: str, trees: int = 0, leaf: int = 64):
    """Writes a part as a file; a shard with its forest."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part, dim = key[0].as_py(), key[1].as_py()
        rows = rows.sort_by([("vec_id", "ascending"), ("hashed", "ascending")])  # the same forest on every attempt
        v, ids, hashed = matrix(rows["v"]), np.asarray(rows["vec_id"], np.int64), np.asarray(rows["hashed"], np.int64)
        data = {"v": v.tobytes(), "ids": ids.tobytes(), "hashed": hashed.tobytes()} | (Forest(v, ids, trees, leaf).stored() if kind == "shard" else {})
        put_file(folder, f"{kind}-{part}-{dim}", pa.table({c: pa.array([x], pa.large_binary()) for c, x in data.items()}))
        return pa.table({"part": pa.array([part], pa.int32()), "dim": pa.array([dim], pa.int32())})

    return run


def _search(folder: str, k: int, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at = None
        read = lambda row, dim: (np.frombuffer(row["v"], np.float64).reshape(-1, dim), np.frombuffer(row["ids"], np.int64))
        for batch in batches:
            for a, b, dim in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (a, dim):
                    at, row = (a, dim), get_file(folder, f"shard-{a}-{dim}").to_pylist()[0]
                    forest = Forest(*read(row, dim), grown=row)
                row = get_file(folder, f"block-{b}-{dim}").to_pylist()[0]
                (q, q_ids), hashed = read(row, dim), np.frombuffer(row["hashed"], np.int64)
                found = forest.search(q, q_ids, k, forest.enough(q, q_ids, k, recall))
                times = [len(rows) for rows, _ in found]
                columns = [np.repeat(q_ids, times), np.repeat(hashed, times), forest.ids[np.concatenate([rows for rows, _ in found])]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(np.concatenate([score for _, score in found]), pa.float64())], names=["query_id", "hashed", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 16_384, block_queries: int = 2_048, trees: int = 10, leaf: int = 64, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query (vec_id, embedding)."""
    spark = vectors.sparkSession
    whole = lambda df: clean(df).filter("v is not null and vec_id is not null").withColumn("dim", F.size("v")).withColumn("hashed", F.xxhash64("v"))
    shards, blocks = max(1, -(-vectors.count() // shard_rows)), max(1, -(-queries.count() // block_queries))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "hashed"), F.lit(n)).cast("int")
    folder = new_path(spark, "forests")
    grown = whole(vectors).withColumn("part", deal(shards)).groupBy("part", "dim").applyInArrow(_keep(folder, "shard", trees, leaf), PART)
    asked = whole(queries).dropDuplicates(["vec_id", "v"]).withColumn("part", deal(blocks)).groupBy("part", "dim").applyInArrow(_keep(folder, "block"), PART)
    pairs = every_pair(written(grown, "shards"), written(asked, "blocks"))
    found = written(pairs.mapInArrow(_search(folder, k, recall), "query_id long, hashed long, vec_id long, score double"), "found")
    forget_path(spark, folder)
    # one query's rows here are at most k a shard
    order = Window.partitionBy("query_id", "hashed").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
