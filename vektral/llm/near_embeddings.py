"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Equal vectors collapse first.  The distinct ones are dealt to shards by a hash; each shard builds a
layered graph, once, as a file of the shared folder, and every vector queries every shard: blocks of
vectors are files too, and a task takes one pair of a block and a shard after the other, so neither side
is copied by a shuffle.  A query's beam starts at beam; where it is full of links it widens without bound
for that query, and for the whole block of queries it doubles until an audit (queries compared with all vectors of the shard) finds 99.9 % of its links, each of which is
sought from its other end too.  The audit always tests
links, however many shards there are: it takes queries of the block that have links, and vectors of
the shard moved to similarities down to the threshold.  Hits are verified by cosine in double
precision on the original vectors, each scaled by a power of two (which is exact), so that very large and
very small components neither overflow nor vanish; a link found from either end counts for both, once.  A task
unites its own links, and distributed star contraction unites those of all tasks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (n_links 0, their own component); copies link with each other and share all other links; a
vec_id that repeats is one graph node with the links of its rows added up; a null vec_id gives a row
whose component is that of its group or null; vectors of other lengths than the most frequent one
link only with vectors of their own length; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, every_pair, forget_path, get_file, new_path, put_file, release, written


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of double; null where it takes no part)."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0.0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(~F.coalesce(bad, F.lit(True)), v).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, the largest component between a half and one."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def normed(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """A layered small-world graph over the unit rows of x, built in growing batches."""

    def __init__(self, x: np.ndarray, m: int = 16, build_beam: int = 48, seed: int = 3, neighbours: list[np.ndarray] | None = None, levels: np.ndarray | None = None):
        self.x, self.m, self.build_beam = np.ascontiguousarray(x, np.float32), m, build_beam
        n = len(x)
        if neighbours is not None:
            self.levels, self.near = levels, neighbours
            return
        draw = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(np.int8), 6)
        if n:
            self.levels[0] = max(1, self.levels.max())
        self.near = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(self.levels.max(initial=0)) + 1)]
        done, size = 1, 32
        while done < n:
            batch = np.arange(done, min(n, done + size))
            self._insert(batch, done)
            done, size = int(batch[-1]) + 1, min(1024, done + size)

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (best first) those that are nearer to the row than to one already
        taken, filled up with the best of the others."""
        b, c = ids.shape
        vectors = self.x[np.maximum(ids, 0)]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        taken = np.zeros((b, c), bool)
        count = np.zeros(b, np.int64)
        valid = ids >= 0
        for j in range(c):
            closest = np.where(taken, between[:, j, :], -np.inf).max(1)
            ok = valid[:, j] & (sims[:, j] > closest) & (count < most)
            taken[ok, j] = True
            count += ok
        # rank: taken ones first, then the rest, each best first
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * c + np.arange(c)
        pick = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(ids, pick, 1)

    def _insert(self, batch: np.ndarray, done: int) -> None:
        q = self.x[batch]
        entry = np.zeros((len(batch), 1), np.int32)
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        for level in range(len(self.near) - 1, -1, -1):
            ids, sims = self.beam(q, entry, self.build_beam if level == 0 else 16, level, done)
            entry = ids[:, : 4 if level else 1]
            here = np.flatnonzero(self.levels[batch] >= level)
            if not len(here):
                continue
            # neighbours inside the batch
            k = min(self.m, len(here))
            own = inner[np.ix_(here, here)]
            best = np.argsort(-own, axis=1)[:, :k]
            own_ids = np.where(np.take_along_axis(own, best, 1) > -np.inf, batch[here][best], -1)
            all_ids = np.concatenate((ids[here], own_ids.astype(np.int32)), 1)
            all_sims = np.concatenate((sims[here], np.take_along_axis(own, best, 1)), 1).astype(np.float32)
            all_sims[all_ids < 0] = -np.inf
            order = np.argsort(-all_sims, axis=1, kind="stable")
            most = self.m
            chosen = self._select(np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1), most)
            self.near[level][batch[here], :most] = chosen
            self._back_links(batch[here], chosen, level)

    def _back_links(self, new: np.ndarray, chosen: np.ndarray, level: int) -> None:
        near = self.near[level]
        to, by = chosen.ravel(), np.repeat(new, chosen.shape[1]).astype(np.int32)
        ok = to >= 0
        to, by = to[ok], by[ok]
        ok = ~(near[to] == by[:, None]).any(1)  # two new nodes may have chosen each other
        to, by = to[ok], by[ok]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        nodes, start, times = np.unique(to, return_index=True, return_counts=True)
        full = near.shape[1]
        held = (near[nodes] >= 0).sum(1)
        fits = held + times <= full
        slot = np.arange(len(to)) - np.repeat(start, times) + np.repeat(held, times)
        ok = np.repeat(fits, times)
        near[to[ok], slot[ok]] = by[ok]
        crowded = np.flatnonzero(~fits)
        for lo in range(0, len(crowded), 256):
            part = crowded[lo : lo + 256]
            width = full + int(min(times[part].max(), 64))
            ids = np.full((len(part), width), -1, np.int32)
            ids[:, :full] = near[nodes[part]]
            for r, c in enumerate(part):
                extra = by[start[c] : start[c] + times[c]]
                if len(extra) > width - full:
                    extra = extra[np.argsort(-(self.x[extra] @ self.x[nodes[c]]), kind="stable")[: width - full]]
                ids[r, full : full + len(extra)] = extra
            sims = np.einsum("bd,bcd->bc", self.x[nodes[part]], self.x[np.maximum(ids, 0)])
            sims[ids < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            near[nodes[part]] = self._select(np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), full)

    def beam(self, q: np.ndarray, entry: np.ndarray, width: int, level: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step: the width best found of each, best first (-1: none)."""
        b = len(q)
        near = self.near[level]
        ids = np.full((b, width), -1, np.int32)
        sims = np.full((b, width), -np.inf, np.float32)
        open_ = np.zeros((b, width), bool)
        seen = np.zeros((b, upto), bool)
        rows = np.arange(b)
        k = min(entry.shape[1], width)
        for j in range(k):
            e = entry[:, j]
            ok = (e >= 0) & ~seen[rows, np.maximum(e, 0)]
            seen[rows[ok], e[ok]] = True
            ids[ok, j] = e[ok]
            sims[ok, j] = np.einsum("bd,bd->b", q[ok], self.x[e[ok]])
            open_[ok, j] = True
        active = rows
        while len(active):
            front = np.where(open_[active], sims[active], -np.inf)
            best = front.argmax(1)
            live = front[np.arange(len(active)), best] > -np.inf
            active, best = active[live], best[live]
            if not len(active):
                break
            open_[active, best] = False
            nb = near[ids[active, best]]
            ok = nb >= 0
            ok &= ~seen[active[:, None], np.maximum(nb, 0)]
            some = ok.any(1)
            if not some.all():
                nb, ok, quiet = nb[some], ok[some], active
                active = active[some]
                if not len(active):
                    active = quiet
                    continue
            else:
                quiet = active
            r, c = np.nonzero(ok)
            seen[active[r], nb[r, c]] = True
            s = np.matmul(self.x[np.maximum(nb, 0)], q[active][:, :, None])[:, :, 0]
            s[~ok] = -np.inf
            all_s = np.concatenate((sims[active], s), 1)
            keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            ids[active] = np.take_along_axis(np.concatenate((ids[active], nb), 1), keep, 1)
            open_[active] = np.take_along_axis(np.concatenate((open_[active], ok), 1), keep, 1)
            sims[active] = np.take_along_axis(all_s, keep, 1)
            active = quiet
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        ids = np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1)
        return ids, sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int32)
        for level in range(len(self.near) - 1, 0, -1):
            entry = self.beam(q, entry, 8, level, len(self.x))[0][:, :4]
        return self.beam(q, entry, width, 0, len(self.x))

    def links(self, q: np.ndarray, least: float, beam: int, audit: int = 24, linked: int = 128, step: int = 256, recall: float = 0.999) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) pairs with a similarity of least or more, in parts.  The beam widens until the audit
        finds the share recall of its links; as a link is sought from both its ends, a share of about
        (1 - recall) ** 2 may be missed."""
        n = len(self.x)
        tests = self._audit(q, least, audit, linked)
        full = [np.flatnonzero(self.x @ t >= least) for t in tests]
        width = min(beam, n)
        while True:  # widen until the audit finds its links
            found = self._within(tests, least, width)
            if width >= n or sum(int(np.isin(f, found[1][found[0] == i]).sum()) for i, f in enumerate(full)) >= recall * sum(map(len, full)):
                break
            width = min(2 * width, n)
        for lo in range(0, len(q), step):
            a, b = self._within(q[lo : lo + step], least, width)
            yield a + lo, b

    def _audit(self, q: np.ndarray, least: float, audit: int, linked: int, step: int = 256, tries: int = 8) -> np.ndarray:
        """Queries to audit: audit evenly spaced ones, linked ones with a link besides themselves as far as
        a few steps of queries hold them, and linked rows of x, each moved to a similarity between least and 1."""
        out = [q[np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int)]]
        rng = np.random.default_rng(5)
        order, missing = rng.permutation(len(q)), linked
        for lo in range(0, min(len(q), tries * step), step):
            part = q[order[lo : lo + step]]
            sims = part @ self.x.T
            has = part[((sims >= least) & (sims < 1 - 1e-6)).any(1)][:missing]
            out.append(has)
            missing -= len(has)
            if not missing:
                break
        own = self.x[np.linspace(0, len(self.x) - 1, min(linked, len(self.x))).astype(int)]
        away = rng.normal(size=own.shape).astype(np.float32)
        away -= np.einsum("ij,ij->i", away, own)[:, None] * own
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        cosine = np.linspace(min(1.0, least + 1e-3), 1, len(own), dtype=np.float32)[:, None]
        out.append(cosine * own + np.sqrt(1 - cosine**2) * away)
        return np.concatenate(out).astype(np.float32)

    def _within(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        out, n = [], len(self.x)
        step = max(1, int(2e8 // (width * 64 + n)))
        for lo in range(0, len(q), step):
            ids, sims = self.search(q[lo : lo + step], width)
            hit = sims >= least
            crowded = np.flatnonzero(hit.all(1)) if width < n else np.zeros(0, np.int64)
            hit[crowded] = False
            r, c = np.nonzero(hit)
            out.append((r + lo, ids[r, c]))
            some = max(1, int(6e7 // n))
            for k in range(0, len(crowded), some):
                part = crowded[k : k + some]
                r, c = self._spread(q[part + lo], ids[part], least)
                out.append((part[r] + lo, c))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _spread(self, q: np.ndarray, ids: np.ndarray, least: float, slack: float = 0.02, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """A beam without bound, from a beam that is full of links: every row near enough is expanded, until
        no expansion finds more."""
        n, near = len(self.x), self.near[0]
        seen = np.zeros((len(q), n), bool)
        r, c = np.repeat(np.arange(len(q)), ids.shape[1]), ids.ravel().astype(np.int64)
        seen[r, c] = True
        out = [(r, c)]
        while len(r):
            front = []
            for lo in range(0, len(r), step):
                to = near[c[lo : lo + step]]
                who, to = np.repeat(r[lo : lo + step], to.shape[1]), to.ravel()
                new = (to >= 0) & ~seen[who, to]
                who, to = np.divmod(np.unique(who[new] * n + to[new]), n)
                seen[who, to] = True
                sims = np.einsum("bd,bd->b", q[who], self.x[to])
                hit, go = sims >= least, sims >= least - slack
                out.append((who[hit], to[hit]))
                front.append((who[go], to[go]))
            r, c = (np.concatenate([f[i] for f in front]) for i in (0, 1))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _vectors(rows: pa.Table) -> dict[str, pa.Array]:
    """A part's vectors, scaled, as one row."""
    one = lambda x: pa.array([x.tobytes()], pa.large_binary())
    return {"ids": one(np.asarray(rows["id"], np.int64)), "copies": one(np.asarray(rows["copies"], np.int64)), "hashed": one(np.asarray(rows["hashed"], np.int64)), "v": one(scaled(matrix(rows["v"])))}


def _read(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (*(np.frombuffer(row[c], np.int64) for c in ("ids", "copies", "hashed")), np.frombuffer(row["v"], np.float64).reshape(-1, dim))


PART = "part int, dim int"


def _keep(folder: str, kind: str):
    """Writes a part as a file; a shard with its graph."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part, dim = key[0].as_py(), key[1].as_py()
        columns = _vectors(rows)
        if kind == "shard":
            g = Graph(normed(np.frombuffer(columns["v"][0].as_py(), np.float64).reshape(-1, dim)))
            columns["levels"] = pa.array([g.levels.tobytes()], pa.large_binary())
            columns["near"] = pa.array([[x.tobytes() for x in g.near]], pa.list_(pa.large_binary()))
        put_file(folder, f"{kind}-{part}-{dim}", pa.table(columns))
        return pa.table({"part": pa.array([part], pa.int32()), "dim": pa.array([dim], pa.int32())})

    return run


class _Roots:
    """Union-find over ids, the least one as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


#: A link of two nodes, the lesser id first: ids, hashes and copies; or, with 0 copies, an id and its root in the task.
LINK = "a long, b long, ha long, hb long, ca long, cb long"


def _query(folder: str, threshold: float, beam: int):
    """Links of a block's vectors with a shard's, for each pair of the two in a task."""

    def pair(graph: Graph, shard: tuple, block: tuple) -> pa.RecordBatch:
        (ids, copies, hashed, v), (q_ids, q_copies, q_hashed, q) = shard, block
        norm, q_norm = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
        found = []
        roots = _Roots()
        for a, b in graph.links(normed(q), threshold - 1e-4, beam):
            ok = q_ids[a] != ids[b]
            a, b = a[ok], b[ok]
            cosine = np.einsum("ij,ij->i", q[a], v[b]) / (q_norm[a] * norm[b])
            a, b = a[cosine >= threshold], b[cosine >= threshold]
            x, y = np.stack((q_ids[a], q_hashed[a], q_copies[a])), np.stack((ids[b], hashed[b], copies[b]))
            first = x[0] < y[0]
            lo, hi = np.where(first, x, y), np.where(first, y, x)
            found.append(np.stack((lo[0], hi[0], lo[1], hi[1], lo[2], hi[2])))
            for s, t in zip(q_ids[a].tolist(), ids[b].tolist()):
                roots.join(s, t)
        links = np.concatenate(found, 1)
        links = links[:, np.lexsort(links[:4])]
        links = links[:, np.r_[True, (links[:4, 1:] != links[:4, :-1]).any(0)][: links.shape[1]]]
        ends = np.array([(x, roots.root(x), 0, 0, 0, 0) for x in list(roots.up)], np.int64).reshape(-1, 6).T
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate((links, ends), 1)], names=["a", "b", "ha", "hb", "ca", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at = None
        for batch in batches:
            for a, b, dim in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (a, dim):
                    at, row = (a, dim), get_file(folder, f"shard-{a}-{dim}").to_pylist()[0]
                    shard = _read(row, dim)
                    near = [np.frombuffer(x, np.int32).reshape(len(shard[0]), -1) for x in row["near"]]
                    graph = Graph(normed(shard[3]), neighbours=near, levels=np.frombuffer(row["levels"], np.int8))
                yield pair(graph, shard, _read(get_file(folder, f"block-{b}-{dim}").to_pylist()[0], dim))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, beam: int = 24, shard_rows: int = 65_536, block_rows: int = 8_192) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).  Work grows with
    the number of vectors times that of shards, so shards are as large as a task holds well."""
    spark = vectors.sparkSession
    rows = written(clean(vectors), "vectors")
    # a node is a distinct vector, named by the least vec_id that has it
    nodes = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("dim", F.size("v")), "nodes")
    n = nodes.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // block_rows))
    hashed = F.xxhash64("v")
    # a vector whose ids are all null is named by a hash of it, below all others
    nodes = nodes.withColumn("hashed", hashed).withColumn("id", F.coalesce("id", -F.abs(hashed / 2).cast("long") - 2**40))
    dealt = nodes.withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int")).withColumn("block", F.pmod(F.shiftright(hashed, 20), F.lit(blocks)).cast("int"))
    folder = new_path(spark, "graphs")
    graphs = written(dealt.withColumnRenamed("shard", "part").groupBy("part", "dim").applyInArrow(_keep(folder, "shard"), PART), "shards")
    asking = written(dealt.withColumnRenamed("block", "part").groupBy("part", "dim").applyInArrow(_keep(folder, "block"), PART), "blocks")
    found = written(every_pair(graphs, asking).mapInArrow(_query(folder, threshold, beam), LINK), "links")
    forget_path(spark, folder)
    # both ends of a link may have found it: once for each
    links = found.filter("ca > 0").groupBy("a", "b", "ha", "hb").agg(F.max("ca").alias("ca"), F.max("cb").alias("cb"))
    links = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("cb").alias("n")), F.struct(F.col("b").alias("id"), F.col("ca").alias("n")))).alias("e"))
    links = links.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.n").alias("n"))
    united = connected_components(found.filter("ca = 0").select("a", "b"))
    named = nodes.select("v", "id", "copies").join(links, "id", "left").join(united.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = rows.join(named, "v", "left")
    component = F.coalesce(F.when(F.col("c") > -(2**40), F.col("c")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
