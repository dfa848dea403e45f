"""Exact Jaccard join of documents' word shingles as a metric-space join.

d(x, y) = 1 - |x & y| / |x | y| is a metric, and documents link when d <= radius (0.2).  x and y can
only link if |d(x, p) - d(y, p)| <= radius for every pivot p.  Texts that share no shingle with a pivot
are all at distance 1 from it, so regions of nearest pivots would replicate each of them to each region.
Candidates come from a prefix-filter join instead, and a region is what links have united so far, inside
*neighbourhoods* that no link leaves: under one order of all shingles (frequent ones last) linked sets
share a shingle among their first n - ceil(0.8 n) + 1, so the documents with the same shingle there
form a neighbourhood.

1  Equal sets collapse to one node, whose document is the smallest doc_id.
2  Frequent shingles are counted over all documents; the order puts them last.
3  Small neighbourhoods are joined directly within the windows of size and position, in buckets.
   Large ones (a frequent passage, a big group of near copies) become rows (neighbourhood, node), dealt
   out by a salt.
4  Level by level: each large neighbourhood takes its most central open node as pivot, each node its
   least neighbour; those pairs get exact distances; what links is united.  Pairs within one united
   region need no further look.  Levels go on until few pairs are left or no longer half as many.  Then
   the open nodes of a neighbourhood are replicated to all its regions that their triangle, size and
   position windows reach, and these pairs, like all others between regions, are verified exactly.
5  A symmetric-difference bound on parity sketches of the sets discards pairs before their sets are made.

Every bound is a necessary condition, so no link is lost, and the links reported are exact up to
collisions of 64-bit shingle hashes.

Defined results: null, empty and blank texts have n_shingles 0 and link with nothing; a text of fewer
words than a shingle is one shingle; rows that repeat a doc_id are one graph node; a null doc_id is a
row like any other that can't be a component's name (its component_id is that of its group, null
alone); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, release, written
from .words import shingle_sets

_TOP = np.uint64(1 << 63)


def _signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sketch(s: np.ndarray, least: int = 512) -> bytes:
    """Parity sketch: a bit per hash class, set if the set holds an odd number of that class.  As wide
    as the set is large (a power of two), so that it tells large sets apart too."""
    width = max(least, 1 << max(0, len(s) - 1).bit_length())
    bits = np.bincount(((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one set only; a wider sketch is folded to the narrower's width."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):
        width = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _scan(docs: DataFrame, k: int, min_local: int) -> DataFrame:
    """kind 0: a document's id, set size, signature and sketch; kind 1: a shingle that min_local
    documents or more of one chunk hold (equal sets counted once), with their number."""
    names = ["kind", "id", "n", "sig", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen, sets, size = set(), [], 0

        def counted() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(sets), return_counts=True)
            often = times >= min_local
            values, times = values[often], times[often]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int32)), pa.array(_signed(values)), pa.array(times.astype(np.int32)), none, pa.nulls(len(values), pa.binary())], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                here = list(shingle_sets(part.column(1).to_pylist(), k))
                n, sig = [len(s) for s in here], [_signature(s) for s in here]
                for s, node in zip(here, zip(sig, n)):
                    if len(s) and node not in seen:
                        seen.add(node)
                        sets.append(s)
                        size += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), part.column(0), pa.array(n, pa.int32()), pa.array(sig, pa.int64()), pa.array(map(_sketch, here), pa.binary())], names=names)
                if size > 3_000_000:
                    yield counted()
                    sets, size = [], 0
                    seen.clear()
        if sets:
            yield counted()

    return docs.mapInArrow(run, "kind int, id long, n int, sig long, sketch binary")


def _frequent(scan: DataFrame, least: int, most_shingles: int) -> np.ndarray:
    """The shingles in `limit` documents or more, where limit is the least power of two times
    `least` that leaves at most most_shingles of them (8 bytes each, so the bound of what is sent)."""
    counts = written(scan.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("df")).filter(F.col("df") >= least), "frequent")
    steps = counts.groupBy(F.floor(F.log2(F.col("df") / least)).alias("e")).count().collect()
    e = 0
    while sum(r["count"] for r in steps if r["e"] >= e) > most_shingles:
        e += 1
    limit = least << e
    found = np.array([r[0] for r in counts.filter(F.col("df") >= limit).select("id").toLocalIterator()], np.int64)
    forget(counts)
    return np.sort(found.view(np.uint64))


def prefix_length(n: int, per_cent: int) -> int:
    return n - -(-n * per_cent // 100) + 1


def _prefixes(docs: DataFrame, k: int, per_cent: int, frequent, buckets: int) -> DataFrame:
    """Packed rows (shingle, node, position) of the prefixes by bucket; those of frequent shingles
    stand apart (kind 1), spread over the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        heavy = frequent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                seen, nodes, sh, of, pos = set(), [], [], [], []
                for s in shingle_sets(batch.column(0).slice(at, 2048).to_pylist(), k):
                    node = (_signature(s), len(s))
                    if not len(s) or node in seen:
                        continue
                    seen.add(node)
                    late = heavy[np.minimum(np.searchsorted(heavy, s), max(0, len(heavy) - 1))] == s if len(heavy) else np.zeros(len(s), bool)
                    p = prefix_length(len(s), per_cent)
                    rare = s[~late]
                    first = rare[:p] if len(rare) >= p else np.concatenate((rare, s[late][: p - len(rare)]))
                    sh.append(first)
                    of.append(np.full(p, len(nodes), np.uint32))
                    pos.append(np.arange(p, dtype=np.uint32))
                    nodes.append(node)
                if not nodes:
                    continue
                sh, of, pos = np.concatenate(sh), np.concatenate(of), np.concatenate(pos)
                sig, n = np.array([x[0] for x in nodes], np.int64), np.array([x[1] for x in nodes], np.int32)
                late = heavy[np.minimum(np.searchsorted(heavy, sh), max(0, len(heavy) - 1))] == sh if len(heavy) else np.zeros(len(sh), bool)
                bucket = ((sh >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                # frequent shingles are rows for later joins: any bucket will do, so each chunk takes its own
                bucket[late] = buckets + int(sig[0]) % buckets
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows = []
                for a, b in zip(cut, np.append(cut[1:], len(order))):
                    pick = order[a:b]
                    used, local = np.unique(of[pick], return_inverse=True)
                    # the columns of the packed arrays: nodes' signatures and sizes, then the rows
                    rows.append((int(bucket[pick[0]]), len(used), sig[used].tobytes() + n[used].tobytes() + sh[pick].tobytes() + local.astype(np.uint16).tobytes() + pos[pick].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "nodes", "data"])

    return docs.mapInArrow(run, "bucket int, nodes int, data binary")


def _unpacked(nodes: int, data: bytes) -> tuple[np.ndarray, ...]:
    rows = (len(data) - 12 * nodes) // 14
    sig = np.frombuffer(data, np.int64, nodes)
    n = np.frombuffer(data, np.int32, nodes, 8 * nodes)
    sh = np.frombuffer(data, np.uint64, rows, 12 * nodes)
    local = np.frombuffer(data, np.uint16, rows, 12 * nodes + 8 * rows)
    pos = np.frombuffer(data, np.uint32, rows, 12 * nodes + 10 * rows)
    return sh, sig[local], n[local], pos.astype(np.int64)


def _windows(n1, p1, n2, p2, per_cent: int):
    """Size and position windows: whether sets of n1, n2 shingles whose first common one stands at
    p1, p2 can still link."""
    need = per_cent * (n1 + n2)  # (100 + per_cent) * common >= need
    common = np.minimum(n1 - p1, n2 - p2)
    return ((100 + per_cent) * common >= need) & (100 * np.minimum(n1, n2) >= per_cent * np.maximum(n1, n2))


_JOINED = "kind int, s long, a long, na int, b long, nb int, pos int"


def _join_bucket(per_cent: int, large: int, buckets: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        release()
        got = [_unpacked(k, x) for k, x in zip(group["nodes"].to_pylist(), group["data"].to_pylist())]
        sh, sig, n, pos = (np.concatenate([g[i] for g in got]) for i in range(4))
        apart = key[0].as_py() >= buckets
        if not apart:
            order = np.lexsort((sig, n, sh))
            sh, sig, n, pos = sh[order], sig[order], n[order], pos[order]
            new = np.ones(len(sh), bool)  # the same set from several chunks counts once
            new[1:] = (sh[1:] != sh[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
            sh, sig, n, pos = sh[new], sig[new], n[new], pos[new]
            start = np.flatnonzero(np.concatenate(([True], sh[1:] != sh[:-1])))
            each = np.diff(np.append(start, len(sh)))
            length = np.repeat(each, each)
            big = length > large
        else:
            big = np.ones(len(sh), bool)
        zero = np.zeros(int(big.sum()), np.int32)
        rows = pa.table({"kind": pa.array(zero + 1), "s": pa.array(_signed(sh[big].copy())), "a": pa.array(sig[big]), "na": pa.array(n[big]), "b": pa.nulls(len(zero), pa.int64()), "nb": pa.nulls(len(zero), pa.int32()), "pos": pa.array(pos[big].astype(np.int32))})
        if apart:
            return rows
        small = (length > 1) & ~big
        sh, sig, n, pos = sh[small], sig[small], n[small].astype(np.int64), pos[small]
        one, two = [], []
        for k in range(1, large):
            near = np.flatnonzero(sh[k:] == sh[:-k])
            if not len(near):
                break
            ok = near[_windows(n[near], pos[near], n[near + k], pos[near + k], per_cent)]
            one.append(ok)
            two.append(ok + k)
        if not one:
            return rows
        x, y = np.concatenate(one), np.concatenate(two)
        swap = (sig[x] > sig[y]) | ((sig[x] == sig[y]) & (n[x] > n[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        pairs = np.unique(np.stack([sig[x], n[x], sig[y], n[y]], 1), axis=0)
        m = len(pairs)
        return pa.concat_tables([rows, pa.table({"kind": pa.array(np.zeros(m, np.int32)), "s": pa.nulls(m, pa.int64()), "a": pa.array(pairs[:, 0]), "na": pa.array(pairs[:, 1].astype(np.int32)), "b": pa.array(pairs[:, 2]), "nb": pa.array(pairs[:, 3].astype(np.int32)), "pos": pa.nulls(m, pa.int32())})])

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with the lesser node first, each once."""
    turn = (F.col("a") > F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("na") > F.col("nb")))
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("a", "b").alias("a"), pick("na", "nb").alias("na"), pick("b", "a").alias("b"), pick("nb", "na").alias("nb")).distinct()


def _sketched(pairs: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """Pairs whose sketches allow a link, with the documents (ra, rb) of their nodes."""
    side = lambda x: nodes.select(F.col("sig").alias(x), F.col("n").alias("n" + x), F.col("rep").alias("r" + x), F.col("sketch").alias("k" + x))
    both = pairs.join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"]).select("a", "na", "b", "nb", "ra", "rb", "ka", "kb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)
            sizes = np.asarray(batch.column(1), np.int64) + np.asarray(batch.column(3), np.int64)
            differ = np.array([_differ(x, y) for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist())], np.int64)
            yield batch.select(range(6)).filter(pa.array((100 + per_cent) * differ <= (100 - per_cent) * sizes))

    return both.mapInArrow(run, "a long, na int, b long, nb int, ra long, rb long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, broadcast_limit: int, per_region: int = 500, per_row: int = 256) -> DataFrame:
    """Pairs with the size of their sets' intersection.

    a is the pivot of a region, the bs its members; a region of many members is split, and each part
    gets the pivot.  The documents are read once more; only the sets of nodes in a pair move, once
    for each region they are in.  A document's seats are rows of per_row or so, whatever their number.
    """
    parts = pairs.groupBy("a", "na").agg(F.ceil(F.count("*") / per_region).cast("int").alias("parts"))
    member = pairs.join(parts, ["a", "na"])
    region = lambda part, role: F.struct(F.col("a"), F.col("na"), part.alias("part"), F.lit(role).alias("role"))
    split = F.pmod(F.xxhash64("b", "nb"), F.col("parts")).cast("int")
    seats = member.select(F.col("rb").alias("_rep"), F.col("b").alias("sig"), F.col("nb").alias("n"), region(split, 1).alias("r"))
    heads = member.select("a", "na", "ra", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    seats = seats.unionByName(heads.select(F.col("ra").alias("_rep"), F.col("a").alias("sig"), F.col("na").alias("n"), region(F.col("part"), 0).alias("r")))
    seats = written(seats, "seats")
    many = seats.groupBy("_rep", "sig", "n").agg(F.ceil(F.count("*") / per_row).cast("int").alias("rows")).filter("rows > 1")
    n_many = many.count()
    if n_many:
        # sent to the seats where it is small, so that these are dealt by row as well
        many = F.broadcast(many) if n_many <= broadcast_limit else many
        lists = seats.join(many, ["_rep", "sig", "n"], "left").withColumn("row", F.pmod(F.xxhash64("r"), F.coalesce("rows", F.lit(1))).cast("int"))
    else:
        lists = seats.withColumn("row", F.lit(0))
    lists = written(lists.groupBy("_rep", "sig", "n", "row").agg(F.collect_list("r").alias("r")), "lists")
    if seats.count() <= broadcast_limit:  # some 50 bytes a seat
        rows = docs.join(F.broadcast(lists), docs["doc_id"] == lists["_rep"])
    else:
        rows = docs.join(lists.hint("merge"), docs["doc_id"] == lists["_rep"])
    forget(seats)
    names = ["a", "na", "part", "role", "sig", "n", "rep", "s"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for s, row in zip(shingle_sets(part.column(0).to_pylist(), k), part.drop_columns("text").to_pylist()):
                    if (row["sig"], row["n"]) == (_signature(s), len(s)):  # else another text of that id
                        out += [(r["a"], r["na"], r["part"], r["role"], row["sig"], row["n"], row["_rep"], s.tobytes()) for r in row["r"]]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    def common(key: tuple, group: pa.Table) -> pa.Table:
        head, got = None, {}
        for role, sig, n, rep, s in zip(*(group[c].to_pylist() for c in ("role", "sig", "n", "rep")), group["s"]):
            if role:
                got[sig, n, rep] = s
            else:
                head = (np.frombuffer(s.as_py(), np.uint64), rep)
        a, na = key[0].as_py(), key[1].as_py()
        found = [(a, na, sig, n, head[1], rep, len(np.intersect1d(head[0], np.frombuffer(s.as_py(), np.uint64), assume_unique=True))) for (sig, n, rep), s in got.items()] if head else []
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=["a", "na", "b", "nb", "ra", "rb", "common"])

    made = rows.select("text", "_rep", "sig", "n", "r").mapInArrow(sets, "a long, na int, part int, role int, sig long, n int, rep long, s binary")
    return made.groupBy("a", "na", "part").applyInArrow(common, "a long, na int, b long, nb int, ra long, rb long, common int")


def jaccard_join(docs: DataFrame, shingle_words: int = 5, per_cent: int = 80, large: int = 64, levels: int = 12, rest: int = 32, salt: int = 1000, most_frequent: int = 500_000, broadcast_limit: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): documents are linked when
    100 * |x & y| >= per_cent * |x | y|.  Neighbourhoods of more than large nodes get pivots, level after
    level, until no more than rest pairs a node are left to be joined, or a level leaves more than half of
    them.  A neighbourhood's rows are dealt out by salt."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    how = (shingle_words, per_cent, large, levels, rest, salt, most_frequent, broadcast_limit)
    if docs.filter("doc_id is null").isEmpty():
        return _join(docs, *how)
    # rows without an id are named by a hash of their text until the groups are known
    own = F.xxhash64(F.lit("no doc_id"), F.coalesce("text", F.lit("")))
    nameless = docs.filter("doc_id is null").select(own.alias("doc_id")).distinct().withColumn("_own", F.lit(True))
    nameless = written(nameless, "nameless")
    out = _join(docs.withColumn("doc_id", F.coalesce("doc_id", own)), *how).join(nameless, "doc_id", "left")
    out = written(out.select(F.when(F.col("_own").isNull(), F.col("doc_id")).alias("doc_id"), "n_shingles", "component_id"), "named")
    least = out.join(nameless.select(F.col("doc_id").alias("component_id")), "component_id").groupBy("component_id").agg(F.min("doc_id").alias("_least"), F.lit(True).alias("_own"))
    out = out.join(least, "component_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("_own").isNull(), F.col("component_id")).otherwise(F.col("_least")).alias("component_id"))


def _join(docs: DataFrame, shingle_words: int, per_cent: int, large: int, levels: int, rest: int, salt: int, most_frequent: int, broadcast_limit: int) -> DataFrame:
    """jaccard_join of docs whose ids aren't null."""
    spark = docs.sparkSession
    scan = written(_scan(docs, shingle_words, 4), "scan")
    rows = scan.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "sig", "sketch")
    nodes = rows.filter("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    n_rows = rows.count()
    frequent = _frequent(scan, large, most_frequent)
    sent = spark.sparkContext.broadcast(frequent)

    # neighbourhoods: small ones are joined in their bucket, large ones become rows
    buckets = max(8, -(-n_rows // 4000))
    packed = _prefixes(docs.select("text"), shingle_words, per_cent, sent, buckets)
    joined = written(packed.groupBy("bucket").applyInArrow(_join_bucket(per_cent, large, buckets), _JOINED), "joined")
    open_pairs = _sketched(_ordered(joined.filter("kind = 0").select("a", "na", "b", "nb")), nodes, per_cent)
    open_pairs = written(open_pairs, "pairs")
    big = joined.filter("kind = 1").select("s", F.col("a").alias("x"), F.col("na").alias("nx"), F.col("pos").alias("px")).distinct()
    big = big.join(nodes.select(F.col("sig").alias("x"), F.col("n").alias("nx"), F.col("rep").alias("rx")), ["x", "nx"])
    big = written(big, "neighbourhoods")
    sizes = written(big.groupBy("s").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / salt).cast("int")), "sizes")
    part = F.pmod(F.xxhash64("x", "nx"), F.col("parts")).cast("int")
    dealt = written(big.join(sizes.select("s", "parts"), "s").withColumn("part", part).drop("parts"), "dealt")
    # what a whole neighbourhood meets goes to each of its parts
    to_parts = lambda df: df.join(sizes.select("s", "parts"), "s").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    windows = f"(100 + {per_cent}) * least(nx - px, ny - py) >= {per_cent} * (nx + ny) and 100 * least(nx, ny) >= {per_cent} * greatest(nx, ny)"
    linked = f"100 * common >= {per_cent} * (na + nb - common)"
    # a doc_id of several texts unites their nodes
    several = rows.groupBy("doc_id").agg(F.min(F.struct("sig", "n")).alias("lo"), F.max(F.struct("sig", "n")).alias("hi")).filter("lo <> hi").select("doc_id")
    several = rows.join(several, "doc_id").join(nodes.select("sig", "n", "rep"), ["sig", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = written(several, "several")
    #: (node, component) of what is united so far
    region: DataFrame | None = None if several.isEmpty() else written(connected_components(several), "regions")
    checked: DataFrame | None = None
    pivots: DataFrame | None = None

    def with_region(df: DataFrame, of: str, to: str) -> DataFrame:
        if region is None:
            return df.withColumn(to, F.col(of))
        return df.join(region.select(F.col("node").alias(of), F.col("component").alias("_c")), of, "left").withColumn(to, F.coalesce("_c", of)).drop("_c")

    def homes() -> DataFrame:
        """(s, part, _home): the regions of a neighbourhood's pivots."""
        return to_parts(with_region(pivots, "ry", "cy").select("s", F.col("cy").alias("_home")).distinct())

    def outside(here: DataFrame) -> DataFrame:
        return here if pivots is None else here.join(homes().withColumnRenamed("_home", "cx"), ["s", "part", "cx"], "left_anti")

    left, level, last = None, 0, False
    while True:
        here = with_region(dealt, "rx", "cx")
        if not last:
            # each neighbourhood's pivot: of the nodes outside the regions of its pivots so far, the one
            # whose shared shingle stands first (edited copies have rare shingles before it)
            pick = outside(here).groupBy("s").agg(F.min(F.struct("px", "nx", "x", "rx")).alias("p")).select("s", F.col("p.px").alias("py"), F.col("p.nx").alias("ny"), F.col("p.x").alias("y"), F.col("p.rx").alias("ry"))
            pick = written(pick, "pivots")
            pivots = pick if pivots is None else pivots.unionByName(pick)
            stars = with_region(here.join(to_parts(pick), ["s", "part"]), "ry", "cy").filter("cx <> cy").filter(windows)
            # and each node of the open pairs takes its least neighbour
            first = with_region(with_region(open_pairs, "ra", "ca"), "rb", "cb").filter("ca <> cb")
            first = first.groupBy("b", "nb", "rb").agg(F.min(F.struct("ra", "a", "na")).alias("p")).select(F.col("p.a").alias("a"), F.col("p.na").alias("na"), "b", "nb")
        else:
            # the rest, exactly: nodes outside the first pivot's region meet the neighbourhood within their windows
            centre = pivots.groupBy("s").agg(F.min_by("ry", "py").alias("ry"))
            away = here.join(to_parts(with_region(centre, "ry", "cy").select("s", F.col("cy").alias("_home"))), ["s", "part"]).filter("cx <> _home")
            near = to_parts(away.select("s", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("px").alias("py"), F.col("rx").alias("ry"), F.col("cx").alias("cy")))
            stars = here.join(near, ["s", "part"]).filter("cx <> cy").filter(windows)
            if checked is not None:
                far = checked.select(F.col("ra").alias("r1"), F.col("rb").alias("r2"), (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d"))
                far = far.unionByName(far.select(F.col("r2").alias("r1"), F.col("r1").alias("r2"), "d"))
                to = centre.join(big.select("s", F.col("rx").alias("r1")), "s").join(far.withColumnRenamed("r2", "ry"), ["r1", "ry"]).select("s", "r1", "d").dropDuplicates(["s", "r1"])
                stars = stars.join(to.select("s", F.col("r1").alias("rx"), F.col("d").alias("dx")), ["s", "rx"], "left").join(to.select("s", F.col("r1").alias("ry"), F.col("d").alias("dy")), ["s", "ry"], "left")
                stars = stars.filter(f"dx is null or dy is null or abs(dx - dy) <= {(100 - per_cent) / 100} + 1e-9")
            first = with_region(with_region(open_pairs, "ra", "ca"), "rb", "cb").filter("ca <> cb").select("a", "na", "b", "nb")
        pairs = _ordered(stars.select(F.col("x").alias("a"), F.col("nx").alias("na"), F.col("y").alias("b"), F.col("ny").alias("nb")).unionByName(first))
        if checked is not None:
            pairs = pairs.join(checked.select("a", "na", "b", "nb"), ["a", "na", "b", "nb"], "left_anti")
        now = written(_sketched(pairs, nodes, per_cent), "asked")
        now = written(_verified(now, docs, shingle_words, broadcast_limit), f"level{level}")
        checked = now if checked is None else checked.unionByName(now)
        if not now.isEmpty():
            edges = now.filter(linked).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            if region is not None:
                edges = edges.unionByName(region.select(F.col("node").alias("a"), F.col("component").alias("b")))
            region = written(connected_components(edges), "regions")
        if last:
            break
        level += 1
        # pairs of nodes in different regions, which the rest would have to look at
        counts = with_region(dealt, "rx", "cx").groupBy("s", "cx").agg(F.count("*").cast("double").alias("c"))
        counts = counts.groupBy("s").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("inside"))
        pairs_left, n_big = counts.agg(F.coalesce(F.sum(F.col("size") * F.col("size") - F.col("inside")), F.lit(0.0)), F.coalesce(F.sum("size"), F.lit(0.0))).first()
        last = level >= 2 and (level >= levels or pairs_left <= rest * n_big or (left is not None and 2 * pairs_left > left))
        left = pairs_left

    out = rows.select("doc_id", "n", "sig").join(nodes.select("sig", "n", "rep"), ["sig", "n"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    if region is not None:
        out = out.join(region.select(F.col("node").alias("rep"), "component"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
