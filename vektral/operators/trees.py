"""Minimum spanning forests, packings, and the dimensions that their growth shows."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, drop_folder, fitting, load_array, read_block, store_array, whole, within
from .graphs import cut, shared_folder
from .neighbours import neighbour_graph


def spanning_forest(edges: DataFrame, weight: str = "d2") -> DataFrame:
    """(src, dst, weight), src < dst: the minimum spanning tree of each connected part of the graph (src, dst,
    weight), its edges in order of weight, src, dst where weights are equal.

    Boruvka's rounds: every part takes its least edge outwards (minima are combined before the shuffle, so a part
    with a third of all edges is no larger than its minimum), the parts so tied are contracted by doubling pointers,
    and of the edges between two parts the least stays.  At least half of the parts go in each round.  Loops,
    null ends and null weights are no edges; of repeated edges the least counts."""
    w = F.col(weight)
    live = edges.filter(F.col("src") != F.col("dst")).filter(w.isNotNull()).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("w"))
    live = cut(live.groupBy("src", "dst").agg(F.min("w").alias("w")).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", "src", "dst").alias("e")))
    forest: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("part"), "b", "e").unionByName(live.select(F.col("b").alias("part"), F.col("a").alias("b"), "e"))
        least = cut(ends.groupBy("part").agg(F.min(F.struct("e", "b")).alias("m")).select("part", "m.e", "m.b"))
        forest.append(least.select("e").distinct())
        to = _roots(least.select("part", F.col("b").alias("up"))).withColumnsRenamed({"part": "_n", "up": "_to"})
        for c in ("a", "b"):
            live = live.join(to, F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce("_to", c)).drop("_n", "_to")
        live = live.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e")
        live = cut(live.groupBy("a", "b").agg(F.min("e").alias("e")))
    if not forest:
        return edges.select("src", "dst", w.alias(weight)).limit(0)
    return reduce(DataFrame.unionByName, forest).select("e.src", "e.dst", F.col("e.w").alias(weight))


def _roots(up: DataFrame) -> DataFrame:
    """(part, up): the root above each part, where each points to one other and only two may point to each
    other, of which the smaller is the root.  Pointers double their reach in each round; many parts that point to
    one are a skewed join, which the session's adaptive plans split."""
    above = lambda df: df.select(F.col("part").alias("up"), F.col("up").alias("top"))
    mutual = (F.col("top") == F.col("part")) & (F.col("part") < F.col("up"))
    now = cut(up.join(above(up), "up").select("part", F.when(mutual, F.col("part")).otherwise(F.col("up")).alias("up")))
    while True:
        new = cut(now.join(above(now), "up").select("part", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("part", "up")
        now = new.select("part", "up")


def hash_order(sample_id: Column) -> Column:
    """60 bits of a hash, the same on every run."""
    return F.conv(F.substring(F.md5(sample_id.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def spanning_lengths(ds: DataFrame, k: int = 6, halvings: int = 3) -> DataFrame:
    """(n, length): of all samples, and of the halves, quarters and so on that come first in hash order, the
    number and the total edge length of the minimum spanning forest of their k-neighbour graph."""
    ds = cut(ds.filter(whole()).select("sample_id", "feat", hash_order(F.col("sample_id")).alias("_h")))
    out = []
    for j in range(halvings + 1):
        part = ds.filter(F.col("_h") < (1 << 60) >> j).drop("_h")
        length = spanning_forest(neighbour_graph(part, k)).agg(F.coalesce(F.sum(F.sqrt("d2")), F.lit(0.0)).alias("length"))
        out.append(cut(part.agg(F.count("*").alias("n")).join(length)))  # a row each
    return reduce(DataFrame.unionByName, out)


def spanning_dimension(ds: DataFrame, k: int = 6, halvings: int = 3) -> DataFrame:
    """(dimension): 1 / (1 - slope) of the log length of the minimum spanning forest over the log number of
    samples, null where fewer than two subsets have a length."""
    lengths = spanning_lengths(ds, k, halvings).filter("n > 1 and length > 0")
    slope = F.regr_slope(F.ln("length"), F.ln(F.col("n").cast("double")))
    return lengths.agg(F.when(slope != 1, F.abs(1 / (1 - slope))).alias("dimension"))


def packing(ds: DataFrame, radius: float, size: int = 4096) -> DataFrame:
    """(sample_id): a greatest set of samples of which no two are nearer than radius: the one that a walk over
    all samples in hash order picks, taking each that is far enough from those taken before.

    The open samples that come first, at most `size`, are walked in one task; then what lies within the radius of
    those taken goes, in blocks that meet the taken alone and give back a mark for each sample.  So the pairs met are
    those of samples and taken ones, and neither a graph of near pairs nor a list of one sample's neighbours is made.
    Samples of different lengths are apart; null, empty and non-finite vectors take no part."""
    rows = cut(ds.filter(whole()).select("sample_id", "feat", hash_order(F.col("sample_id")).alias("h")))
    if rows.isEmpty():
        return ds.select("sample_id").limit(0)
    spark = rows.sparkSession
    blocks = Blocks(rows, "h", size=min(size, fitting(rows.count())))
    names, at = [(r["name"], r["dim"]) for r in blocks.names.select("name", "dim").collect()], blocks.folder
    work = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    context = spark.sparkContext
    parts = min(len(names), 4 * max(1, context.defaultParallelism))

    def opened(key: tuple[str, int], turn: int) -> np.ndarray:
        return load_array(f"{work}/{turn}", key[0]) if turn else np.ones(len(read_block(at, key[0])[0]), bool)

    turn, found = 0, []
    while True:  # the places of the first open samples are `size` numbers
        def heads(key: tuple[str, int], turn: int = turn) -> np.ndarray:
            h = read_block(at, key[0])[2]["h"][opened(key, turn)]
            return np.sort(h)[:size]

        first = context.parallelize(names, parts).map(heads).reduce(lambda a, b: np.sort(np.concatenate((a, b)))[:size])
        if not len(first):
            break
        last = int(first[-1])

        def leading(key: tuple[str, int], turn: int = turn, last: int = last) -> tuple:
            ids, x, o = read_block(at, key[0])
            take = opened(key, turn) & (o["h"] <= last)
            return [(int(h), int(i), v) for h, i, v in zip(o["h"][take], ids[take], x[take])]

        def walked(rows) -> list:
            """The walk over one block of open samples."""
            by_length: dict[int, list] = {}
            for row in sorted(rows, key=lambda r: r[:2]):
                by_length.setdefault(len(row[2]), []).append(row)
            for dim, some in by_length.items():
                x = np.array([r[2] for r in some])
                free, won = np.ones(len(x), bool), []
                near = np.concatenate([within(x[lo : lo + 512], x, radius**2) for lo in range(0, len(x), 512)])
                for i in range(len(x)):
                    if free[i]:
                        won.append(i)
                        free &= ~near[i]
                store_array(f"{work}/won-{turn}", str(dim), x[won])
                store_array(f"{work}/ids-{turn}", str(dim), np.array([some[i][1] for i in won]))
            return sorted(by_length)

        dims = context.parallelize(names, parts).flatMap(leading).coalesce(1).mapPartitions(walked).collect()

        def cover(key: tuple[str, int], turn: int = turn, last: int = last, dims: list[int] = dims) -> int:
            _, x, o = read_block(at, key[0])
            free = opened(key, turn) & (o["h"] > last)
            if key[1] in dims and free.any():
                y = load_array(f"{work}/won-{turn}", str(key[1]))
                for lo in range(0, len(y), 512):
                    left = np.flatnonzero(free)
                    if len(left):
                        free[left] = ~within(x[left], y[lo : lo + 512], radius**2).any(1)
            store_array(f"{work}/{turn + 1}", key[0], free)
            return int(free.sum())

        found.append((turn, dims))
        if not context.parallelize(names, parts).map(cover).sum():
            break
        turn += 1

    files = [(t, dim) for t, dims in found for dim in dims]

    def taken(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(load_array(f"{work}/ids-{files[k][0]}", str(files[k][1])), pa.int64())], names=["sample_id"])

    out = cut(spark.range(0, len(files), 1, min(len(files), parts)).mapInArrow(taken, "sample_id long"))
    drop_folder(spark, work)
    blocks.forget()
    return out


def packing_dimension(ds: DataFrame, small: float, large: float, size: int = 4096) -> DataFrame:
    """(n_small, n_large, dimension): sizes of the packings of two radii, and how fast the one shrinks to the
    other."""
    count = lambda r, name: packing(ds, r, size).agg(F.count("*").alias(name))
    both = count(small, "n_small").join(count(large, "n_large"))  # a row each
    slope = -(F.ln("n_large") - F.ln("n_small")) / (np.log(large) - np.log(small))
    return both.select("n_small", "n_large", F.when(F.col("n_small") > 0, slope).alias("dimension"))
