"""Blocked passes over all pairs of two datasets: each side is dealt into files of bounded size in the shared
folder, and a task gets names of files, so that no side's rows are copied through a shuffle or a broadcast.

What a pass gives back is reduced in its task: pairs of one left block stand together, and their results are
merged before they leave."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import cut, shared_folder

#: columns of a block: ids, vectors, and what else a row is compared by
Block = tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]


def whole(feat: str = "feat"):
    """Vectors that aren't null or empty and hold no null or non-finite component."""
    return F.forall(feat, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(feat) > 0)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def read_block(folder: str, name: str) -> Block:
    store, at = _store(folder)
    with store.open_input_file(f"{at}/{name}.arrow") as source, pa.ipc.open_file(source) as file:
        t = file.read_all()
    x = np.asarray(t["feat"].combine_chunks().flatten(), float).reshape(t.num_rows, -1)
    return np.asarray(t["sample_id"]), x, {c: np.asarray(t[c]) for c in t.column_names if c not in ("sample_id", "feat")}


class Blocks:
    """A dataset (sample_id, feat and other columns of numbers) as files: folder, and names as a table.

    by, one of the other columns, deals rows of one value together: values of at least half a block get blocks of
    their own, smaller ones share some, rows without a value go.  Names then come with the least and greatest value (lo, hi)."""

    def __init__(self, ds: DataFrame, *others: str, size: int = 4096, by: str | None = None):
        self.spark = ds.sparkSession
        self.folder = f"{shared_folder(self.spark)}/blocks-{uuid.uuid4().hex}"
        rows = ds.filter(whole()).select("sample_id", "feat", *others)
        folder = self.folder

        def put(key: tuple, part: pa.Table) -> pa.Table:
            part = part.drop_columns(["part", "dim"]).sort_by("sample_id")
            store, at = _store(folder)
            store.create_dir(at, recursive=True)
            name = f"{key[0].as_py()}-{key[1].as_py()}"
            fresh = f"{at}/{uuid.uuid4().hex}.part"  # attempts of one task write the same
            with store.open_output_stream(fresh) as out, pa.ipc.new_file(out, part.schema) as to:
                to.write_table(part)
            store.move(fresh, f"{at}/{name}.arrow")
            ends = {c: pa.array([f(part[by]).as_py()], pa.int64()) for c, f in (("lo", pc.min), ("hi", pc.max))} if by else {}
            return pa.table({"name": [name], "dim": pa.array([key[1].as_py()], pa.int32())} | ends)

        if by:
            counts = cut(rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n")))
            shared = counts.filter(2 * F.col("_n") < size).agg(F.sum("_n")).first()[0] or 0
            deal = lambda what, n: F.pmod(F.xxhash64(what), n)
            own = F.concat_ws("_", by, deal("sample_id", F.ceil(F.col("_n") / size)))
            part = F.when(2 * F.col("_n") >= size, own).otherwise(F.concat(F.lit("s"), deal(by, F.lit(max(1, -(-shared // size))))))
            dealt = rows.join(counts, by).withColumn("part", part).drop("_n")
        else:
            n = max(1, -(-rows.count() // size))
            dealt = rows.withColumn("part", F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("int"))
        schema = "name string, dim int" + (", lo long, hi long" if by else "")
        self.names = cut(dealt.withColumn("dim", F.size("feat")).groupBy("part", "dim").applyInArrow(put, schema))

    def forget(self) -> None:
        drop_folder(self.spark, self.folder)


    def listed(self) -> list[str]:
        """Names of the blocks, all of whose vectors are of one length."""
        found = self.names.select("name", "dim").collect()
        if len({r["dim"] for r in found}) > 1:
            raise ValueError("vectors of different lengths")
        return sorted(r["name"] for r in found)


def fitting(n: int) -> int:
    """Rows of a block for passes whose tasks take a block each: small inputs spread over the cores."""
    return min(2048, max(256, -(-n // 48)))


def store_array(folder: str, name: str, x: np.ndarray) -> None:
    """An array as a file; attempts of one task write the same."""
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    data, fresh = io.BytesIO(), f"{at}/{uuid.uuid4().hex}.part"
    np.save(data, x, allow_pickle=False)
    with store.open_output_stream(fresh) as out:
        out.write(data.getvalue())
    store.move(fresh, f"{at}/{name}.npy")


def load_array(folder: str, name: str) -> np.ndarray:
    store, at = _store(folder)
    with store.open_input_file(f"{at}/{name}.npy") as source:
        return np.load(io.BytesIO(source.read()), allow_pickle=False)


def drop_folder(spark, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def summed(spark, names: list, give: Callable[[object], np.ndarray]) -> np.ndarray:
    """The sum of the arrays, all of one shape, that give returns for each block.  Tasks add up their blocks'."""
    context = spark.sparkContext
    parts = context.parallelize(names, min(len(names), 4 * max(1, context.defaultParallelism)))
    return parts.map(give).reduce(np.add)


def summed_pairs(blocks: Blocks, meet: Callable[[Block, Iterator[Block | None]], np.ndarray], chunk: int = 64) -> np.ndarray | None:
    """The sum of meet(block, others) over all unordered pairs of blocks, a block's pair with itself being None, but for
    pairs of one value of the column that blocks are dealt by; None if there are no blocks.  Of blocks in a circle each
    meets the half that follows it, at most chunk of them in a call, so all have the same work and no list of pairs is made."""
    found = sorted((r["name"], r["lo"], r["hi"]) for r in blocks.names.collect())
    if not found:
        return None
    n, half, folder = len(found), len(found) // 2, blocks.folder
    chunk = min(chunk, max(1, n * (half + 1) // (8 * max(1, blocks.spark.sparkContext.defaultParallelism))))
    slices = -(-(half + 1) // chunk)

    def give(task: int) -> np.ndarray:
        i, s = divmod(task, slices)
        name, lo, hi = found[i]
        steps = range(s * chunk, min((s + 1) * chunk, half + 1))
        ahead = ((t, *found[(i + t) % n]) for t in steps if not (t and 2 * t == n and i >= half))
        return meet(read_block(folder, name), (read_block(folder, b) if t else None for t, b, *ends in ahead if not lo == hi == ends[0] == ends[1]))

    return summed(blocks.spark, list(range(n * slices)), give)


def paired(spark, names: list[str], work: str, start: Callable[[str], object], meet: Callable[[object, object | None], tuple[np.ndarray, np.ndarray | None]], finish: Callable[[str, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of finish(name, total), where a block's total adds up what meet gives to it over its pairs with all
    blocks.  Each unordered pair is met once: meet(one, other), of what start gives for their names, returns what goes
    to each; other is None for a block's pair with itself.  Of blocks in a circle each meets the half that follows
    it; what goes to others stands in files until it is added up."""
    n, half = len(names), len(names) // 2
    parts = f"{work}/parts-{uuid.uuid4().hex}"
    ahead = lambda i: [(i + t) % n for t in range(1, half + 1) if not (2 * t == n and i >= half)]
    context = spark.sparkContext

    def give(i: int) -> int:
        one = start(names[i])
        mine = meet(one, None)[0]
        for j in ahead(i):
            to, theirs = meet(one, start(names[j]))
            mine = mine + to
            store_array(parts, f"{j}-{i}", theirs)
        store_array(parts, f"{i}-{i}", mine)
        return 1

    def add(j: int) -> np.ndarray:
        total = load_array(parts, f"{j}-{j}")
        for t in range(1, half + 1):
            i = (j - t) % n
            if not (2 * t == n and i >= half):
                total = total + load_array(parts, f"{j}-{i}")
        return finish(names[j], total)

    context.parallelize(range(n), n).map(give).count()
    out = summed(spark, list(range(n)), add)
    drop_folder(spark, parts)
    return out


def vectors_of(blocks: Blocks, names: list[str], give: Callable[[str], np.ndarray]) -> DataFrame:
    """(sample_id, feat): the rows that give returns for each block."""
    folder = blocks.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, y = read_block(folder, names[k])[0], np.asarray(give(names[k]), float)
                feat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), feat], names=["sample_id", "feat"])

    return cut(blocks.spark.range(0, len(names), 1, len(names)).mapInArrow(run, "sample_id long, feat array<double>"))


def by_gallery(probes: DataFrame, gallery: DataFrame, decide: Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]], rows: int = 256) -> DataFrame:
    """(sample_id, cls, predicted): decide(vectors, classes) of the whole gallery gives a function of a batch of
    probes.  The gallery is files that each task reads, in the order of class and id; a task has about so many
    probes.  The driver sees names of files."""
    blocks = Blocks(gallery, "cls")
    folder, names = blocks.folder, [r["name"] for r in blocks.names.select("name").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = None
        for batch in batches:
            if batch.num_rows:
                if choose is None:
                    parts = [read_block(folder, name) for name in names]
                    ids, x, c = (np.concatenate(v) for v in zip(*((i, v, o["cls"]) for i, v, o in parts)))
                    order = np.lexsort((ids, c))
                    choose = decide(x[order], c[order])
                found = choose(np.asarray(batch.column(2).flatten(), float).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.astype(np.int32))], names=["sample_id", "cls", "predicted"])

    asked = probes.select("sample_id", "cls", "feat")
    out = cut(asked.repartition(max(1, -(-asked.count() // rows)), "sample_id").mapInArrow(run, "sample_id long, cls int, predicted int"))
    blocks.forget()
    return out


def over_pairs(left: Blocks, right: Blocks, start: Callable[[Block], object], meet: Callable[[object, Block, Block], object], finish: Callable[[object, Block], pa.RecordBatch], schema: str, most: int = 10_000, chunk: int = 64, same: bool = False) -> DataFrame:
    """For each left block: start(block), then meet(what is known, block, right block) for the right blocks of
    its dimension, chunk of them in a task, then finish gives rows.  same leaves out pairs of blocks that share no
    value of the column that both sides are dealt by."""
    a, b = (side.names.withColumnRenamed("name", c) for side, c in ((left, "a"), (right, "b")))
    if same:
        b = b.withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
    pairs = a.join(b, "dim").filter("lo <= hi2 and lo2 <= hi") if same else a.join(b, "dim")
    several = pairs.withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(-(-max(1, right.names.count()) // chunk))))
    tasks = several.groupBy("a", "slice").agg(F.sort_array(F.collect_list("b")).alias("bs"))  # names of about chunk files
    n = max(1, min(most, tasks.count()))
    one, other = left.folder, right.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, bs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = read_block(one, a)
                known = start(block)
                for b in bs:
                    known = meet(known, block, read_block(other, b))
                yield finish(known, block)

    return tasks.select("a", "bs").repartition(n).mapInArrow(run, schema)


def squared_distances(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and the rounding error of each row's."""
    x2, y2 = (x * x).sum(1), (y * y).sum(1)
    error = 8 * np.finfo(float).eps * (x.shape[1] + 2) * (x2 + y2.max(initial=0))
    return x2[:, None] + y2 - 2 * x @ y.T, error


def within(x: np.ndarray, y: np.ndarray, d2: float) -> np.ndarray:
    """Whether rows of x and y lie at a squared distance under d2; doubtful ones are compared exactly."""
    d, error = squared_distances(x, y)
    near = d < d2
    for i, j in zip(*np.nonzero(np.abs(d - d2) <= error[:, None])):
        near[i, j] = ((x[i] - y[j]) ** 2).sum() < d2
    return near
