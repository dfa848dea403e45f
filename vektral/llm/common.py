"""What the operators of this folder share: the shared folder, written tables, graph components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster is refused, since
    a machine's own folder isn't seen by the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="vektral-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vektral/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and it survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._vektral_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no result reads any more."""
    for t in tables:
        path = getattr(t, "_vektral_path", None)
        if path:
            forget_path(t.sparkSession, path)


def forget_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def store_of(folder: str):
    """The file system of a folder in the shared one, for tasks, and the folder's place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def put_file(folder: str, name: str, rows) -> None:
    """Writes an Arrow table as one file of a shared folder.  An attempt writes beside it and moves it there
    when it is whole; attempts of one task write the same."""
    import pyarrow as pa

    store, at = store_of(folder)
    store.create_dir(at, recursive=True)
    part = f"{at}/{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out, pa.ipc.new_file(out, rows.schema) as to:
        to.write_table(rows)
    store.move(part, f"{at}/{name}.arrow")


def get_file(folder: str, name: str):
    import pyarrow as pa

    store, at = store_of(folder)
    with store.open_input_file(f"{at}/{name}.arrow") as source:
        return pa.ipc.open_file(source).read_all()


def every_pair(left: DataFrame, right: DataFrame, most: int = 10_000) -> DataFrame:
    """(a, b, dim) for each file a of left and b of right (part, dim) of one dimension: names of files, not
    rows.  Pairs of one a stand together, dealt to tasks by ranges."""
    pairs = written(left.select(F.col("part").alias("a"), "dim").join(right.select(F.col("part").alias("b"), "dim"), "dim"), "pairs")
    n = max(1, min(most, pairs.count()))
    return pairs.repartitionByRange(n, "dim", "a", "b").sortWithinPartitions("dim", "a", "b").select("a", "b", "dim")


def small_batches(spark: SparkSession, rows: int = 2048, size: str = "8m") -> None:
    """Arrow batches of a few MB, however long the texts, unless the session says otherwise: a task holds
    one on either side of its Python worker."""
    for key, value, default in (("maxRecordsPerBatch", str(rows), "10000"), ("maxBytesPerBatch", size, "64MB")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key).upper() in (default, str(64 << 20), f"{64 << 20}B"):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps.  Every step is an aggregation with map-side
    combine and an equi-join, so no component or neighbour list meets in one task; each round is a
    written table.  Null ends and self loops are ignored; no edges give no rows.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    e = written(e.filter("lo is not null and hi is not null and lo <> hi").distinct(), "edges")
    last = None
    old: deque[DataFrame] = deque([e])
    while True:
        # large star: every larger neighbour of u is tied to the least node around u
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).filter("lo <> hi").distinct()
        e = written(small, "edges")
        old.append(e)
        while len(old) > 2:
            forget(old.popleft())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == last:
            forget(old.popleft())
            break
        last = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


#: Large tables that a Python worker keeps from task to task, of one operator at a time.
_held: dict = {}


def held(key, make):
    """The tables under this key, made when the worker first needs them; those of other keys go."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release(keep=None) -> None:
    """Called first in a task, since a worker may come from another operator: tables it keeps go, unless
    they are held under keep, and memory that is free in the process goes back to the machine."""
    if keep is not None and keep in _held:
        return
    import ctypes
    import gc

    import pyarrow as pa

    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: the memory is free for reuse, if not returned
