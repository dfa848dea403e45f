"""Connected parts and hop distances of graphs given as edge tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.  A local session without
    one gets a temporary folder, a cluster without one is refused."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="vektral-cut-"))
            atexit.register(shutil.rmtree, _own[0], True)
        found = f"file://{_own[0]}"
    return found


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and so do the constraints of its plan, which
    a checkpoint keeps and joins in a loop multiply."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_parts(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, part): the smallest node reachable over the edges (src, dst), itself included.

    Star contraction: a round hangs each node's larger neighbours on its smallest one, then each
    node's smaller neighbours.  Minima are combined before the shuffle, so a hub's edges are never
    gathered in one task; rounds grow with the logarithm of the longest path.  Null ends are ignored,
    loops and repeated edges change nothing.
    """
    ends = cut(edges.filter("src is not null and dst is not null").select("src", "dst"))
    nodes = ends.select(F.col("src").alias("node")).unionByName(ends.select(F.col("dst").alias("node"))).distinct()
    now = cut(ends.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.withColumnRenamed("m", "v")).filter("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("_p")), "node", "left").select("node", F.coalesce("_p", "node").alias("part"))
        state = seen
    raise RuntimeError("connected parts did not settle")


def hops(edges: DataFrame, sources: DataFrame, most_hops: int) -> DataFrame:
    """(node, hops): least number of edges (src, dst) from any of the sources (node), up to most_hops."""
    edges = cut(edges.select("src", "dst"))  # each round reads them
    found = cut(sources.select("node").distinct().withColumn("hops", F.lit(0)))
    front = found
    for k in range(1, most_hops + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(found, "node", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found
