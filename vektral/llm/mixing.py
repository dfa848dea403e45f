"""Mixing sources to target weights, with DataFrame operations only.

Each document gets a key from a hash of its id; within its source the documents stand in the order
of their keys.  Rows equal in source, id and size are one row with a count from the start on, so that an
id that a third of all rows share is no larger than its number of sizes.  Key ranges of about
rows_per_range documents are summed, and so are runs of RUN ranges; the runs are summed up within the
source, the ranges within their run, and inside a range a window adds the rest: a prefix sum of three
levels, of which no step but the topmost holds more than one range or run, however large a source is
(the topmost has a row for each two million documents).  The source's target is then cut off exactly:
so many whole epochs, and of the last one the words before the cut.

Sizes are the numbers of runs of other characters than [\\x20\\x09-\\x0D].

Defined results: a null or empty text has size 0 and nothing of it is taken; a null source is a
source of its own, last; rows that repeat a doc_id are documents of their own, in the order of their
sizes; documents without any word at all give target 0; other columns, whatever their names, aren't read and go
along with the mixed documents; an empty table gives an empty one.  The targets' windows see one row a source, in
one task: some hundred bytes each, so a million sources are well within its memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
#: ranges to a run, a power of two
RUN = 1024
#: copies that one row is expanded to in its own task
COPIES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash_key(doc_id: Column) -> Column:
    """60 random bits of an id, the same on every run; a null id counts as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """(rank, source, n, source_size, target): one row per source.

    Targets are min(max_epochs * source_size, level * weight); the level is found from the sources
    in the order in which they reach their limit.  The windows run over the sources only.
    """
    totals = sizes.groupBy("source").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("source_size"))
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") - 1) % len(weights) + 1)
    s = totals.withColumn("rank", F.row_number().over(by_code)).withColumn("weight", w)
    s = s.withColumn("limit", max_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    s = s.withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    # the first source in that order that stays below its limit fixes the level of all that follow
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)
    s = s.withColumn("level", first["level"])
    return s.select("rank", "source", "n", "source_size", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, rows_per_range: int = 2_000, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs."""
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    sizes = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    sizes = written(sizes.withColumn("key", hash_key(F.col("doc_id"))), "sizes")
    targets = source_targets(sizes, weights, max_epochs)
    rows = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # as many equal key ranges as the source needs
    ranges = F.ceil(F.col("n") / rows_per_range)
    rows = rows.withColumn("range", F.floor(F.col("key") / (F.lit(2**KEY_BITS) / ranges)).cast("long")).withColumn("words", F.col("copies") * F.col("size"))
    sums = rows.groupBy("rank", "range").agg(F.sum("words").alias("_sum")).withColumn("run", F.shiftright("range", RUN.bit_length() - 1))
    earlier = lambda *keys, by: F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy("rank", "run").agg(F.sum("_sum").alias("_sum")).select("rank", "run", earlier("rank", by="run").alias("_base"))
    sums = sums.select("rank", "run", "range", earlier("rank", "run", by="range").alias("_in_run")).join(runs, ["rank", "run"])
    sums = sums.select("rank", "range", (F.col("_base") + F.col("_in_run")).alias("base"))
    inside = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["rank", "range"]).withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    # equal rows stand one after the other; very many of them are dealt to several tasks first
    few = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    if (sizes.agg(F.max("copies")).first()[0] or 0) > COPIES:
        many = rows.filter(F.col("copies") > COPIES).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
        many = many.repartition("doc_id", "_c")
        many = many.withColumn("_k", F.explode(F.sequence(F.col("_c") * COPIES, F.least(F.col("copies") - 1, F.col("_c") * COPIES + (COPIES - 1))))).drop("_c")
        rows = rows.filter(F.col("copies") <= COPIES).withColumn("_k", few).unionByName(many)
    else:
        rows = rows.withColumn("_k", few)
    rows = rows.withColumn("before", F.col("before") + F.col("_k") * F.col("size"))
    whole = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size")).cast("long")).otherwise(0)
    cut = whole - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), cut - F.col("before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time only if the cut leaves
    half of its words or more.  Columns as docs, whatever their names; whole texts; a document without words goes."""
    own = uuid.uuid4().hex  # no column of docs has it in its name
    c_id, c_size, c_times, c_copy = (f"_{x}{own}" for x in ("id", "size", "times", "copy"))
    ids = F.col(f"`{kw.get('doc_id', 'doc_id')}`")
    taken = mix_sources(docs, **kw)
    times = taken.select(F.col("doc_id").alias(c_id), F.col("size").alias(c_size + "r"), F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias(c_times))
    # rows that repeat an id and a size get the sum of their times once each
    times = times.groupBy(c_id, c_size + "r").agg(F.floor(F.avg(c_times) + 0.5).cast("int").alias(c_times)).filter(F.col(c_times) > 0)
    both = docs.withColumn(c_size, n_words(F.col(f"`{kw.get('text', 'text')}`")))
    joined = both.join(times, ids.eqNullSafe(F.col(c_id)) & (F.col(c_size) == F.col(c_size + "r")))
    return joined.withColumn(c_copy, F.explode(F.sequence(F.lit(1), F.col(c_times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM t),
w AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap FROM r),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, CAST(total - before AS DOUBLE) / open AS lev FROM o),
c AS (SELECT lev FROM l WHERE lev * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
g AS (SELECT l.source, l.source_size, least(CAST(l.cap AS DOUBLE), c.lev * l.weight) AS target FROM l, c),
p AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM p)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
