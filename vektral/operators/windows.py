"""Block-wise splits and count-based moving windows over ordered samples of a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dataset import with_count, with_place


def block_split(row: Column, n: Column, tr: float, val: float, te: float) -> Column:
    """TR, VAL or TE of the row-th of n samples, in contiguous blocks; what is left over is null."""
    seen = tr + val
    seen_end = F.ceil(n * seen)
    tr_end = F.ceil(seen_end / seen * tr)
    te_end = seen_end + F.floor(n * te)
    return F.when(row <= tr_end, "TR").when(row <= seen_end, "VAL").when(row <= te_end, "TE")


def segments(df: DataFrame, cls: str, order: str, tr: float, val: float, te: float) -> DataFrame:
    """Adds row (place in the class), split, and pos (place in the class's block of that split).  The blocks
    follow each other, so that a place in one is a place in the class less what stands before it."""
    row, n = F.col("row"), F.col("_n")
    out = with_count(with_place(df, cls, [order], "row"), cls)
    split = block_split(row, n, tr, val, te)
    seen_end = F.ceil(n * (tr + val))
    tr_end = F.ceil(seen_end / (tr + val) * tr)
    out = out.withColumn("split", split).filter("split is not null")
    pos = F.when(F.col("split") == "TR", row).when(F.col("split") == "VAL", row - tr_end).otherwise(row - seen_end)
    return out.withColumn("pos", pos.cast("int")).withColumn("row", row.cast("int")).drop("_n")


def window_bounds(blocks: DataFrame, size: int, step: int) -> DataFrame:
    """(…, st, en) of all windows of blocks with a length column: starts 1, 1 + step, … until a window
    reaches the end; the last one is cut there."""
    last = F.greatest(F.lit(0), F.ceil((F.col("length") - size) / step)).cast("int")
    out = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    return out.withColumn("st", F.col("k") * step + 1).withColumn("en", F.least(F.col("st") + size - 1, F.col("length"))).drop("k")


def moving_windows(segmented: DataFrame, cls: str, value: str, size: int, step: int) -> DataFrame:
    """(cls, split, st, en, n, total, scaled_max): each window's sum, and its greatest value over the
    greatest of all windows of its block.  A sample goes to its windows by arithmetic, not by a range
    join."""
    blocks = segmented.groupBy(cls, "split").agg(F.count("*").alias("length"))
    bounds = window_bounds(blocks, size, step)
    # the windows (st - 1) / step that can hold a sample
    k = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("pos") - size) / step)).cast("int"), F.floor((F.col("pos") - 1) / step).cast("int"))
    rows = segmented.select(cls, "split", F.col(value).alias("x"), F.explode(k).alias("k")).withColumn("st", F.col("k") * step + 1)
    sums = rows.join(bounds, [cls, "split", "st"]).groupBy(cls, "split", "st", "en").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("x").alias("_max"))
    top = sums.groupBy(F.col(cls).alias("_cls"), F.col("split").alias("_split")).agg(F.max("_max").alias("_top"))
    sums = sums.join(top, F.col(cls).eqNullSafe(F.col("_cls")) & (F.col("split") == F.col("_split")))
    return sums.withColumn("scaled_max", F.when(F.col("_top") != 0, F.col("_max") / F.col("_top"))).drop("_max", "_cls", "_split", "_top")


def z_scores(df: DataFrame, by: str, value: str) -> DataFrame:
    """Sample z-scores inside each group; constant groups give 0.  A group's mean and deviation are an aggregate
    with map-side combine, joined to its rows."""
    stats = df.groupBy(F.col(by).alias("_by")).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    z = F.when(F.col("_sd") == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("_mean")) / F.col("_sd"))
    return df.join(stats, F.col(by).eqNullSafe(F.col("_by"))).withColumn("z", z).drop("_by", "_mean", "_sd")
