"""Class index, declarative slices, set operations and scenario grids of datasets."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graphs import cut


def class_index(ds: DataFrame) -> DataFrame:
    """Adds n_per_class and cls_st, the number (from 1) of the class's first sample when classes follow
    one another.  The running sum runs over the classes, not the samples."""
    sizes = ds.groupBy("cls").agg(F.count("*").alias("n_per_class"))
    before = Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("cls_st", F.coalesce(F.sum("n_per_class").over(before), F.lit(0)) + 1)
    return ds.join(sizes, "cls")


def stable_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, id): ids of distinct keys by first appearance."""
    first = df.groupBy(key).agg(F.min(order).alias("_at"))
    return first.select(key, F.row_number().over(Window.orderBy("_at", key)).alias("id"))


@dataclass(frozen=True)
class Selection:
    """Which samples go to which split: classes and places inside the class, with repeats.

    A list of lists gives each class, in the order of the classes chosen, places of its own.
    """

    tr: list = field(default_factory=list)
    val: list = field(default_factory=list)
    te: list = field(default_factory=list)
    tr_out: list = field(default_factory=list)
    val_out: list = field(default_factory=list)
    te_out: list = field(default_factory=list)
    classes: list[int] | None = None
    val_classes: list[int] | None = None
    te_classes: list[int] | None = None

    def spec(self) -> list[tuple[str, int | None, int, int]]:
        """(split, class or None for all, place, how many-th repeat) of all samples asked for."""
        rows = []
        for split, places, classes in (("TR", self.tr, self.classes), ("VAL", self.val, self.val_classes or self.classes), ("TE", self.te, self.te_classes or self.classes), ("TR_OUT", self.tr_out, self.classes), ("VAL_OUT", self.val_out, self.val_classes or self.classes), ("TE_OUT", self.te_out, self.te_classes or self.classes)):
            ragged = bool(places) and isinstance(places[0], list)
            if ragged and classes is None:
                raise ValueError("places by class need the classes")
            for k, cls in enumerate(sorted(set(classes)) if classes else [None]):
                seen: dict[int, int] = {}
                for place in sorted(places[k] if ragged else places):
                    seen[place] = seen.get(place, 0) + 1
                    rows.append((split, cls, place, seen[place]))
        return rows


def slice_dataset(ds: DataFrame, selection: Selection) -> DataFrame:
    """Samples by split, in the place given: one equi-join with the (small) specification."""
    spark = ds.sparkSession
    spec = spark.createDataFrame(selection.spec(), "split string, _cls int, col_idx int, dup int")
    every = spec.filter("_cls is null").drop("_cls")
    some = spec.filter("_cls is not null").withColumnRenamed("_cls", "cls")
    picked = ds.join(F.broadcast(every), "col_idx").unionByName(ds.join(F.broadcast(some), ["cls", "col_idx"]))
    return picked


def missing_places(ds: DataFrame, selection: Selection) -> DataFrame:
    """What a selection asks for and the dataset lacks."""
    spec = ds.sparkSession.createDataFrame(selection.spec(), "split string, _cls int, col_idx int, dup int")
    classes = ds.select("cls").distinct()
    asked = spec.filter("_cls is null").drop("_cls").join(F.broadcast(classes)).unionByName(spec.filter("_cls is not null").withColumnRenamed("_cls", "cls"))
    return asked.join(ds.select("cls", "col_idx"), ["cls", "col_idx"], "left_anti").select("split", "cls", "col_idx")


def target_pairs(sliced: DataFrame, split: str = "TR", target: str = "TR_OUT") -> DataFrame:
    """Inputs and targets of a regression: the k-th of each, class by class."""
    side = lambda s, name: with_place(sliced.filter(F.col("split") == s), "cls", ["col_idx", "dup"], "k").select("cls", "k", F.col("sample_id").alias(name))
    return side(split, "input_id").join(side(target, "target_id"), ["cls", "k"])


def with_count(df: DataFrame, key: str, name: str = "_n") -> DataFrame:
    """The number of rows of a row's key: counts with map-side combine, joined back."""
    n = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(name))
    return df.join(n, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def select_share(ds: DataFrame, share: float) -> DataFrame:
    """The first ceil(share * n) samples of each class."""
    return with_count(ds, "cls").filter(F.col("col_idx") <= F.ceil(F.lit(share) * F.col("_n"))).drop("_n")


def flip_classes(ds: DataFrame) -> DataFrame:
    """Samples of each class in reverse order."""
    return with_count(ds, "cls").withColumn("col_idx", (F.col("_n") + 1 - F.col("col_idx")).cast("int")).drop("_n")


def merge_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Class by class: a's samples, then b's."""
    both = a.withColumn("_src", F.lit(0)).unionByName(b.withColumn("_src", F.lit(1)))
    placed = with_place(both, "cls", ["_src", "col_idx"], "_new")
    return placed.drop("col_idx", "_src").withColumn("_new", F.col("_new").cast("int")).withColumnRenamed("_new", "col_idx")


def concat_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's classes behind a's."""
    last = a.agg(F.max("cls").alias("_last"))
    return a.unionByName(b.join(F.broadcast(last)).withColumn("cls", F.col("cls") + F.coalesce("_last", F.lit(0))).drop("_last"))


def joined_galleries(*parts: DataFrame) -> DataFrame:
    """Galleries, each projected by its own weights, as one: a row's gallery says which it came from."""
    out = None
    for k, part in enumerate(parts, 1):
        part = part.withColumn("gallery", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def excerpt(ds: DataFrame, offset: int, n: int, order: list[str]) -> DataFrame:
    """n samples from the offset-th on (from 0), in the order given: for display."""
    return with_ordinal(ds, order).filter(F.col("ordinal").between(offset + 1, offset + n))


def mini_batches(ds: DataFrame, size: int, order: list[str]) -> DataFrame:
    """batch numbers in a given order, short last batch.  Ordinals come from counts per range of the
    order, so no window spans all rows."""
    numbered = with_ordinal(ds, order)
    return numbered.withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("long"))


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Global row numbers (from 1) by unique sort columns: a range partitioning, the partitions' counts
    summed up, and row numbers inside the partitions.

    The ranged rows are written once with their partition and place, and counts and rows both come from
    there: a second evaluation could draw other ranges."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: no more than spark.sql.shuffle.partitions
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def with_place(df: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """A row's number (from 1) among the rows of its key, by unique sort columns: its global row number less that
    of its key's first row.  A key with a third of all rows is dealt out by ranges like any other."""
    numbered = with_ordinal(df, [key, *order], "_ordinal")
    first = numbered.groupBy(F.col(key).alias("_key")).agg(F.min("_ordinal").alias("_first"))
    placed = numbered.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return placed.withColumn(name, F.col("_ordinal") - F.col("_first") + 1).drop("_key", "_first", "_ordinal")


def arrangements(spark: SparkSession, n: int, k: int, ordered: bool, repeated: bool) -> DataFrame:
    """Permutations or combinations of 1..n taken k at a time, columns c1..ck."""
    out = spark.range(1, n + 1).select(F.col("id").alias("c1"))
    for j in range(2, k + 1):
        nxt = spark.range(1, n + 1).select(F.col("id").alias(f"c{j}"))
        if ordered and repeated:
            out = out.crossJoin(nxt)
        elif ordered:
            keep = F.lit(True)
            for i in range(1, j):
                keep = keep & (F.col(f"c{i}") != F.col(f"c{j}"))
            out = out.crossJoin(nxt).filter(keep)
        else:
            prev, now = F.col(f"c{j - 1}"), F.col(f"c{j}")
            out = out.crossJoin(nxt).filter(prev <= now if repeated else prev < now)
    return out


def damage_grid(spark: SparkSession, elements: list[list[int]], magnitudes: list[float], n_elements: int) -> DataFrame:
    """All magnitude combinations of each case's elements, first element slowest; other elements 1.0.
    ulbl counts on over the cases; row 0 is the intact structure."""
    s, cases, offset = len(magnitudes), [], 0
    mags = F.array(*[F.lit(m) for m in magnitudes])
    for c, els in enumerate(elements, 1):
        k, row = len(els), F.col("id")
        values = {e: F.element_at(mags, (F.floor(row / s ** (k - i)) % s + 1).cast("int")) for i, e in enumerate(els, 1)}
        state = F.array(*[values.get(e, F.lit(1.0)) for e in range(1, n_elements + 1)])
        cases.append(spark.range(s**k).select(F.lit(c).alias("case_id"), (row + 1 + offset).alias("ulbl"), F.lit(1).alias("llbl"), state.alias("state")))
        offset += s**k
    intact = spark.range(1).select(F.lit(0).alias("case_id"), F.lit(0).cast("long").alias("ulbl"), F.lit(0).alias("llbl"), F.array(*[F.lit(1.0)] * n_elements).alias("state"))
    out = intact
    for case in cases:
        out = out.unionByName(case)
    return out


def single_element_grid(spark: SparkSession, n_elements: int, magnitudes: list[float]) -> DataFrame:
    """Each element damaged by each magnitude: ulbl runs on, llbl is the element."""
    s, mags = len(magnitudes), F.array(*[F.lit(m) for m in magnitudes])
    row = F.col("id")
    element, m = F.floor(row / s) + 1, F.element_at(mags, (row % s + 1).cast("int"))
    return spark.range(n_elements * s).select((row + 1).alias("ulbl"), element.cast("int").alias("llbl"), m.alias("magnitude"))


def range_union(*ranges: list[int]) -> list[int]:
    return sorted(set(chain.from_iterable(ranges)))
