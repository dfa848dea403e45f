"""Aggregates over datasets, and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dataset import with_ordinal
from .graphs import cut


def long_form(ds: DataFrame, *keys: str) -> DataFrame:
    """One row per component: keys, pos (from 0), x."""
    return ds.select(*keys, F.posexplode("feat").alias("pos", "x"))


def feature_statistics(ds: DataFrame, *by: str) -> DataFrame:
    """Mean, deviations and range of each component, by class or over all; partial sums first."""
    return long_form(ds, *by).groupBy(*by, "pos").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.stddev_pop("x").alias("std_pop"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def mean_vector(ds: DataFrame, *by: str) -> DataFrame:
    means = long_form(ds, *by).groupBy(*by, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def covariance(ds: DataFrame, dims: int) -> DataFrame:
    """(i, j, cov) of the population, i <= j.  The first pass gives the means (dims numbers), the second a
    task's products of centred batches, dims * dims numbers each, summed by component."""
    import numpy as np
    import pyarrow as pa

    first = long_form(ds).groupBy("pos").agg(F.avg("x").alias("m"), F.count("*").alias("n")).orderBy("pos").collect()
    mean, n = np.array([r["m"] for r in first] or [0.0] * dims), first[0]["n"] if first else 0

    def run(batches):
        total, some = np.zeros((dims, dims)), False
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1) - mean
                total, some = total + x.T @ x, True
        if some:
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "x"])

    return ds.select("feat").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg((F.sum("x") / max(1, n)).alias("cov"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracies(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy (share), balanced_accuracy (mean of the classes' accuracies)."""
    per = df.groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("a"), F.count("*").alias("n"))
    return per.agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("accuracy"), F.avg("a").alias("balanced_accuracy"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """nmi = MI / max(H_a, H_b), base 2."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    cells = cells.withColumn("p", F.col("n") / F.sum("n").over(whole))
    cells = cells.withColumn("pa", F.sum("p").over(Window.partitionBy(a))).withColumn("pb", F.sum("p").over(Window.partitionBy(b)))
    # - sum p_ab log p_a is the entropy of a
    sums = cells.agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), (-F.sum(F.col("p") * F.log2("pa"))).alias("ha"), (-F.sum(F.col("p") * F.log2("pb"))).alias("hb"))
    return sums.select((F.col("mi") / F.greatest("ha", "hb")).alias("nmi"))


def vote(df: DataFrame, key: str, label: str, score: str | None = None) -> DataFrame:
    """The label with most votes (or greatest sum of scores), ties to the smallest label."""
    got = df.groupBy(key, label).agg((F.sum(score) if score else F.count("*")).alias("votes"))
    return got.groupBy(key).agg(F.max_by(label, F.struct("votes", -F.col(label))).alias("winner"))


def average_rank(df: DataFrame, by: str, value: str, name: str = "avg_rank") -> DataFrame:
    """Ranks inside groups, equal values sharing their mean rank."""
    order, ties = Window.partitionBy(by).orderBy(value), Window.partitionBy(by, value)
    return df.withColumn(name, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)


def friedman(ranks: DataFrame, block: str, treatment: str, rank: str) -> DataFrame:
    """chi2 and F statistic of treatments ranked in blocks."""
    r = ranks.groupBy(treatment).agg(F.avg(rank).alias("r"), F.count("*").alias("n"))
    s = r.agg(F.sum(F.col("r") * F.col("r")).alias("s"), F.count("*").alias("k"), F.max("n").alias("n"))
    chi2 = 12 * F.col("n") / (F.col("k") * F.col("k") + F.col("k")) * (F.col("s") - F.col("k") * (F.col("k") + 1) * (F.col("k") + 1) / 4)
    s = s.withColumn("chi2", chi2)
    return s.select("k", "n", "chi2", ((F.col("n") - 1) * F.col("chi2") / (F.col("n") * (F.col("k") - 1) - F.col("chi2"))).alias("f"))


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.when(x > 0, F.ln(x))))


def folds(ds: DataFrame, k: int) -> DataFrame:
    """Stratified folds 1..k: samples of each class dealt in the order of a hash of their ids."""
    return ds.withColumn("fold", F.ntile(k).over(Window.partitionBy("cls").orderBy(F.md5(F.col("sample_id").cast("string")), "sample_id")))


def fit_scaler(ds: DataFrame, kind: str) -> DataFrame:
    """(a, b) arrays so that x -> (x - a) / b: zscore (population) or minmax.  NaN counts as missing."""
    s = feature_statistics(ds.withColumn("feat", F.transform("feat", lambda x: F.when(~F.isnan(x), x))))
    a, b = (F.col("mean"), F.col("std_pop")) if kind == "zscore" else (F.col("lo"), F.col("hi") - F.col("lo"))
    s = s.select("pos", a.alias("a"), F.when(b == 0, F.lit(1.0)).otherwise(b).alias("b"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "a", "b")))
    return s.agg(F.transform(rows, lambda r: r["a"]).alias("a"), F.transform(rows, lambda r: r["b"]).alias("b"))


def apply_scaler(ds: DataFrame, scaler: DataFrame) -> DataFrame:
    """The scaler is one row of as many numbers as components."""
    both = ds.join(F.broadcast(scaler))
    scaled = F.transform(F.arrays_zip("feat", "a", "b"), lambda r: (r["feat"] - r["a"]) / r["b"])
    return both.withColumn("feat", scaled).drop("a", "b")


def quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, share, value): quantiles where the i-th of n sorted values stands at (i - 0.5) / n, linear
    between.  Each is a sum over the two values beside it, found by their global row numbers, so no group is
    gathered or sorted in one task."""
    rows = df.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_x"))
    ranked = with_ordinal(rows, [by, "_x"], "_o")  # equal values may change places
    groups = ranked.groupBy(by).agg(F.min("_o").alias("_first"), F.count("*").alias("_n"))
    each = groups.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    each = each.withColumn("_at", F.least(F.col("_n").cast("double"), F.greatest(F.lit(1.0), F.col("share") * F.col("_n") + 0.5)))
    each = each.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).withColumn("_o", F.col("_first") - 1 + F.col("_k"))
    beside = each.join(ranked.select("_o", "_x"), "_o")  # row numbers are unique: no key is large
    return beside.groupBy(by, "share").agg(F.sum(F.col("_x") * (1 - F.abs(F.col("_k") - F.col("_at")))).alias(value))


def bandwidth(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, bandwidth): 1.06 min(std, iqr / 1.34) n^-0.2."""
    q = quantiles(df, by, value, [0.25, 0.75]).groupBy(by).agg((F.max(value) - F.min(value)).alias("iqr"))
    s = df.groupBy(by).agg(F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return s.join(q, by).select(by, (1.06 * F.least("std", F.col("iqr") / 1.34) * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"))


def two_sample_t(ds: DataFrame, first: int, second: int) -> DataFrame:
    """(pos, t): how far two classes' means lie apart, component by component (unequal variances)."""
    side = lambda k: [f(F.when(F.col("cls") == k, F.col("x"))) for f in (F.avg, F.var_samp, F.count)]
    (m1, v1, n1), (m2, v2, n2) = side(first), side(second)
    return long_form(ds.filter(F.col("cls").isin(first, second)), "cls").groupBy("pos").agg(((m1 - m2) / F.sqrt(v1 / n1 + v2 / n2)).alias("t"))


def permutation_accuracy(df: DataFrame, key: str, truth: str, predicted: str, times: int, seed: int = 1) -> DataFrame:
    """(replicate, accuracy): accuracies when predictions are dealt out anew, by hashes of the key; 0 is
    as given.  Ranks are global row numbers, as all replicates have the same number of rows; the join is
    a merge, since files tell too little of the rows' size in memory."""
    df = cut(df.select(key, truth, predicted))
    hit = F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy")
    given = df.agg(F.count("*").alias("_n"), hit).filter("_n > 0").select(F.lit(0).alias("replicate"), "accuracy")
    if times < 1:
        return given
    each = df.select(key, predicted).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(times))))
    each = each.withColumn("_h", F.xxhash64(key, "replicate", F.lit(seed)))
    dealt = with_ordinal(each, ["replicate", "_h", key], "_o").withColumn("_k", F.col("_o") - (F.col("replicate") - 1) * F.lit(df.count()))
    kept = with_ordinal(df.select(key, truth), [key], "_k").select("_k", truth)
    return given.unionByName(dealt.select("replicate", predicted, "_k").join(kept.hint("merge"), "_k").groupBy("replicate").agg(hit))


def latex_rows(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row: the (report-sized) table as the body of a LaTeX tabular, rows by `order`."""
    line = F.concat(F.concat_ws(" & ", *[F.col(c).cast("string") for c in columns]), F.lit(r" \\"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    return df.agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("latex"))


def gaussian_noise(*keys: Column | str, seed: int = 0) -> Column:
    """A standard normal number made from hashes of the keys: reruns and lost tasks give the same."""
    uniform = lambda k: (F.pmod(F.xxhash64(*keys, F.lit(seed * 2 + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * 3.141592653589793 * uniform(1))


def noisy(ds: DataFrame, level: Column | float, replicas: int, seed: int = 0) -> DataFrame:
    """replicas rows per sample (replica from 1): each component times 1 + level * noise."""
    each = ds.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
    level = level if isinstance(level, Column) else F.lit(float(level))
    return each.withColumn("feat", F.transform("feat", lambda x, i: x * (1 + level * gaussian_noise(F.col("sample_id"), F.col("replica"), i, seed=seed))))


def augmented(ds: DataFrame, ratio: float, per_class: int, seed: int = 0) -> DataFrame:
    """per_class samples (cls, replica, feat) around each class mean, ratio deviations wide."""
    s = feature_statistics(ds, "cls").withColumn("s", F.struct("pos", "mean", "std"))
    rows = s.groupBy("cls").agg(F.array_sort(F.collect_list("s")).alias("s")).withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(per_class))))
    made = F.transform("s", lambda p: p["mean"] + ratio * F.coalesce(p["std"], F.lit(0.0)) * gaussian_noise(F.col("cls"), F.col("replica"), p["pos"], seed=seed))
    return rows.select("cls", "replica", made.alias("feat"))


def same_vectors(ds: DataFrame) -> DataFrame:
    """(sample_id, first_id): the smallest id with the same vector."""
    first = ds.groupBy("feat").agg(F.min("sample_id").alias("first_id"))
    return ds.select("sample_id", "feat").join(first, "feat").select("sample_id", "first_id")


def sign_aligned(ds: DataFrame) -> DataFrame:
    """Vectors flipped so that they agree in sign with their class's first sample where that one is
    greatest in size (first place on ties)."""
    size = F.transform("_b", F.abs)
    at = F.array_position(size, F.array_max(size)).cast("int")
    base = ds.filter("col_idx = 1").select("cls", F.col("feat").alias("_b"))
    flip = F.element_at("feat", at) * F.element_at("_b", at) < 0
    return ds.join(base, "cls").withColumn("feat", F.when(flip, F.transform("feat", lambda x: -x)).otherwise(F.col("feat"))).drop("_b")


def similarity_alignment(ds: DataFrame, points: int) -> DataFrame:
    """(sample_id, scale, angle): the least-squares similarity that maps a sample's landmarks (x1..xn,
    y1..yn first in feat) onto those of its class's first sample."""
    base = ds.filter("col_idx = 1").select("cls", F.col("feat").alias("_b"))
    part = lambda c, y: F.slice(F.col(c), 1 + points * y, points)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / points
    both = ds.join(base, "cls")
    for name, c, y in (("_px", "feat", 0), ("_py", "feat", 1), ("_qx", "_b", 0), ("_qy", "_b", 1)):
        both = both.withColumn(name + "m", mean(part(c, y)))
        m = F.col(name + "m")
        both = both.withColumn(name, F.transform(part(c, y), lambda x: x - m))  # noqa: B023
    dot = lambda a, b: F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = dot("_px", "_px") + dot("_py", "_py")
    a, b = (dot("_px", "_qx") + dot("_py", "_qy")) / size, (dot("_px", "_qy") - dot("_py", "_qx")) / size
    return both.select("sample_id", F.sqrt(a * a + b * b).alias("scale"), F.atan2(b, a).alias("angle"))


def percent_ranked(feat: Column) -> Column:
    """Each value's share of values of its vector that are not above it."""
    return F.transform(feat, lambda x: F.size(F.filter(feat, lambda y: y <= x)) / F.size(feat))


def class_widths(df: DataFrame, cls: str, error: str) -> DataFrame:
    """(cls, std, width): the standard deviation of a class's errors weighed by exp(-error / least), where least
    is the least error that isn't 0 (the greatest if all are), and the reciprocal of the greatest such
    deviation of all classes, at most 1."""
    e = F.col(error).cast("double")
    least = df.groupBy(cls).agg(F.coalesce(F.min(F.when(e >= 1e-15, e)), F.max(e)).alias("_least"))
    least = cut(least)
    few = F.broadcast if least.count() <= 100_000 else (lambda df: df)  # a row for each class
    weighed = df.join(few(least), cls).withColumn("_w", F.exp(-e / F.col("_least")))
    sums = weighed.groupBy(cls).agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * e).alias("_s"))
    off = F.col("_w") * F.pow(e - F.col("_m"), F.lit(2))
    mean = sums.select(cls, (F.col("_s") / F.col("_w")).alias("_m"))
    out = weighed.join(few(mean), cls).groupBy(cls).agg(F.sqrt(F.sum(off) / F.sum("_w")).alias("std"))
    top = out.agg(F.least(F.lit(1.0), F.min(1 / F.greatest(F.lit(1.0), F.col("std")))).alias("width"))
    return out.crossJoin(F.broadcast(top))  # one row


def critical_difference(ranked: DataFrame, block: str, treatment: str, rank: str, q: float) -> DataFrame:
    """(a, b, difference, differs): mean ranks of each two treatments after a Friedman test, and whether they
    are further apart than q * sqrt(k (k + 1) / (6 n)); q is the studentised range's value over sqrt(2)."""
    mean = ranked.groupBy(treatment).agg(F.avg(rank).alias("_m"), F.count("*").alias("_n"))
    k = mean.agg(F.count("*").alias("_k"))
    a, b = mean.select(F.col(treatment).alias("a"), F.col("_m").alias("_ma"), "_n"), mean.select(F.col(treatment).alias("b"), F.col("_m").alias("_mb"))
    far = F.abs(F.col("_ma") - F.col("_mb"))
    limit = F.lit(q) * F.sqrt(F.col("_k") * (F.col("_k") + 1) / (6 * F.col("_n")))
    # treatments, not blocks, meet here
    return a.join(b, F.col("a") < F.col("b")).join(F.broadcast(k)).select("a", "b", far.alias("difference"), (far > limit).alias("differs"))
