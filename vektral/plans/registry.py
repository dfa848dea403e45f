"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import classifiers as C
from ..operators import dataset as D
from ..operators import discriminants as R
from ..operators import graphs as G
from ..operators import images as I
from ..operators import large_margin as LM
from ..operators import learning as L
from ..operators import manifolds as M
from ..operators import margins as MG
from ..operators import mixtures as MX
from ..operators import neighbours as N
from ..operators import preparing as P
from ..operators import selection as SE
from ..operators import statistics as S
from ..operators import trees as TR
from ..operators import windows as W
from ..sources.tables import high_pass_sections, high_passed, image_name, image_samples, natural_key, read_bitmap, samples, save_images, stream_of, table
from ..streaming.stages import Pipeline, Scaler, run_stream, stream_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The dataset that most queries run over.
SAMPLES = """samples AS (SELECT vec_id AS sample_id, CAST(label + 1 AS INTEGER) AS cls,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS col_idx, CAST(embedding AS DOUBLE[]) AS feat FROM embeddings)"""
LONG = "long AS (SELECT sample_id, cls, unnest(feat) AS x, generate_subscripts(feat, 1) - 1 AS pos FROM samples)"


def query(sql: str | None = None, base: bool = True):
    """Registers a query by its function's name; base puts the dataset before the SQL."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SAMPLES}{sql}" if base else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def zeroed(df: DataFrame, digits: int = 6) -> DataFrame:
    """Vectors as rounded arrays without negative zeros."""
    return df.withColumn("feat", F.transform("feat", lambda x: F.round(x, digits) + 0.0))


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Vectors as rounded arrays, as in SQL: halves are those of the scaled number, not of its decimals, and what is
    rounded to zero keeps its sign."""
    unit = 10.0**digits

    def rounded_as_sql(x):
        scaled = F.round(x * unit, 0)  # a scaled number that overflows leaves x as it is
        return F.when(F.abs(x * unit) == float("inf"), x).when(scaled == 0, x * 0.0).otherwise(scaled / unit)

    return df.withColumn("feat", F.transform("feat", rounded_as_sql))


# -- class index, slices and sets


@query(" SELECT cls, count(*) AS n FROM samples GROUP BY cls")
def class_histogram(spark, d):
    return samples(spark, d).groupBy("cls").agg(F.count("*").alias("n"))


@query(", n AS (SELECT cls, count(*) AS n_per_class FROM samples GROUP BY cls), s AS (SELECT *, CAST(coalesce(sum(n_per_class) OVER (ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS cls_st FROM n) SELECT sample_id, cls, col_idx, n_per_class, cls_st FROM samples JOIN s USING (cls)")
def class_index(spark, d):
    return D.class_index(samples(spark, d)).select("sample_id", "cls", "col_idx", "n_per_class", "cls_st")


@query("SELECT o_orderpriority, row_number() OVER (ORDER BY m, o_orderpriority) AS id FROM (SELECT o_orderpriority, min(o_orderkey) AS m FROM orders GROUP BY 1)", base=False)
def stable_class_ids(spark, d):
    return D.stable_ids(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@query(" SELECT sample_id, cls, CAST(count(*) OVER (PARTITION BY cls) + 1 - col_idx AS INTEGER) AS col_idx FROM samples")
def class_flip(spark, d):
    return D.flip_classes(samples(spark, d)).select("sample_id", "cls", "col_idx")


SELECTION = D.Selection(tr=[1, 2, 3, 3, 5], val=[6, 7], te=[8, 9, 10, 11, 12], tr_out=[1, 1, 1, 1, 1], classes=[1, 2, 3, 4, 5, 6], te_classes=[5, 6, 7])


@query(""", spec AS (SELECT 'TR' AS split, c AS cls, p AS col_idx, k AS dup FROM (VALUES (1,1),(2,1),(3,1),(3,2),(5,1)) v(p,k), range(1,7) r(c)
 UNION ALL SELECT 'VAL', c, p, 1 FROM (VALUES (6),(7)) v(p), range(1,7) r(c) UNION ALL SELECT 'TE', c, p, 1 FROM range(8,13) v(p), range(5,8) r(c)
 UNION ALL SELECT 'TR_OUT', c, 1, k FROM range(1,6) v(k), range(1,7) r(c))
 SELECT split, cls, col_idx, CAST(dup AS INTEGER) AS dup, sample_id FROM spec JOIN samples USING (cls, col_idx)""")
def slice_splits(spark, d):
    return D.slice_dataset(samples(spark, d), SELECTION).select("split", "cls", "col_idx", "dup", "sample_id")


@query(", spec(cls, col_idx) AS (VALUES (2,1),(2,4),(3,2),(3,3),(3,9),(5,7)) SELECT 'TR' AS split, cls, col_idx, sample_id FROM spec JOIN samples USING (cls, col_idx)")
def slice_ragged(spark, d):
    return D.slice_dataset(samples(spark, d), D.Selection(tr=[[1, 4], [2, 3, 9], [7]], classes=[2, 3, 5])).select("split", "cls", "col_idx", "sample_id")


@query(""", i AS (SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY col_idx, dup) AS k, sample_id FROM samples JOIN (VALUES (1,1),(2,1),(3,1),(3,2),(5,1)) v(col_idx,dup) USING (col_idx) WHERE cls <= 6)
 SELECT i.cls, CAST(k AS INTEGER) AS k, i.sample_id AS input_id, s.sample_id AS target_id FROM i JOIN samples s ON s.cls = i.cls AND s.col_idx = 1""")
def slice_target_pairs(spark, d):
    return D.target_pairs(D.slice_dataset(samples(spark, d), SELECTION))


@query(" SELECT sample_id, cls, col_idx FROM (SELECT *, count(*) OVER (PARTITION BY cls) AS n FROM samples) WHERE col_idx <= ceil(0.6 * n)")
def select_percent(spark, d):
    return D.select_share(samples(spark, d), 0.6).select("sample_id", "cls", "col_idx")


@query(", spec AS (SELECT 'TE' AS split, c AS cls, p AS col_idx FROM (VALUES (1),(45),(52),(300),(100000)) v(p), (SELECT DISTINCT cls AS c FROM samples)) SELECT split, cls, col_idx FROM spec ANTI JOIN samples USING (cls, col_idx)")
def slice_missing(spark, d):
    return D.missing_places(samples(spark, d), D.Selection(te=[1, 45, 52, 300, 100000]))


@query(" SELECT sample_id, cls, CAST(row_number() OVER (PARTITION BY cls ORDER BY src, col_idx) AS INTEGER) AS col_idx FROM (SELECT *, 0 AS src FROM samples WHERE col_idx > 5 UNION ALL SELECT *, 1 FROM samples WHERE col_idx <= 5)")
def merge_datasets(spark, d):
    s = samples(spark, d)
    return D.merge_datasets(s.filter("col_idx > 5"), s.filter("col_idx <= 5")).select("sample_id", "cls", "col_idx")


@query(" SELECT sample_id, cls, col_idx FROM samples UNION ALL SELECT sample_id, CAST(cls + (SELECT max(cls) FROM samples) AS INTEGER), col_idx FROM samples WHERE cls <= 3")
def concat_datasets(spark, d):
    s = samples(spark, d)
    return D.concat_datasets(s, s.filter("cls <= 3")).select("sample_id", "cls", "col_idx")


@query(" SELECT cls, sample_id FROM samples WHERE cls IN (1,2,3,4,5) INTERSECT SELECT cls, sample_id FROM samples WHERE cls IN (4,5,6) EXCEPT SELECT cls, sample_id FROM samples WHERE col_idx <= 3")
def range_set_operations(spark, d):
    s = samples(spark, d).select("cls", "sample_id", "col_idx")
    both = s.filter(F.col("cls").isin(D.range_union([1, 2, 3], [3, 4, 5]))).join(s.filter(F.col("cls").isin(4, 5, 6)).select("sample_id"), "sample_id", "left_semi")
    return both.join(s.filter("col_idx <= 3").select("sample_id"), "sample_id", "left_anti").select("cls", "sample_id")


def _arrangements(ordered: bool, repeated: bool):
    op = {(True, True): "true", (True, False): "c1 <> c2 AND c1 <> c3 AND c2 <> c3", (False, True): "c1 <= c2 AND c2 <= c3", (False, False): "c1 < c2 AND c2 < c3"}[ordered, repeated]

    def f(spark, d):
        return D.arrangements(spark, 6, 3, ordered, repeated)

    f.__name__ = ("permutations" if ordered else "combinations") + ("_repeated" if repeated else "")
    query(f"SELECT c1, c2, c3 FROM range(1,7) a(c1), range(1,7) b(c2), range(1,7) c(c3) WHERE {op}", base=False)(f)


for _o in (True, False):
    for _r in (True, False):
        _arrangements(_o, _r)


@query("""WITH m AS (SELECT [0.95, 0.9, 0.85, 0.8] AS g), r AS (
 SELECT 0 AS case_id, 0 AS ulbl, 0 AS llbl, [1.0, 1.0, 1.0]::DOUBLE[] AS state UNION ALL
 SELECT 1, i + 1, 1, [g[i % 4 + 1], 1.0, 1.0] FROM m, range(4) t(i) UNION ALL
 SELECT 2, i + 5, 1, [g[i // 4 + 1], g[i % 4 + 1], 1.0] FROM m, range(16) t(i) UNION ALL
 SELECT 3, i + 21, 1, [g[i // 4 + 1], 1.0, g[i % 4 + 1]] FROM m, range(16) t(i)) SELECT CAST(case_id AS INTEGER) AS case_id, CAST(ulbl AS BIGINT) AS ulbl, CAST(llbl AS INTEGER) AS llbl, state FROM r""", base=False)
def damage_grid(spark, d):
    return D.damage_grid(spark, [[1], [1, 2], [1, 3]], [0.95, 0.9, 0.85, 0.8], 3)


@query("SELECT CAST(i + 1 AS BIGINT) AS ulbl, CAST(i // 4 + 1 AS INTEGER) AS llbl, CAST([0.95, 0.9, 0.85, 0.8][i % 4 + 1] AS DOUBLE) AS magnitude FROM range(280) t(i)", base=False)
def single_element_grid(spark, d):
    return D.single_element_grid(spark, 70, [0.95, 0.9, 0.85, 0.8])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ordinal, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 128 AS BIGINT) AS batch FROM orders", base=False)
def mini_batches(spark, d):
    return D.mini_batches(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 128, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "ordinal", "batch")


# -- projections of vectors


@query(" SELECT sample_id, [round(x / greatest(sqrt(list_dot_product(feat, feat)), 1e-14), 6) FOR x IN feat] AS feat FROM samples")
def class_features_normalized(spark, d):
    s = samples(spark, d)
    return flat(s.select("sample_id", V.l2_normalized(F.col("feat")).alias("feat")))


@query(f", {LONG}, m AS (SELECT pos, avg(x) AS m FROM long GROUP BY pos), a AS (SELECT list(m ORDER BY pos) AS m FROM m) SELECT sample_id, [round(feat[i] - m[i], 6) FOR i IN range(1, len(feat) + 1)] AS feat FROM samples, a")
def features_minus_mean(spark, d):
    s = samples(spark, d)
    both = s.join(F.broadcast(S.mean_vector(s)))
    return flat(both.select("sample_id", V.subtract(F.col("feat"), F.col("mean")).alias("feat")))


@query(f", {LONG}, m AS (SELECT cls, pos, avg(x) AS m FROM long GROUP BY cls, pos), a AS (SELECT cls, list(m ORDER BY pos) AS m FROM m GROUP BY cls) SELECT sample_id, round(sqrt(list_sum([(feat[i] - m[i]) * (feat[i] - m[i]) FOR i IN range(1, len(feat) + 1)])), 6) AS dist FROM samples JOIN a USING (cls)")
def distance_to_class_mean(spark, d):
    s = samples(spark, d)
    both = s.join(S.mean_vector(s, "cls"), "cls")
    return both.select("sample_id", F.round(V.distance(F.col("feat"), F.col("mean"), "euclidean"), 6).alias("dist"))


@query(f", {LONG} SELECT cls, pos, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(stddev_pop(x), 6) AS std_pop, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM long GROUP BY cls, pos")
def feature_statistics(spark, d):
    return rounded(S.feature_statistics(samples(spark, d), "cls"), "mean", "std", "std_pop", "lo", "hi")


@query(", p AS (SELECT i, j, feat[i + 1] AS x, feat[j + 1] AS y FROM samples, range(64) a(i), range(64) b(j) WHERE i <= j) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(covar_pop(x, y), 6) + 0.0 AS cov FROM p GROUP BY i, j")
def covariance(spark, d):
    c = S.covariance(samples(spark, d), 64)
    return c.select("i", "j", (F.round("cov", 6) + 0.0).alias("cov"))


@query(f", {LONG} SELECT CAST(pos AS INTEGER) AS pos FROM long GROUP BY pos HAVING min(x) <> max(x)")
def varying_features(spark, d):
    return S.feature_statistics(samples(spark, d)).filter("lo <> hi").select("pos")


@query(" SELECT s.sample_id, [round(b.feat[i] - s.feat[i], 6) FOR i IN range(1, 65)] AS feat FROM samples s JOIN samples b ON b.cls = s.cls AND b.col_idx = 1")
def difference_to_first(spark, d):
    s = samples(spark, d)
    base = s.filter("col_idx = 1").select("cls", F.col("feat").alias("_b"))
    return flat(s.join(base, "cls").select("sample_id", V.subtract(F.col("_b"), F.col("feat")).alias("feat")))


@query(" SELECT sample_id, CAST(cls - 1 AS INTEGER) AS label0, [CAST(k = cls AS INTEGER) FOR k IN range(1, 11)] AS one_hot FROM samples")
def one_hot_labels(spark, d):
    hot = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: (k == F.col("cls")).cast("int"))
    return samples(spark, d).select("sample_id", (F.col("cls") - 1).alias("label0"), hot.alias("one_hot"))


@query(f", {LONG}, m AS (SELECT pos, avg(x) AS a, stddev_pop(x) AS b FROM long JOIN samples USING (sample_id) WHERE col_idx <= 20 GROUP BY pos), a AS (SELECT list(a ORDER BY pos) AS a, list(b ORDER BY pos) AS b FROM m) SELECT sample_id, [round((feat[i] - a[i]) / b[i], 5) FOR i IN range(1, 65)] AS feat FROM samples, a")
def standardized_by_training(spark, d):
    s = samples(spark, d)
    return flat(S.apply_scaler(s, S.fit_scaler(s.filter("col_idx <= 20"), "zscore")).select("sample_id", "feat"), 5)


@query(f", {LONG}, m AS (SELECT pos, min(x) AS a, max(x) - min(x) AS b FROM long GROUP BY pos), a AS (SELECT list(a ORDER BY pos) AS a, list(b ORDER BY pos) AS b FROM m) SELECT sample_id, [round((feat[i] - a[i]) / b[i], 6) FOR i IN range(1, 65)] AS feat FROM samples, a")
def scaled_to_range(spark, d):
    s = samples(spark, d)
    return flat(S.apply_scaler(s, S.fit_scaler(s, "minmax")).select("sample_id", "feat"))


# -- distances, kernels, recognition


def _split(spark, d):
    """Two thirds of each class as gallery, the rest as probes."""
    s = samples(spark, d)
    sizes = s.groupBy("cls").agg(F.count("*").alias("_n"))
    part = lambda rule: s.join(sizes, "cls").filter(rule).select(*s.columns)
    return part("3 * col_idx <= 2 * _n"), part("3 * col_idx > 2 * _n")


_RECOGNIZED = """, sizes AS (SELECT cls, count(*) AS n FROM samples GROUP BY cls), g AS (SELECT s.* FROM samples s JOIN sizes USING (cls) WHERE 3 * col_idx <= 2 * n), p AS (SELECT s.* FROM samples s JOIN sizes USING (cls) WHERE 3 * col_idx > 2 * n),
 d AS (SELECT p.sample_id, p.cls, g.cls AS predicted, g.sample_id AS gid, list_sum([(p.feat[i] - g.feat[i]) * (p.feat[i] - g.feat[i]) FOR i IN range(1, 65)]) AS d2 FROM p, g),
 r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d2, gid) AS k FROM d)"""


@query(_RECOGNIZED + " SELECT sample_id, cls, predicted, round(d2, 6) AS d2 FROM r WHERE k = 1")
def recognition(spark, d):
    gallery, probes = _split(spark, d)
    return rounded(N.recognize(probes, gallery), "d2")


@query(_RECOGNIZED + " SELECT count(*) AS n, round(100 * avg(CAST(predicted = cls AS INTEGER)), 6) AS accuracy FROM r WHERE k = 1")
def recognition_accuracy(spark, d):
    gallery, probes = _split(spark, d)
    r = N.recognize(probes, gallery)
    return r.agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("predicted") == F.col("cls")).cast("int")), 6).alias("accuracy"))


_KNN = """, s AS (SELECT sample_id, feat FROM samples), d AS (SELECT a.sample_id AS src, b.sample_id AS dst, list_sum([(a.feat[i] - b.feat[i]) * (a.feat[i] - b.feat[i]) FOR i IN range(1, 65)]) AS d2 FROM s a JOIN s b ON a.sample_id <> b.sample_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS k FROM d), e AS (SELECT src, dst, d2 FROM r WHERE k <= 5), u AS (SELECT src, dst, min(d2) AS d2 FROM (SELECT * FROM e UNION ALL SELECT dst, src, d2 FROM e) GROUP BY src, dst)"""


@query(_KNN + " SELECT src, dst, round(d2, 6) AS d2 FROM u")
def neighbour_graph(spark, d):
    return rounded(N.neighbour_graph(samples(spark, d), 5), "d2")


@query(_KNN + " SELECT src, dst, round(exp(-d2 / 2), 6) AS w FROM u")
def heat_affinity(spark, d):
    return rounded(N.affinity(N.neighbour_graph(samples(spark, d), 5), "heat"), "w")


@query(" SELECT sample_id, cls, round(1.0 / n, 9) AS w FROM samples JOIN (SELECT cls, count(*) AS n FROM samples GROUP BY cls) USING (cls)")
def supervised_affinity(spark, d):
    return rounded(N.supervised_affinity(samples(spark, d)), "w", digits=9)


_PAIRS = ", p AS (SELECT a.sample_id AS a_id, b.sample_id AS b_id, a.feat AS a, b.feat AS b FROM samples a JOIN samples b ON b.cls = a.cls AND b.col_idx = 1), q AS (SELECT *, [a[i] - b[i] FOR i IN range(1, 65)] AS e, list_avg(a) AS ma, list_avg(b) AS mb FROM p)"


def _pairs(spark, d):
    s = samples(spark, d)
    first = s.filter("col_idx = 1").select("cls", F.col("sample_id").alias("b_id"), F.col("feat").alias("b"))
    return s.select("cls", F.col("sample_id").alias("a_id"), F.col("feat").alias("a")).join(first, "cls")


@query(_PAIRS + """ SELECT a_id, b_id, round(sqrt(list_dot_product(e, e)), 6) AS euclidean, round(list_dot_product(e, e), 6) AS sqeuclidean, round(list_sum([abs(x) FOR x IN e]), 6) AS cityblock,
 round(list_max([abs(x) FOR x IN e]), 6) AS chebychev, round(pow(list_sum([pow(abs(x), 3.0) FOR x IN e]), 1.0 / 3), 6) AS minkowski, round(1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) + 0.0 AS cosine,
 round(1 - list_sum([(a[i] - ma) * (b[i] - mb) FOR i IN range(1, 65)]) / sqrt(list_sum([(x - ma) * (x - ma) FOR x IN a]) * list_sum([(x - mb) * (x - mb) FOR x IN b])), 6) + 0.0 AS correlation FROM q""")
def distance_metrics(spark, d):
    names = ["euclidean", "sqeuclidean", "cityblock", "chebychev", "minkowski", "cosine", "correlation"]
    return _pairs(spark, d).select("a_id", "b_id", *[(F.round(V.distance(F.col("a"), F.col("b"), m), 6) + 0.0).alias(m) for m in names])


@query(_PAIRS + """ SELECT a_id, b_id, round(exp(-list_dot_product(e, e) / 2), 6) AS gaussian, round(exp(-list_dot_product(e, e)), 6) AS rbf, round(list_dot_product(a, b), 6) + 0.0 AS linear,
 round(pow(list_dot_product(a, b), 2), 6) AS polynomial, round(pow(list_dot_product(a, b) + 1, 2), 6) AS polyplus, round(tanh(list_dot_product(a, b)), 6) + 0.0 AS sigmoid FROM q""")
def kernels(spark, d):
    names = ["gaussian", "rbf", "linear", "polynomial", "polyplus", "sigmoid"]
    return _pairs(spark, d).select("a_id", "b_id", *[(F.round(V.kernel(F.col("a"), F.col("b"), m), 6) + 0.0).alias(m) for m in names])


@query(_PAIRS + " SELECT a_id, b_id, round(pow(list_dot_product(a, b) + 1, 2) / sqrt(pow(list_dot_product(a, a) + 1, 2) * pow(list_dot_product(b, b) + 1, 2)), 6) AS k FROM q")
def normalized_kernel(spark, d):
    k = lambda x, y: V.kernel(F.col(x), F.col(y), "polyplus")
    return _pairs(spark, d).select("a_id", "b_id", F.round(k("a", "b") / F.sqrt(k("a", "a") * k("b", "b")), 6).alias("k"))


# -- metrics


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2", base=False)
def confusion_matrix(spark, d):
    return S.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("WITH c AS (SELECT quality, avg(CAST(quality = toxic AS DOUBLE)) AS a, count(*) AS n FROM labels GROUP BY 1) SELECT round(sum(a * n) / sum(n), 9) AS accuracy, round(avg(a), 9) AS balanced_accuracy FROM c", base=False)
def accuracies(spark, d):
    return rounded(S.accuracies(table(spark, d, "labels"), "quality", "toxic"), "accuracy", "balanced_accuracy", digits=9)


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT a, b, n / sum(n) OVER () AS p FROM c),
 q AS (SELECT *, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM p) SELECT round(sum(p * log2(p / (pa * pb))) / greatest(-sum(p * log2(pa)), -sum(p * log2(pb))), 9) AS nmi FROM q""", base=False)
def normalized_mutual_information(spark, d):
    return rounded(S.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), "nmi", digits=9)


@query("WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_linenumber AS winner FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) = 1", base=False)
def majority_vote(spark, d):
    return S.vote(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber")


@query("WITH c AS (SELECT l_suppkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_linenumber AS winner FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) = 1", base=False)
def weighted_vote(spark, d):
    return S.vote(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), "l_suppkey", "l_linenumber", "q")


@query("SELECT c_mktsegment, round(exp(avg(ln(c_acctbal)) FILTER (c_acctbal > 0)), 4) AS gmean FROM customer GROUP BY 1", base=False)
def geometric_mean(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(S.geometric_mean(F.col("c_acctbal")), 4).alias("gmean"))


@query(f", {LONG} SELECT cls, round(avg(CAST(abs(x) <= 0.01 AS INTEGER)), 9) AS sparsity FROM long GROUP BY cls")
def sparsity(spark, d):
    return S.long_form(samples(spark, d), "cls").groupBy("cls").agg(F.round(F.avg((F.abs("x") <= 0.01).cast("int")), 9).alias("sparsity"))


@query("SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS avg_rank FROM part", base=False)
def average_ranks(spark, d):
    return S.average_rank(table(spark, d, "part"), "p_brand", "p_size").select("p_partkey", "p_brand", "avg_rank")


@query("""WITH c AS (SELECT l_suppkey, l_shipmode_no, n FROM (SELECT l_suppkey, l_linenumber AS l_shipmode_no, count(*) AS n FROM lineitem GROUP BY 1, 2)),
 f AS (SELECT * FROM c WHERE l_suppkey IN (SELECT l_suppkey FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_linenumber) FROM lineitem))), k AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY n) + (count(*) OVER (PARTITION BY l_suppkey, n) - 1) / 2 AS r FROM f),
 t AS (SELECT l_shipmode_no, avg(r) AS r, count(*) AS n FROM k GROUP BY 1), s AS (SELECT count(*) AS k, max(n) AS n, sum(r * r) AS s FROM t),
 x AS (SELECT k, n, 12 * n / (k * k + k) * (s - k * (k + 1) * (k + 1) / 4) AS chi2 FROM s) SELECT k, n, round(chi2, 6) AS chi2, round((n - 1) * chi2 / (n * (k - 1) - chi2), 6) AS f FROM x""", base=False)
def friedman_test(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    # blocks that hold every treatment; one row of the number of treatments
    every = c.agg(F.countDistinct("l_linenumber").alias("k"))
    full = c.groupBy("l_suppkey").count().join(F.broadcast(every), F.col("count") == F.col("k")).select("l_suppkey")
    ranked = S.average_rank(c.join(full, "l_suppkey", "left_semi"), "l_suppkey", "n", "r")
    return rounded(S.friedman(ranked, "l_suppkey", "l_linenumber", "r"), "chi2", "f")


@query(" SELECT sample_id, cls, ntile(5) OVER (PARTITION BY cls ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) AS fold FROM samples")
def stratified_folds(spark, d):
    return S.folds(samples(spark, d), 5).select("sample_id", "cls", "fold")


# -- windows over series

_SEG = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS row, count(*) OVER (PARTITION BY event_type) AS n FROM events),
 b AS (SELECT *, ceil(n * (0.8::DOUBLE + 0.1::DOUBLE)) AS r1 FROM r), s AS (SELECT *, CASE WHEN row <= ceil(r1 / (0.8::DOUBLE + 0.1::DOUBLE) * 0.8::DOUBLE) THEN 'TR' WHEN row <= r1 THEN 'VAL' WHEN row <= r1 + floor(n * 0.1::DOUBLE) THEN 'TE' END AS split FROM b),
 g AS (SELECT event_id, event_type, split, value, row_number() OVER (PARTITION BY event_type, split ORDER BY event_id) AS pos FROM s WHERE split IS NOT NULL)"""


def _segments(spark, d):
    return W.segments(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "event_id", 0.8, 0.1, 0.1)


@query(_SEG + " SELECT event_id, event_type, split, CAST(pos AS INTEGER) AS pos FROM g", base=False)
def block_segments(spark, d):
    return _segments(spark, d).select("event_id", "event_type", "split", "pos")


@query(_SEG + """, l AS (SELECT event_type, split, count(*) AS length FROM g GROUP BY 1, 2), w AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((length - 40) / 18)) AS BIGINT) + 1)) AS k FROM l),
 x AS (SELECT event_type, split, k * 18 + 1 AS st, least(k * 18 + 40, length) AS en FROM w),
 y AS (SELECT x.event_type, x.split, st, en, count(*) AS n, sum(value) AS total, max(value) AS m FROM x JOIN g ON g.event_type = x.event_type AND g.split = x.split AND pos BETWEEN st AND en GROUP BY 1, 2, 3, 4)
 SELECT event_type, split, st, en, n, round(total, 4) AS total, round(m / nullif(max(m) OVER (PARTITION BY event_type, split), 0), 6) AS scaled_max FROM y""", base=False)
def moving_windows(spark, d):
    out = W.moving_windows(_segments(spark, d), "event_type", "value", 40, 18)
    return out.select("event_type", "split", F.col("st").cast("long").alias("st"), F.col("en").cast("long").alias("en"), "n", F.round("total", 4).alias("total"), F.round("scaled_max", 6).alias("scaled_max"))


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY event_type)", base=False)
def z_scores(spark, d):
    return W.z_scores(table(spark, d, "events"), "event_type", "value").select("event_id", (F.round("z", 6) + 0.0).alias("z"))


# -- images: 8 x 8 x 1 or 4 x 4 x 4


@query(" SELECT sample_id, y || '_' || x || '_4_4' AS patch_id, [feat[(x - 1 + j) * 8 + (y - 1 + i) + 1] FOR j IN range(0, 4) FOR i IN range(0, 4)] AS patch FROM samples, (VALUES (1),(3),(5)) a(y), (VALUES (1),(3),(5)) b(x)".replace("[feat[(x - 1 + j) * 8 + (y - 1 + i) + 1] FOR j IN range(0, 4) FOR i IN range(0, 4)]", "[feat[(x - 1 + k // 4) * 8 + (y - 1 + k % 4) + 1] FOR k IN range(0, 16)]"))
def image_patches(spark, d):
    return I.patches(samples(spark, d), 8, 8, 1, 4, 4, 2, 2)


@query(" SELECT sample_id, [feat[(k // 4) * 16 + (k % 4) * 2 + 1] FOR k IN range(0, 16)] AS feat FROM samples")
def image_downsample(spark, d):
    return samples(spark, d).select("sample_id", I.downsample(F.col("feat"), 8, 8, 2).alias("feat"))


@query(" SELECT sample_id, [feat[(k // 16) * 16 + (k % 4) * 4 + (k % 16) // 4 + 1] FOR k IN range(0, 64)] AS chw, [feat[(k % 4) * 16 + ((k // 4) % 4) * 4 + k // 16 + 1] FOR k IN range(0, 64)] AS hwc FROM samples")
def image_export(spark, d):
    f = F.col("feat")
    return samples(spark, d).select("sample_id", I.export_order(f, 4, 4, 4, "CHW").alias("chw"), I.export_order(f, 4, 4, 4, "HWC").alias("hwc"))


@query(" SELECT sample_id, [round(0.2989 * feat[i] + 0.587 * feat[i + 16] + 0.114 * feat[i + 32], 6) FOR i IN range(1, 17)] AS feat FROM samples")
def image_grey(spark, d):
    return flat(samples(spark, d).select("sample_id", I.grey(F.col("feat"), 4, 4).alias("feat")))


@query(""" SELECT sample_id, [CASE WHEN (i - 1) % 8 + 1 BETWEEN 6 AND 8 THEN 0.0 ELSE feat[i] END FOR i IN range(1, 65)] AS bottom, [CASE WHEN (i - 1) // 8 + 1 BETWEEN 4 AND 6 THEN 0.0 ELSE feat[i] END FOR i IN range(1, 65)] AS right_off,
 [CASE WHEN (i - 1) % 8 + 1 BETWEEN 1 AND 2 THEN 0.0 ELSE feat[i] END FOR i IN range(1, 65)] AS top, [CASE WHEN (i - 1) // 8 + 1 BETWEEN 3 AND 4 THEN 0.0 ELSE feat[i] END FOR i IN range(1, 65)] AS left_off FROM samples""")
def image_occlusion(spark, d):
    f = F.col("feat")
    o = lambda *a: I.occlusion(f, 8, 8, *a)
    return samples(spark, d).select("sample_id", o("b", 0.3).alias("bottom"), o("r", 0.3, 0.25).alias("right_off"), o("t", 0.3).alias("top"), o("l", 0.3, 0.25).alias("left_off"))


@query(", p AS (SELECT sample_id, s, y, x, list_avg([feat[(x * s + k // s) * 8 + y * s + k % s + 1] FOR k IN range(0, s * s)]) AS m FROM samples, (VALUES (8),(4)) a(s), range(0, 2) b(y), range(0, 2) c(x) WHERE y < 8 // s AND x < 8 // s) SELECT sample_id, list(round(m, 6) + 0.0 ORDER BY s DESC, y, x) AS feat FROM p GROUP BY sample_id")
def patch_pooling(spark, d):
    pooled = samples(spark, d).select("sample_id", I.pooled(F.col("feat"), 8, 8, [8, 4]).alias("feat"))
    return pooled.withColumn("feat", F.transform("feat", lambda x: F.round(x, 6) + 0.0))


@query(", b AS (SELECT sample_id, [CAST(least(63, floor(round((x + 1) * 127) / 256.0 * 64)) AS INTEGER) FOR x IN feat] AS c FROM samples) SELECT sample_id, [round(len(list_filter(c, lambda y: y <= x)) / 64.0, 6) FOR x IN c] AS feat FROM b")
def histogram_equalization(spark, d):
    s = samples(spark, d).select("sample_id", F.transform("feat", lambda x: F.round((x + 1) * 127)).alias("feat"))
    return flat(I.equalized(s).select("sample_id", "feat"))


@query(" SELECT sample_id, (o - 1) // 16 AS row, (o - 1) % 16 AS col, ((o - 1) // 16) * 10 + 1 AS y0, ((o - 1) % 16) * 9 + 1 AS x0 FROM (SELECT sample_id, row_number() OVER (ORDER BY cls, col_idx) AS o FROM samples)")
def image_grid(spark, d):
    s = D.with_ordinal(samples(spark, d).select("sample_id", "cls", "col_idx"), ["cls", "col_idx"])
    return I.image_grid(s, 16, 8, 8, 2, 1)


@query(""", l AS (SELECT sample_id, [round((x + 1) * 127) FOR x IN feat] AS feat, [exp(-0.5 * (pow((i - 1) % 8 + 1 - 3, 2) / 4.0 + pow((i - 1) // 8 + 1 - 5, 2) / 6.0)) FOR i IN range(1, 65)] AS light FROM samples),
 r AS (SELECT *, 255 - coalesce(list_avg([feat[i] FOR i IN range(1, 65) IF light[i] >= 1.0 / 255 AND feat[i] <> 0]), 0) AS room FROM l)
 SELECT sample_id, [greatest(0.0, least(255.0, round(feat[i] + room * light[i] - CASE WHEN light[i] >= 1.0 / 255 THEN 0 ELSE 255 END))) FOR i IN range(1, 65)] AS feat FROM r""")
def illumination(spark, d):
    s = samples(spark, d).select("sample_id", F.transform("feat", lambda x: F.round((x + 1) * 127)).alias("feat"))
    return s.select("sample_id", I.illumination(F.col("feat"), 8, 8, (3, 5), (4, 6)).alias("feat"))


@query(" SELECT sample_id, format('{}_{}.jpg', cls, col_idx) AS name FROM samples")
def image_names(spark, d):
    return samples(spark, d).select("sample_id", image_name(F.col("cls"), F.col("col_idx")).alias("name"))


# -- order


@query("""WITH p AS (SELECT c_custkey, 'v' || (c_custkey % 97) || '.' || (c_custkey % 13) || '.txt' AS name FROM customer) SELECT c_custkey, name, array_to_string([CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END FOR x IN regexp_extract_all(name, '[0-9]+|[^0-9]+')], '') AS key FROM p""", base=False)
def natural_order(spark, d):
    name = F.concat(F.lit("v"), F.col("c_custkey") % 97, F.lit("."), F.col("c_custkey") % 13, F.lit(".txt"))
    return table(spark, d, "customer").select("c_custkey", name.alias("name")).withColumn("key", natural_key(F.col("name")))


@query("SELECT c_custkey, c_nationkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3", base=False)
def top_scores(spark, d):
    order = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, d, "customer").withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("c_custkey", "c_nationkey", F.col("rank").cast("long").alias("rank"))


@query(" SELECT sample_id, cls FROM samples QUALIFY row_number() OVER (PARTITION BY cls ORDER BY md5('7' || sample_id), sample_id) <= 3")
def random_picks(spark, d):
    order = Window.partitionBy("cls").orderBy(F.md5(F.concat(F.lit("7"), F.col("sample_id")).cast("binary")), "sample_id")
    return samples(spark, d).withColumn("k", F.row_number().over(order)).filter("k <= 3").select("sample_id", "cls")


# -- learners (numeric, checked by tests)


@query(f", {LONG}, m AS (SELECT pos, avg(x) AS m FROM long GROUP BY pos), c AS (SELECT sample_id, list(x - m ORDER BY pos) AS c FROM long JOIN m USING (pos) GROUP BY sample_id), p AS (SELECT i, j, sum(c[i] * c[j]) AS s FROM c, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j) SELECT round(sum(s) FILTER (i = j), 5) AS total, round(sum(s * s), 3) AS squares FROM p")
def pca_moments(spark, d):
    """Sum of the eigenvalues and of their squares: the trace of the scatter matrix and its squared norm."""
    _, values, _ = L.pca(samples(spark, d))
    return spark.createDataFrame([(round(float(values.sum()), 5), round(float((values**2).sum()), 3))], "total double, squares double")


@query()
def pca_spectrum(spark, d):
    _, values, _ = L.pca(samples(spark, d), 10)
    return spark.createDataFrame([(i + 1, round(float(v), 6)) for i, v in enumerate(values)], "component int, eigenvalue double")


@query(f", {LONG}, m AS (SELECT pos, avg(x) AS m FROM long GROUP BY pos) SELECT round(sum((x - m) * (x - m)), 4) AS total FROM long JOIN m USING (pos)")
def pca_total_variance(spark, d):
    _, values, _ = L.pca(samples(spark, d))
    return spark.createDataFrame([(round(float(values.sum()), 4),)], "total double")


@query()
def lda_recognition(spark, d):
    return _projected(spark, d, L.lda)


@query()
def kmeans_clusters(spark, d):
    return L.kmeans(samples(spark, d), 10)[1]


@query()
def kernel_pca(spark, d):
    return L.kernel_pca(samples(spark, d))


@query()
def classical_scaling(spark, d):
    return L.classical_scaling(samples(spark, d))


@query()
def isomap(spark, d):
    return L.isomap(L.manifold(spark, "swiss", 400))


@query()
def laplacian_eigenmaps(spark, d):
    return L.laplacian_eigenmaps(L.manifold(spark, "helix", 400))


@query()
def locally_linear_embedding(spark, d):
    return L.locally_linear(L.manifold(spark, "twinpeaks", 400))


@query()
def sparse_recognition(spark, d):
    gallery, probes = _split(spark, d)
    return L.sparse_recognition(probes, gallery)


@query("SELECT i AS sample_id, round(1 - 2 * (i % 20) / 20, 9) AS x, round(1 - 2 * (i // 20) / 20, 9) AS y, round(sin(pi() * (1 - 2 * (i % 20) / 20)) * tanh(3 * (1 - 2 * (i // 20) / 20)) * 10, 6) + 0.0 AS z FROM range(400) t(i)", base=False)
def manifold_twinpeaks(spark, d):
    at = lambda i: F.element_at("feat", i)
    return L.manifold(spark, "twinpeaks", 400).select("sample_id", F.round(at(1), 9).alias("x"), F.round(at(2), 9).alias("y"), (F.round(at(3), 6) + 0.0).alias("z"))


# -- graphs, reports, noise


@query(_KNN.replace("k <= 5", "k <= 2") + ", reach AS (SELECT src AS node, src AS part FROM u UNION SELECT u.dst, reach.part FROM reach JOIN u ON u.src = reach.node) SELECT node, min(part) AS part FROM reach GROUP BY node")
def connected_parts(spark, d):
    return G.connected_parts(N.neighbour_graph(samples(spark, d), 2))


ORACLES["connected_parts"] = ORACLES["connected_parts"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(_KNN.replace("k <= 5", "k <= 2") + ", reach AS (SELECT sample_id AS node, 0 AS hops FROM samples WHERE col_idx = 1 UNION SELECT u.dst, hops + 1 FROM reach JOIN u ON u.src = reach.node WHERE hops < 3) SELECT node, min(hops) AS hops FROM reach GROUP BY node")
def hops(spark, d):
    s = samples(spark, d)
    return G.hops(N.neighbour_graph(s, 2), s.filter("col_idx = 1").select(F.col("sample_id").alias("node")), 3)


ORACLES["hops"] = ORACLES["hops"].replace("WITH ", "WITH RECURSIVE ", 1)

_QUANTILES = """WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)),
 p AS (SELECT l_returnflag, n, share, least(n, greatest(1, share * n + 0.5)) AS place FROM (SELECT DISTINCT l_returnflag, n FROM r), (VALUES (0.25::DOUBLE), (0.5), (0.75)) v(share)),
 q AS (SELECT p.l_returnflag, share, p.n, max(x) FILTER (k = floor(place)) + (any_value(place) - floor(any_value(place))) * (max(x) FILTER (k = ceil(place)) - max(x) FILTER (k = floor(place))) AS v FROM p JOIN r ON r.l_returnflag = p.l_returnflag AND k IN (floor(place), ceil(place)) GROUP BY 1, 2, 3)"""


@query(_QUANTILES + " SELECT l_returnflag, share, round(v, 4) AS l_extendedprice FROM q", base=False)
def quantiles(spark, d):
    return rounded(S.quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [0.25, 0.5, 0.75]), "l_extendedprice", digits=4)


@query(_QUANTILES + ", i AS (SELECT l_returnflag, max(v) FILTER (share = 0.75) - max(v) FILTER (share = 0.25) AS iqr FROM q GROUP BY 1), s AS (SELECT l_returnflag, stddev_samp(l_extendedprice) AS sd, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, round(1.06 * least(sd, iqr / 1.34) * pow(n, -0.2), 3) AS bandwidth FROM s JOIN i USING (l_returnflag)", base=False)
def bandwidth(spark, d):
    return rounded(S.bandwidth(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"), "bandwidth", digits=3)


@query(f", {LONG}, m AS (SELECT pos, cls, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM long WHERE cls IN (1, 2) GROUP BY ALL) SELECT CAST(a.pos AS INTEGER) AS pos, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) + 0.0 AS t FROM m a JOIN m b ON a.pos = b.pos AND a.cls = 1 AND b.cls = 2")
def two_sample_t(spark, d):
    return S.two_sample_t(samples(spark, d), 1, 2).select("pos", (F.round("t", 6) + 0.0).alias("t"))


@query()
def permutation_accuracy(spark, d):
    return S.permutation_accuracy(table(spark, d, "labels"), "doc_id", "quality", "toxic", 50)


@query("SELECT string_agg(r_regionkey || ' & ' || r_name || ' \\\\', chr(10) ORDER BY r_regionkey) AS latex FROM region", base=False)
def latex_table(spark, d):
    return S.latex_rows(table(spark, d, "region"), "r_regionkey", ["r_regionkey", "r_name"])


@query(" SELECT sample_id, CAST(r AS INTEGER) AS replica, feat FROM samples, range(1, 4) t(r)")
def noise_replicas(spark, d):
    return S.noisy(samples(spark, d), 0.0, 3).select("sample_id", "replica", "feat")


@query()
def measurement_noise(spark, d):
    return S.noisy(samples(spark, d), 0.05, 2, seed=3).select("sample_id", "replica", "feat")


@query(f", {LONG}, m AS (SELECT cls, pos, avg(x) AS m FROM long GROUP BY cls, pos), a AS (SELECT cls, list(round(m, 6) + 0.0 ORDER BY pos) AS feat FROM m GROUP BY cls) SELECT cls, CAST(r AS INTEGER) AS replica, feat FROM a, range(1, 4) t(r)")
def augmented_means(spark, d):
    return S.augmented(samples(spark, d), 0.0, 3).withColumn("feat", F.transform("feat", lambda x: F.round(x, 6) + 0.0))


@query()
def augmented_samples(spark, d):
    return S.augmented(samples(spark, d), 0.5, 20, seed=1)


@query(" SELECT sample_id, min(sample_id) OVER (PARTITION BY feat) AS first_id FROM samples")
def same_vectors(spark, d):
    return S.same_vectors(samples(spark, d))


@query(", b AS (SELECT cls, feat AS b, list_position([abs(x) FOR x IN feat], list_max([abs(x) FOR x IN feat])) AS place FROM samples WHERE col_idx = 1) SELECT sample_id, CASE WHEN feat[place] * b[place] < 0 THEN [round(-x, 6) + 0.0 FOR x IN feat] ELSE [round(x, 6) + 0.0 FOR x IN feat] END AS feat FROM samples JOIN b USING (cls)")
def sign_aligned(spark, d):
    return S.sign_aligned(samples(spark, d)).select("sample_id", F.transform("feat", lambda x: F.round(x, 6) + 0.0).alias("feat"))


@query(""", b AS (SELECT cls, feat AS b FROM samples WHERE col_idx = 1), c AS (SELECT sample_id, feat[1:5] AS px, feat[6:10] AS py, b[1:5] AS qx, b[6:10] AS qy FROM samples JOIN b USING (cls)),
 m AS (SELECT sample_id, [x - list_avg(px) FOR x IN px] AS px, [x - list_avg(py) FOR x IN py] AS py, [x - list_avg(qx) FOR x IN qx] AS qx, [x - list_avg(qy) FOR x IN qy] AS qy FROM c),
 e AS (SELECT sample_id, list_dot_product(px, px) + list_dot_product(py, py) AS s, list_dot_product(px, qx) + list_dot_product(py, qy) AS a, list_dot_product(px, qy) - list_dot_product(py, qx) AS b FROM m)
 SELECT sample_id, round(sqrt(a * a + b * b) / s, 6) AS scale, round(atan2(b, a), 6) + 0.0 AS angle FROM e""")
def landmark_alignment(spark, d):
    return S.similarity_alignment(samples(spark, d), 5).select("sample_id", F.round("scale", 6).alias("scale"), (F.round("angle", 6) + 0.0).alias("angle"))


@query(" SELECT sample_id, cls FROM samples WHERE feat[1] BETWEEN -0.1 AND 0.1 AND feat[2] BETWEEN -0.2 AND 0.1 AND feat[3] BETWEEN -0.1 AND 0.2")
def pose_filter(spark, d):
    at = lambda i: F.element_at("feat", i)
    return samples(spark, d).filter(at(1).between(-0.1, 0.1) & at(2).between(-0.2, 0.1) & at(3).between(-0.1, 0.2)).select("sample_id", "cls")


@query(" SELECT cls, any_value(n) AS n FROM (SELECT cls, count(*) AS n FROM samples GROUP BY cls) GROUP BY cls HAVING cls IN (SELECT label + 1 FROM embeddings WHERE vec_id < 20) AND cls NOT IN (SELECT label + 1 FROM embeddings WHERE vec_id < 3)")
def classes_except(spark, d):
    s = samples(spark, d)
    some = lambda n: s.filter(F.col("sample_id") < n).select("cls").distinct()
    return s.join(some(20), "cls", "left_semi").join(some(3), "cls", "left_anti").groupBy("cls").agg(F.count("*").alias("n"))


# -- more images


_SPACES = ["XYZ", "YIQ", "III", "YUV", "nRGB", "nXYZ"]


@query(" SELECT sample_id, " + ", ".join("[" + "round(" + " + ".join(f"CASE k // 16 WHEN 0 THEN {I.COLOURS[c][0][j]!r} WHEN 1 THEN {I.COLOURS[c][1][j]!r} ELSE {I.COLOURS[c][2][j]!r} END * feat[k % 16 + {1 + 16 * j}]" for j in range(3)) + f", 6) + 0.0 FOR k IN range(0, 48)] AS {c}" for c in _SPACES) + " FROM samples")
def colour_spaces(spark, d):
    each = [F.transform(I.recoloured(F.col("feat"), 4, 4, c), lambda x: F.round(x, 6) + 0.0).alias(c) for c in _SPACES]
    return samples(spark, d).select("sample_id", *each)


@query(", b AS (SELECT cls, list_sort(feat) AS b FROM samples WHERE col_idx = 1) SELECT sample_id, [b[CAST(len(list_filter(feat, lambda y: y <= x)) AS INTEGER)] FOR x IN feat] AS feat FROM samples JOIN b USING (cls)")
def histogram_matching(spark, d):
    s = samples(spark, d)
    base = s.filter("col_idx = 1").select("cls", F.col("feat").alias("_b"))
    return s.join(base, "cls").select("sample_id", I.matched(F.col("feat"), F.col("_b")).alias("feat"))


@query(" SELECT sample_id, [round(len(list_filter(feat, lambda y: y <= x)) / 64.0, 6) FOR x IN feat] AS feat FROM samples")
def rank_normalized(spark, d):
    return flat(samples(spark, d).select("sample_id", S.percent_ranked(F.col("feat")).alias("feat")))


@query(", t AS (SELECT sample_id, feat, list_sort(feat)[7] AS lo, list_sort(feat)[58] AS hi FROM samples) SELECT sample_id, [round((least(hi, greatest(lo, x)) - lo) / (hi - lo) * 255, 4) FOR x IN feat] AS feat FROM t")
def histogram_truncation(spark, d):
    return flat(samples(spark, d).select("sample_id", I.truncated(F.col("feat"), 0.1, 0.1).alias("feat")), 4)


@query(" SELECT sample_id, y || '_' || x || '_3_3' AS patch_id, [feat[(x - 1 + k // 3) * 8 + (y - 1 + k % 3) + 1] FOR k IN range(0, 9)] AS patch FROM samples, range(1, 7) a(y), range(1, 7) b(x)")
def sliding_columns(spark, d):
    return I.patches(samples(spark, d), 8, 8, 1, 3, 3, 1, 1)


@query(" SELECT sample_id, [CASE WHEN (i - 1) % 8 < 4 - (i - 1) // 8 THEN 0.0 ELSE feat[i] END FOR i IN range(1, 65)] AS feat FROM samples")
def triangle_mask(spark, d):
    mask = [0.0 if k % 8 < 4 - k // 8 else 1.0 for k in range(64)]
    return samples(spark, d).select("sample_id", F.transform(I.masked(F.col("feat"), mask), lambda x: x + 0.0).alias("feat"))


@query(f" SELECT sample_id, [round(list_dot_product(feat, w), 6) + 0.0 FOR w IN {np.kron(I.resize_weights(8, 4), I.resize_weights(8, 4)).tolist()}] AS feat FROM samples")
def image_resize(spark, d):
    return zeroed(I.resized(samples(spark, d), 8, 8, 1, 4, 4).select("sample_id", "feat"))


# the filter as a circular convolution: its answer to a point at the origin, moved to every pixel
_ANSWER = np.fft.ifft2(I.frequency_mask(8, 8, 0.25, 2, "high")).real
_FILTERED = [[float(_ANSWER[(k % 8 - j % 8) % 8, (k // 8 - j // 8) % 8]) for j in range(64)] for k in range(64)]


@query(f" SELECT sample_id, [round(list_dot_product(feat, w), 6) + 0.0 FOR w IN {_FILTERED}] AS feat FROM samples")
def frequency_filter(spark, d):
    return zeroed(I.frequency_filtered(samples(spark, d), 8, 8, 0.25, 2, "high").select("sample_id", "feat"))


@query()
def block_noise(spark, d):
    return samples(spark, d).select("sample_id", I.dotted_block(F.col("feat"), F.col("sample_id"), 8, 8, 0.5).alias("feat"))


# -- more learners


_GALLERY = f", sizes AS (SELECT cls, count(*) AS n FROM samples GROUP BY cls), g AS (SELECT s.* FROM samples s JOIN sizes USING (cls) WHERE 3 * col_idx <= 2 * n), p AS (SELECT s.* FROM samples s JOIN sizes USING (cls) WHERE 3 * col_idx > 2 * n), {LONG.replace('FROM samples', 'FROM g')}, ms AS (SELECT cls, pos, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM long GROUP BY cls, pos), a AS (SELECT cls, list(m ORDER BY pos) AS m, list(v ORDER BY pos) AS v, max(n) AS n FROM ms GROUP BY cls)"


@query(_GALLERY + " SELECT sample_id, p.cls, a.cls AS predicted FROM p, a QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY list_sum([(feat[i] - m[i]) * (feat[i] - m[i]) FOR i IN range(1, 65)]), a.cls) = 1")
def nearest_centroid(spark, d):
    return C.nearest_centroid(*_split(spark, d))


@query(_GALLERY + " SELECT sample_id, p.cls, a.cls AS predicted FROM p, a QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ln(n) - 0.5 * list_sum([ln(2 * pi() * v[i]) + (feat[i] - m[i]) * (feat[i] - m[i]) / v[i] FOR i IN range(1, 65)]) DESC, a.cls) = 1")
def naive_bayes(spark, d):
    return C.naive_bayes(*_split(spark, d))


@query(_RECOGNIZED + ", v AS (SELECT c.k AS k, sample_id, predicted, count(*) AS n FROM r, (VALUES (1), (3), (5)) c(k) WHERE r.k <= c.k GROUP BY ALL) SELECT k, sample_id, predicted FROM v QUALIFY row_number() OVER (PARTITION BY k, sample_id ORDER BY n DESC, predicted) = 1")
def neighbour_votes(spark, d):
    return C.vote_of_neighbours(*_split(spark, d), [1, 3, 5])


@query(_RECOGNIZED + " SELECT DISTINCT gid AS sample_id FROM r WHERE k <= 3")
def selected_gallery(spark, d):
    gallery, probes = _split(spark, d)
    return N.nearest(probes, gallery, 3).select(F.col("gallery_id").alias("sample_id")).distinct()


@query()
def linear_regression_classifier(spark, d):
    return C.linear_regression_classifier(*_split(spark, d))


@query()
def nonnegative_recognition(spark, d):
    return C.nonnegative_recognition(*_split(spark, d))


@query()
def forward_selection(spark, d):
    chosen, scores = C.forward_selection(*_split(spark, d), [list(range(k, k + 8)) for k in range(0, 64, 8)])
    return spark.createDataFrame(list(zip(range(1, len(chosen) + 1), chosen, scores)), "step int, feature_group int, accuracy double")


@query()
def dictionary_codes(spark, d):
    return C.learned_dictionary(samples(spark, d), 20, 3, 5)[1]


@query()
def directions_codes(spark, d):
    return C.learned_dictionary(samples(spark, d), 20, 3, 5, "mod")[1]


@query()
def nonnegative_factors(spark, d):
    s = samples(spark, d).withColumn("feat", F.transform("feat", lambda x: x + 1))
    return C.nonnegative_factors(s, 4, 5)[1]


def _projected(spark, d, learn):
    """Accuracy of the probes in a space learned from the gallery."""
    gallery, probes = _split(spark, d)
    got = learn(gallery)
    w, mean = got if isinstance(got, tuple) else (got, None)
    return S.accuracies(N.recognize(L.project(probes, w, mean), L.project(gallery, w, mean)), "cls", "predicted")


@query(" SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(i = j AS DOUBLE) AS product, TRUE AS equal FROM range(0, 64) a(i), range(0, 64) b(j) WHERE i <= j")
def whitened_products(spark, d):
    """The whitened features' mean products are those of the identity, but for a constant factor."""
    s = samples(spark, d)
    c = S.covariance(L.project(s, *R.whitening(s)), 64)
    unit = c.filter("i = j").agg(F.avg("cov").alias("_u"))
    same = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0))
    c = c.join(F.broadcast(unit))  # one row
    return c.select("i", "j", same.alias("product"), (F.abs(F.col("cov") / F.col("_u") - same) < 1e-6).alias("equal"))


@query()
def whitened(spark, d):
    s = samples(spark, d)
    return L.project(s.select("sample_id", "feat"), *R.whitening(s))


@query()
def fisher_recognition(spark, d):
    return _projected(spark, d, R.fisher)


@query()
def direct_discriminants(spark, d):
    return _projected(spark, d, R.direct_lda)


@query()
def robust_discriminants(spark, d):
    return _projected(spark, d, lambda g: R.robust_lda(g, steps=5))


@query()
def correntropy_discriminants(spark, d):
    return _projected(spark, d, lambda g: R.robust_lda(g, steps=5, kind="correntropy"))


@query()
def correntropy_components(spark, d):
    return _projected(spark, d, lambda g: R.correntropy_pca(g, 10, 5))


@query()
def partial_least_squares(spark, d):
    return _projected(spark, d, lambda g: R.partial_least_squares(g, 5))


@query()
def masked_reconstruction(spark, d):
    return R.masked_reconstruction(samples(spark, d).select("sample_id", "cls", "feat"), list(range(48)), 10)


@query()
def kernel_discriminants(spark, d):
    return R.kernel_discriminant(samples(spark, d))


@query()
def locality_preserving_recognition(spark, d):
    return _projected(spark, d, lambda g: M.locality_preserving(g, 5, 1.0, 8))


@query()
def neighbourhood_preserving_recognition(spark, d):
    return _projected(spark, d, lambda g: M.neighbourhood_preserving(g, 5, 8))


@query()
def neighbourhood_components(spark, d):
    return _projected(spark, d, lambda g: M.neighbourhood_components(g, 8, 30))


@query()
def factor_loadings(spark, d):
    load, noise, _ = M.factor_analysis(samples(spark, d), 3)
    return spark.createDataFrame([(i, float(n), [float(x) for x in r]) for i, (r, n) in enumerate(zip(load, noise))], "pos int, noise double, loadings array<double>")


@query()
def probabilistic_components(spark, d):
    load, noise, _ = M.factor_analysis(samples(spark, d), 3, shared=True)
    return spark.createDataFrame([(i, float(n), [float(x) for x in r]) for i, (r, n) in enumerate(zip(load, noise))], "pos int, noise double, loadings array<double>")


@query(_KNN + ", t AS (SELECT src, max(d2) AS last FROM r WHERE k <= 6 GROUP BY src), m AS (SELECT src, 1 / avg(0.5 * ln(last / d2)) AS m FROM r JOIN t USING (src) WHERE k < 6 AND d2 > 0 GROUP BY src) SELECT round(avg(m), 6) AS mle FROM m")
def intrinsic_dimension(spark, d):
    s = samples(spark, d)
    return rounded(M.intrinsic_dimension(N.nearest(s, s, 6, skip_self=True), 6), "mle")


@query(_KNN + ", n AS (SELECT d2 FROM r WHERE k <= 6), m AS (SELECT quantile_cont(d2, 0.5) AS mid, max(d2) AS far FROM n) SELECT round(ln(count(*) / count(*) FILTER (d2 <= mid)) / (0.5 * ln(any_value(far) / any_value(mid))), 6) AS dimension FROM n, m")
def correlation_dimension(spark, d):
    s = samples(spark, d)
    return rounded(M.correlation_dimension(N.nearest(s, s, 6, skip_self=True)), "dimension")


@query()
def t_stochastic_neighbours(spark, d):
    return M.stochastic_neighbours(samples(spark, d), steps=250)


@query()
def symmetric_stochastic_neighbours(spark, d):
    return M.stochastic_neighbours(samples(spark, d), steps=250, heavy=False)


@query()
def sammon_mapping(spark, d):
    return M.sammon(L.manifold(spark, "helix", 300), 2, 100)


@query()
def diffusion_map(spark, d):
    return M.diffusion_map(L.manifold(spark, "helix", 300))


@query()
def tangent_alignment(spark, d):
    return M.tangent_alignment(L.manifold(spark, "twinpeaks", 400))


@query()
def hessian_embedding(spark, d):
    return M.hessian_embedding(L.manifold(spark, "twinpeaks", 400))


@query()
def landmark_isomap(spark, d):
    return M.landmark_isomap(L.manifold(spark, "swiss", 500))


@query()
def proximity_embedding(spark, d):
    return M.proximity_embedding(L.manifold(spark, "helix", 300))


@query("""SELECT i AS sample_id, [round(t * cos(t), 6) + 0.0, round(30 * v, 6), round(t * sin(t), 6) + 0.0] AS feat FROM (SELECT i, ((i * 104729) % 500) / 500.0 AS v, 1.5 * pi() * (1 + 2 * CASE WHEN u < 0.5 THEN u * 0.8 ELSE 0.6 + (u - 0.5) * 0.8 END) AS t FROM (SELECT i, ((i * 7919) % 500) / 500.0::DOUBLE AS u FROM range(500) r(i)))""", base=False)
def broken_swiss_roll(spark, d):
    return zeroed(M.surface(spark, "broken_swiss", 500))


@query("""SELECT i AS sample_id, [round(10 * CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END + sin(i), 6) + 0.0, round(10 * CASE WHEN i % 3 = 1 THEN 1 ELSE 0 END + sin(i * 2), 6) + 0.0, round(10 * CASE WHEN i % 3 = 2 THEN 1 ELSE 0 END + sin(i * 3), 6) + 0.0] AS feat FROM range(300) r(i)""", base=False)
def cluster_surface(spark, d):
    return zeroed(M.surface(spark, "clusters", 300))


@query("""SELECT i AS sample_id, [round(cos(t), 6) + 0.0, round(cos(t) * sin(t), 6) + 0.0, round(3 * v, 6)] AS feat FROM (SELECT i, ((i * 104729) % 400) / 400.0::DOUBLE AS v, 2 * pi() * (((i * 7919) % 400) / 400.0::DOUBLE) AS t FROM range(400) r(i))""", base=False)
def crossing_surface(spark, d):
    return zeroed(M.surface(spark, "intersect", 400))


@query("""SELECT i AS sample_id, [round(cos(q[1]), 6), round(tanh(3 * q[2]), 6), round(q[1] + q[3], 6), round(q[4] * sin(q[2]), 6), round(sin(q[1] + q[5]), 6), round(q[5] * cos(q[2]), 6), round(q[5] + q[4], 6), q[2], q[3] * q[4], q[1]] AS feat FROM (SELECT i, [((i // CAST(pow(3, j) AS BIGINT)) % 3) / 2.0::DOUBLE FOR j IN range(0, 5)] AS q FROM range(243) r(i))""", base=False)
def difficult_surface(spark, d):
    return zeroed(M.surface(spark, "difficult", 243))


@query()
def cosine_clusters(spark, d):
    return L.kmeans(samples(spark, d), 10, 10, cosine=True)[1]


_PARTS = """, f AS (SELECT sample_id, cls, feat, ntile(5) OVER (PARTITION BY cls ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) AS fold FROM samples),
 d AS (SELECT p.sample_id, p.cls, g.cls AS predicted, g.sample_id AS gid, list_sum([(p.feat[i] - g.feat[i]) * (p.feat[i] - g.feat[i]) FOR i IN range(1, 65)]) AS d2 FROM f p JOIN f g ON p.fold <> g.fold),
 r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d2, gid) AS k FROM d), v AS (SELECT c.k AS k, sample_id, cls, predicted, count(*) AS n FROM r, (VALUES (1), (3), (7)) c(k) WHERE r.k <= c.k GROUP BY ALL),
 w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY k, sample_id ORDER BY n DESC, predicted) = 1)"""


@query(_PARTS + " SELECT k, count(*) AS n, round(avg(CAST(predicted = cls AS DOUBLE)), 9) AS accuracy FROM w GROUP BY k")
def cross_validated_votes(spark, d):
    return rounded(C.cross_validated_votes(S.folds(samples(spark, d), 5), 5, [1, 3, 7]), "accuracy", digits=9)


@query(f", {LONG} SELECT CAST(pos AS INTEGER) AS pos, sample_id, x FROM long")
def features_first(spark, d):
    return S.long_form(samples(spark, d), "sample_id").select("pos", "sample_id", "x").repartitionByRange("pos").sortWithinPartitions("pos", "sample_id")


@query()
def high_pass(spark, d):
    return high_passed(table(spark, d, "events"), "event_type", "event_id", "value", high_pass_sections(50, 0.4, 0.8))


@query(""", b AS (SELECT sample_id, [round((x + 1) * 127) FOR x IN feat[1:48]] AS f FROM samples), v AS (SELECT *, [greatest(f[i], f[i + 16], f[i + 32]) FOR i IN range(1, 17)] AS v FROM b),
 c AS (SELECT *, [CAST(least(63, floor(x / 256 * 64)) AS INTEGER) FOR x IN v] AS c FROM v)
 SELECT sample_id, [round(CASE WHEN v[(i - 1) % 16 + 1] > 0 THEN f[i] * (len(list_filter(c, lambda y: y <= c[(i - 1) % 16 + 1])) / 16.0 * 255 / v[(i - 1) % 16 + 1]) ELSE 0 END, 6) FOR i IN range(1, 49)] AS feat FROM c""")
def brightness_equalization(spark, d):
    s = samples(spark, d).select("sample_id", F.transform(F.slice("feat", 1, 48), lambda x: F.round((x + 1) * 127)).alias("feat"))
    return flat(I.brightness_equalized(s, 4, 4))


@query()
def nonlocal_means(spark, d):
    return I.nonlocal_means(samples(spark, d).select("sample_id", "feat"), 8, 8)


@query()
def total_variation(spark, d):
    return I.total_variation(samples(spark, d).select("sample_id", "feat"), 8, 8, 0.1)


@query()
def autoencoded(spark, d):
    s = samples(spark, d)
    encode, _ = C.autoencoder(s, 8, 100)
    return I.mapped(s.select("sample_id", "feat"), encode)


# -- prepared slices, batches, galleries, streams

_BYTES = ", bytes AS (SELECT sample_id, cls, col_idx, [round((x + 1) * 127) FOR x IN feat] AS feat FROM samples), tr AS (SELECT * FROM bytes JOIN (VALUES (1, 1), (2, 2), (4, 3)) v(col_idx, k) USING (col_idx))"
_TRAINING = D.Selection(tr=[1, 2, 4])


def _bytes(spark, d):
    return samples(spark, d).withColumn("feat", F.transform("feat", lambda x: F.round((x + 1) * 127)))


def _training(spark, d, h, w, ch, **prep):
    out = P.prepared_slice(_bytes(spark, d), _TRAINING, P.Preparation(**prep), h, w, ch)
    return out.select("split", "sample_id", "cls", "col_idx", "feat")


_HALVED = str(np.kron(I.resize_weights(8, 4), I.resize_weights(8, 4)).tolist())


@query(_BYTES + f" SELECT 'TR' AS split, sample_id, cls, col_idx, [round(list_dot_product(feat, w), 6) + 0.0 FOR w IN {_HALVED}] AS feat FROM tr")
def slice_scaled(spark, d):
    got = _training(spark, d, 8, 8, 1, scale=0.5)
    return got.withColumn("feat", F.transform("feat", lambda x: F.round(x, 6) + 0.0))


@query(_BYTES + f" SELECT 'TR' AS split, sample_id, cls, col_idx, [round(2 * list_dot_product(feat, w) + 4, 6) FOR w IN {_HALVED}] AS feat FROM tr")
def slice_scripted(spark, d):
    return flat(_training(spark, d, 8, 8, 1, scale=0.5, script=lambda ds, h, w, ch: ds.withColumn("feat", F.transform("feat", lambda x: 2 * x + h))))


@query(_BYTES + ", b AS (SELECT *, CASE k WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 0 END AS hide FROM tr) SELECT 'TR' AS split, sample_id, cls, col_idx, [CASE WHEN (i - 1) % 8 < hide THEN 0.0 ELSE feat[i] END FOR i IN range(1, 65)] AS feat FROM b")
def slice_occluded(spark, d):
    return _training(spark, d, 8, 8, 1, occlusion=(("t", 0.0, 0.0), ("t", 0.5, 0.0), ("t", 0.2, 0.0)))


@query(_BYTES + ", b AS (SELECT *, CASE k WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 9 END AS first, CASE k WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 8 END AS last FROM tr) SELECT 'TR' AS split, sample_id, cls, col_idx, [CASE WHEN (i - 1) % 8 + 1 BETWEEN first AND last THEN 0.0 ELSE feat[i] END FOR i IN range(1, 65)] AS feat FROM b")
def slice_occluded_band(spark, d):
    return _training(spark, d, 8, 8, 1, occlusion=(("t", 0.0, 0.0), ("t", 0.5, 0.25), ("t", 0.2, 0.4)))


@query(_BYTES + " SELECT 'TR' AS split, sample_id, cls, col_idx, [CASE WHEN (i - 1) % 8 < 4 - (i - 1) // 8 THEN 0.0 ELSE feat[i] END FOR i IN range(1, 65)] AS feat FROM tr")
def slice_masked(spark, d):
    return _training(spark, d, 8, 8, 1, mask=tuple(0.0 if k % 8 < 4 - k // 8 else 1.0 for k in range(64)))


@query(_BYTES + """, l AS (SELECT *, [exp(-0.5 * (pow((i - 1) % 8 + 1, 2) + pow((i - 1) // 8 + 1 - 4, 2)) / CASE k WHEN 3 THEN 10.0 ELSE 1.0 END) FOR i IN range(1, 65)] AS light FROM tr),
 r AS (SELECT *, 255 - coalesce(list_avg([feat[i] FOR i IN range(1, 65) IF light[i] >= 1.0 / 255 AND feat[i] <> 0]), 0) AS room FROM l)
 SELECT 'TR' AS split, sample_id, cls, col_idx, [greatest(0.0, least(255.0, round(feat[i] + room * light[i]))) FOR i IN range(1, 65)] AS feat FROM r""")
def slice_lit(spark, d):
    return _training(spark, d, 8, 8, 1, light=(((0, 4), (1, 1)), ((0, 4), (1, 1)), ((0, 4), (10, 10))))


_GREY = ", g AS (SELECT *, [0.2989 * feat[i] + 0.587 * feat[i + 16] + 0.114 * feat[i + 32] FOR i IN range(1, 17)] AS grey FROM bytes), c AS (SELECT *, [least(63, floor(x / 256 * 64)) FOR x IN grey] AS cell FROM g)"


@query(_BYTES + _GREY + """, b AS (SELECT cls, list_sort(grey) AS b FROM g WHERE col_idx = 1)
 SELECT 'TR' AS split, sample_id, cls, col_idx, [round(b[CAST(len(list_filter(cell, lambda y: y <= x)) AS INTEGER)], 6) FOR x IN cell] AS feat FROM c JOIN b USING (cls) WHERE col_idx IN (1, 2, 4)""")
def slice_grey_matched(spark, d):
    return flat(_training(spark, d, 4, 4, 3, colour="grey", equalize=True, match=1))


@query(_BYTES + " SELECT 'TR' AS split, sample_id, cls, col_idx, feat[17:32] AS feat FROM tr")
def slice_channel(spark, d):
    return _training(spark, d, 4, 4, 4, colour=2)


@query(_BYTES + " SELECT sample_id, cls, col_idx, y || '_' || x || '_4_4' AS patch_id, [feat[(x - 1 + k // 4) * 8 + (y - 1 + k % 4) + 1] FOR k IN range(0, 16)] AS patch FROM tr, (VALUES (1), (5)) a(y), (VALUES (1), (5)) b(x)")
def slice_patches(spark, d):
    return P.patch_slices(D.slice_dataset(_bytes(spark, d), _TRAINING), 8, 8, 1, 4, 4, 4, 4).select("sample_id", "cls", "col_idx", "patch_id", "patch")


@query()
def slice_noisy(spark, d):
    return _training(spark, d, 8, 8, 1, noise=(0.0, 0.5, 0.2))


@query(" SELECT sample_id, ordinal, CAST((ordinal - 1) // 32 AS BIGINT) AS batch, round(target, 6) + 0.0 AS target FROM (SELECT sample_id, row_number() OVER (ORDER BY md5('7_1_' || sample_id), sample_id) AS ordinal, feat[1] AS target FROM samples)")
def synced_batches(spark, d):
    s = samples(spark, d)
    return P.shuffled_batches(s.select("sample_id"), s, 32, seed=7, epoch=1).select("sample_id", "ordinal", "batch", (F.round(F.element_at("target", 1), 6) + 0.0).alias("target"))


@query(" SELECT sample_id, cls, 1 AS gallery, [round(x, 6) + 0.0 FOR x IN feat[1:4]] AS feat FROM samples WHERE col_idx % 2 = 1 UNION ALL SELECT sample_id, cls, 2, [round(x, 6) + 0.0 FOR x IN feat[5:8]] FROM samples WHERE col_idx % 2 = 0")
def joined_galleries(spark, d):
    s, w = samples(spark, d), np.eye(64)
    both = D.joined_galleries(L.project(s.filter("col_idx % 2 = 1"), w[:, :4]), L.project(s.filter("col_idx % 2 = 0"), w[:, 4:8]))
    return both.select("sample_id", "cls", "gallery", F.transform("feat", lambda x: F.round(x, 6) + 0.0).alias("feat"))


@query(" SELECT sample_id, ordinal FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS ordinal FROM samples) WHERE ordinal BETWEEN 11 AND 35")
def excerpt(spark, d):
    return D.excerpt(samples(spark, d).select("sample_id"), 10, 25, ["sample_id"])


@query("""WITH e AS (SELECT l_returnflag AS cls, l_quantity AS e FROM lineitem), m AS (SELECT cls, coalesce(min(e) FILTER (e >= 1e-15), max(e)) AS least FROM e GROUP BY cls), w AS (SELECT cls, e, exp(-e / least) AS w FROM e JOIN m USING (cls)),
 c AS (SELECT cls, sum(w * e) / sum(w) AS c FROM w GROUP BY cls), s AS (SELECT cls, sqrt(sum(w * (e - c) * (e - c)) / sum(w)) AS std FROM w JOIN c USING (cls) GROUP BY cls)
 SELECT cls AS l_returnflag, round(std, 6) AS std, round((SELECT least(1, min(1 / greatest(1, std))) FROM s), 6) AS width FROM s""", base=False)
def class_widths(spark, d):
    return rounded(S.class_widths(table(spark, d, "lineitem"), "l_returnflag", "l_quantity"), "std", "width")


@query(ORACLES["friedman_test"].split(" t AS (")[0] + """ t AS (SELECT l_shipmode_no, avg(r) AS m, count(*) AS n FROM k GROUP BY 1) SELECT a.l_shipmode_no AS a, b.l_shipmode_no AS b, round(abs(a.m - b.m), 6) AS difference,
 abs(a.m - b.m) > 2.9 * sqrt((SELECT count(*) * (count(*) + 1) FROM t) / (6.0 * a.n)) AS differs FROM t a JOIN t b ON a.l_shipmode_no < b.l_shipmode_no""", base=False)
def critical_difference(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    every = c.agg(F.countDistinct("l_linenumber").alias("k"))
    full = c.groupBy("l_suppkey").count().join(F.broadcast(every), F.col("count") == F.col("k")).select("l_suppkey")
    ranked = S.average_rank(c.join(full, "l_suppkey", "left_semi"), "l_suppkey", "n", "r")
    return rounded(S.critical_difference(ranked, "l_suppkey", "l_linenumber", "r", 2.9), "difference")


@query(" SELECT sample_id, [round(round((x + 1) * 127) / 255, 9) FOR x IN feat] AS feat, round(exp(-list_dot_product(feat, feat) / 2), 9) AS weight FROM samples")
def shares_and_weights(spark, d):
    f = F.transform("feat", lambda x: F.round((x + 1) * 127))
    squared = F.aggregate("feat", F.lit(0.0), lambda a, x: a + x * x)
    return samples(spark, d).select("sample_id", F.transform(V.zero_to_one(f), lambda x: F.round(x, 9)).alias("feat"), F.round(V.gauss_error(squared), 9).alias("weight"))


@query(_RECOGNIZED.replace("(p.feat[i] - g.feat[i]) * (p.feat[i] - g.feat[i])", "abs(p.feat[i] - g.feat[i])") + " SELECT sample_id, cls, predicted, round(d2, 6) AS distance FROM r WHERE k = 1")
def recognition_by_own_distance(spark, d):
    gallery, probes = _split(spark, d)
    return N.recognize(probes, gallery, distance=lambda q, y: np.abs(y - q).sum(1)).select("sample_id", "cls", "predicted", F.round("d2", 6).alias("distance"))


@query("""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
 w AS (SELECT event_type, unnest(range(1, any_value(n) - 98, 50)) AS st FROM e GROUP BY event_type HAVING any_value(n) >= 100)
 SELECT event_type, st, st + 99 AS en, round(sum(value), 4) AS total FROM w JOIN e USING (event_type) WHERE k BETWEEN st AND st + 99 GROUP BY ALL""", base=False)
def stream_moving_windows(spark, d):
    events = stream_of(spark, d, "events").select("event_id", "event_type", "value")
    return rounded(run_stream(stream_windows(events, "event_type", "value", 100, 50), f"{G.shared_folder(spark)}/stream-{uuid.uuid4().hex}"), "total", digits=4)


# -- more of the same families

_UNIT = ", s AS (SELECT sample_id, [x / sqrt(list_dot_product(feat, feat)) FOR x IN feat] AS feat FROM samples), d AS"


@query(_KNN.replace(", s AS (SELECT sample_id, feat FROM samples), d AS", _UNIT) + " SELECT src, dst, round(1 - d2 / 2, 6) + 0.0 AS w FROM u")
def cosine_affinity(spark, d):
    s = samples(spark, d).withColumn("feat", V.l2_normalized(F.col("feat")))
    return N.affinity(N.neighbour_graph(s, 5), "cosine").select("src", "dst", (F.round("w", 6) + 0.0).alias("w"))


@query(" SELECT sample_id, round(list_aggregate(feat, 'stddev_samp'), 6) AS deviation FROM samples")
def row_deviations(spark, d):
    return samples(spark, d).select("sample_id", F.round(V.row_deviation(F.col("feat")), 6).alias("deviation"))


@query(f", {LONG}, m AS (SELECT pos, avg(x) FILTER (x <= 0.25) AS a, stddev_pop(x) FILTER (x <= 0.25) AS b FROM long GROUP BY pos) SELECT sample_id, CAST(pos AS INTEGER) AS pos, round((x - a) / b, 5) + 0.0 AS z FROM long JOIN m USING (pos) WHERE x <= 0.25")
def standardized_without_missing(spark, d):
    s = samples(spark, d).withColumn("feat", F.transform("feat", lambda x: F.when(x > 0.25, F.lit(float("nan"))).otherwise(x)))
    z = S.long_form(S.apply_scaler(s, S.fit_scaler(s, "zscore")), "sample_id").filter(~F.isnan("x"))
    return z.select("sample_id", "pos", (F.round("x", 5) + 0.0).alias("z"))


@query(_KNN + ", t AS (SELECT k, ln(avg(sqrt(d2))) AS y FROM r WHERE k BETWEEN 2 AND 8 GROUP BY k) SELECT round(1 / regr_slope(y, ln(k)), 5) AS dimension FROM t")
def neighbour_dimension(spark, d):
    s = samples(spark, d)
    return rounded(M.neighbour_dimension(N.nearest(s, s, 8, skip_self=True), 2, 8), "dimension", digits=5)


@query()
def eigen_dimension(spark, d):
    return spark.createDataFrame([(M.eigen_dimension(samples(spark, d)),)], "dimension int")


@query(" SELECT sample_id, [feat[(7 - k // 8) * 8 + k % 8 + 1] FOR k IN range(0, 64)] AS mirrored, [feat[(k // 8) * 8 + 7 - k % 8 + 1] FOR k IN range(0, 64)] AS upside FROM samples")
def flipped_images(spark, d):
    f = F.col("feat")
    return samples(spark, d).select("sample_id", I.flipped(f, 8, 8, 1).alias("mirrored"), I.flipped(f, 8, 8, 1, True).alias("upside"))


@query(" SELECT cls, CAST(col_idx AS INTEGER) AS col_idx, 8 AS h, 8 AS w, [round((x + 1) * 127) FOR x IN feat] AS feat FROM samples")
def image_files(spark, d):
    """Written as image files, a folder a class, and read back; folders in natural order are the classes."""
    path = f"{G.shared_folder(spark)}/images-{uuid.uuid4().hex}"
    save_images(_bytes(spark, d), path, 8, 8).write.format("noop").mode("overwrite").save()
    return image_samples(spark, path, read=functools.partial(read_bitmap, grey=True)).select("cls", "col_idx", "h", "w", "feat")


@query(f", g AS (SELECT s.* FROM samples s JOIN (SELECT cls, count(*) AS n FROM samples GROUP BY cls) USING (cls) WHERE 3 * col_idx <= 2 * n), {LONG}, m AS (SELECT pos, avg(x) AS a, stddev_pop(x) AS b FROM long WHERE sample_id IN (SELECT sample_id FROM g) GROUP BY pos), z AS (SELECT sample_id, pos, (x - a) / b AS x FROM long JOIN m USING (pos)),"
       " l AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM z WHERE sample_id IN (SELECT sample_id FROM g) GROUP BY pos) SELECT sample_id, CAST(pos AS INTEGER) AS pos, round((x - lo) / (hi - lo), 5) + 0.0 AS x FROM z JOIN l USING (pos)")
def fitted_stages(spark, d):
    """Two stages fitted one after the other on the gallery, applied to every sample."""
    gallery, probes = _split(spark, d)
    every = gallery.withColumn("split", F.lit("TR")).unionByName(probes.withColumn("split", F.lit("TE")))
    out = Pipeline(Scaler("zscore"), Scaler("minmax")).fit(every).transform(every)
    return S.long_form(out, "sample_id").select("sample_id", "pos", (F.round("x", 5) + 0.0).alias("x"))


@query(", c0 AS (SELECT cls AS k, feat AS c FROM samples WHERE col_idx = 1), n AS (SELECT sample_id, feat, k FROM samples, c0 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY list_sum([(feat[i] - c[i]) * (feat[i] - c[i]) FOR i IN range(1, 65)]), k) = 1),"
       " p AS (SELECT k, i, avg(feat[i]) AS m FROM n, range(1, 65) r(i) GROUP BY k, i), c1 AS (SELECT k, list(m ORDER BY i) AS c FROM p GROUP BY k)"
       " SELECT sample_id, CAST(k AS INTEGER) AS cluster FROM samples, c1 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY list_sum([(feat[i] - c[i]) * (feat[i] - c[i]) FOR i IN range(1, 65)]), k) = 1")
def kmeans_step(spark, d):
    """One step from given centres, the first sample of each class."""
    s = samples(spark, d)
    start = np.array([r["feat"] for r in s.filter("col_idx = 1").orderBy("cls").collect()])  # a row a class
    return L.kmeans(s, len(start), 1, start=start)[1]


@query()
def singular_least_squares(spark, d):
    return _projected(spark, d, lambda g: R.partial_least_squares(g, 5, "svd"))


@query()
def layered_recognition(spark, d):
    """Probes with a quarter of their rows hidden, coded over the gallery and single pixels."""
    gallery, probes = _split(spark, d)
    hidden = probes.withColumn("feat", I.occlusion(F.col("feat"), 8, 8, "t", 0.25))
    return S.accuracies(L.layered_recognition(hidden, gallery, np.eye(64)), "cls", "predicted")


# -- margins, trees, packings


@query()
def margin_recognition(spark, d):
    """Support vector machines of each class against the others, over the whole gallery."""
    gallery, probes = _split(spark, d)
    return S.accuracies(MG.machine_recognition(gallery, probes), "cls", "predicted")


@query(" SELECT DISTINCT cls, TRUE AS optimal FROM samples")
def margin_optimality(spark, d):
    """The machines' primal and dual values meet, class by class."""
    fit = MG.consensus_margins(samples(spark, d), "machine", tolerance=2e-3)
    met = np.abs(fit.primal - fit.dual) <= 5e-3 * np.abs(fit.primal)
    return spark.createDataFrame([(int(c), bool(m)) for c, m in zip(fit.classes, met)], "cls int, optimal boolean")


@query()
def sphere_recognition(spark, d):
    gallery, probes = _split(spark, d)
    return S.accuracies(MG.sphere_recognition(gallery, probes), "cls", "predicted")


@query(" SELECT cls, count(*) AS n, TRUE AS holds FROM samples GROUP BY cls")
def sphere_shares(spark, d):
    """No more of a class lies outside its sphere than the share allowed, nor less than that but for the samples on it."""
    s = samples(spark, d)
    found = MG.sphere_members(s, MG.consensus_margins(s, "sphere", outside=0.2))
    out = F.avg((F.col("d2") > F.col("r2") * 1.001).cast("int"))
    inside = F.avg((F.col("d2") < F.col("r2") * 0.999).cast("int"))
    return found.groupBy("cls").agg(F.count("*").alias("n"), ((out <= 0.22) & (inside <= 0.82)).alias("holds"))


@query("WITH RECURSIVE " + SAMPLES + _KNN + """, n AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS p FROM samples),
 o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d2, src, dst) AS k, src, dst, d2, a.p AS ps, b.p AS pd FROM u JOIN n a ON a.sample_id = src JOIN n b ON b.sample_id = dst WHERE src < dst),
 t(k, part, took) AS (SELECT CAST(0 AS BIGINT), (SELECT list(p ORDER BY p) FROM n), FALSE UNION ALL
  SELECT o.k, list_transform(part, lambda x: CASE WHEN x = part[pd] THEN part[ps] ELSE x END), part[ps] <> part[pd] FROM t JOIN o ON o.k = t.k + 1)
 SELECT src, dst, round(d2, 6) AS d2 FROM t JOIN o USING (k) WHERE took""", base=False)
def spanning_forest(spark, d):
    return rounded(TR.spanning_forest(N.neighbour_graph(samples(spark, d), 5)), "d2")


@query()
def spanning_tree_dimension(spark, d):
    return rounded(TR.spanning_dimension(samples(spark, d)), "dimension")


_PACKING = ", h AS (SELECT sample_id, feat, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(sample_id AS VARCHAR)), 1, 15) AS BIGINT), sample_id) AS k FROM samples)"


@query("WITH RECURSIVE " + SAMPLES + _PACKING + """, r AS MATERIALIZED (SELECT a.k, list(b.k) FILTER (WHERE list_sum([(a.feat[i] - b.feat[i]) * (a.feat[i] - b.feat[i]) FOR i IN range(1, 65)]) < 1.2 * 1.2) AS near FROM h a JOIN h b ON b.k < a.k OR a.k = b.k AND a.k = 1 GROUP BY a.k),
 t(k, picked) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] UNION ALL SELECT r.k, CASE WHEN list_has_any(picked, coalesce(near, [])) THEN picked ELSE list_append(picked, r.k) END FROM t JOIN r ON r.k = t.k + 1)
 SELECT sample_id FROM h WHERE k IN (SELECT unnest(picked) FROM t WHERE t.k = (SELECT max(k) FROM h))""", base=False)
def packing(spark, d):
    return TR.packing(samples(spark, d), 1.2)


@query()
def packing_dimension(spark, d):
    return rounded(TR.packing_dimension(samples(spark, d), 1.0, 1.2), "dimension")


@query()
def large_margin_recognition(spark, d):
    """Nearest gallery samples under a metric of large margins learned from the gallery."""
    return _projected(spark, d, lambda g: LM.large_margin_metric(g, steps=10).transform)


@query("""WITH """ + SAMPLES + """, d AS (SELECT a.sample_id, b.sample_id AS target_id, list_sum([(a.feat[i] - b.feat[i]) * (a.feat[i] - b.feat[i]) FOR i IN range(1, 65)]) AS d2 FROM samples a JOIN samples b ON a.cls = b.cls AND a.sample_id <> b.sample_id)
 SELECT sample_id, target_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d2, target_id) AS rank FROM d) WHERE rank <= 3""", base=False)
def target_neighbours(spark, d):
    return LM.target_neighbours(samples(spark, d), 3)


# -- selection, tangents


@query("WITH RECURSIVE " + SAMPLES + """, long AS (SELECT sample_id, cls, unnest(feat) AS x, generate_subscripts(feat, 1) AS pos FROM samples),
 m AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY pos), l AS (SELECT sample_id, cls, pos, CASE WHEN x > m + s THEN 2 WHEN x < m - s THEN 0 ELSE 1 END AS v FROM long JOIN m USING (pos)),
 n AS (SELECT count(*) AS n FROM samples), one AS (SELECT pos, v, count(*) AS c FROM l GROUP BY ALL), k AS (SELECT cls, count(*) AS c FROM samples GROUP BY cls),
 jc AS (SELECT cls, pos, v, count(*) AS c FROM l GROUP BY ALL), rel AS (SELECT pos, sum(jc.c / n * ln(jc.c * n / (k.c * one.c)::DOUBLE)) AS r FROM jc JOIN k USING (cls) JOIN one USING (pos, v), n GROUP BY pos),
 jp AS (SELECT a.pos AS i, b.pos AS j, a.v AS u, b.v AS v, count(*) AS c FROM l a JOIN l b USING (sample_id) GROUP BY ALL),
 red AS (SELECT i, j, sum(jp.c / n * ln(jp.c * n / (a.c * b.c)::DOUBLE)) AS r FROM jp JOIN one a ON a.pos = i AND a.v = u JOIN one b ON b.pos = j AND b.v = jp.v, n GROUP BY i, j),
 w AS MATERIALIZED (SELECT (SELECT list(r ORDER BY pos) FROM rel) AS rel, (SELECT list(x ORDER BY i) FROM (SELECT i, list(r ORDER BY j) AS x FROM red GROUP BY i)) AS red),
 t(step, chosen, scores) AS (SELECT 0, []::BIGINT[], []::DOUBLE[] UNION ALL SELECT step + 1, list_append(chosen, list_position(s, list_max(s))::BIGINT), list_append(scores, list_max(s))
  FROM (SELECT step, chosen, scores, [CASE WHEN list_contains(chosen, j) THEN -1e9 ELSE rel[j] - coalesce(list_avg([red[j][c] FOR c IN chosen]), 0) END FOR j IN range(1, 65)] AS s FROM t, w WHERE step < 8))
 SELECT CAST(k AS INTEGER) AS step, CAST(chosen[k] - 1 AS INTEGER) AS feature, round(scores[k], 6) AS score FROM t, range(1, 9) r(k) WHERE t.step = 8""", base=False)
def relevant_features(spark, d):
    """Eight features by mutual information with the class and with each other."""
    got = SE.relevant_features(samples(spark, d), 8)
    return spark.createDataFrame([(k, j, round(s, 6)) for k, (j, s) in enumerate(got, 1)], "step int, feature int, score double")


@query()
def tangent_map_recognition(spark, d):
    """Nearest gallery samples under the linear map that keeps local tangents."""
    return _projected(spark, d, lambda g: SE.tangent_map(g, 8))


@query(" SELECT CAST(step AS INTEGER) AS step, (SELECT count(*) FROM samples) AS samples, TRUE AS rises FROM range(1, 9) s(step)")
def mixture_densities(spark, d):
    """Each step of the mixture of factor analysers deals every sample out whole and doesn't lower the density."""
    _, history = MX.mixture(samples(spark, d), 4, 3, steps=8, tolerance=-np.inf)
    risen = [True, *(b[0] >= a[0] - 1e-9 for a, b in zip(history, history[1:]))]
    return spark.createDataFrame([(i + 1, round(h[1]), r) for i, (h, r) in enumerate(zip(history, risen))], "step int, samples long, rises boolean")


def _coordinate_products(spark, d, neighbours):
    s = samples(spark, d)
    mix, _ = MX.mixture(s, 4, 3, steps=8)
    c = S.covariance(MX.coordinates(s, mix, *MX.aligned(s, mix, 3, neighbours)), 3)
    same = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0))
    return c.select("i", "j", same.alias("product"), (F.abs(F.col("cov") - same) < 1e-5).alias("equal"))


_UNIT = " SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(i = j AS DOUBLE) AS product, TRUE AS equal FROM range(0, 3) a(i), range(0, 3) b(j) WHERE i <= j"


@query(_UNIT)
def charted_products(spark, d):
    """Coordinates joined from charts that agree on the samples they share have unit covariance."""
    return _coordinate_products(spark, d, 0)


@query(_UNIT)
def coordinated_products(spark, d):
    """Coordinates joined so that neighbours' weights rebuild each sample have unit covariance."""
    return _coordinate_products(spark, d, 5)
