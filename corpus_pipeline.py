"""A corpus pipeline of five stages; counted as part of vektral.llm.

Defined results: a null, empty or blank text is scored, deduplicated and mixed as one without words, which the
mix takes none of; null and repeated doc_ids are rows of their own in every stage; exact repeats count as near
copies, of which the row with the least doc_id stays (null after all others, one of equal rows); empty tables
give empty ones; extra columns, whatever their names, come through all stages but the last unchanged, whose columns
are its own.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektral.llm.bpe_fst import encode_documents
from vektral.llm.common import forget_path, new_path, small_batches, table, written
from vektral.llm.jaccard_join import jaccard_join
from vektral.llm.line_dedup import dedup_lines
from vektral.llm.mixing import mixed_documents
from vektral.llm.quality_mil import score_documents, train
from vektral.llm.queries import pattern, vocabulary


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _beside(stage):
    """A stage that sees the columns of documents under their names and all others under names of no one
    else's, and gives all of them back."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = uuid.uuid4().hex
        away = {c: f"_{k}{own}" for k, c in enumerate(docs.columns) if c not in COLUMNS}
        done = stage(spark, docs.withColumnsRenamed(away), sf_dir)
        return done.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])

    return run


@_beside
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, doesn't reject."""
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")), keep_columns=True)
    return scored.filter("predicted = 1")


@_beside
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of ten documents or more."""
    return dedup_lines(docs, min_docs=10).withColumn("n_chars", F.length("text").cast("long"))


@_beside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: one with the smallest doc_id, null after all others.
    Rows are told apart by a number of their own, so null and repeated doc_ids lose nothing."""
    row = f"_row{uuid.uuid4().hex}"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard_join(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    groups = groups.join(rows.select(row, "doc_id"), row)
    least = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("_least"), F.count("*").alias("_n"))
    goes = groups.join(least.filter("_n > 1"), "component_id").filter(F.col(row) != F.col("_least")[row]).select(row)
    return rows.join(goes, row, "left_anti").select(*docs.columns)


@_beside
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to weights 1, 2, 3: documents cut out or repeated."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their counts and digests; documents repeated in the mix stay repeated.
    Small tables a worker: the executors' heaps have grown in the stages before."""
    return encode_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), keep_ids=True, room=32 << 20)


def _stage(f):
    """f in a session with small Arrow batches, so that what the stages leave behind stays small."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


STAGES = [(name, _stage(f)) for name, f in (("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mixture), ("byte-level BPE", tokens))]

#: SQL has no model and no tokenizer: tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; a stage's table goes once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            forget_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
