"""Line dedup: lines found in many documents are dropped from every document.

Texts are split at \\n, the lines' keys hashed and exploded, distinct documents counted per hash, and the
lines of a hash at or over the threshold dropped; the others are put together again in their order.  All
of it is DataFrame functions.  Counting goes by (hash, document) first and by hash then, so a line that a
third of all documents hold is summed up from partial counts.  Frequent hashes up to literal_limit are
looked up as a set inside the scan; beyond that the lines' hashes and positions are joined with them (sent
to every task up to broadcast_limit rows, 8 bytes each), and a document is put together from the
positions that stay.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z in lower case.

Defined results: a null or empty text is one empty line, kept, and comes back as an empty text; a
key shorter than min_chars code points is never dropped; a document is a doc_id, so rows that repeat one
count once, and rows without one count for none, though they lose frequent lines like others; a
repeated line counts once per document; texts of any length are taken whole; an empty table gives an
empty one.  All other columns pass through, whatever their names.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, n_docs) of the line hashes found in min_docs documents or more."""
    keys = F.transform(lines_of(F.col(text)), line_key)
    hashes = F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_chars), lambda k: F.xxhash64(k))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(hashes)).alias("key"))
    return each.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id", literal_limit: int = 10_000, broadcast_limit: int = 1_000_000) -> DataFrame:
    """docs with frequent lines dropped from text, and the columns n_lines and n_dropped (replaced
    where docs has such columns)."""
    docs = docs.drop("n_lines", "n_dropped")
    lines = lines_of(F.col(text))
    hot = written(frequent_lines(docs, min_docs, min_chars, text, doc_id).select("key"), "hot-lines")
    n_hot = hot.count()
    if n_hot <= literal_limit:
        found = [r[0] for r in hot.collect()]
        kept = F.filter(lines, lambda x: ~F.xxhash64(line_key(x)).isin(found)) if found else lines
        n_dropped = F.size(lines) - F.size(kept)
        rows = docs
    else:
        row, at = f"_row{uuid.uuid4().hex}", f"_at{uuid.uuid4().hex}"  # no column of docs has these names
        # rows that share both hashes are equal in id and text, and lose the same lines
        name = F.struct(F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), text, doc_id))
        docs = docs.withColumn(row, name)
        places = docs.select(F.col(row), F.posexplode(F.transform(lines, lambda x: F.xxhash64(line_key(x)))).alias("_at", "key"))
        gone = places.join(F.broadcast(hot) if n_hot <= broadcast_limit else hot, "key", "left_semi")
        gone = gone.groupBy(row).agg(F.collect_set("_at").alias(at))
        rows = docs.join(gone, row, "left")
        # the split lines are read more than once below, so that they stay a column and are split once
        rows = rows.withColumn(at + "l", lines)
        lines = F.col(at + "l")
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(at), F.array().cast("array<int>")))
        kept = F.transform(stay, lambda k: F.get(lines, k))
        n_dropped = F.coalesce(F.size(F.col(at)), F.lit(0))
    columns = [F.array_join(kept, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if n_hot <= literal_limit or c != row]
    return rows.select(*columns, F.size(lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
