"""Source divergence audit: how far the word use of the sources of a language lies apart, and by which terms.

Terms are counted by (language, source, term) with map-side combine, so a source or a term that holds a
third of all words is summed up from partial counts.  Each term of enough documents is then pivoted into one
wide row, an array of counts in the order of its language's sources.  From there on the work grows with the
vocabulary, not with the corpus: higher-order functions make the terms' smoothed shares and, of each wide row,
the contributions of all pairs of sources, which map-side aggregation sums up.  All arithmetic is that of
whole numbers (shares are scaled by 1e9 and rounded down, products are decimals).

The table of a language's sources is joined by language and a salt, so that a large language is dealt to
many tasks; Spark sends it to all of them instead where it is below the session's broadcast threshold.

Defined results: null text, language and source are empty strings; a document is a row, so repeated rows
count each; sources without any term have the smoothed shares of zero counts; a language without kept terms
has pairs of value 0; a language of one source has no pairs; ties in value go by the item's bytes; an empty
table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
SALTS = 64


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(TERMS), F.lit(0))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    rows = docs.select("lang", "source", terms_of(F.col("text")).alias("terms"))
    rows = rows.select("lang", "source", F.array_distinct("terms").alias("once"), "terms")
    # a document's distinct terms stand in front of all its terms
    rows = rows.select("lang", "source", F.size("once").alias("k"), F.posexplode(F.concat("once", "terms")).alias("pos", "term"))
    once = (F.col("pos") < F.col("k")).cast("long")
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - once).alias("n"), F.sum(once).alias("docs"))


def wide_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, counts): a row for each term of min_docs documents or more of its language, with its
    occurrences by source."""
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return by_term.filter(F.col("docs") >= min_docs).select("lang", "term", F.map_from_entries("counts").alias("counts"))


def _share(count: Column, total: Column, kept: Column, smooth: int) -> Column:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * kept)), exactly."""
    over = ((count + smooth).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(32,0)")
    under = (total + smooth * kept).cast("decimal(20,0)")
    return F.call_function("div", over, under).cast("long") + 1


def source_divergence(docs: DataFrame, min_docs: int = 30, smooth: int = 5, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.  Part pair: every other source of the language, with the sum
    over all kept terms of the shares' absolute difference.  Part term: the top terms that the source uses
    more than its language does, with the difference of the two shares."""
    some = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(some(text, "text"), some(lang, "lang"), some(source, "source"))
    wide = written(wide_terms(rows, min_docs), "wide-terms")
    groups = rows.select("lang", "source").distinct()

    # one row a language: its sources in order, the words of each, and the number of kept terms
    words = wide.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("words"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = groups.join(words, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("words", F.lit(0)).alias("words")).alias("g"))
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("sources"))
    langs = langs.join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    langs = written(langs.withColumn("words", F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["words"])), "languages")

    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    vectors = wide.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    count = lambda s: F.coalesce(F.element_at("counts", s["source"]), F.lit(0).cast("long"))
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, n: a + n)
    shares = F.transform("sources", lambda s: F.struct(s["source"].alias("source"), count(s).alias("n"), _share(count(s), s["words"], F.col("kept"), smooth).alias("p")))
    vectors = vectors.select("lang", "term", shares.alias("shares"), _share(total, F.col("words"), F.col("kept"), smooth).alias("q"))
    vectors = written(vectors.withColumn("p", F.transform("shares", lambda s: s["p"])), "term-vectors")

    # pairs of the places i < j of one wide row
    later = lambda i: F.slice("p", i + 2, F.size("p"))
    at_i = lambda i: F.transform(later(i), lambda x, k: F.struct(i.alias("i"), (i + 1 + k).alias("j"), F.abs(x - F.get("p", i)).alias("f")))
    pairs = vectors.filter(F.size("p") > 1).select("lang", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - 2), at_i))).alias("c"))
    sums = pairs.groupBy("lang", "c.i", "c.j").agg(F.sum("c.f").alias("value"))
    # every ordered pair of a language's sources, even without kept terms
    name = F.transform("sources", lambda s: s["source"])
    each = langs.select("lang", name.alias("names"), F.posexplode(name).alias("a", "source")).select("lang", "a", "source", F.posexplode("names").alias("b", "item")).filter("a <> b")
    each = each.select("lang", "source", "item", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    pair = each.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    more = vectors.select("lang", "term", "q", F.explode(F.filter("shares", lambda s: (s["n"] > 0) & (s["p"] > F.col("q")))).alias("s"))
    term = more.select("lang", F.col("s.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("s.p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).filter(F.col("rank") <= top))


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_id FROM documents),
w AS (SELECT lang, source, row_id, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM x JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM k JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
UNION ALL SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM t) WHERE rank <= 50
"""
