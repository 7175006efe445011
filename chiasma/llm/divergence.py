"""How far the sources of a language differ in their words: counts, densified by the kept vocabulary, joined on terms.

Terms are runs of letters (ASCII letters and everything beyond ASCII); only A-Z are lower-cased. A language keeps the
terms of at least ``MIN_DOCS`` of its documents. Every group, a (lang, source) that occurs, and each language itself
gives a kept term p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), with N the group's occurrences of kept terms and V the
number of kept terms. Two distributions differ at a term by floor((p - q)^2 / (p + q)). All in whole numbers: products
that may pass 2^63 are decimals.

How it is dealt: documents are exploded once and summed before the shuffle, so a source with a third of all rows is a
few partial sums a task. The vocabulary meets the groups of its language in salted parts (``SALTS``), the zeros come from
that join, and distributions meet by language and term. Pairs are made once (smaller source first) and turned round
after they are summed. The ranks of terms need ten rows of each group from each task.

Defined results: null text, lang and source are ''; a document is a row, so repeated rows count each; a text without
terms gives its group no count, but the group has its rows of part ``pair``; equal values rank by item in UTF-8 order;
a language without kept terms has only pairs of value 0; an empty table gives no rows; other columns are ignored. A very
long text is exploded in its task as it is, a row for each distinct term and each occurrence.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import shuffle_partitions, stored

#: What lies between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10


def terms_of(text: Column) -> Column:
    """The terms of a text in order, and perhaps empty strings at its ends.

    They are had as what lies between the matches of the complement, for a sixth of the time of a list of matches.
    """
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    plain = F.octet_length(text) == F.length(text)  # where a text is ASCII, lower() is the same and faster
    return F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower)), BETWEEN)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count (occurrences) and docs (documents with it)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(blank("lang"), blank("source"), blank("text")).select("lang", "source", terms_of(F.col("text")).alias("every"))
    rows = rows.withColumn("once", F.array_distinct("every"))
    # each distinct term once and then each occurrence, told apart by their places
    rows = rows.select("lang", "source", F.size("once").alias("n"), F.posexplode(F.concat("once", "every")).alias("at", "term")).filter("term <> ''")
    first = F.col("at") < F.col("n")
    return rows.groupBy("lang", "source", "term").agg(F.sum(F.when(first, 0).otherwise(1)).alias("count"), F.sum(F.when(first, 1).otherwise(0)).alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term: exact, as decimals."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(F.lit(SCALE), 10) * wide(count + 2, 20), wide(total + 2 * kept, 20)) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def distributions(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, total, kept), and of each group and kept term: lang, source, term, count, p, q.

    ``p`` is the group's, ``q`` the language's.
    """
    salts = shuffle_partitions(docs.sparkSession)
    counts = stored(term_counts(docs), "divergence-counts")
    words = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("in_lang")).filter(F.col("docs") >= min_docs)
    words = stored(words.select("lang", "term", "in_lang"), "divergence-words")
    own = stored(counts.select("lang", "source", "term", "count").join(words, ["lang", "term"], "left_semi"), "divergence-kept")
    sizes = words.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = named.join(own.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = stored(groups.na.fill(0, ["total", "kept", "lang_total"]), "divergence-groups")

    salted = groups.filter("kept > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dense = words.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    dense = dense.join(own, ["lang", "source", "term"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    dense = dense.select("lang", "source", "term", "count", share(F.col("count"), F.col("total"), F.col("kept")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("kept")).alias("q"))
    return groups, stored(dense, "divergence-dense")


def source_pairs(groups: DataFrame, dense: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: both directions of each pair."""
    a = dense.select("lang", "term", "source", "p")
    b = a.withColumnsRenamed({"source": "item", "p": "q"})
    sums = a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(gap(F.col("p"), F.col("q"))).alias("value"))
    # languages without kept terms: their sources meet in salted parts too
    salts = shuffle_partitions(groups.sparkSession)
    bare = groups.filter("kept = 0").select("lang", "source")
    left = bare.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int"))
    right = bare.select("lang", F.col("source").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    zeros = left.join(right, ["lang", "salt"]).filter("source < item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return sums.unionByName(zeros).select("lang", "value", F.explode(ways).alias("w")).select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by how far they lie, and the terms a source has most beyond its language."""
    groups, dense = distributions(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = dense.filter("count > 0 and p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return ranked(source_pairs(groups, dense), "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), tokens AS (
  SELECT lang, source, unnest(ts) AS term FROM d
), own AS (
  SELECT lang, source, term, count(*) AS count FROM tokens GROUP BY ALL
), vocabulary AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10
), kept AS (
  SELECT lang, source, term, count FROM own SEMI JOIN vocabulary USING (lang, term)
), groups AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(count) AS n FROM kept GROUP BY ALL) USING (lang, source)
), langs AS (
  SELECT v.lang, v.term, w.v, w.n, sum(k.count) AS count
  FROM vocabulary v JOIN kept k USING (lang, term) JOIN (
    SELECT lang, (SELECT count(*) FROM vocabulary x WHERE x.lang = kept.lang) AS v, sum(count) AS n FROM kept GROUP BY lang) w ON w.lang = v.lang
  GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, l.term, coalesce(k.count, 0) AS count,
    (1 + 1000000000::HUGEINT * (coalesce(k.count, 0) + 2) // (g.n + 2 * l.v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (l.count + 2) // (l.n + 2 * l.v))::BIGINT AS q
  FROM groups g JOIN langs l ON l.lang = g.lang LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = l.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM dense WHERE count > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""
