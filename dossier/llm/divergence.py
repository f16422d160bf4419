"""Source divergence audit: how each source's words differ from its language's, in plain relational steps.

Terms are exploded and counted by language, source and term.  A language keeps
the terms of many of its documents; every source of it, and the language as a
whole, is crossed with these, so that terms that a source lacks count as
zeros.  Smoothed shares are whole numbers, so all sums are exact.  Sources are
set beside each other by a join on language and term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import salted_join, store

#: Letters of ASCII and everything beyond it, in a text without A-Z: a class of fewer ranges is matched several times as fast.
TERM = r"[a-z\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares are in units of one in SCALE; every term counts SMOOTH more than it occurs.
SCALE, SMOOTH = 1_000_000_000, 5


def _folded(text: Column) -> Column:
    """Only A-Z lower-cased: a text of one byte a character by lower, which is quick, others letter by letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, occurrences and the number of documents with the term; a null text, lang or source is an empty one.

    A group's documents are counted map-side first, so a hot source or
    language is no hot key.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(plain("lang").alias("lang"), plain("source").alias("source"), _folded(plain("text")).alias("text"))
    matched = texts.select("lang", "source", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("terms"))
    # each match as an occurrence, each different one once more as a document
    twice = matched.select("lang", "source", F.inline(F.array(F.struct(F.lit(0).alias("first"), F.col("terms").alias("found")), F.struct(F.lit(1).alias("first"), F.array_distinct("terms").alias("found")))))
    exploded = twice.select("lang", "source", "first", F.explode("found").alias("term"))
    return exploded.groupBy("lang", "source", "term").agg(F.count_if(F.col("first") == 0).alias("n"), F.sum("first").cast("bigint").alias("documents"))


def vocabulary(counted: DataFrame, min_documents: int) -> DataFrame:
    """lang, term and n of the terms that occur in min_documents or more of a language's documents."""
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")).where(F.col("documents") >= min_documents).drop("documents")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), in decimals of 38 digits, so nothing overflows or is rounded."""
    wide = lambda c: c.cast("decimal(20,0)")
    quotient = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + SMOOTH), wide(total + SMOOTH * terms))
    return (1 + quotient).cast("bigint")


def audit(docs: DataFrame, min_documents: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank for every source of docs (text, lang, source).

    Part "pair": item is each other source of the language, value the sum over
    all kept terms of the two shares' differences; all are ranked.  Part
    "term": item is each kept term of which the source has more than its
    language (share against share), value the difference; only the first
    top_terms come back.  Ranks begin at 1, larger values first, equal ones by
    the item's bytes.  Null texts, languages and sources are empty ones; a
    source without terms has all kept terms at zero; a language that keeps no
    term has pairs of value 0 and no terms; a language of one source has no
    pairs.  Repeated rows count as often as they come.  An empty table gives
    no rows; other columns, whatever their names, are not read.
    """
    counted = store(counts(docs), "audit-counts")
    kept = store(vocabulary(counted, min_documents), "audit-terms")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = store(docs.select(plain("lang"), plain("source")).distinct(), "audit-groups")

    terms = kept.join(of_lang, "lang").select("lang", "term", share(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"), "terms")
    crossed = salted_join(terms, groups, ["lang"], "term", "inner")
    own = counted.join(kept.select("lang", "term"), ["lang", "term"])
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    dense = crossed.join(own.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").join(totals, ["lang", "source"], "left")
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))
    shares = store(dense.select("lang", "source", "term", n.alias("n"), "q", share(n, total, F.col("terms")).alias("p")), "audit-shares")

    # a further term that all sources have alike pairs those of languages without kept terms
    every = shares.select("lang", "term", "source", "p").unionByName(groups.select("lang", F.lit("").alias("term"), "source", F.lit(0).cast("bigint").alias("p")))
    a, b = every.alias("a"), every.alias("b")
    beside = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    summed = beside.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("one"), F.col("b.source").alias("other")).agg(F.sum(F.abs(F.col("a.p") - F.col("b.p"))).alias("value"))
    both = F.inline(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    pairs = summed.select("lang", "value", both)

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    more = shares.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked_terms = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return ranked_pairs.unionByName(ranked_terms)
