"""Places in a normal form as places in the raw text, as columns: contexts of quotes without a copy of the text leaving the engine.

Normalising maps characters one to one or drops them, so a text is a row of
stretches that are kept or dropped.  Their lengths, kept ones positive and
dropped ones negative, are made once a source; running sums over them, one in
the normal form and one in the raw text, give for each place in the former
its place in the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EVIDENCE_DROP, EVIDENCE_FROM, EVIDENCE_TO, WHITE, bind, evidence_norm, strip
from ..sources.scratch import by_size

#: Characters of which the normal form has nothing: those that are dropped, and those that are mapped to such.
DROPPED = EVIDENCE_DROP + "".join(a for a, b in zip(EVIDENCE_FROM, EVIDENCE_TO) if b in EVIDENCE_DROP)


def _in_class(characters: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in characters)


#: A tag, dropped characters, kept ones, or a < that opens no tag.
STRETCH = f"<[^>]*>|[{_in_class(DROPPED)}]+|[^<{_in_class(DROPPED)}]+|<"


def stretches(text: Column) -> Column:
    """The lengths of a text's stretches in order, negative where the normal form has nothing of them."""
    dropped = lambda s: (s.startswith("<") & (F.length(s) > 1)) | (F.translate(F.substring(s, 1, 1), DROPPED, "") == "")
    return F.transform(F.regexp_extract_all(text, F.lit(STRETCH), F.lit(0)), lambda s: F.when(dropped(s), -F.length(s)).otherwise(F.length(s)))


def raw_places(lengths: Column, first: Column, last: Column) -> Column:
    """start and end (both from 0, both included) in the raw text of a span of the normal form; null where it is not in it."""
    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).alias("normal"), F.lit(0).alias("raw"), none.alias("start"), none.alias("end"))

    def step(sums: Column, length: Column) -> Column:
        kept = F.greatest(length, F.lit(0))
        place = lambda at: F.when((length > 0) & (sums["normal"] <= at) & (at < sums["normal"] + length), sums["raw"] + at - sums["normal"])
        return F.struct((sums["normal"] + kept).alias("normal"), (sums["raw"] + F.abs(length)).alias("raw"), F.coalesce(sums["start"], place(first)).alias("start"), F.coalesce(sums["end"], place(last)).alias("end"))

    return F.aggregate(lengths, begin, step, lambda sums: F.struct(sums["start"].alias("start"), sums["end"].alias("end")))


def longest_fragment(quote: Column) -> Column:
    """The longest part of a quote between ellipses, the first of equal ones; empty if all are blank."""
    parts = F.filter(F.split(quote, r"…+|\.{3,}"), lambda x: strip(x) != "")
    return F.aggregate(parts, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def contexts(pairs: DataFrame, sources: DataFrame, window: int = 120) -> DataFrame:
    """pairs (source, quote, ...) with context: the source's raw text around the longest fragment of the quote, found in normal form.

    window characters on either side are taken, white space is folded.  The
    context is empty where the quote is null or blank, the source is not there,
    or the fragment is not in it.  Only sources that a pair names are
    normalised, each once; a text meets its pairs in one join and is cut there.
    """
    named = by_size(sources.select(F.col("rel").alias("_rel"), "text"), "text", "_rel").join(pairs.select(F.col("source").alias("_rel")).distinct(), "_rel", "left_semi")
    ready = named.select("_rel", F.col("text").alias("_text"), evidence_norm(F.col("text")).alias("_body"), stretches(F.col("text")).alias("_lengths"))
    joined = pairs.join(ready, F.col("source") == F.col("_rel"), "left").withColumn("_wanted", evidence_norm(longest_fragment(F.coalesce("quote", F.lit("")))))
    at = F.when(F.col("_wanted") != "", F.call_function("locate", F.col("_wanted"), F.col("_body"), F.lit(1)) - 1)

    def cut(place: Column) -> Column:
        start = F.greatest(F.lit(0), place["start"] - window)
        return F.substr(F.col("_text"), start + 1, place["end"] + 1 + window - start)

    placed = F.when(at >= 0, bind(raw_places(F.col("_lengths"), at, at + F.length("_wanted") - 1), cut))
    folded = F.btrim(F.regexp_replace(placed, f"[{_in_class(WHITE)}]+", " "), F.lit(" "))
    return joined.withColumn("context", F.coalesce(folded, F.lit(""))).select(*pairs.columns, "context")
