"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources share a total of words by weight.  A source whose share exceeds the
words of its maximum epochs is clamped there, and what it leaves goes to the
others by weight, round by round, until no share is above its cap.

A source's target is then met by repetitions of its documents: each is taken
as often as the target holds the source whole, and the fraction that remains
is filled in the order of a seeded hash, one repetition a document, until a
last document is taken in part.  Where that order is cut is found by a
histogram of the hash, so no source is sorted: only the rows in the bin of the
cut are ordered, a 2^-BIN_BITS part of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import numbered, salted_join, store

WHITE_RUN = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the seeded hash, and how many of its leading bits are a bin.
HASH_DIGITS, BIN_BITS = 15, 12
#: So many sources at most are broadcast; more are joined by a shuffle with salt.
BROADCAST_SOURCES = 100_000


def in_turn(points: DataFrame, turn: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source and weight: the sources of points by code point, null last, weigh as turn says, over and over."""
    ranked = numbered(points.select("source").distinct(), [F.asc_nulls_last("source")])
    weight = F.element_at(F.array(*[F.lit(w) for w in turn]), (F.pmod("number", F.lit(len(turn))) + 1).cast("int"))
    return ranked.select("source", weight.cast("bigint").alias("weight"))


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size (words of the whole text; a null text has none) and the row's place in the seeded order."""
    size = F.coalesce(F.regexp_count("text", F.lit(WHITE_RUN)), F.lit(0)).cast("bigint")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    place = F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), place.alias("place"))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds target to sources (source, weight, source_size): they share the sum of all sizes.

    A round is one row of exact sums; each clamps one source or more, and the
    level, words a unit of weight, rises until none is above its cap.
    """
    cap = max_epochs * F.col("source_size")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, clamped = 0.0, -1
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        # the first round has clamped none
        some = F.lit(False) if clamped < 0 else over
        found = sources.agg(F.count_if(some), F.coalesce(F.sum(F.when(some, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~some, F.col("weight"))), F.lit(0))).first()
        if found[0] == clamped:
            break
        clamped = found[0]
        if not found[2]:
            break
        level = (total - found[1]) / found[2]
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def _with_sources(rows: DataFrame, sources: DataFrame, count: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of sources: broadcast if they are few, else by a shuffle that deals a hot source's rows to many tasks."""
    keyed = sources.withColumn("source_key", _key(F.col("source"))).drop("source")
    marked = rows.withColumn("source_key", _key(F.col("source")))
    joined = marked.join(F.broadcast(keyed), "source_key", how) if count <= BROADCAST_SOURCES else salted_join(marked, keyed, ["source_key"], "place", how)
    return joined.drop("source_key")


def _key(source: Column) -> Column:
    """A source without null: a leading mark says whether there is one."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and repetitions of every row of docs (doc_id, text, source).

    weights has source and weight (whole numbers above 0), one row a source;
    without it sources weigh 1, 2, 3 in turn.  A source without a weight has
    target 0, a weight without documents no rows.  A null source is a source
    of its own; a null or empty text has size 0 and is taken for 0 words.
    taken is what the mix takes of the row: whole repetitions, and a last one
    that is whole, partial or absent; a source's taken words differ from its
    target by rounding, less than one word, or a word a repeated row: rows
    with equal source and doc_id tie, and share what is cut among them alike.
    No row exceeds max_epochs times its size, and the same rows and seed give
    the same result however they are dealt.  An empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    points = store(sizes(docs, seed), "mix-points")
    weights = in_turn(points) if weights is None else weights.select(F.col("source").cast("string").alias("source"), F.col("weight").cast("bigint").alias("weight"))
    held = points.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = held.withColumn("key", _key(F.col("source"))).join(weights.select(_key(F.col("source")).alias("key"), "weight"), "key", "left").drop("key")
    sources = store(weighed.withColumn("weight", F.coalesce("weight", F.lit(0))), "mix-sources")
    count = sources.count()
    filled = water_fill(sources, max_epochs)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("bigint")
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("bigint")
    targets = store(filled.withColumn("whole", whole).withColumn("rest", rest), "mix-targets")

    # the bin in which the words of a source's last, partial epoch end
    bins = points.groupBy("source", F.shiftright("place", 4 * HASH_DIGITS - BIN_BITS).alias("bin")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")
    ends = _with_sources(bins.withColumn("before", before).withColumn("place", F.col("bin")), targets.select("source", "rest"), count)
    cut = store(ends.where("before <= rest AND rest < before + words").select("source", F.col("bin").alias("cut_bin"), (F.col("rest") - F.col("before")).alias("room")), "mix-cuts")

    cuts = targets.withColumn("k", _key(F.col("source"))).join(cut.select(_key(F.col("source")).alias("k"), "cut_bin", "room"), "k", "left").drop("k")
    rows = _with_sources(points, cuts, count)
    bin_ = F.shiftright("place", 4 * HASH_DIGITS - BIN_BITS)
    # without a cut all words of the rest are there, as where the rest is the whole source by rounding
    early = F.when(F.col("cut_bin").isNull(), F.when(F.col("rest") > 0, F.col("size")).otherwise(F.lit(0))).when(bin_ < F.col("cut_bin"), F.col("size")).when(bin_ > F.col("cut_bin"), F.lit(0))
    dealt = rows.withColumn("last", early.cast("bigint"))
    inside = dealt.where("last IS NULL")
    places = inside.groupBy("source", "place").agg(F.sum("size").alias("tied")).withColumn("upto", F.sum("tied").over(Window.partitionBy("source").orderBy("place")))
    own = inside.withColumn("k", _key(F.col("source"))).join(places.select(_key(F.col("source")).alias("k"), "place", "tied", "upto"), ["k", "place"]).drop("k")
    left = F.greatest(F.lit(0), F.least(F.col("tied"), F.col("room") - (F.col("upto") - F.col("tied"))))
    # equal places are repeated rows: each gets its size's share of what is left for them
    shared = F.when(F.col("tied") == F.col("size"), left).otherwise(F.floor(left * F.col("size") / F.nullif(F.col("tied"), F.lit(0))))
    settled = own.withColumn("last", F.coalesce(shared, F.lit(0)).cast("bigint")).select(*dealt.columns)
    all_rows = dealt.where("last IS NOT NULL").unionByName(settled)
    taken = F.col("whole") * F.col("size") + F.col("last")
    return all_rows.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
        (F.col("whole") + F.coalesce(F.col("last") / F.nullif(F.col("size"), F.lit(0)), F.lit(0.0))).alias("repetitions"),
    )
