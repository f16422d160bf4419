"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gets two histograms: character classes (lower-case, other
letters, digits, white space, sentence marks, the rest) and common words (the
function words below, and all other words).  A language's reference is the
sum of the histograms of all its documents that pass the base rules, so a
document is compared with the corpus it comes from.  A document is rejected
if the Jensen-Shannon distance to its reference exceeds a limit, or both together do; short texts
have wild histograms, so the word histogram counts only from MIN_WORDS on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, store

# Frequent function words of four languages.
COMMON_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "le", "la", "de", "et", "les", "un", "une", "pour", "der", "die", "und", "zu", "den", "mit", "von", "das", "el", "los", "en", "que", "y", "se", "por", "con"]
WHITE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Base: fewer words fail; more than this share of words in repeated 3-word windows fails.
BASE_MIN_WORDS, BASE_MAX_REPEAT = 50, 0.5
#: Guards and limits of the divergence rules.
MIN_CHARS, MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MAX_SUM = 200, 100, 0.25, 0.35, 0.4
POSITION_BITS = 30


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _equal_to_neighbour(values: Column, key) -> Column:
    """The elements of a sorted array whose key equals that of the one before or after."""
    return let(values, lambda s: F.filter(s, lambda x, i: F.coalesce(key(x) == key(F.get(s, i + 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(s, i - 1)), F.lit(False))))


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in windows that occur twice or more in the array.

    Windows are sorted as (part of their hash, place) packed in one long; only
    those that share that part are then compared by their whole hash.
    """
    mask = (1 << POSITION_BITS) - 1

    def count(w: Column) -> Column:
        gram = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])
        packed = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0))), lambda x, i: gram(i).bitwiseAND(~mask).bitwiseOR(i.cast("bigint")))
        near = _equal_to_neighbour(F.sort_array(packed), lambda x: F.shiftright(x, POSITION_BITS))
        whole = F.transform(near, lambda x: let(x.bitwiseAND(mask).cast("int"), lambda p: F.struct(gram(p).alias("h"), p.alias("p"))))
        same = _equal_to_neighbour(F.sort_array(whole), lambda x: x["h"])
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(*[x["p"] + k for k in range(window)])))))

    return let(words, count)


def _occurrences(spaced: Column, word: str) -> Column:
    token = f" {word} "
    return (F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(token), F.lit("")))) / len(token)


def features(docs: DataFrame) -> DataFrame:
    """One row of counts a document: base columns and both histograms."""
    text = F.coalesce("text", F.lit(""))
    words = words_of(F.col("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    counted = docs.select("doc_id", F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), text.alias("t")).select(
        "doc_id",
        "lang",
        F.length("t").alias("chars"),
        let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).cast("bigint").alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.regexp_replace("t", r"\p{Ll}+", "").alias("rest"),
        F.concat(F.lit(" "), F.regexp_replace(F.lower("t"), r"[^\p{L}]+", "  "), F.lit(" ")).alias("spaced"),
    )
    rest = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    white = F.length("rest") - F.length(F.translate("rest", WHITE_CHARS, ""))
    counted = counted.select(
        "doc_id", "lang", "chars", "w.*", "n_dup_lines", "spaced",
        F.length("rest").alias("n_rest"), white.alias("white"),
        (F.length("rest") - F.length(F.translate("rest", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length("rest") - rest("rest", r"\p{L}+")).alias("other_letters"),
        (F.length("rest") - rest("rest", r"\p{N}+")).alias("digits"),
        (F.length("rest") - rest("rest", "[.,;:?'\"()-]+")).alias("marks"),
    )
    classes = F.array(F.col("chars") - F.col("n_rest"), "other_letters", "digits", "white", "marks", F.col("n_rest") - F.col("other_letters") - F.col("digits") - F.col("white") - F.col("marks"))
    counts = [_occurrences(F.col("spaced"), w) for w in COMMON_WORDS]
    return counted.select(
        "doc_id", "lang", "chars", "n_words", (F.col("chars") - F.col("white")).cast("bigint").alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        F.transform(classes, lambda x: x.cast("double")).alias("char_hist"),
        F.array(*counts).alias("common"),
    ).withColumn("word_hist", F.concat("common", F.array(F.greatest(F.lit(0.0), F.col("n_words") - F.aggregate("common", F.lit(0.0), lambda a, x: a + x))))).drop("common")


def _share(hist: Column) -> Column:
    return let(hist, lambda h: let(F.aggregate(h, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(h, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0)))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, from 0 to 1, of two histograms."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(_share(p), _share(q), lambda a, b: (half(a, b) + half(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def references(counted: DataFrame) -> DataFrame:
    """For each language the summed histograms of its documents that pass the base rules; shares, so long texts do not rule."""
    # each document's shares are made once, before the aggregate
    split = counted.where(~F.col("base_failed")).select("lang", _share(F.col("char_hist")).alias("char_hist"), _share(F.col("word_hist")).alias("word_hist"))
    sums = [F.sum(F.col(h)[i]).alias(f"{h}{i}") for h, n in (("char_hist", 6), ("word_hist", len(COMMON_WORDS) + 1)) for i in range(n)]
    return split.groupBy("lang").agg(*sums).select(
        F.col("lang").alias("ref_lang"),
        F.array(*[f"char_hist{i}" for i in range(6)]).alias("ref_chars"),
        F.array(*[f"word_hist{i}" for i in range(len(COMMON_WORDS) + 1)]).alias("ref_words"),
    )


def assess(docs: DataFrame) -> DataFrame:
    """One row a document with the base counts, both distances, base_failed and kept.

    A null or empty text has no words and fails the base; a null language is a
    language of its own; a text under a guard's length is not judged by that
    histogram; where no document of a language passes the base, there is no
    reference and nothing more is rejected.  Repeated rows are judged alike.
    Columns other than doc_id, text and lang are not read.
    """
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * BASE_MAX_REPEAT) * F.col("n_words"))
    counted = store(features(docs).withColumn("base_failed", failed), "quality-features")
    refs = store(references(counted), "quality-references")
    held = counted.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    char = F.when(F.col("chars") >= MIN_CHARS, js_distance(F.col("char_hist"), F.col("ref_chars")))
    word = F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("word_hist"), F.col("ref_words")))
    char_d, word_d = F.coalesce("char_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    verdict = (char_d <= MAX_CHAR_DISTANCE) & (word_d <= MAX_WORD_DISTANCE) & (char_d + word_d <= MAX_SUM)
    return (
        held.withColumn("char_distance", char)
        .withColumn("word_distance", word)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), "char_distance", "word_distance")
    )
