"""Quality flags of converted texts: reasons in a fixed order, each with the measured value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, filled_chars, garbled_chars, split_lines, strip


@dataclass(frozen=True)
class Thresholds:
    min_chars: int = 20
    min_chars_per_page: int = 50
    garbled_ratio: float = 0.02
    repeat_count: int = 30
    repeat_length: int = 10
    min_confidence: float = 0.6
    disagreement_ratio: float = 0.1


def top_repeat(text: Column, longer_than: int = 10) -> Column:
    """How often the most frequent stripped line of more than that length occurs.

    Lines are sorted, so equal ones form runs; a run's length is the distance between its first and the next run's.
    """
    lines = F.sort_array(F.filter(F.transform(split_lines(text), lambda x: strip(x)), lambda x: F.length(x) > longer_than))
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, f: F.array_max(F.transform(f, lambda x, i: F.coalesce(F.get(f, i + 1), F.size(s)) - x))
    return bind(lines, lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(bind(first(s), lambda f: runs(s, f))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds filled, garbled and repeats."""
    return docs.withColumn("filled", filled_chars(F.col(text))).withColumn("garbled", garbled_chars(F.col(text))).withColumn("repeats", top_repeat(F.col(text)))


def reasons(docs: DataFrame, text: str = "text", pages: str | None = None, confidences: str | None = None, limits: Thresholds = Thresholds()) -> DataFrame:
    """docs with an array of reasons: near-empty, per page, garbled, repetition, confidence."""
    m = measure(docs, text)
    ratio = F.col("garbled") / F.nullif(F.col("filled"), F.lit(0))
    rules = [F.when(F.col("filled") < limits.min_chars, F.format_string("near-empty output (%d chars)", "filled"))]
    if pages:
        per_page = F.floor(F.col("filled") / F.col(pages))
        rules.append(F.when((F.col(pages) >= 2) & (per_page < limits.min_chars_per_page), F.format_string("avg %d chars/page over %d pages", per_page, F.col(pages))))
    rules.append(F.when(ratio > limits.garbled_ratio, F.format_string("garbled-char ratio %.1f%%", ratio * 100)))
    rules.append(F.when(F.col("repeats") > limits.repeat_count, F.format_string("line repeated %dx (possible OCR loop)", "repeats")))
    if confidences:
        low = F.filter(confidences, lambda x: x < limits.min_confidence)
        rules.append(F.when(F.size(low) > 0, F.format_string("%d low-confidence regions, min %.2f", F.size(low), F.array_min(confidences))))
    return m.withColumn("reasons", F.array_compact(F.array(*rules))).drop("filled", "garbled", "repeats")
