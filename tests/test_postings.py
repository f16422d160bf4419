"""Postings are counted where their chunks are."""

import re
from collections import Counter

from pyspark.sql import functions as F

from dossier.functions.text import tokens
from dossier.operators import postings


def test_postings_are_counted_in_their_rows(spark, monkeypatch):
    monkeypatch.setattr(postings, "TOKENS", 5)
    texts = ["a b a", None, "", "B c d e f g h b", "x", "x x x", "  "]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, ord int, text string").coalesce(1)
    counted = rows.select("source", "ord", tokens(F.col("text")).alias("_t")).withColumn("dl", F.size("_t"))
    found = postings.posted(counted, ("source", "ord"))
    assert "Exchange" not in found._jdf.queryExecution().toString()
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    assert sorted((r.ord, r.term, r.tf, r.dl) for r in found.collect()) == sorted((i, w, n, len(ws)) for i, ws in enumerate(words) for w, n in Counter(ws).items())
