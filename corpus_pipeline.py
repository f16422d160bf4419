"""A training-corpus pipeline of five operators, one stage each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm import bpe, decontaminate, jaccard, pii, quality
from dossier.llm.queries import vocabulary
from dossier.llm.shared import store

#: Near duplicates: five-word shingles, similarity of 0.8 or more. Benchmarks: ten words in a row.
SHINGLE, PERCENT, WINDOW = 5, 80, 10


def _row(docs: DataFrame) -> str:
    """A name that no column of docs has."""
    return "row_key_" + "_".join(sorted(docs.columns))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of id and text: a decision is made for each different row, and equal rows share it."""
    return docs.withColumn(_row(docs), F.xxhash64("doc_id", "text"))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs with a key in keys (key)."""
    return _keyed(docs).join(keys.withColumnRenamed("key", _row(docs)), _row(docs), "left_semi").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and do not diverge from their language.

    Null and empty texts fail the base rules, so they go; a null doc_id, lang
    or source is no reason to go.  Repeated rows are kept or dropped alike and
    stay repeated.  An empty table stays empty; further columns are kept.
    """
    key = _row(docs)
    judged = quality.assess(_keyed(docs).select(F.col(key).alias("doc_id"), "text", "lang"))
    return _only(docs, judged.where("kept").select(F.col("doc_id").alias("key")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id.

    Null texts and texts without words are copies of nothing and all stay.
    Rows repeated under the id that stays, words and all, become one.  Rows
    with a null doc_id stay unless they copy a document with one.  An empty
    table stays empty; further columns are kept.
    """
    labels = jaccard.join(docs, SHINGLE, PERCENT)
    first = labels.where((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    key = _row(docs)
    at, null = f"{key}_at", f"{key}_null"  # never null, so that texts are shuffled once, for the join and the repeated rows alike
    by_id = lambda rows, column: rows.withColumns({at: F.coalesce(column, F.lit(0)), null: F.col(column).isNull()})
    left = by_id(_keyed(docs), "doc_id").join(by_id(first, "stays"), [at, null], "left_semi")
    nth = F.row_number().over(Window.partitionBy(at, null, key).orderBy(key))
    filled = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return left.withColumn("nth_" + key, nth).where((F.col("nth_" + key) == 1) | ~filled).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts have none and stay; repeated rows go or stay alike.
    Without benchmark items all stay.  Further columns are kept.
    """
    key = _row(docs)
    found = decontaminate.report(_keyed(docs).select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW)
    return _only(docs, found.where(~F.col("contaminated")).select(F.col("doc_id").alias("key")))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew; null texts stay null, all rows and columns stay."""
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of all documents; a null text has no ids and an empty decoded text, repeated rows come as often."""
    return bpe.encode(docs, vocabulary("word_bpe_49k.json"), outputs="ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("private_data", private_data),
    ("encoding", encoding),
]

#: SQL cannot express the CRF, the tree concatenation and the divergence references in one statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
