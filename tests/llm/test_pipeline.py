"""The pipeline's stages on the smallest table."""

import re

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    extra = spark.createDataFrame([(10**6, None, "en", "s", None), (10**6 + 1, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra).persist()
    columns, n = docs.columns, docs.count()
    stage = dict(P.STAGES)
    assert list(stage) == ["quality_rules", "near_duplicates", "benchmark_decontamination", "private_data", "encoding"]
    kept = stage["quality_rules"](spark, docs, SF)
    assert kept.columns == columns and 0 < kept.count() < n
    twice = docs.unionByName(docs.where("doc_id < 5"))
    single = stage["near_duplicates"](spark, twice, SF)
    assert single.columns == columns and single.where("doc_id < 5").count() <= 5 and single.where("doc_id >= 1000000").count() == 2
    clean = stage["benchmark_decontamination"](spark, docs, SF)
    assert clean.columns == columns and 0 < clean.count() <= n
    masked = stage["private_data"](spark, docs, SF)
    assert masked.columns == columns and masked.count() == n
    assert stage["encoding"](spark, docs, SF).count() == n


def test_near_duplicates_shuffles_texts_once(spark):
    body = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, body), (1, body), (2, body), (3, None), (3, None), (None, " "), (None, " "), (None, "alone"), (None, "alone"), (4, "\n"), (4, "\n"), (5, "one"), (5, "two"), (5, "two")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.near_duplicates(spark, docs, SF)
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([(1, body), (3, ""), (3, ""), (0, " "), (0, " "), (0, "alone"), (4, "\n"), (5, "one"), (5, "two")])
    shuffles = re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan)
    assert shuffles and sum("text#" in columns for columns in shuffles) == 1
