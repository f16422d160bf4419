"""Queries over whole documents: retrieval, quality and conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import filled_chars, ocr_norm
from ..operators import convert, quality, retrieval, store

QUERY = "the and of quarterly 555"
K = 50


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    """Documents as chunks: one chunk each, the source a folder."""
    return table(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), "text")


def _bm25_sql(where: str = "") -> str:
    return f"""
WITH t AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS tok FROM documents),
c AS (SELECT doc_id, source, len(tok) AS dl, q.term, len(list_filter(tok, lambda x: x = q.term)) AS tf
      FROM t, (SELECT unnest(['555','and','of','quarterly','the']) AS term) q),
s AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM t),
f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM c GROUP BY term),
r AS (SELECT c.source, c.doc_id AS ord, sum(ln(1 + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * c.tf * 2.2::DOUBLE / (c.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * c.dl / s.avgdl))) AS score
      FROM c JOIN f USING (term), s WHERE c.tf > 0 {where} GROUP BY c.source, c.doc_id)
SELECT source, ord, round(score, 4) AS score FROM r ORDER BY round(score, 4) DESC, source, ord LIMIT {K}"""


def bm25_topk(spark, d):
    return retrieval.text_search(_docs(spark, d), QUERY, K).select("source", "ord", "score")


_indexes: dict[tuple[str, str], str] = {}


def bm25_index_topk(spark, d):
    """The same as bm25_topk from stored postings, which are built once a session and folder."""
    from uuid import uuid4

    from ..operators import postings
    from ..sources.scratch import folder

    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        path = f"{folder(spark)}/postings-{uuid4().hex}"
        postings.build(_docs(spark, d), path)
        _indexes[key] = path
    return postings.search(spark, _indexes[key], QUERY, K).select("source", "ord", "score")


def bm25_prefix_topk(spark, d):
    return retrieval.text_search(_docs(spark, d), QUERY, K, prefix="src1").select("source", "ord", "score")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


def _query_vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first().embedding]


def cosine_topk(spark, d):
    return retrieval.vector_search(_vectors(spark, d), _query_vector(spark, d), K, ("vec_id",)).select("vec_id", "score")


def cosine_floor(spark, d):
    return retrieval.vector_search(_vectors(spark, d), _query_vector(spark, d), 200, ("vec_id",), floor=0.2).select("vec_id", "score")


def cosine_knn_label_vote(spark, d):
    return retrieval.vector_search(_vectors(spark, d), _query_vector(spark, d), K, ("vec_id",)).groupBy("label").agg(F.count("*").alias("votes"), F.round(F.avg("score"), 4).alias("mean_score"))


COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4)"


def _length_chunks(spark, d):
    """A deterministic embedder for tests: [length, 1, 0]."""
    return _docs(spark, d).withColumn("vector", F.array(F.length("text").cast("double"), F.lit(1.0), F.lit(0.0)))


FAKE = [300.0, 1.0, 0.0]
_FAKE_SQL = "round((length(text) * 300.0::DOUBLE + 1) / (sqrt(length(text)::DOUBLE * length(text) + 1) * sqrt(90001.0::DOUBLE)), 4)"


def fake_embed_search(spark, d):
    return retrieval.vector_search(_length_chunks(spark, d), FAKE, K).select("source", "ord", "score")


_FAKE_TOP = f"SELECT source, doc_id AS ord, {_FAKE_SQL} AS score FROM documents ORDER BY score DESC, source, ord LIMIT {K}"


def rrf_hybrid_topk(spark, d):
    return retrieval.hybrid_search(_length_chunks(spark, d), QUERY, FAKE, 20).select("source", "ord", "score", "score_kind")


def rrf_floor_keyword_survives(spark, d):
    return retrieval.hybrid_search(_length_chunks(spark, d), QUERY, FAKE, 20, floor=0.99999).select("source", "ord", "score", "score_kind")


def _rrf_sql(floor: str = "") -> str:
    return f"""
WITH v AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, ord) - 1 AS rk FROM ({_FAKE_TOP}) {floor}),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, ord) - 1 AS rk FROM ({_bm25_sql()})),
u AS (SELECT source, ord, rk, 0 AS ch FROM v UNION ALL SELECT source, ord, rk, 1 FROM t),
g AS (SELECT source, ord, sum(1.0::DOUBLE / (60 + rk)) AS raw, min(rk) FILTER (ch = 0) AS vr, min(rk) FILTER (ch = 1) AS tr FROM u GROUP BY source, ord)
SELECT source, ord, round(raw, 6) AS score, 'rrf' AS score_kind FROM g ORDER BY raw DESC, vr ASC NULLS LAST, tr ASC NULLS LAST LIMIT 20"""


# --- quality
def quality_near_empty(spark, d):
    return table(spark, d, "documents").withColumn("filled", filled_chars(F.col("text")).cast("bigint")).where("filled < 20").select("doc_id", "filled")


def quality_garbled(spark, d):
    m = quality.measure(table(spark, d, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("�"), 40)).otherwise(F.lit(""))).alias("text")))
    return m.where(F.col("garbled") / F.nullif(F.col("filled"), F.lit(0)) > 0.02).select("doc_id", F.col("filled").cast("bigint").alias("filled"), F.col("garbled").cast("bigint").alias("garbled"))


_GARBLED = "length(regexp_replace(t, '[\\s\\p{L}\\p{N}!-/:-@\\[-`{-~，。、；：？！“”‘’（）《》【】〈〉「」『』…—–·～％]+', '', 'g'))"


def quality_repeat(spark, d):
    return table(spark, d, "documents").withColumn("repeats", quality.top_repeat(F.col("text")).cast("bigint")).where("repeats > 2").select("doc_id", "repeats")


_REPEAT = "SELECT doc_id, max(n) AS repeats FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) WHERE length(l) > 10 GROUP BY doc_id, l) GROUP BY doc_id"


def quality_reasons(spark, d):
    docs = table(spark, d, "documents").withColumn("pages", (F.col("doc_id") % 40).cast("int"))
    return quality.reasons(docs, pages="pages").where(F.size("reasons") > 0).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


_REASONS = f"""
WITH r AS ({_REPEAT}),
m AS (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS filled, doc_id % 40 AS pages, coalesce(r.repeats, 0) AS repeats FROM documents LEFT JOIN r USING (doc_id))
SELECT doc_id, concat_ws('; ', CASE WHEN filled < 20 THEN format('near-empty output ({{}} chars)', filled) END,
 CASE WHEN pages >= 2 AND filled // pages < 50 THEN format('avg {{}} chars/page over {{}} pages', filled // pages, pages) END,
 CASE WHEN repeats > 30 THEN format('line repeated {{}}x (possible OCR loop)', repeats) END) AS reasons FROM m
WHERE filled < 20 OR (pages >= 2 AND filled // pages < 50) OR repeats > 30"""


def quality_vs_labels(spark, d):
    flagged = quality.measure(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", ((F.col("filled") < 20) | (F.col("repeats") > 4)).alias("flag"))
    both = flagged.join(table(spark, d, "labels"), "doc_id")
    bad = F.col("quality") == 0
    return both.agg(F.count_if(bad).alias("bad"), F.count_if(bad & F.col("flag")).alias("found"), F.count_if(~bad & F.col("flag")).alias("false_alarms"), F.count("*").alias("labelled"))


def low_confidence_regions(spark, d):
    scores = F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.55)
    low = F.filter(scores, lambda x: x < 0.6)
    return table(spark, d, "embeddings").select("vec_id", F.size(low).cast("bigint").alias("regions"), F.round(F.array_min(scores), 4).alias("least")).where("regions > 0")


def chars_per_page(spark, d):
    pages = (F.col("doc_id") % 40).cast("int")
    per = F.floor(filled_chars(F.col("text")) / pages)
    return table(spark, d, "documents").where(pages >= 2).select("doc_id", per.cast("bigint").alias("per_page")).where("per_page < 50")


def content_hash_dups(spark, d):
    return table(spark, d, "documents").groupBy(convert.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _pair_sql(left: str) -> str:
    return f"SELECT a.doc_id, {left} FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"


def _pairs(spark, d):
    """Each document beside the next one by id."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.withColumnRenamed("text", "a").join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")


def digit_mismatch(spark, d):
    return _pairs(spark, d).select("doc_id", convert.digit_mismatches(F.col("a"), F.col("b")).cast("bigint").alias("mismatches")).where("mismatches > 0")


_MISMATCH = """
WITH p AS (SELECT a.doc_id, regexp_extract_all(a.text, '[0-9]+(?:年|月|日)?') AS x, regexp_extract_all(b.text, '[0-9]+(?:年|月|日)?') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, abs(len(x) - len(y)) + len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i])) AS mismatches FROM p
WHERE abs(len(x) - len(y)) + len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i])) > 0"""


def ocr_normalize(spark, d):
    wide = F.concat(F.lit("（"), F.translate("text", "0123456789,", "０１２３４５６７８９，"), F.lit("）"))
    return table(spark, d, "documents").select("doc_id", F.md5(ocr_norm(wide)).alias("normal"))


def disagreement_ratio(spark, d):
    return convert.cross_check(_pairs(spark, d)).select("doc_id", "ratio", F.col("digits").cast("bigint").alias("digits"))


def route_by_extension(spark, d):
    names = ["a.pdf", "b.DOC", "c.png", "d.md", "e.bin", "f.html"]
    path = F.concat("url", F.lit("/"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 6 + 1).cast("int")))
    pages = table(spark, d, "pages").select("page_id", convert.route(path, F.length("html") / 50.0).alias("route"))
    return pages.groupBy("route").agg(F.count("*").alias("files"))


def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", convert.html_text("html").alias("text"))


#: For pages whose tags are closed on the spot and whose entities are those below.
_HTML = """
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<h1[^>]*>', chr(10) || '# ', 'g'), '<h2[^>]*>', chr(10) || '## ', 'g'), '<li[^>]*>', chr(10) || '- ', 'g'), '</?(p|div|article|section|br|li|ul|ol|nav|footer|header|table|tr|title|h[1-6])( [^>]*)?/?>', chr(10), 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>') AS t FROM b),
d AS (SELECT page_id, list_transform(string_split(regexp_replace(t, '&amp;?', '&', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))) AS l FROM c)
SELECT page_id, array_to_string(list_filter(l, lambda x: x NOT IN ('', '-', '#')), chr(10)) AS text FROM d"""


def image_markers(spark, d):
    text = F.concat(F.lit("!["), F.lit("alt"), F.lit("](img/"), F.col("page_id").cast("string"), F.lit(".png) <IMG src='x/y.gif'> "), "url")
    return table(spark, d, "pages").select("page_id", convert.image_count(text).cast("bigint").alias("images"), convert.mark_images(text).alias("marked"))


def name_collisions(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), (F.col("doc_id") % 300).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".docx").otherwise(".txt")).alias("path"))
    return convert.output_names(files).select("doc_id", "output")


def outcome_report(spark, d):
    docs = quality.reasons(table(spark, d, "documents"))
    kind = F.when(F.col("doc_id") % 11 == 0, "unsupported").otherwise("native")
    error = F.when(F.col("doc_id") % 13 == 0, "ValueError: bad").when(F.col("doc_id") % 17 == 0, "unavailable: no converter")
    return convert.report(docs.select(convert.outcome(kind, F.col("doc_id") % 5 == 0, error, F.col("reasons")).alias("status")))


_OUTCOME = f"""
WITH r AS ({_REPEAT}), m AS (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) < 20 OR coalesce(r.repeats, 0) > 30 AS warned FROM documents LEFT JOIN r USING (doc_id)),
s AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'skipped_existing' WHEN doc_id % 11 = 0 THEN 'skipped_unsupported' WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 17 = 0 THEN 'skipped_unsupported' WHEN warned THEN 'warned' ELSE 'succeeded' END AS status FROM m)
SELECT {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in convert.STATUSES)}, count(*) AS files FROM s"""


def skip_existing(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("rel"), F.lit(100).alias("modified"), convert.content_hash(F.col("text")).alias("hash"), "doc_id")
    made = docs.where("doc_id % 3 <> 0").select("rel", (F.lit(90) + F.col("doc_id") % 20).alias("modified"), F.when(F.col("doc_id") % 4 == 0, "stale").when(F.col("doc_id") % 4 == 1, F.col("hash")).alias("source_hash"))
    return convert.up_to_date(docs, made).groupBy("current").agg(F.count("*").alias("files"))


# --- store
def manifest_counts(spark, d):
    return store.manifest(_docs(spark, d))


def manifest_drift(spark, d):
    docs = _docs(spark, d)
    recorded = store.manifest(docs.where("ord % 10 <> 3 AND source <> 'src2'"))
    return store.drift(recorded, store.manifest(docs.where("source <> 'src3'")))


def upsert_source(spark, d):
    docs = _docs(spark, d)
    fresh = docs.where("source IN ('src1', 'src4') AND ord % 2 = 0").select("source", "ord", F.concat(F.lit("new "), "text").alias("text"))
    return store.upsert(docs, fresh).select("source", "ord", F.md5("text").alias("hash"))


def doctor_report(spark, d):
    docs = _docs(spark, d)
    return store.doctor(store.manifest(docs.where("source <> 'src2'")), docs)


CATALOGUE = {
    "bm25_topk": (bm25_topk, _bm25_sql()),
    "bm25_index_topk": (bm25_index_topk, _bm25_sql()),
    "bm25_prefix_topk": (bm25_prefix_topk, _bm25_sql("AND starts_with(c.source, 'src1')")),
    "cosine_topk": (cosine_topk, f"SELECT vec_id, {COSINE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {K}"),
    "cosine_floor": (cosine_floor, f"SELECT * FROM (SELECT vec_id, {COSINE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 200) WHERE score >= 0.2"),
    "cosine_knn_label_vote": (cosine_knn_label_vote, f"SELECT label, count(*) AS votes, round(avg(score), 4) AS mean_score FROM (SELECT vec_id, label, {COSINE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {K}) GROUP BY label"),
    "fake_embed_search": (fake_embed_search, _FAKE_TOP),
    "rrf_hybrid_topk": (rrf_hybrid_topk, _rrf_sql()),
    "rrf_floor_keyword_survives": (rrf_floor_keyword_survives, _rrf_sql("WHERE score >= 0.99999")),
    "quality_near_empty": (quality_near_empty, "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS filled FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) < 20"),
    "quality_garbled": (quality_garbled, f"WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN repeat(chr(65533), 40) ELSE '' END AS t FROM documents), m AS (SELECT doc_id, length(regexp_replace(t, '\\s', '', 'g')) AS filled, {_GARBLED} AS garbled FROM t) SELECT * FROM m WHERE garbled > 0.02 * filled"),
    "quality_repeat": (quality_repeat, f"SELECT * FROM ({_REPEAT}) WHERE repeats > 2"),
    "quality_reasons": (quality_reasons, _REASONS.replace("{{", "{").replace("}}", "}")),
    "quality_vs_labels": (quality_vs_labels, f"WITH r AS ({_REPEAT}), m AS (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) < 20 OR coalesce(r.repeats, 0) > 4 AS flag FROM documents LEFT JOIN r USING (doc_id)) SELECT count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 0 AND flag) AS found, count(*) FILTER (quality <> 0 AND flag) AS false_alarms, count(*) AS labelled FROM m JOIN labels USING (doc_id)"),
    "low_confidence_regions": (low_confidence_regions, "SELECT * FROM (SELECT vec_id, len(list_filter(embedding, lambda x: abs(x::DOUBLE) + 0.55::DOUBLE < 0.6::DOUBLE)) AS regions, round(list_min(list_transform(embedding, lambda x: abs(x::DOUBLE) + 0.55::DOUBLE)), 4) AS least FROM embeddings) WHERE regions > 0"),
    "chars_per_page": (chars_per_page, "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) // (doc_id % 40) AS per_page FROM documents WHERE doc_id % 40 >= 2 AND length(regexp_replace(text, '\\s', '', 'g')) // (doc_id % 40) < 50"),
    "content_hash_dups": (content_hash_dups, "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "digit_mismatch": (digit_mismatch, _MISMATCH),
    "ocr_normalize": (ocr_normalize, "SELECT doc_id, md5('(' || regexp_replace(regexp_replace(regexp_replace(text, '([0-9]),([0-9]{3})\\b', '\\1\\2', 'g'), '([0-9]),([0-9]{3})\\b', '\\1\\2', 'g'), '\\s', '', 'g') || ')') AS normal FROM documents"),
    "disagreement_ratio": (disagreement_ratio, None),
    "route_by_extension": (route_by_extension, "SELECT CASE page_id % 6 WHEN 0 THEN CASE WHEN length(html) / 50.0 >= 50 THEN 'native' ELSE 'ocr' END WHEN 1 THEN 'legacy' WHEN 2 THEN 'ocr' WHEN 4 THEN 'unsupported' ELSE 'native' END AS route, count(*) AS files FROM pages GROUP BY 1"),
    "html_to_text": (html_to_text, _HTML),
    "image_markers": (image_markers, "SELECT page_id, 2 AS images, '〔图像：' || page_id || '.png —— 已省略未保留，请查原件〕 〔图像：y.gif —— 已省略未保留，请查原件〕 ' || url AS marked FROM pages"),
    "name_collisions": (name_collisions, "WITH f AS (SELECT doc_id, source || '/' || (doc_id % 300) AS stem, CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '.txt' END AS ext FROM documents) SELECT doc_id, stem || CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN ext ELSE '' END || '.md' AS output FROM f"),
    "outcome_report": (outcome_report, _OUTCOME),
    "skip_existing": (skip_existing, "SELECT doc_id % 3 <> 0 AND 90 + doc_id % 20 >= 100 AND doc_id % 4 <> 0 AS current, count(*) AS files FROM documents GROUP BY 1"),
    "manifest_counts": (manifest_counts, "SELECT source, count(*) AS chunks FROM documents GROUP BY source"),
    "manifest_drift": (manifest_drift, "WITH r AS (SELECT source, count(*) AS recorded FROM documents WHERE doc_id % 10 <> 3 AND source <> 'src2' GROUP BY 1), a AS (SELECT source, count(*) AS actual FROM documents WHERE source <> 'src3' GROUP BY 1) SELECT source, recorded, actual FROM r FULL JOIN a USING (source) WHERE recorded IS DISTINCT FROM actual"),
    "upsert_source": (upsert_source, "SELECT source, doc_id AS ord, md5(text) AS hash FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source IN ('src1', 'src4') AND doc_id % 2 = 0) UNION ALL SELECT source, doc_id, md5('new ' || text) FROM documents WHERE source IN ('src1', 'src4') AND doc_id % 2 = 0"),
    "doctor_report": (doctor_report, "WITH r AS (SELECT source, count(*) AS r FROM documents WHERE source <> 'src2' GROUP BY 1), a AS (SELECT source, count(*) AS a FROM documents GROUP BY 1) SELECT bool_and(r IS NOT DISTINCT FROM a) AS in_sync, count(r) AS recorded_sources, sum(r)::BIGINT AS recorded_chunks, count(a) AS actual_sources, sum(a)::BIGINT AS actual_chunks FROM r FULL JOIN a USING (source)"),
}
