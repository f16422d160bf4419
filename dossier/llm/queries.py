"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, bpe, decontaminate, divergence, jaccard, kdtree, linecrf, mixing, pii, quality, runs, suffixes, warc
from .shared import documents, let


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.roundtrip(pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), n=4, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir)).drop("char_distance", "word_distance")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def op6_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kdtree.shard(documents(spark, sf_dir), leaves=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir), window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), outputs="digests")


def _fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(_fold(7) == 2, F.lit(False))
    found = attention.score(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    chain = linecrf.train(docs.where(~held_out), labels.where(~held_out))
    return linecrf.score(docs, chain).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir), min_documents=30, top_terms=50)


def _with_tails(docs: DataFrame) -> DataFrame:
    """Documents in which one in ten has a periodic tail, as the id's checksum says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def tail(w):
        n, a = F.size(w).cast("bigint"), F.pmod(g, F.size(w).cast("bigint"))
        return let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), lambda x: F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))))

    changed = let(words, lambda w: F.when(F.size(w) > 0, F.array_join(tail(w), " ")).otherwise(F.lit("")))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.detect(_with_tails(documents(spark, sf_dir)), min_length=24, min_periods=3)
    # lengths over periods are compared by cross products, so that no rounding makes ties
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda held, x: F.when(better(x, held), x).otherwise(held))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), max_epochs=3).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_kd_tree": op6_kd_tree,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_mixing": op13_mixing,
}

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d"""

_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
t AS (SELECT rep, n, unnest(s) AS token FROM c),
o AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM t a JOIN t b ON a.token = b.token AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * shared >= 85 * (na + nb - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
k AS (SELECT rep, least(rep, coalesce(min(other), rep)) AS component_id FROM c LEFT JOIN r ON r.node = rep GROUP BY rep)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, doc_id) AS component_id FROM s LEFT JOIN c ON c.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN k ON k.rep = c.rep"""

_OCCURS = ", ".join(f"(strlen(spaced) - strlen(replace(spaced, ' {w} ', ''))) / {len(w) + 2}" for w in quality.COMMON_WORDS)
_HALVES = "list_sum(list_transform(range(1, len({p}) + 1), lambda i: (CASE WHEN {p}[i] > 0 THEN {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) ELSE 0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2(2 * {q}[i] / ({p}[i] + {q}[i])) ELSE 0 END) / 2))"
_SHARES = "list_transform({h}, lambda x: CASE WHEN list_sum({h}) > 0 THEN x / list_sum({h}) ELSE 0 END)"
_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS k FROM d WHERE len(w) > 2)),
x AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
c AS (SELECT d.*, coalesce(x.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_dup_lines, regexp_replace(t, '\\p{{Ll}}+', '', 'g') AS rest, ' ' || regexp_replace(lower(t), '[^\\p{{L}}]+', '  ', 'g') || ' ' AS spaced FROM d LEFT JOIN x USING (r) LEFT JOIN l USING (r)),
m AS (SELECT *, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(rest) AS h1, length(rest) - length(regexp_replace(rest, '\\p{{L}}+', '', 'g')) AS h2, length(rest) - length(regexp_replace(rest, '\\p{{N}}+', '', 'g')) AS h3,
 length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) AS h4, length(rest) - length(regexp_replace(rest, '[.,;:?''"()-]+', '', 'g')) AS h5, [{_OCCURS}] AS k FROM c),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [h1, h2, h3, h4, h5, length(rest) - h2 - h3 - h4 - h5]::DOUBLE[] AS ch, list_append(k, greatest(0, n_words - list_sum(k)))::DOUBLE[] AS wh FROM m),
s AS (SELECT *, {_SHARES.format(h="ch")} AS cs, {_SHARES.format(h="wh")} AS ws FROM f),
q AS (SELECT lang, kind, list(v ORDER BY i) AS v FROM (SELECT lang, kind, i, sum(v) AS v FROM (SELECT lang, 'c' AS kind, unnest(cs) AS v, generate_subscripts(cs, 1) AS i FROM s WHERE NOT base_failed UNION ALL SELECT lang, 'w', unnest(ws), generate_subscripts(ws, 1) FROM s WHERE NOT base_failed) GROUP BY ALL) GROUP BY lang, kind),
z AS (SELECT s.*, {_SHARES.format(h="qc.v")} AS qcs, {_SHARES.format(h="qw.v")} AS qws FROM s LEFT JOIN q qc ON qc.lang IS NOT DISTINCT FROM s.lang AND qc.kind = 'c' LEFT JOIN q qw ON qw.lang IS NOT DISTINCT FROM s.lang AND qw.kind = 'w'),
y AS (SELECT *, coalesce(CASE WHEN length(t) >= {quality.MIN_CHARS} THEN sqrt(greatest(0, {_HALVES.format(p="cs", q="qcs")})) END, 0) AS cd, coalesce(CASE WHEN n_words >= {quality.MIN_WORDS} THEN sqrt(greatest(0, {_HALVES.format(p="ws", q="qws")})) END, 0) AS wd FROM z)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND cd <= {quality.MAX_CHAR_DISTANCE} AND wd <= {quality.MAX_WORD_DISTANCE} AND cd + wd <= {quality.MAX_SUM} AS kept FROM y"""

_LEAKS = f"""
WITH f AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM f WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
v AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT v.doc_id, v.n, v.p, i.item_id FROM v JOIN i ON v.n = i.n AND v.k = i.k),
x AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM h)) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""

_REPEATS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, p, sha256(array_to_string(w[p : p + 12], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS p FROM w WHERE len(w) >= 13)),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first_id FROM v) WHERE doc_id > first_id),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY t.p) FILTER (g.p IS NULL) AS kept FROM t LEFT JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_DIVERGENCE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS m FROM documents),
x AS (SELECT r, lang, source, unnest(m) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
 FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o) WHERE part = 'pair' OR rank <= 50"""

_MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, CAST('0x' || substr(md5('0:' || doc_id), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER o AS k, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(3 * source_size) OVER o AS BIGINT) - 3 * source_size AS clamped, CAST(sum(weight) OVER () - sum(weight) OVER o AS BIGINT) + weight AS open_weight
 FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT coalesce(arg_min((total - clamped)::DOUBLE / open_weight, k) FILTER (3 * source_size > weight * ((total - clamped)::DOUBLE / open_weight)), 0) AS level FROM r),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * level) AS target FROM s, f),
w AS (SELECT *, CAST(floor(coalesce(target / nullif(source_size, 0), 0)) AS BIGINT) AS whole FROM t),
u AS (SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, CAST(round(w.target - w.whole * w.source_size) AS BIGINT) AS rest, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) AS BIGINT) AS upto
 FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, rest - upto + size)) AS taken FROM u"""

#: The others have a method that SQL cannot express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": _WARC,
    "op3_ngram_jaccard_join": _JACCARD,
    "op4_quality_rules": _QUALITY,
    "op5_benchmark_decontamination": _LEAKS,
    "op7_substring_dedup": _REPEATS,
    "op11_source_divergence": _DIVERGENCE,
    "op13_mixing": _MIX,
}
