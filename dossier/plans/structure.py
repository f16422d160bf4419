"""Queries over the structure of texts: sections, chunks, tables, headings and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, convert, graph, retrieval
from .documents import FAKE, K, QUERY, table

#: The tables have no Markdown headings: every fourth line gets one, and every eighth one of a lower level.
_MARK_SQL = "CASE WHEN (i - 1) % 8 = 4 THEN '### ' WHEN (i - 1) % 4 = 0 THEN '## ' ELSE '' END || l"


def marked(spark, d):
    line = lambda x, i: F.concat(F.when(i % 8 == 4, "### ").when(i % 4 == 0, "## ").otherwise(""), x)
    return table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"


def chunk_sections(spark, d):
    s = chunking.sections(marked(spark, d))
    return s.select("source", F.col("sec_ord").cast("bigint").alias("sec_ord"), F.md5("heading_path").alias("path"), F.md5("body").alias("body"))


#: What stripping takes away, for DuckDB's trim.
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(12288)"
_SECTIONS = f"""
WITH l AS ({_LINES}),
m AS (SELECT doc_id, i, l, CASE WHEN (i - 1) % 8 = 4 THEN 3 WHEN (i - 1) % 4 = 0 THEN 2 END AS lev0 FROM l),
h AS (SELECT doc_id, i, l, CASE WHEN lev0 IS NOT NULL AND trim(l) <> '' THEN lev0 END AS lev, {_MARK_SQL} AS raw FROM m),
s AS (SELECT *, count(lev) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
t AS (SELECT doc_id, sec, max(lev) AS lev, regexp_replace(max(trim(l)) FILTER (lev IS NOT NULL), '\\s*#*\\s*$', '') AS title, trim(string_agg(raw, chr(10) ORDER BY i) FILTER (lev IS NULL), {_BLANK}) AS body FROM s GROUP BY doc_id, sec),
p AS (SELECT *, last_value(CASE WHEN lev = 2 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec) AS up FROM t WHERE sec > 0)
SELECT doc_id AS source, sec - 1 AS sec_ord, md5(CASE WHEN lev = 2 OR up IS NULL THEN title ELSE up || ' > ' || title END) AS path, md5(coalesce(body, '')) AS body FROM p
UNION ALL SELECT doc_id, 0, md5(''), md5(coalesce(body, '')) FROM t WHERE sec = 0 AND doc_id NOT IN (SELECT doc_id FROM p)"""


def _line_units(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").select("doc_id", lines.alias("u"))


def chunk_pack_lines(spark, d):
    packed = chunking.pack(F.col("u"), 120, 0, glue="\n")
    return _line_units(spark, d).select("doc_id", F.posexplode(packed).alias("ord", "c")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.md5("c").alias("chunk"))


_PACK = """
WITH RECURSIVE l AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, greatest(1, (length(l) + 3) // 4) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l) <> ''),
p AS (SELECT doc_id, k, 0 AS ord, n AS held FROM l WHERE k = 1
  UNION ALL SELECT l.doc_id, l.k, CASE WHEN p.held + l.n > 120 THEN p.ord + 1 ELSE p.ord END, CASE WHEN p.held + l.n > 120 THEN l.n ELSE p.held + l.n END FROM p JOIN l ON l.doc_id = p.doc_id AND l.k = p.k + 1)
SELECT doc_id, ord, md5(string_agg(l, chr(10) ORDER BY k)) AS chunk FROM p JOIN l USING (doc_id, k) GROUP BY doc_id, ord"""


def chunk_pack_overlap(spark, d):
    packed = chunking.pack(F.col("u"), 120, 40, glue="\n")
    return _line_units(spark, d).select("doc_id", F.posexplode(packed).alias("ord", "chunk"))


#: A chunk is a stretch of units from s on; base is what the units before s sum to, j the first unit of the longest tail within the overlap.
_PACK_OVERLAP = """
WITH RECURSIVE l AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, greatest(1, (length(l) + 3) // 4) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l) <> ''),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS upto FROM l),
t AS (SELECT a.doc_id, a.k, a.upto, coalesce(min(b.k), a.k + 1) AS j, coalesce(min(b.upto - b.n), a.upto) AS j_base FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id AND b.k BETWEEN a.k - 40 AND a.k AND a.upto - b.upto + b.n <= 40 GROUP BY a.doc_id, a.k, a.upto),
p AS (SELECT doc_id, k, 0 AS ord, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS base, j, j_base FROM t WHERE k = 1
  UNION ALL SELECT t.doc_id, t.k, CASE WHEN t.upto - p.base > 120 THEN p.ord + 1 ELSE p.ord END, CASE WHEN t.upto - p.base > 120 THEN greatest(p.s, p.j) ELSE p.s END, CASE WHEN t.upto - p.base > 120 THEN greatest(p.base, p.j_base) ELSE p.base END, t.j, t.j_base FROM p JOIN t ON t.doc_id = p.doc_id AND t.k = p.k + 1),
e AS (SELECT doc_id, ord, min(s) AS s, max(k) AS k FROM p GROUP BY doc_id, ord)
SELECT e.doc_id, e.ord, string_agg(c.l, chr(10) ORDER BY c.k) AS chunk FROM e JOIN c ON c.doc_id = e.doc_id AND c.k BETWEEN e.s AND e.k GROUP BY e.doc_id, e.ord"""


def chunk_hard_split(spark, d):
    pieces = F.posexplode(chunking.hard_split(F.col("text"), 100)).alias("ord", "piece")
    return table(spark, d, "documents").select("doc_id", pieces).select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.md5("piece").alias("piece"))


_HARD = """
WITH s AS (SELECT doc_id, text, CASE WHEN greatest(1, (length(text) + 3) // 4) <= 100 THEN length(text) ELSE CAST(ceil(length(text)::DOUBLE / ceil(greatest(1, (length(text) + 3) // 4)::DOUBLE / 100)) AS BIGINT) END AS size FROM documents)
SELECT doc_id, i AS ord, md5(substring(text, (i * size + 1)::BIGINT, size)) AS piece FROM (SELECT *, unnest(range(0, CAST(ceil(length(text)::DOUBLE / size) AS BIGINT))) AS i FROM s WHERE size > 0)
UNION ALL SELECT doc_id, 0, md5(text) FROM s WHERE size = 0"""


def table_line_blocks(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count_if(chunking.is_table_line(F.col("l"))).alias("table_lines"), F.count_if(F.col("l").contains("|")).alias("with_pipes")).where("with_pipes > 0")


def chunks_structured(spark, d):
    c = chunking.chunk(marked(spark, d), 96, 16)
    return c.select("source", "ord", F.md5("heading_path").alias("path"), F.md5("text").alias("text"))


#: Sections by lines, blocks of table lines and of prose, paragraphs, sentences of long ones, slices, and packing with overlap inside a section.
#: Tables that outgrow a chunk are left out: no text has one.
_STRUCTURED = f"""
WITH RECURSIVE l AS ({_LINES}),
m AS (SELECT doc_id, i, l, CASE WHEN (i - 1) % 8 = 4 THEN 3 WHEN (i - 1) % 4 = 0 THEN 2 END AS lev0 FROM l),
h AS (SELECT doc_id, i, l, CASE WHEN lev0 IS NOT NULL AND trim(l) <> '' THEN lev0 END AS lev, {_MARK_SQL} AS raw FROM m),
s AS (SELECT *, count(lev) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
y AS (SELECT doc_id, sec, max(lev) AS lev, regexp_replace(max(trim(l)) FILTER (lev IS NOT NULL), '\\s*#*\\s*$', '') AS title FROM s GROUP BY doc_id, sec),
u AS (SELECT *, last_value(CASE WHEN lev = 2 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec) AS up FROM y WHERE sec > 0),
x AS (SELECT doc_id, sec, i, raw, starts_with(trim(raw), '|') OR (raw LIKE '%|%' AND regexp_full_match(trim(raw), '[|: -]+')) AS t FROM s WHERE lev IS NULL),
z AS (SELECT *, sum(CASE WHEN t = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sec ORDER BY i) AS b FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id, sec ORDER BY i) AS before FROM x)),
k AS (SELECT doc_id, sec, b, any_value(t) AS t, trim(string_agg(raw, chr(10) ORDER BY i), {_BLANK}) AS body FROM z GROUP BY doc_id, sec, b),
g AS (SELECT doc_id, sec, b, g, p FROM (SELECT doc_id, sec, b, unnest(a) AS p, generate_subscripts(a, 1) AS g FROM (SELECT doc_id, sec, b, CASE WHEN t THEN [body] ELSE list_filter(list_transform(string_split_regex(body, '\\n\\s*\\n'), lambda q: trim(q, {_BLANK})), lambda q: q <> '') END AS a FROM k WHERE body <> ''))),
v AS (SELECT doc_id, sec, b, g, unnest(a) AS p, generate_subscripts(a, 1) AS w FROM (SELECT doc_id, sec, b, g, CASE WHEN (length(p) + 3) // 4 <= 400 THEN [p] ELSE list_filter(list_transform(string_split(regexp_replace(p, '([。！？.!?])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda q: trim(q, {_BLANK})), lambda q: q <> '') END AS a FROM g)),
d AS (SELECT *, CASE WHEN greatest(1, (length(p) + 3) // 4) <= 96 THEN length(p) ELSE CAST(ceil(length(p)::DOUBLE / ceil(((length(p) + 3) // 4)::DOUBLE / 96)) AS BIGINT) END AS size FROM v),
e AS (SELECT doc_id, sec, substring(p, (r * size + 1)::BIGINT, size) AS p, row_number() OVER (PARTITION BY doc_id, sec ORDER BY b, g, w, r) AS k FROM (SELECT *, unnest(range(0, CAST(ceil(length(p)::DOUBLE / size) AS BIGINT))) AS r FROM d)),
c AS (SELECT *, greatest(1, (length(p) + 3) // 4) AS n, CAST(sum(greatest(1, (length(p) + 3) // 4)) OVER (PARTITION BY doc_id, sec ORDER BY k) AS BIGINT) AS upto FROM e),
j AS (SELECT a.doc_id, a.sec, a.k, a.upto, coalesce(min(b.k), a.k + 1) AS j, coalesce(min(b.upto - b.n), a.upto) AS j_base FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id AND b.sec = a.sec AND b.k BETWEEN a.k - 16 AND a.k AND a.upto - b.upto + b.n <= 16 GROUP BY a.doc_id, a.sec, a.k, a.upto),
q AS (SELECT doc_id, sec, k, 0 AS o, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS base, j, j_base FROM j WHERE k = 1
  UNION ALL SELECT j.doc_id, j.sec, j.k, CASE WHEN j.upto - q.base > 96 THEN q.o + 1 ELSE q.o END, CASE WHEN j.upto - q.base > 96 THEN greatest(q.s, q.j) ELSE q.s END, CASE WHEN j.upto - q.base > 96 THEN greatest(q.base, q.j_base) ELSE q.base END, j.j, j.j_base FROM q JOIN j ON j.doc_id = q.doc_id AND j.sec = q.sec AND j.k = q.k + 1),
f AS (SELECT doc_id, sec, o, min(s) AS s, max(k) AS k FROM q GROUP BY doc_id, sec, o),
t AS (SELECT f.doc_id, f.sec, f.o, string_agg(c.p, chr(10) || chr(10) ORDER BY c.k) AS chunk FROM f JOIN c ON c.doc_id = f.doc_id AND c.sec = f.sec AND c.k BETWEEN f.s AND f.k GROUP BY f.doc_id, f.sec, f.o)
SELECT t.doc_id AS source, CAST(row_number() OVER (PARTITION BY t.doc_id ORDER BY t.sec, t.o) - 1 AS INT) AS ord, md5(CASE WHEN t.sec = 0 THEN '' WHEN u.lev = 2 OR u.up IS NULL THEN u.title ELSE u.up || ' > ' || u.title END) AS path, md5(t.chunk) AS text FROM t LEFT JOIN u ON u.doc_id = t.doc_id AND u.sec = t.sec"""


def hybrid_with_parents(spark, d):
    """Documents are the chunks, four parents a source: a parent's text is that of its first document, whole."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), "text", (F.col("doc_id") % 4).cast("int").alias("parent_ord"))
    docs = docs.withColumn("vector", F.array(F.length("text").cast("double"), F.lit(1.0), F.lit(0.0)))
    parents = table(spark, d, "documents").groupBy("source", (F.col("doc_id") % 4).cast("int").alias("parent_ord")).agg(F.min_by("text", "doc_id").alias("text"))
    return retrieval.hybrid_search(docs, QUERY, FAKE, 20, parents=parents).select("source", "ord", "parent_ord", "parent_text")


def _hybrid_parents_sql():
    from .documents import CATALOGUE

    return f"""SELECT h.source, h.ord, CAST(h.ord % 4 AS INT) AS parent_ord, p.text AS parent_text FROM ({CATALOGUE['rrf_hybrid_topk'][1]}) h
LEFT JOIN (SELECT source, doc_id % 4 AS po, arg_min(text, doc_id) AS text FROM documents GROUP BY 1, 2) p ON p.source = h.source AND p.po = h.ord % 4"""


def heading_candidates(spark, d):
    return convert.heading_candidates(table(spark, d, "documents"), "doc_id").select("source", F.col("line_no").cast("bigint").alias("line_no"), "text")


def heading_density(spark, d):
    found = convert.heading_candidates(table(spark, d, "documents"), "doc_id")
    levels = F.count_if(F.length("text") < 20)
    ratio = found.groupBy("source").agg(F.count("*").alias("candidates"), levels.alias("levels"))
    return ratio.select("source", "candidates", "levels", (F.col("levels") / F.col("candidates") > 0.35).alias("rejected"))


_CANDIDATES = "SELECT doc_id AS source, i - 1 AS line_no, trim(l) AS text FROM (" + _LINES + ") WHERE trim(l) <> '' AND length(trim(l)) <= 80 AND NOT starts_with(trim(l), '|') AND length(l) - length(replace(l, '|', '')) < 2"


def outline_tree(spark, d):
    o = graph.outline(marked(spark, d))
    big = [F.col(c).cast("bigint").alias(c) for c in ("node_id", "parent_id", "level", "line_start", "line_end")]
    return o.select("source", F.md5("title").alias("title"), *big)


_OUTLINE = f"""
WITH l AS ({_LINES}), n AS (SELECT doc_id, count(*) - count(*) FILTER (i = last AND (i - 1) % 4 <> 0 AND l = '') AS total FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS last FROM l) GROUP BY 1),
h AS (SELECT doc_id, i, CASE WHEN (i - 1) % 8 = 4 THEN 3 ELSE 2 END AS lev, trim(l) AS title FROM l WHERE (i - 1) % 4 = 0 AND trim(l) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS node_id FROM h)
SELECT k.doc_id AS source, md5(k.title) AS title, k.node_id, (SELECT max(e.node_id) FROM k e WHERE e.doc_id = k.doc_id AND e.node_id < k.node_id AND e.lev < k.lev) AS parent_id, k.lev AS level, k.i AS line_start,
 coalesce((SELECT min(e.i) FROM k e WHERE e.doc_id = k.doc_id AND e.node_id > k.node_id AND e.lev <= k.lev) - 1, n.total) AS line_end FROM k JOIN n USING (doc_id)"""

CATALOGUE = {
    "chunk_sections": (chunk_sections, _SECTIONS),
    "chunk_pack_lines": (chunk_pack_lines, _PACK),
    "chunk_pack_overlap": (chunk_pack_overlap, _PACK_OVERLAP),
    "chunk_hard_split": (chunk_hard_split, _HARD),
    "table_line_blocks": (table_line_blocks, "SELECT * FROM (SELECT doc_id, count(*) FILTER (starts_with(trim(l), '|') OR (l LIKE '%|%' AND regexp_full_match(trim(l), '[|: -]+'))) AS table_lines, count(*) FILTER (l LIKE '%|%') AS with_pipes FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id) WHERE with_pipes > 0"),
    "chunks_structured": (chunks_structured, _STRUCTURED),
    "hybrid_with_parents": (hybrid_with_parents, _hybrid_parents_sql()),
    "heading_candidates": (heading_candidates, _CANDIDATES),
    "heading_density": (heading_density, f"SELECT source, count(*) AS candidates, count(*) FILTER (length(text) < 20) AS levels, count(*) FILTER (length(text) < 20) > 0.35 * count(*) AS rejected FROM ({_CANDIDATES}) GROUP BY source"),
    "outline_tree": (outline_tree, _OUTLINE),
}
