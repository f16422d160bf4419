"""Queries of the gates, the graph and incremental ingestion, over pages made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import anchor
from ..operators import gates, graph, offsets, retrieval
from ..sources.scratch import folder
from ..streaming import incremental
from .documents import table


def _sources(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("_md/"), F.col("doc_id").cast("string")).alias("rel"), "text", F.when(F.col("doc_id") % 9 == 0, "suspect").alias("quality"))


def _claims(spark, d):
    """Anchors of each document to the next one: two stretches of it with an ellipsis, the order wrong in every third, the digits changed in every fifth."""
    docs = table(spark, d, "documents").select((F.col("doc_id") - 1).alias("page"), "text")
    flat = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit(" "))
    a, b = F.substring(flat, 5, 25), F.substring(flat, 60, 25)
    snippet = F.when(F.col("page") % 3 == 0, F.concat(b, F.lit("…"), a)).when(F.col("page") % 5 == 0, F.concat(F.lit("987654"), a)).otherwise(F.concat(a, F.lit("* … "), b))
    rel = F.when(F.col("page") % 7 == 0, F.lit("_md/../x")).otherwise(F.concat(F.lit("_md/./"), (F.col("page") + 1 + F.when(F.col("page") % 8 == 0, 10**9).otherwise(0)).cast("string")))
    return docs.select("page", F.lit(1).alias("line_no"), F.lit(0).alias("anchor_no"), rel.alias("rel"), snippet.alias("snippet"), (F.col("page") % 2 == 0).alias("marked"))


def anchor_verify(spark, d):
    return gates.check_anchors(_claims(spark, d), _sources(spark, d)).select("page", "rel", "kind")


_NORM = "translate(translate(regexp_replace({0}, '<[^>]*>', '', 'g'), '，（）：；“”‘’－—–', ',():;\"\"''''---'), ' ' || chr(9) || chr(13) || chr(10) || '　,|*#>`~_', '')"


def _anchor_sql(kinds: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, doc_id - 1 AS page, text, replace(replace(text, chr(10), ' '), '|', ' ') AS f FROM documents),
c AS (SELECT page, CASE WHEN page % 7 = 0 THEN '_md/../x' ELSE '_md/./' || (page + 1 + CASE WHEN page % 8 = 0 THEN 1000000000 ELSE 0 END) END AS rel,
  CASE WHEN page % 3 = 0 THEN [substring(f, 60, 25), substring(f, 5, 25)] WHEN page % 5 = 0 THEN ['987654' || substring(f, 5, 25)] ELSE [substring(f, 5, 25), substring(f, 60, 25)] END AS parts,
  page % 7 = 0 AS outside, page % 8 = 0 AS missing, (page + 1) % 9 = 0 AS suspect, page % 2 = 0 AS marked, {_NORM.format('text')} AS body FROM d),
n AS (SELECT *, {_NORM.format('parts[1]')} AS a, {_NORM.format("coalesce(parts[2], '')")} AS b FROM c),
k AS (SELECT *, instr(body, a) AS p FROM n),
v AS (SELECT page, rel, CASE WHEN outside THEN 'outside' WHEN missing THEN 'missing' WHEN a <> '' AND p = 0 THEN 'mismatch' WHEN b <> '' AND instr(substring(body, (CASE WHEN a = '' THEN 1 ELSE p + length(a) END)::BIGINT), b) = 0 THEN 'mismatch' END AS kind FROM k
  UNION ALL SELECT page, rel, 'unmarked' FROM k WHERE suspect AND NOT marked AND NOT outside AND NOT missing)
SELECT page, rel, kind FROM v WHERE {kinds}"""


def anchor_missing(spark, d):
    return gates.check_anchors(_claims(spark, d), _sources(spark, d)).where("kind = 'missing'").select("page", "rel")


def verbatim_passages(spark, d):
    """Benchmark passages that occur in documents, in normal form."""
    from ..functions.text import evidence_norm
    from ..operators import passages

    items = table(spark, d, "benchmark").select("item_id", evidence_norm(F.col("text")).alias("norm"))
    bodies = table(spark, d, "documents").select("doc_id", evidence_norm(F.col("text")).alias("body"))
    return passages.passages(bodies, items).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))


TERMS = ["quarterly", "onthe", "the and", "+1 (5", "zzzz-none"]


def grep_terms_capped(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select(F.col("doc_id").alias("source"), (F.col("i") + 1).cast("bigint").alias("line_no"), "line")
    got = retrieval.grep_terms(lines, TERMS)
    state = lambda df, name: df.select("term", F.lit(-1).cast("bigint").alias("source"), F.lit(-1).cast("bigint").alias("line_no"), F.lit(name).alias("state"))
    return got["hits"].select("term", "source", "line_no", F.lit("hit").alias("state")).unionByName(state(got["not_found"], "not found")).unionByName(state(got["truncated"], "truncated"))


_GREP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
q AS (SELECT unnest([{', '.join(f"'{t}'" for t in TERMS)}]) AS term),
h AS (SELECT term, doc_id, i, row_number() OVER (PARTITION BY term ORDER BY doc_id, i) AS n FROM l JOIN q ON contains({_NORM.format('line')}, {_NORM.format('term')}))
SELECT term, doc_id AS source, i AS line_no, 'hit' AS state FROM h WHERE n <= 20
UNION ALL SELECT term, -1, -1, 'truncated' FROM h WHERE n = 21
UNION ALL SELECT term, -1, -1, 'not found' FROM q WHERE term NOT IN (SELECT term FROM h)"""


def coverage_ledger(spark, d):
    rel = F.col("doc_id").cast("string")
    docs = table(spark, d, "documents").select(rel.alias("rel"), "doc_id")
    cited = docs.where("doc_id % 4 = 0").select("rel")
    skips = table(spark, d, "labels").select(rel.alias("path"), (F.col("quality") == 1).alias("has_reason"))
    return gates.coverage_totals(gates.coverage(docs, cited, skips))


def reconcile_sources(spark, d):
    docs = table(spark, d, "documents")
    status = F.when(F.col("doc_id") % 5 == 0, "failed").when(F.col("doc_id") % 7 == 0, "skipped_unsupported").when(F.col("doc_id") % 3 == 0, "warned").otherwise("succeeded")
    outcomes = docs.where("doc_id % 50 <> 1").select(F.col("doc_id").cast("string").alias("file"), status.alias("status"))
    skips = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path"), (F.col("toxic") == 0).alias("has_reason"))
    return gates.reconcile(outcomes, skips, docs.agg(F.count("*").alias("source_total")))


def claim_context(spark, d):
    """The raw text around each quote of the next document that can be found there."""
    pairs = _claims(spark, d).select("page", F.concat(F.lit("_md/"), (F.col("page") + 1).cast("string")).alias("source"), F.col("snippet").alias("quote"))
    return gates.with_context(pairs, _sources(spark, d)).select("page", F.md5("context").alias("context"))


_STRETCH = offsets.STRETCH.replace("'", "''")
_CONTEXT = f"""
WITH d AS (SELECT doc_id - 1 AS page, text, replace(replace(text, chr(10), ' '), '|', ' ') AS f, {_NORM.format('text')} AS body FROM documents),
q AS (SELECT *, CASE WHEN page % 3 = 0 THEN substring(f, 60, 25) || '…' || substring(f, 5, 25) WHEN page % 5 = 0 THEN '987654' || substring(f, 5, 25) ELSE substring(f, 5, 25) || '* … ' || substring(f, 60, 25) END AS quote FROM d),
g AS (SELECT *, list_filter(string_split_regex(quote, '…+|\\.{{3,}}'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || '　') <> '') AS frags FROM q),
l AS (SELECT *, coalesce(frags[list_position(list_transform(frags, lambda x: length(x)), list_max(list_transform(frags, lambda x: length(x))))], '') AS longest FROM g),
w AS (SELECT *, {_NORM.format('longest')} AS wanted FROM l),
a AS (SELECT *, CASE WHEN wanted <> '' THEN instr(body, wanted) - 1 ELSE -1 END AS first FROM w),
p AS (SELECT page, first, first + length(wanted) - 1 AS last, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT *, regexp_extract_all(text, '{_STRETCH}') AS s FROM a WHERE first >= 0)),
k AS (SELECT *, CASE WHEN {_NORM.format('s')} = '' THEN 0 ELSE length(s) END AS kept FROM p),
r AS (SELECT *, sum(kept) OVER o - kept AS normal, sum(length(s)) OVER o - length(s) AS raw FROM k WINDOW o AS (PARTITION BY page ORDER BY i ROWS UNBOUNDED PRECEDING)),
m AS (SELECT page, min(raw + first - normal) FILTER (normal <= first AND first < normal + kept) AS b, min(raw + last - normal) FILTER (normal <= last AND last < normal + kept) AS e FROM r GROUP BY page)
SELECT page, md5(coalesce(trim(regexp_replace(substring(text, (greatest(0, b - 120) + 1)::BIGINT, (e + 121 - greatest(0, b - 120))::BIGINT), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), ' '), '')) AS context FROM a LEFT JOIN m USING (page)"""


def skip_ledger_log(spark, d):
    """A ledger of three lines a document: a heading (of an entry, of something else, or none), a reason that may be blank, and a remark."""
    i = F.col("doc_id")
    path = F.concat(F.lit("_md\\"), (i % 90).cast("string"), F.lit(".md"))
    head = F.when(i % 5 == 0, F.concat(F.lit("## [2024-01-02] skip | "), path)).when(i % 5 == 1, F.lit("# other")).otherwise(F.lit("remark"))
    reason = F.when(i % 7 == 0, F.lit("- 原因：  ")).when(i % 3 == 0, F.lit("- 原因: because")).otherwise(F.lit("-"))
    lines = table(spark, d, "documents").select((i * 3).alias("n"), F.posexplode(F.array(head, reason, F.lit("  原因：no dash"))).alias("k", "line"))
    return gates.skip_ledger(lines.select((F.col("n") + F.col("k")).alias("line_no"), "line"))


_LEDGER = """
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '_md/' || (doc_id % 90) || '.md' WHEN doc_id % 5 = 1 THEN '' END AS opens, doc_id % 7 <> 0 AND doc_id % 3 = 0 AS reason FROM documents),
y AS (SELECT *, last_value(opens IGNORE NULLS) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS path FROM x)
SELECT path, bool_or(reason) AS has_reason FROM y WHERE path <> '' GROUP BY path"""


def timeline_pages(spark, d):
    """A page of dated lines a user, some of them no entries, and what is out of order on it."""
    i = F.col("event_id")
    ymd = [F.date_format("ts", "yyyy'年'"), F.date_format("ts", "yyyy'年'M'月'"), F.date_format("ts", "yyyy'年' M'月'd'日'")]
    date = F.when(i % 3 == 0, ymd[0]).when(i % 3 == 1, ymd[1]).otherwise(ymd[2])
    line = F.concat(F.when(i % 4 == 3, "note ").otherwise(" - "), F.when(i % 11 == 5, "no date").otherwise(date), F.lit(" 1999年"))
    lines = table(spark, d, "events").select("user_id", F.struct(((i * 7919) % 100003).alias("place"), i.alias("i"), line.alias("line")).alias("x"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n")
    pages = lines.groupBy("user_id").agg(text.alias("text")).select(F.concat(F.lit("wiki/时间线/"), F.col("user_id").cast("string"), F.lit(".md")).alias("page"), "text")
    return gates.check_timelines(pages).select("page", F.col("line_no").cast("bigint").alias("line_no"))


_TIMELINE_PAGES = """
WITH l AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 100003, event_id) AS line_no FROM events),
t AS (SELECT *, CASE WHEN event_id % 11 = 5 THEN [1999] WHEN event_id % 3 = 0 THEN [year(ts)] WHEN event_id % 3 = 1 THEN [year(ts), month(ts)] ELSE [year(ts), month(ts), day(ts)] END AS k FROM l WHERE event_id % 4 <> 3),
p AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY line_no) AS b FROM t)
SELECT 'wiki/时间线/' || user_id || '.md' AS page, line_no FROM p WHERE b IS NOT NULL AND k[1:least(len(k), len(b))] < b[1:least(len(k), len(b))]"""


def _case_pages(spark, d):
    """A wiki page a document: aliases, a title, up to three anchors on the next document, a link, dated entries, a check and a last line."""
    i = F.col("doc_id")
    n, s = (lambda x: x.cast("string")), (lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x]))
    docs = table(spark, d, "documents")
    quoted = docs.select((i - 1).alias("page_id"), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 5, 25).alias("quote"))
    flat = F.regexp_replace(F.coalesce("quote", F.lit("none")), "[\\[\\]〔〕「」\\r\\f\\x0b\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]", "")
    mark = anchor(s("_md/", n(i + 1), ".md"), F.when(i % 5 == 0, s("987654", flat)).otherwise(s("a", flat)))
    mark = F.when(i % 8 != 3, mark)
    target = F.when(i % 3 == 0, s("别名", n(i + 1))).when(i % 3 == 1, n(i + 1)).otherwise(s("nowhere", n(i)))
    text = F.array_join(F.array(
        F.lit("---"), s("aliases: [别名", n(i), ", 又名", n(i), "]"), F.lit("---"), s("# ", n(i)),
        F.coalesce(s("付款 ", mark), F.lit("# 结论")), s("见 [[", target, "#x]]"),
        F.coalesce(s("- 2024年", n(1 + i % 12), "月 ", mark), F.lit("")), F.coalesce(s("- 2024年", n(1 + (i * 7) % 12), "月 ", mark), F.lit("")),
        s("> [!check] 1,000 + ", n(i), " == ", n(1000 + i + F.when(i % 4 == 0, 1).otherwise(0))),
        F.when(i % 7 == 0, s("裸 ", n(i))).otherwise(F.lit(gates.NOT_FOUND + "。")),
    ), "\n")
    pages = docs.select("doc_id").join(quoted, i == F.col("page_id"), "left")
    return pages.select(s("wiki/", F.when(i % 6 == 0, "时间线").otherwise("页"), "/", n(i), ".md").alias("page"), text.alias("text"))


def scan_case(spark, d):
    """Violations and warnings of a case of one page and one source a document, and its totals as lines of their own."""
    sources = table(spark, d, "documents").select(F.concat(F.lit("_md/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"), F.concat(F.lit("a"), F.expr("substring(text, 5)")).alias("text"), F.when(F.col("doc_id") % 9 == 0, "suspect").alias("quality"))
    found = gates.scan_whole_case(_case_pages(spark, d), sources)
    rows = found.violations.select("page", F.col("line_no").cast("bigint").alias("line_no"), "kind").unionByName(found.warnings.select("page", F.lit(0).cast("bigint").alias("line_no"), "kind"))
    totals = found.totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("page"), F.col(c).cast("bigint").alias("line_no"), F.lit("total").alias("kind")) for c in ("anchors", "total", "cited", "skipped", "unresolved")])))
    return rows.unionByName(totals)


_CASE = f"""
WITH d AS (SELECT doc_id AS i, 'a' || substring(text, 5) AS body, substring(replace(text, chr(10), ' '), 5, 25) AS f, doc_id % 9 = 0 AS suspect FROM documents),
p AS (SELECT p.i, 'wiki/' || CASE WHEN p.i % 6 = 0 THEN '时间线' ELSE '页' END || '/' || p.i || '.md' AS page, n.i IS NOT NULL AS there, n.suspect, n.body,
  CASE WHEN p.i % 5 = 0 THEN '987654' ELSE 'a' END || regexp_replace(coalesce(n.f, 'none'), '[\\[\\]〔〕「」\\r\\f\\x0B\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', '', 'g') AS quote FROM d p LEFT JOIN d n ON n.i = p.i + 1),
a AS (SELECT i, page, l AS line_no, there, suspect, len(list_filter(string_split_regex(quote, '…+|\\.{{3,}}'), lambda x: {_NORM.format('x')} <> '' AND NOT contains({_NORM.format('body')}, {_NORM.format('x')}))) > 0 AS bad FROM p, (SELECT unnest([5, 7, 8]) AS l) WHERE i % 8 <> 3),
v AS (SELECT page, line_no, CASE WHEN NOT there THEN 'missing' WHEN bad THEN 'mismatch' END AS kind FROM a
 UNION ALL SELECT page, line_no, 'unmarked' FROM a WHERE there AND suspect
 UNION ALL SELECT page, 6, 'dead link' FROM p WHERE i % 3 = 2 OR NOT there
 UNION ALL SELECT page, 8, 'timeline' FROM p WHERE i % 6 = 0 AND i % 8 <> 3 AND (i * 7) % 12 < i % 12
 UNION ALL SELECT page, 9, 'mismatch' FROM p WHERE i % 4 = 0
 UNION ALL SELECT page, 10, 'unanchored' FROM p WHERE i % 7 = 0),
c AS (SELECT '_md/' || d.i || '.md' AS rel, b.i IS NOT NULL AS cited FROM d LEFT JOIN d b ON b.i = d.i - 1 AND b.i % 8 <> 3)
SELECT page, CAST(line_no AS BIGINT) AS line_no, kind FROM v WHERE kind IS NOT NULL
UNION ALL SELECT rel, 0, 'unresolved' FROM c WHERE NOT cited
UNION ALL SELECT 'anchors', count(*), 'total' FROM a UNION ALL SELECT 'total', count(*), 'total' FROM c UNION ALL SELECT 'cited', count(*) FILTER (cited), 'total' FROM c
UNION ALL SELECT 'skipped', 0, 'total' UNION ALL SELECT 'unresolved', count(*) FILTER (NOT cited), 'total' FROM c"""


def _link_pages(spark, d):
    """A page a customer with links to a nation (dead ones among them) and, through an alias, to a region."""
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("page"), F.concat(F.lit("see [[n"), F.col("c_nationkey") + F.col("c_custkey") % 4, F.lit("#x|nation]] and\n[[ Region "), F.col("c_custkey") % 7, F.lit(" ]] [[#self]]")).alias("text"))


def dead_links(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name")).union(table(spark, d, "region").select(F.concat(F.lit("Region "), F.col("r_regionkey").cast("string"))))
    return gates.dead_links(gates.wikilinks(_link_pages(spark, d)), names).select("page", F.col("line_no").cast("bigint").alias("line_no"), "target")


def _graph(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    node = lambda df, p, k, kind, alias: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("stem"), F.lit(kind).alias("page_type"), F.array(F.concat(F.lit(alias), F.col(k).cast("string"))).alias("aliases"))
    pages = node(c, "c", "c_custkey", "案件主体", "customer ").union(node(n, "n", "n_nationkey", "法律关系", "nation ")).union(node(r, "r", "r_regionkey", "法律事实", "region ")).withColumn("path", F.col("stem"))
    links = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("stem"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("target"))
    links = links.union(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))).union(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("r"), ((F.col("r_regionkey") + 1) % 5).cast("string"))))
    return graph.build(pages, links)


def graph_neighbors(spark, d):
    nodes, edges, alias = _graph(spark, d)
    return graph.neighbors(edges, nodes, alias, "nation 3")


def graph_shortest_path(spark, d):
    _, edges, _ = _graph(spark, d)
    return graph.shortest_path(edges, "c1", "c2").select(F.array_join("path", ">").alias("path"), F.col("hops").cast("bigint").alias("hops"))


_EDGES = """
e0 AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'r' || ((r_regionkey + 1) % 5) FROM region),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b)"""


def timeline_order(spark, d):
    """Events of a user before the one before them; places repeat from 100,003 events on, where the order is that of the events."""
    parts = F.when(F.col("event_id") % 3 == 0, F.array(F.year("ts"))).when(F.col("event_id") % 3 == 1, F.array(F.year("ts"), F.month("ts"))).otherwise(F.array(F.year("ts"), F.month("ts"), F.day("ts")))
    dated = table(spark, d, "events").select("user_id", "event_id", ((F.col("event_id") * 7919) % 100003).alias("place"), parts.alias("date"))
    return gates.timeline_order(dated, "user_id", ("place", "event_id")).select("user_id", "event_id")


_TIMELINE = """
WITH t AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN [year(ts)] WHEN 1 THEN [year(ts), month(ts)] ELSE [year(ts), month(ts), day(ts)] END AS k FROM events),
p AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 100003) AS b FROM t)
SELECT user_id, event_id FROM p WHERE b IS NOT NULL AND k[1:least(len(k), len(b))] < b[1:least(len(k), len(b))]"""


def closure_check(spark, d):
    """Recorded totals of orders against the sum of their lines, as check lines of one page an order."""
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("p"))
    text = F.concat(F.lit("> [!check] "), F.array_join(F.transform("p", lambda x: F.format_number(x["q"] * 1000, 0)), " ＋ "), F.lit(" == "), F.aggregate("p", F.lit(0), lambda s, x: s + x["q"] * 1000) + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0), F.when(F.col("l_orderkey") % 5 == 0, " units").otherwise(""))
    return gates.check_closures(parts.select(F.col("l_orderkey").alias("page"), text.alias("text"))).select("page", "kind")


def last_assistant_reply(spark, d):
    return gates.last_reply(table(spark, d, "conversations")).select("conv_id", F.md5("text").alias("reply"))


def _drafts(spark, d):
    """Turns as drafts: a title, plain lines, a checked row and an anchored sentence."""
    text = F.concat(F.lit("# 结论\n\n"), "text", F.lit("\n| a | b |\n|---|---|\n> [!note] 分析\n> free\n\n> still free\nsaid "), anchor(F.lit("_md/x"), F.substring(F.regexp_replace("text", "\n", " "), 1, 12)), F.lit("。\n"), gates.F.lit(gates.NOT_FOUND + "。"))
    return table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("page"), text.alias("text"))


def bare_lines(spark, d):
    return gates.bare_lines(_drafts(spark, d)).groupBy("page").agg(F.count("*").alias("bare"))


def claim_pairs(spark, d):
    return gates.claim_pairs(_drafts(spark, d)).select("page", "claim", "source", "quote")


def provenance_mismatch(spark, d):
    docs = table(spark, d, "documents")
    source = F.col("doc_id").cast("string")
    good = F.sha2("text", 256)
    converted = docs.select(source.alias("rel"), F.when(F.col("doc_id") % 6 == 0, None).otherwise("1").alias("provenance_version"), F.when(F.col("doc_id") % 10 == 1, "gone").otherwise(source).alias("source"), F.when(F.col("doc_id") % 7 == 0, "bad").otherwise(good).alias("source_sha256"), F.when(F.col("doc_id") % 8 == 0, "bad").otherwise(good).alias("content_sha256"), F.col("text").alias("body"))
    return gates.check_provenance(converted, docs.select(source.alias("source"), F.col("text").cast("binary").alias("content")))


def incremental_events(spark, d):
    """A stream that takes a folder's files once gives what a batch query gives."""
    from uuid import uuid4

    root = f"{folder(spark)}/stream-{uuid4().hex}"
    table(spark, d, "events").repartition(4, "user_id").write.parquet(f"{root}/in")
    rows = incremental.stored_rows(spark, f"{root}/in", "event_id bigint, ts timestamp, user_id bigint, event_type string, value double", f"{root}/out", f"{root}/checkpoint")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


CATALOGUE = {
    "anchor_verify": (anchor_verify, _anchor_sql("kind IS NOT NULL")),
    "anchor_missing": (anchor_missing, f"SELECT page, rel FROM ({_anchor_sql(chr(107) + 'ind = ' + chr(39) + 'missing' + chr(39))})"),
    "verbatim_passages": (verbatim_passages, f"SELECT item_id, count(*) AS documents, min(doc_id) AS first_id FROM (SELECT item_id, {_NORM.format('text')} AS norm FROM benchmark) b JOIN (SELECT doc_id, {_NORM.format('text')} AS body FROM documents) d ON contains(body, norm) WHERE norm <> '' GROUP BY item_id"),
    "grep_terms_capped": (grep_terms_capped, _GREP),
    "coverage_ledger": (coverage_ledger, "SELECT count(*) AS total, count(*) FILTER (doc_id % 4 = 0) AS cited, count(*) FILTER (doc_id % 4 <> 0 AND l.quality IS NOT NULL) AS skipped, count(*) FILTER (doc_id % 4 <> 0 AND l.quality IS NULL) AS unresolved FROM documents LEFT JOIN labels l USING (doc_id)"),
    "reconcile_sources": (reconcile_sources, "WITH o AS (SELECT doc_id, doc_id % 5 = 0 OR doc_id % 7 = 0 AS open FROM documents WHERE doc_id % 50 <> 1), j AS (SELECT o.*, coalesce(toxic = 0, false) AS ok FROM o LEFT JOIN labels USING (doc_id)) SELECT count(*) FILTER (NOT open) AS produced, count(*) FILTER (open AND ok) AS registered, count(*) FILTER (open AND NOT ok) + CASE WHEN (SELECT count(*) FROM documents) > count(*) THEN 1 ELSE 0 END AS unresolved, (SELECT count(*) FROM documents) AS source_total, count(*) AS accounted FROM j"),
    "dead_links": (dead_links, "WITH l AS (SELECT 'c' || c_custkey AS page, 1 AS line_no, 'n' || (c_nationkey + c_custkey % 4) AS target FROM customer UNION ALL SELECT 'c' || c_custkey, 2, 'Region ' || (c_custkey % 7) FROM customer) SELECT * FROM l WHERE target NOT IN (SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'Region ' || r_regionkey FROM region)"),
    "graph_neighbors": (graph_neighbors, f"WITH {_EDGES} SELECT b AS stem, CASE left(b, 1) WHEN 'c' THEN '案件主体' WHEN 'n' THEN '法律关系' ELSE '法律事实' END AS type FROM e WHERE a = 'n3'"),
    "graph_shortest_path": (graph_shortest_path, f"WITH RECURSIVE {_EDGES}, d AS (SELECT 'c2' AS node, 0 AS k UNION SELECT e.b, d.k + 1 FROM d JOIN e ON e.a = d.node WHERE d.k < 12), m AS (SELECT node, min(k) AS k FROM d GROUP BY node), w AS (SELECT 'c1' AS node, ['c1'] AS path UNION ALL SELECT e.b, list_append(w.path, e.b) FROM w JOIN e ON e.a = w.node JOIN m x ON x.node = w.node JOIN m y ON y.node = e.b AND y.k = x.k - 1) SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM w WHERE node = 'c2' ORDER BY path LIMIT 1"),
    "scan_case": (scan_case, _CASE),
    "claim_context": (claim_context, _CONTEXT),
    "skip_ledger_log": (skip_ledger_log, _LEDGER),
    "timeline_pages": (timeline_pages, _TIMELINE_PAGES),
    "timeline_order": (timeline_order, _TIMELINE),
    "closure_check": (closure_check, "SELECT DISTINCT l_orderkey AS page, CASE WHEN l_orderkey % 5 = 0 THEN 'unparsable' ELSE 'mismatch' END AS kind FROM lineitem WHERE l_orderkey % 5 = 0 OR l_orderkey % 3 = 0"),
    "last_assistant_reply": (last_assistant_reply, "SELECT conv_id, md5(arg_max(text, turn)) AS reply FROM conversations WHERE role = 'assistant' AND trim(coalesce(text, '')) <> '' GROUP BY conv_id"),
    "bare_lines": (bare_lines, "SELECT conv_id || ':' || turn AS page, count(*) AS bare FROM (SELECT conv_id, turn, trim(unnest(string_split(text, chr(10)))) AS s FROM conversations) WHERE s <> '' AND NOT regexp_full_match(s, '[-*_]{3,}') AND NOT regexp_full_match(s, '\\|?[\\s:|-]+\\|?') GROUP BY 1"),
    "claim_pairs": (claim_pairs, "SELECT conv_id || ':' || turn AS page, 'said' AS claim, '_md/x' AS source, trim(left(replace(text, chr(10), ' '), 12)) AS quote FROM conversations"),
    "provenance_mismatch": (provenance_mismatch, "SELECT doc_id::VARCHAR AS rel, unnest(CASE WHEN doc_id % 6 = 0 THEN ['no version'] ELSE list_filter([CASE WHEN doc_id % 10 = 1 THEN 'missing original' WHEN doc_id % 7 = 0 THEN 'original changed' END, CASE WHEN doc_id % 8 = 0 THEN 'body changed' END], lambda x: x IS NOT NULL) END) AS kind FROM documents"),
    "incremental_events": (incremental_events, "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type"),
}
