"""Gates over wiki pages and drafts: each takes tables and returns a table of violations."""

from __future__ import annotations

import ast
import operator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ANCHOR, DATE, WHITE, WIKILINK, aliases, bind, date_key, evidence_norm, fragments, lexical_path, link_target, posix, provenance_fields, strip
from ..sources.scratch import by_size, materialise
from .offsets import contexts
from .scans import last_known

# Section labels that claim nothing.
LABELS = ["回答", "结论", "本案结论", "摘要", "案件摘要", "概览", "案件概况", "事实", "案件事实", "事实依据", "证据", "证据依据", "依据", "说明", "分析", "法律分析", "检索结果", "材料情况", "付款情况", "争议焦点", "时间线", "案件主体", "法律关系", "风险", "风险提示", "建议", "待核实事项", "案件索引", "案件 wiki 索引"]
# Words that may stand beside links in a row of navigation.
NAVIGATION = ["", "见", "参见", "另见", "主体", "相关主体", "相关页面", "相关法律事实", "关系"]
NOT_FOUND = "在案件材料中未找到"
# Fixed patterns: a ledger entry's heading and reason, and an arithmetic assertion.
SKIP_HEAD = r"^##\s*\[\d{4}-\d{2}-\d{2}\]\s*skip\s*\|\s*(.+?)\s*$"
SKIP_REASON = r"^\s*-\s*原因[:：](.*)$"
CHECK = r">\s*\[!check\]\s*(.+)"
TOLERANCE = 1e-6


def numbered_lines(pages: DataFrame) -> DataFrame:
    """page, line_no (from 1) and line of every page's text."""
    return pages.select("page", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]")).alias("i", "line")).select("page", (F.col("i") + 1).alias("line_no"), "line")


def gate_lines(pages: DataFrame) -> DataFrame:
    """numbered_lines of pages, each with what it may hold for the gates: one struct of flags, told from the line once."""
    entry = F.array_contains(F.split("page", "/"), "时间线") & strip(F.col("line")).startswith("-") & F.col("line").rlike(DATE)
    gate = F.struct(F.col("line").contains("〔来源:").alias("anchor"), F.col("line").contains("[[").alias("link"), entry.alias("entry"), F.col("line").rlike(CHECK).alias("check"))
    return numbered_lines(pages).withColumn("gate", gate)


def _lines(pages: DataFrame, lines: DataFrame | None, gate: str) -> DataFrame:
    """The lines of pages that a gate looks at: from lines that were made before, or made now."""
    return (gate_lines(pages) if lines is None else lines).where(F.col("gate")[gate]).select("page", "line_no", "line")


def anchors(pages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """page, line_no, anchor_no, rel, snippet and marked (an unverified mark follows) of every anchor."""
    found = _lines(pages, lines, "anchor")
    whole = ANCHOR + "(?:[ \\t]*（未核验）)?"
    each = found.select("page", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(whole), F.lit(0))).alias("anchor_no", "raw"))
    return each.select("page", "line_no", "anchor_no", posix(F.trim(F.regexp_extract("raw", ANCHOR, 1))).alias("rel"), F.trim(F.regexp_extract("raw", ANCHOR, 2)).alias("snippet"), F.col("raw").endswith("（未核验）").alias("marked"))


def in_order(parts: Column, body: Column) -> Column:
    """Whether all parts occur in the body, each after the one before."""
    step = lambda at, f: F.when(at == 0, F.lit(0)).otherwise(bind(F.call_function("locate", f, body, at), lambda p: F.when(p == 0, F.lit(0)).otherwise(p + F.length(f))))
    return F.aggregate(parts, F.lit(1), step) > 0


def check_anchors(found: DataFrame, sources: DataFrame, root: str = "_md") -> DataFrame:
    """Violations (page, line_no, anchor_no, rel, kind) of anchors against sources (rel, text[, quality]).

    Kinds: outside (not under root), missing, mismatch (fragments not in order),
    unmarked (a suspect source without the mark).  Only named sources are joined.
    """
    if "quality" not in sources.columns:
        sources = sources.withColumn("quality", F.lit(None).cast("string"))
    located = found.withColumn("_path", lexical_path(F.col("rel")))
    # texts are dealt once, to so many tasks that what one sorts does not grow with them
    paths = located.select(F.col("_path").alias("rel")).distinct()
    wanted = by_size(sources, "text", "rel").join(paths, "rel", "left_semi")  # only named bodies are normalised and sent
    bodies = wanted.select(F.col("rel").alias("_rel"), evidence_norm(F.col("text")).alias("_body"), "quality")
    named = located.join(bodies, F.col("_path") == F.col("_rel"), "left")
    parts = F.filter(F.transform(fragments(F.col("snippet")), evidence_norm), lambda x: x != "")
    outside = ~F.col("_path").startswith(root + "/") if root else F.lit(False)
    kinds = F.array_compact(F.array(
        F.when(outside, F.lit("outside"))
        .when(F.col("_rel").isNull(), F.lit("missing"))
        .when(~in_order(parts, F.col("_body")), F.lit("mismatch")),
        F.when(~outside & (F.col("quality") == "suspect") & ~F.col("marked"), F.lit("unmarked")),
    ))
    return named.select("page", "line_no", "anchor_no", "rel", F.explode(kinds).alias("kind"))


def check_provenance(converted: DataFrame, originals: DataFrame) -> DataFrame:
    """rel and kind for converted (rel, provenance_version, source, source_sha256, content_sha256, body) against originals (source, content)."""
    kept = originals.select(F.col("source").alias("_source"), F.sha2("content", 256).alias("_hash"))
    both = converted.join(kept, F.col("source") == F.col("_source"), "left")
    full = F.col("source").isNotNull() & F.col("source_sha256").isNotNull() & F.col("content_sha256").isNotNull()
    kinds = F.when(F.col("provenance_version").isNull(), F.array(F.lit("no version"))).when(F.col("provenance_version") != "1", F.array(F.lit("unknown version"))).when(~full, F.array(F.lit("missing field"))).otherwise(F.array_compact(F.array(
        F.when(F.col("_source").isNull(), F.lit("missing original")).when(F.col("_hash") != F.col("source_sha256"), F.lit("original changed")),
        F.when(F.sha2(F.col("body").cast("binary"), 256) != F.col("content_sha256"), F.lit("body changed")),
    )))
    return both.select("rel", F.explode(kinds).alias("kind"))


def wikilinks(pages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """page, line_no and target of every link that names a page."""
    each = _lines(pages, lines, "link").select("page", "line_no", F.explode(F.regexp_extract_all("line", F.lit(WIKILINK), F.lit(1))).alias("raw"))
    return each.select("page", "line_no", link_target(F.col("raw")).alias("target")).where("target <> ''")


def dead_links(links: DataFrame, names: DataFrame) -> DataFrame:
    return links.join(names.select(F.col("name").alias("target")).distinct(), "target", "left_anti").select(*links.columns)


def timeline_order(dated: DataFrame, group: str = "page", place: str | tuple[str, ...] = "line_no", key: str = "date") -> DataFrame:
    """Rows whose date (array of ints) is before the row before it, on the precision that both have.

    place is one column or several, of which the later ones order rows that the
    earlier ones leave level; all of them should leave none level, or which row
    is the one before is left to chance.
    """
    before = F.lag(key).over(Window.partitionBy(group).orderBy(*([place] if isinstance(place, str) else place)))
    short = F.least(F.size(key), F.size("before"))
    return dated.withColumn("before", before).where(F.col("before").isNotNull() & (F.slice(key, 1, short) < F.slice("before", 1, short)))


def check_timelines(pages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Out-of-order entries of pages below a folder or with the name 时间线: lines that begin with a dash, whatever follows it, and have a date."""
    return timeline_order(_lines(pages, lines, "entry").withColumn("date", date_key(F.col("line"))))


# What either side of a closure may consist of.
CLOSURE_CHARS = frozenset("0123456789,+-*().") | frozenset(WHITE)
_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.USub: operator.neg, ast.UAdd: operator.pos}


def evaluate(expression: str) -> float:
    """Sums, differences and products of numbers; ValueError for anything else."""

    def value(node: ast.AST) -> float:
        match node:
            case ast.Constant(value=int() | float() as number) if not isinstance(number, bool):
                return number
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPS:
                return _OPS[type(op)](value(a), value(b))
            case ast.UnaryOp(op=op, operand=a) if type(op) in _OPS:
                return _OPS[type(op)](value(a))
        raise ValueError(expression)

    try:
        return value(ast.parse(expression.replace(",", "").strip(), mode="eval").body)
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise ValueError(expression) from e


def check_closures(pages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """page, line_no and kind (unparsable or mismatch) of arithmetic assertions `left == right`."""
    asserted = _lines(pages, lines, "check").select("page", "line_no", F.translate(F.regexp_extract("line", CHECK, 1), "，＋－×＝", ",+-*=").alias("said"))

    @F.pandas_udf("string")
    def kind(said: pd.Series) -> pd.Series:
        def one(s: str) -> str | None:
            sides = s.split("==")
            # digits, the three operators, brackets, points and commas: no exponents, no other bases
            if len(sides) != 2 or not all(x and CLOSURE_CHARS.issuperset(x) for x in sides):
                return "unparsable"
            try:
                return "mismatch" if abs(evaluate(sides[0]) - evaluate(sides[1])) > TOLERANCE else None
            except ValueError:
                return "unparsable"

        return said.map(one)

    return asserted.withColumn("kind", kind("said")).where("kind is not null").select("page", "line_no", "kind")


def skip_ledger(log: DataFrame) -> DataFrame:
    """path and has_reason from log lines (line_no, line); entries of one path are joined by or.

    A heading opens or closes an entry for all lines up to the next one, in the
    order of line_no, however many tasks the log is dealt to.
    """
    is_head = F.col("line").startswith("#")
    heads = log.withColumn("_opens", F.when(is_head, posix(F.regexp_extract("line", SKIP_HEAD, 1))))
    marked = last_known(heads, ["line_no"], "_opens", "_entry")
    reason = F.trim(F.regexp_extract("line", SKIP_REASON, 1)) != ""
    return marked.where("_entry <> ''").groupBy(F.col("_entry").alias("path")).agg(F.bool_or(reason & ~is_head).alias("has_reason"))


def coverage(sources: DataFrame, cited: DataFrame, skips: DataFrame) -> DataFrame:
    """rel and state: cited, skipped, skipped without a reason, or unresolved; a citation wins over a skip."""
    c = cited.select("rel").distinct().withColumn("_c", F.lit(True))
    s = skips.select(F.col("path").alias("rel"), "has_reason")
    state = F.when(F.col("_c"), "cited").when(F.col("has_reason"), "skipped").when(F.col("has_reason").isNotNull(), "skipped without reason").otherwise("unresolved")
    return sources.select("rel").join(c, "rel", "left").join(s, "rel", "left").select("rel", state.alias("state"))


def coverage_totals(states: DataFrame) -> DataFrame:
    return states.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "cited").alias("cited"), F.count_if(F.col("state").startswith("skipped")).alias("skipped"), F.count_if(F.col("state") == "unresolved").alias("unresolved"))


def bare_lines(pages: DataFrame, allow_navigation: bool = False, lines: DataFrame | None = None) -> DataFrame:
    """page, line_no and line of every line that states something without an anchor.

    Exempt, in this order: frontmatter, fence markers, blank lines and rules,
    marked analysis, separators, checks, two callout heads, the title and known
    labels, table heads, anchored lines with nothing after the anchor but
    punctuation, rows of links (if allowed), and the not-found sentence.
    """
    lines = by_size(numbered_lines(pages) if lines is None else lines.select("page", "line_no", "line"), "line", "page").withColumn("s", F.btrim("line", F.lit(" \t")))
    order = Window.partitionBy("page").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fence_end = F.min(F.when((F.col("line_no") > 1) & (F.col("s") == "---"), F.col("line_no"))).over(Window.partitionBy("page"))
    opens = F.max(F.when((F.col("line_no") == 1) & (F.col("s") == "---"), F.lit(True))).over(Window.partitionBy("page"))
    x = lines.withColumn("skip_to", F.when(opens, F.coalesce(fence_end, F.lit(0))).otherwise(0)).where("line_no > skip_to")
    quiet = F.col("s").startswith("```") | (F.col("s") == "") | F.col("s").rlike(r"^[-*_]{3,}$")
    begins = F.col("s").rlike(r"^>\s*\[!note\]\s*分析(?:（非本案证据）)?\s*$")
    ends = ~quiet & ~begins & ~F.col("s").startswith(">")
    x = x.withColumn("next", F.btrim(F.lead("line").over(order), F.lit(" \t"))).withColumn("quiet", quiet).withColumn("begins", begins)
    x = x.withColumn("analysis", F.last(F.when(F.col("begins"), F.lit(True)).when(ends, F.lit(False)), ignorenulls=True).over(upto))
    x = x.where(~F.col("quiet") & ~F.col("begins") & ~(F.coalesce("analysis", F.lit(False)) & F.col("s").startswith(">")))
    x = x.withColumn("s", F.when(F.col("s").startswith(">"), F.btrim(F.regexp_replace("s", r"^[> ]+", ""), F.lit(" \t"))).otherwise(F.col("s")))
    is_head = F.col("s").startswith("#")
    heading = F.btrim(F.regexp_replace("s", r"^[# ]+", ""), F.lit(" \t"))
    nth = F.sum(is_head.cast("int")).over(upto)
    x = x.withColumn("nth_head", nth)
    title = F.col("title") if "title" in pages.columns else F.lit(None).cast("string")
    if "title" in pages.columns:
        x = x.join(pages.select("page", "title"), "page")
    separator = lambda c: c.rlike(r"^\|?[\s:|-]+\|?$")
    anchored = F.col("s").rlike(ANCHOR)
    tail = F.regexp_replace(F.regexp_replace("s", r"^.*" + ANCHOR, ""), r"^[ \t]*（未核验）", "")
    links = F.regexp_extract_all("s", F.lit(WIKILINK), F.lit(1))
    rest = F.btrim(F.regexp_replace(F.regexp_replace("s", WIKILINK, ""), r"^[-*+]\s*", ""), F.lit(" \t，,。；;：:"))
    exempt = (
        (F.col("s") == "") | separator(F.col("s")) | F.col("s").startswith("[!check]")
        | F.col("s").rlike(r"^(?:\[!warning\]\s*⚠?\s*冲突|\[!caution\]\s*含未核验来源)$")
        | (is_head & (((F.col("nth_head") == 1) & heading.eqNullSafe(title)) | heading.isin(LABELS)))
        | (F.col("s").startswith("|") & F.col("s").endswith("|") & F.coalesce(separator(F.col("next")), F.lit(False)))
        | (anchored & tail.rlike(r"^[ \t，,。；;：:|]*$"))
        | (F.lit(allow_navigation) & ~anchored & (F.size(links) > 0) & ~F.exists(links, lambda t: t.contains("|")) & rest.isin(NAVIGATION))
        | F.col("s").rlike(f"^{NOT_FOUND}[。！？]?$")
    )
    return x.where(~exempt).select("page", "line_no", F.col("s").alias("line"))


def claim_pairs(pages: DataFrame) -> DataFrame:
    """page, line_no, anchor_no, claim (what precedes the anchor on its line), source and quote; headings and marked analysis are left out."""
    lines = numbered_lines(pages).withColumn("s", F.btrim("line", F.lit(" \t")))
    begins, quoted = F.col("s").rlike(r"^>\s*\[!note\]\s*分析"), F.col("s").startswith(">")
    upto = Window.partitionBy("page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("analysis", F.last(F.when(begins, F.lit(True)).when(~quoted, F.lit(False)), ignorenulls=True).over(upto))
    x = x.where(~begins & ~(quoted & F.coalesce("analysis", F.lit(False))))
    x = x.withColumn("line", F.when(quoted, F.regexp_replace("s", r"^[> ]+", "")).otherwise(F.col("line"))).where(~F.btrim("line", F.lit(" \t")).startswith("#"))
    x = x.withColumn("parts", F.split("line", ANCHOR)).withColumn("raw", F.regexp_extract_all("line", F.lit(ANCHOR), F.lit(0))).where(F.size("raw") > 0)
    each = x.select("page", "line_no", "parts", F.posexplode("raw").alias("anchor_no", "a"))
    claim = F.regexp_replace(F.get("parts", F.col("anchor_no")), r"^\s*(?:[-*+]\s+)?", "")
    return each.select("page", "line_no", "anchor_no", F.btrim(claim, F.lit(" ；;，,、")).alias("claim"), F.trim(F.regexp_extract("a", ANCHOR, 1)).alias("source"), F.trim(F.regexp_extract("a", ANCHOR, 2)).alias("quote"))


def with_context(pairs: DataFrame, sources: DataFrame, window: int = 120) -> DataFrame:
    """pairs with context: the source's text around the longest fragment of the quote, found in normal form, cut from the raw text, white space folded; empty if not found."""
    return contexts(pairs, sources, window)


def last_reply(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id and text of the last filled turn of that role."""
    return turns.where((F.col("role") == role) & (F.trim(F.coalesce("text", F.lit(""))) != "")).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def scan_answer(drafts: DataFrame, sources: DataFrame, root: str = "_md") -> DataFrame:
    """All violations of drafts (page, text): anchors, closures and bare lines."""
    a = check_anchors(anchors(drafts), sources, root).select("page", "line_no", "kind")
    c = check_closures(drafts).select("page", "line_no", "kind")
    b = bare_lines(drafts).select("page", "line_no", F.lit("unanchored").alias("kind"))
    return a.unionByName(c).unionByName(b)


def scan_case(pages: DataFrame, sources: DataFrame, names: DataFrame, root: str = "_md") -> DataFrame:
    """page, line_no and kind of all violations on wiki pages (log.md is free of the bare-line gate)."""
    parts = [
        check_anchors(anchors(pages), sources, root).select("page", "line_no", "kind"),
        dead_links(wikilinks(pages), names).select("page", "line_no", F.lit("dead link").alias("kind")),
        check_timelines(pages).select("page", "line_no", F.lit("timeline").alias("kind")),
        check_closures(pages),
        bare_lines(pages.where(~F.col("page").rlike(r"(^|/)log\.md$")), True).select("page", "line_no", F.lit("unanchored").alias("kind")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page_names(pages: DataFrame) -> DataFrame:
    """name: what links may name, the stems of pages (page, text) and the aliases that their frontmatter lists."""
    return pages.select(F.explode(F.concat(F.array(page_stem(F.col("page"))), F.coalesce(aliases(F.col("text")), F.array().cast("array<string>")))).alias("name")).distinct()


def page_stem(page: Column) -> Column:
    """A page's name without its folders and its suffix."""
    return F.regexp_extract(page, r"([^/]+?)(?:\.[^./]*)?$", 1)


@dataclass
class CaseScan:
    """What a scan of a case found: violations (page, line_no, kind), warnings (page, kind), and one row of totals: anchors, total, cited, skipped and unresolved sources."""

    violations: DataFrame
    warnings: DataFrame
    totals: DataFrame


def scan_whole_case(pages: DataFrame, sources: DataFrame, originals: DataFrame | None = None, log: DataFrame | None = None, root: str = "_md") -> CaseScan:
    """All gates over the wiki pages (page, text) of a case and its sources (rel, text[, quality]), from one table of lines.

    Names come from the pages themselves; the page's stem is its allowed title;
    log.md is free of the bare-line gate only.  With originals (source,
    content) the sources' provenance is checked too: a source without a version
    is a warning, all else a violation.  log has the ledger's lines (line_no,
    line); without it nothing is skipped.  A citation counts if its path is
    inside root, whether or not its text is found there.
    """
    lines = materialise(gate_lines(pages))
    found = materialise(anchors(pages, lines))
    titled = pages.select("page", page_stem(F.col("page")).alias("title"))
    is_log = F.col("page").rlike(r"(^|/)log\.md$")
    violations = [
        check_anchors(found, sources, root).select("page", "line_no", "kind"),
        dead_links(wikilinks(pages, lines), page_names(pages)).select("page", "line_no", F.lit("dead link").alias("kind")),
        check_timelines(pages, lines).select("page", "line_no", F.lit("timeline").alias("kind")),
        check_closures(pages, lines),
        bare_lines(titled.where(~is_log), True, lines.where(~is_log)).select("page", "line_no", F.lit("unanchored").alias("kind")),
    ]
    skips = skip_ledger(log) if log is not None else pages.sparkSession.createDataFrame([], "path string, has_reason boolean")
    cited = found.select(lexical_path(F.col("rel")).alias("rel")).where(F.col("rel").startswith(root + "/"))
    states = materialise(coverage(sources, cited, skips))
    warnings = states.where(F.col("state").isin("unresolved", "skipped without reason")).select(F.col("rel").alias("page"), F.col("state").alias("kind"))
    if originals is not None:
        stated = provenance_fields(F.col("text"))
        fields = sources.select("rel", stated.alias("p"))
        converted = fields.select("rel", *[F.col("p.fields")[n].alias(n) for n in ("provenance_version", "source", "source_sha256", "content_sha256")], F.col("p.body").alias("body"))
        said = materialise(check_provenance(converted, originals))
        violations.append(said.where("kind <> 'no version'").select(F.col("rel").alias("page"), F.lit(None).cast("int").alias("line_no"), "kind"))
        warnings = warnings.unionByName(said.where("kind = 'no version'").select(F.col("rel").alias("page"), "kind"))
    one = F.lit(1).alias("one")
    totals = found.agg(F.count("*").alias("anchors")).withColumn("one", F.lit(1)).join(coverage_totals(states).select("*", one), "one").drop("one")
    return CaseScan(reduce(DataFrame.unionByName, violations), warnings, totals)


def reconcile(outcomes: DataFrame, skips: DataFrame, source_total: DataFrame) -> DataFrame:
    """One row of counts: produced, registered, unresolved, source_total and accounted.

    outcomes has file and status (succeeded, warned, skipped_existing, failed,
    skipped_unsupported); failed and unsupported files need a ledger entry with
    a reason; files that no outcome accounts for count as one more unresolved.
    """
    open_ = outcomes.where(F.col("status").isin("failed", "skipped_unsupported")).join(skips.select(F.col("path").alias("file"), "has_reason"), "file", "left")
    totals = outcomes.agg(F.count_if(F.col("status").isin("succeeded", "warned", "skipped_existing")).alias("produced"), F.count("*").alias("accounted"))
    ledger = open_.agg(F.count_if("has_reason").alias("registered"), F.count_if(~F.coalesce("has_reason", F.lit(False))).alias("missing"))
    one = totals.withColumn("one", F.lit(1)).join(ledger.withColumn("one", F.lit(1)), "one").join(source_total.select("source_total").withColumn("one", F.lit(1)), "one")
    return one.select("produced", "registered", (F.col("missing") + (F.col("source_total") > F.col("accounted")).cast("int")).cast("bigint").alias("unresolved"), "source_total", "accounted")


# Files that a case must have, and the sentence that they must contain.
CASE_FILES, CASE_SENTENCE = ["AGENTS.md", "CLAUDE.md"], "答前必先检索"


def case_files(found: DataFrame) -> DataFrame:
    """name and kind (missing or hollow) of the case files that found (name, text) lacks or has without the sentence."""
    wanted = found.sparkSession.createDataFrame([(n,) for n in CASE_FILES], "name string")
    both = wanted.join(found.select("name", F.coalesce("text", F.lit("")).alias("text")), "name", "left")
    kind = F.when(F.col("text").isNull(), "missing").when(~F.contains("text", F.lit(CASE_SENTENCE)), "hollow")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("name", "kind")


def stop_decision(turns: DataFrame, sources: DataFrame, root: str = "_md") -> DataFrame:
    """For each conversation's last reply with anchors: conv_id, blocked and reasons (line:kind:source, in order); a reply without anchors passes."""
    replies = last_reply(turns).select(F.col("conv_id").cast("string").alias("page"), "text").where(F.col("text").rlike(ANCHOR))
    bad = check_anchors(anchors(replies), sources, root)
    reasons = bad.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("line_no", "anchor_no", "kind", "rel"))).alias("r"))
    said = F.transform("r", lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["kind"], x["rel"]))
    return replies.select("page").join(reasons, "page", "left").select(F.col("page").alias("conv_id"), F.col("r").isNotNull().alias("blocked"), F.coalesce(said, F.array().cast("array<string>")).alias("reasons"))
