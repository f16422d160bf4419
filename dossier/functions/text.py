"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that comparisons of evidence map or drop.
EVIDENCE_FROM = "，（）：；“”‘’－—–"
EVIDENCE_TO = ",():;\"\"''---"
EVIDENCE_DROP = "　 \t\r\n,|*#>`~_"
# Full-width forms and CJK punctuation with their ASCII forms.
WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CJK_MARKS = "，。、；：（）％～－"
ASCII_MARKS = ",.,;:()%~-"
# Punctuation that never counts as garbled.
ALLOWED_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~，。、；：？！“”‘’（）《》【】〈〉「」『』…—–·～％"
# Fixed patterns: an evidence anchor, a wiki link, a partial date.
ANCHOR = r"〔来源:\s*(.+?)：「(.+?)」〕"
WIKILINK = r"\[\[([^\]\n]+?)\]\]"
DATE = r"(\d{4})\s*年(?:\s*(\d{1,2})\s*月)?(?:\s*(\d{1,2})\s*日)?"
TOKEN = r"[\p{L}\p{N}]+"
CJK_RUN = r"[\x{4E00}-\x{9FFF}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates an expression once and hands it to a lambda."""
    return F.transform(F.array(value), body)[0]


#: White space as stripping takes it, and what ends a line.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(s: Column) -> Column:
    """Without any white space at both ends."""
    return F.btrim(s, F.lit(WHITE))


def split_lines(s: Column) -> Column:
    """The lines of a text; an end of line at the very end begins no further one."""
    return bind(F.split(s, LINE_END), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def evidence_norm(s: Column) -> Column:
    """Drops paired tags and formatting, unifies punctuation; digits and letters stay exact.  Mapped commas are dropped too."""
    plain = F.regexp_replace(s, r"<[^>]*>", "")
    return F.translate(F.translate(plain, EVIDENCE_FROM, EVIDENCE_TO), EVIDENCE_DROP, "")


def fragments(snippet: Column) -> Column:
    """The parts of a snippet between ellipses, without empty ones."""
    return F.filter(F.transform(F.split(snippet, r"…+|\.{3,}"), lambda x: strip(x)), lambda x: x != "")


def ocr_norm(s: Column) -> Column:
    """For comparing two readings: half-width forms, ASCII punctuation, no thousands separators, no white space."""
    narrow = F.translate(F.translate(F.coalesce(s, F.lit("")), WIDE, NARROW), CJK_MARKS, ASCII_MARKS)
    return F.regexp_replace(F.regexp_replace(narrow, r"(?U)(?<=\d),(?=\d{3}\b)", ""), r"(?U)\s+", "")


def filled_chars(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"(?U)\s+", ""))


def garbled_chars(s: Column) -> Column:
    """Characters that are neither white space, letters, digits nor known punctuation."""
    rest = F.regexp_replace(s, r"(?U)[\s\p{L}\p{N}]+", "")
    return F.length(F.translate(rest, ALLOWED_MARKS, ""))


def tokens(s: Column) -> Column:
    """Lower-cased runs of letters and digits; runs of CJK ideographs as their bigrams."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(TOKEN), F.lit(0))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
    # few texts have such runs; a text without them is not gone through again, token by token
    return F.when(s.rlike(CJK_RUN), F.flatten(F.transform(runs, lambda x: F.when(x.rlike(f"^{CJK_RUN}$"), pairs(x)).otherwise(F.array(x))))).otherwise(runs)


def count_tokens(s: Column) -> Column:
    """The default estimate: a token for each four characters, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(s) / 4)).cast("int")


def date_key(s: Column) -> Column:
    """The first partial date as an array of year[, month[, day]]; null without one."""
    got = [F.nullif(F.regexp_extract(s, DATE, i), F.lit("")).cast("int") for i in (1, 2, 3)]
    return F.when(got[0].isNotNull(), F.array_compact(F.array(*got)))


def link_target(link: Column) -> Column:
    """A wiki link's page: before the bar, then before the hash."""
    return strip(F.substring_index(F.substring_index(link, "|", 1), "#", 1))


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def split_csv(s: Column) -> Column:
    """Parts between ASCII or CJK commas, trimmed, none empty."""
    return F.filter(F.transform(F.split(s, "[,，]"), lambda x: strip(x)), lambda x: x != "")


def lexical_path(path: Column) -> Column:
    """Resolves . and .. in a relative path without a file system; steps above the root stay as .."""
    parts = F.filter(F.split(posix(path), "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def frontmatter_block(s: Column) -> Column:
    """Raw dialect: what lies between a leading --- and the next line that begins with it; empty if never closed."""
    return F.regexp_extract(s, r"(?s)\A---(.*?)\n---", 1)


def frontmatter_map(s: Column) -> Column:
    """Index dialect: key: value lines up to --- or the end; lines with a lead of space, tab, # or - are skipped; later keys win."""
    lines = F.split(s, r"\r?\n")
    body = F.slice(lines, 2, F.size(lines))
    end = F.coalesce(F.nullif(F.array_position(F.transform(body, lambda x: F.trim(x)), F.lit("---")), F.lit(0)), F.size(body) + 1)
    used = F.filter(F.slice(body, 1, end.cast("int") - 1), lambda x: ~x.rlike(r"^[ \t#-]") & x.contains(":"))
    pairs = F.transform(used, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.substr(x, F.instr(x, ":") + 1)), r"^[\"']+|[\"']+$", "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    found = F.map_from_arrays(keys, F.transform(keys, last))
    return F.when(F.trim(lines[0]) == "---", found).otherwise(F.create_map().cast("map<string,string>"))


def provenance_fields(s: Column) -> Column:
    """Provenance dialect: struct of fields (map) and body; a closing fence and one blank line are required, else no fields and the whole text."""
    fence = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n\r?\n"
    head = F.regexp_extract(s, fence, 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.contains(":") & ~x.rlike(r"^[\s-]"))
    value = lambda x: bind(F.trim(F.substr(x, F.instr(x, ":") + 1)), lambda v: F.when(v.rlike(r'^".*"$'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"), v)).otherwise(v))
    keys = F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1)))
    has = s.rlike(fence)
    return F.struct(
        F.when(has, F.map_from_arrays(keys, F.transform(lines, value))).otherwise(F.create_map().cast("map<string,string>")).alias("fields"),
        F.when(has, F.regexp_replace(s, fence, "")).otherwise(s).alias("body"),
    )


def single_line(s: Column) -> Column:
    """Without leading frontmatter, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?s)\A\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", ""), r"(?U)\s+", " "))


def anchor(source: Column, snippet: Column, quality: Column | None = None) -> Column:
    plain = F.concat(F.lit("〔来源: "), source, F.lit("：「"), snippet, F.lit("」〕"))
    return plain if quality is None else F.concat(plain, F.when(quality == "suspect", F.lit("（未核验）")).otherwise(F.lit("")))


def yaml_value(s: Column) -> Column:
    """A scalar as it is, or in double quotes if YAML would read it otherwise: a colon before a space or at the end, # " or a line end in it, white space around it."""
    risky = s.contains(": ") | s.endswith(":") | s.rlike('[#"\n]') | (strip(s) != s)
    return F.when(risky, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(s)


def frontmatter_text(source: Column, source_type: Column, engine: Column, converted_at: Column, body: Column, pages: Column | None = None, warnings: Column | None = None, source_sha256: Column | None = None) -> Column:
    """A file's whole text: the block of its provenance, a blank line, the body; with warnings it is marked as suspect."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    content = F.sha2(body.cast("binary"), 256)
    source_hash = F.lit(None).cast("string") if source_sha256 is None else source_sha256
    noted = F.coalesce(warnings, F.array().cast("array<string>")) if warnings is not None else F.array().cast("array<string>")
    head = F.array(
        F.lit("---"),
        F.when(source_hash.isNotNull(), "provenance_version: 1"),
        line("source", yaml_value(source)),
        line("source_type", yaml_value(source_type)),
        line("engine", yaml_value(engine)),
        line("pages", pages.cast("string")) if pages is not None else F.lit(None).cast("string"),
        line("converted_at", yaml_value(converted_at)),
        line("source_sha256", source_hash),
        line("content_sha256", content),
        F.when(F.size(noted) > 0, "quality: suspect\nwarnings:"),
    )
    lines = F.concat(F.array_compact(head), F.transform(noted, lambda x: F.concat(F.lit("  - "), yaml_value(x))), F.array(F.lit("---\n\n")))
    return F.concat(F.array_join(lines, "\n"), body)


def _picked(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(frontmatter_block(text), pattern, 1), F.lit(""))


def source_quality(text: Column) -> Column:
    """The quality that a file's frontmatter states, or null."""
    return _picked(text, r"(?m)^quality:\s*(\S+)")


def page_type(text: Column) -> Column:
    """The type that a page's frontmatter states, or an empty string."""
    return F.coalesce(_picked(text, r"(?m)^\s*类型:\s*(\S+)"), F.lit(""))


def aliases(text: Column) -> Column:
    """The names in the frontmatter's list of aliases."""
    listed = F.coalesce(_picked(text, r"aliases:\s*\[(.*?)\]"), F.lit(""))
    return F.filter(F.transform(F.split(listed, ","), strip), lambda x: x != "")


def select_fields(fields: Column, names: list[str]) -> Column:
    """The named fields that a map has."""
    return F.map_filter(fields, lambda k, v: k.isin(names))


def encode_meta(fields: Column) -> Column:
    """A map as JSON."""
    return F.to_json(fields)


def decode_meta(s: Column) -> Column:
    """JSON as a map; absent or broken JSON is an empty one."""
    return F.coalesce(F.from_json(s, "map<string,string>"), F.create_map().cast("map<string,string>"))
