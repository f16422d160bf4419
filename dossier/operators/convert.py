"""Conversion of files: routing, text of HTML, image marks, outcomes, provenance and comparison of readings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bind, ocr_norm, strip
from .matching import ratios

# Extensions by route, and names that systems leave behind.
NATIVE = ["docx", "xlsx", "pptx", "html", "htm", "csv", "json", "xml", "txt", "md", "epub"]
IMAGES = ["png", "jpg", "jpeg", "bmp", "tif", "tiff", "gif", "webp"]
LEGACY = ["doc", "wps"]
JUNK = ["Thumbs.db", "desktop.ini", ".DS_Store"]
NUMBER = r"\d+(?:年|月|日)?"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\?#]+)(?:[?#].*)?$", 1))


def route(path: Column, pdf_chars_per_page: Column | None = None, threshold: int = 50) -> Column:
    """native, ocr, legacy or unsupported; a PDF is native if its pages have text enough."""
    e = extension(path)
    pdf = F.coalesce(pdf_chars_per_page, F.lit(0.0)) if pdf_chars_per_page is not None else F.lit(0.0)
    return F.when(e == "pdf", F.when(pdf >= threshold, "native").otherwise("ocr")).when(e.isin(NATIVE), "native").when(e.isin(IMAGES), "ocr").when(e.isin(LEGACY), "legacy").otherwise("unsupported")


def container(content: Column) -> Column:
    """ooxml, ole2 or unknown by a file's first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("504B0304"), "ooxml").when(head == "D0CF11E0A1B11AE1", "ole2").otherwise("unknown")


def output_names(files: DataFrame, path: str = "path") -> DataFrame:
    """files with output: the stem with .md; where two share a stem the whole name with .md."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    return files.withColumn("_stem", stem).withColumn("output", F.concat(F.when(F.count("*").over(Window.partitionBy("_stem")) > 1, F.col(path)).otherwise(F.col("_stem")), F.lit(".md"))).drop("_stem")


def outcome(kind: Column, current: Column, error: Column, reasons: Column, changed: Column | None = None) -> Column:
    """A file's status: up to date, unsupported, failed (also if it changed meanwhile), then warned or succeeded."""
    return (
        F.when(current, "skipped_existing").when(kind == "unsupported", "skipped_unsupported")
        .when(error.startswith("unavailable"), "skipped_unsupported").when(error.isNotNull(), "failed")
        .when(F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False), "failed")
        .when(F.size(reasons) > 0, "warned").otherwise("succeeded")
    )


STATUSES = ("succeeded", "warned", "failed", "skipped_existing", "skipped_unsupported")


def report(outcomes: DataFrame) -> DataFrame:
    """One row of counts by status."""
    return outcomes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("files"))


def up_to_date(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """sources (rel, modified, hash) with current: an output (rel, modified, source_hash) is no older and records no other hash."""
    made = outputs.select("rel", F.col("modified").alias("_m"), F.col("source_hash").alias("_h"))
    return sources.join(made, "rel", "left").withColumn("current", F.coalesce((F.col("_m") >= F.col("modified")) & (F.col("_h").isNull() | (F.col("_h") == F.col("hash"))), F.lit(False))).drop("_m", "_h")


class _Text(HTMLParser):
    """Collects text; some tags become Markdown, scripts and styles vanish."""

    blocks = {"p", "div", "article", "section", "br", "li", "ul", "ol", "nav", "footer", "header", "table", "tr", "title", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.blocks:
            self.out.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag in self.blocks:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_to_text(markup: str | None) -> str:
    parser = _Text()
    parser.feed(markup or "")
    parser.close()
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(parser.out).split("\n")]
    return "\n".join(x for x in lines if x and x not in ("-", "#"))


def html_text(markup: Column | str) -> Column:
    """The text of HTML: blocks on lines of their own, headings and list items marked, scripts and styles left out."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(html_to_text)

    return run(markup)


# Fixed patterns and words: image references in Markdown and HTML, empty divisions, what a mark says.
IMAGE_MD, IMAGE_HTML = r"!\[([^\]]*)\]\(([^)]*)\)", r"<[iI][mM][gG]\b[^>]*?>"
EMPTY_DIVISION = r"(?i)<div\b[^>]*>\s*</div>"
MARK_BEGIN, MARK_END, UNNAMED = "〔图像：", " —— 已省略未保留，请查原件〕", "未命名"


def image_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(IMAGE_MD)) + F.regexp_count(text, F.lit(IMAGE_HTML))


def mark_images(text: Column | str) -> Column:
    """Image references become marks with the file's name, else the alternative text; empty divisions go, nested ones too."""
    s = F.col(text) if isinstance(text, str) else text
    either = f"{IMAGE_MD}|{IMAGE_HTML}"
    attribute = lambda m, which: F.regexp_extract(m, rf"(?i){which}\s*=\s*[\"']([^\"']*)[\"']", 1)

    def mark(m: Column) -> Column:
        markdown = m.startswith("!")
        path = F.when(markdown, F.regexp_extract(m, IMAGE_MD, 2)).otherwise(attribute(m, "src"))
        alt = F.when(markdown, F.regexp_extract(m, IMAGE_MD, 1)).otherwise(attribute(m, "alt"))
        name = F.coalesce(*[F.nullif(strip(x), F.lit("")) for x in (F.regexp_extract(path, r"([^/\\]*)$", 1), alt)], F.lit(UNNAMED))
        return F.concat(F.lit(MARK_BEGIN), name, F.lit(MARK_END))

    between, marks = F.split(s, either), F.transform(F.regexp_extract_all(s, F.lit(either), F.lit(0)), mark)
    marked = F.when(s.rlike(either), F.array_join(F.zip_with(between, marks, lambda x, m: F.concat(x, F.coalesce(m, F.lit("")))), "")).otherwise(s)
    # each round takes a level of nested divisions, and there are no more levels than divisions
    rounds = lambda t: F.aggregate(F.sequence(F.lit(0), F.regexp_count(t, F.lit(r"(?i)<div\b"))), t, lambda acc, _: F.when(acc.rlike(EMPTY_DIVISION), F.regexp_replace(acc, EMPTY_DIVISION, "")).otherwise(acc))
    return bind(marked, lambda t: F.when(t.rlike(EMPTY_DIVISION), rounds(t)).otherwise(t))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def digit_mismatches(a: Column, b: Column) -> Column:
    """Number tokens that differ place by place, plus the difference in their count."""
    x, y = numbers(a), numbers(b)
    shared = F.least(F.size(x), F.size(y))
    differ = F.zip_with(F.slice(x, 1, shared), F.slice(y, 1, shared), lambda p, q: (p != q).cast("int"))
    return F.abs(F.size(x) - F.size(y)) + F.aggregate(differ, F.lit(0), lambda s, v: s + v)


def disagreement(a: Column | str, b: Column | str) -> Column:
    """1 minus the share of matching blocks of two readings; 0 if both are empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1 - r for r in ratios(zip(x, y))], dtype="float64")

    return run(a, b)


def cross_check(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """pairs (a, b) with ratio, digits and reasons, compared in normal form."""
    n = pairs.withColumn("_a", ocr_norm(F.col("a"))).withColumn("_b", ocr_norm(F.col("b")))
    n = n.withColumn("ratio", disagreement("_a", "_b")).withColumn("digits", digit_mismatches(F.col("_a"), F.col("_b")))
    said = F.concat(F.format_string("双OCR分歧 %.1f%%", F.col("ratio") * 100), F.when(F.col("digits") > 0, F.format_string("，含 %d 处数字/日期位不一致", "digits")).otherwise(F.lit("")))
    return n.withColumn("reasons", F.when((F.col("digits") > 0) | (F.col("ratio") > threshold), F.array(said)).otherwise(F.array().cast("array<string>"))).withColumn("ratio", F.round("ratio", 4)).drop("_a", "_b")


def heading_candidates(docs: DataFrame, key: str = "source", text: str = "text", most: int = 80) -> DataFrame:
    """source, line_no (from 0) and text of short filled lines that are no table rows."""
    lines = docs.select(F.col(key).alias("source"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    s = F.btrim("line", F.lit(" \t\r\n"))
    return lines.where((s != "") & (F.length(s) <= most) & ~s.startswith("|") & (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) < 2)).select("source", "line_no", s.alias("text"))


def apply_levels(docs: DataFrame, levels: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """docs with heading marks on the lines that levels (source, line_no, level) names; other lines as they were."""
    per = levels.where(F.col("level").between(1, 6)).groupBy(F.col("source").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("line_no", "level"))).alias("_l"))
    bare = lambda x: F.btrim(F.regexp_replace(x, r"^\s*#{1,6}\s+", ""), F.lit(" \t"))
    line = lambda x, i: F.when(F.map_contains_key("_l", i), F.concat(F.repeat(F.lit("#"), F.element_at("_l", i)), F.lit(" "), bare(x))).otherwise(x)
    return docs.join(per, key, "left").withColumn(text, F.when(F.col("_l").isNull(), F.col(text)).otherwise(F.array_join(F.transform(F.split(text, "\n"), line), "\n"))).drop("_l")


def parse_levels(reply: Column) -> Column:
    """line_no to level from the JSON object in a model's reply; levels outside 1 to 6 are dropped."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "map<string,int>")
    kept = F.map_filter(parsed, lambda k, v: v.between(1, 6) & k.rlike(r"^\d+$"))
    return F.transform_keys(kept, lambda k, v: k.cast("int"))


def structured(candidates: Column, levels: Column, most_lines: int = 1500, most_share: float = 0.35) -> Column:
    """Whether a model's headings are taken, or why not."""
    n = F.size(levels)
    return F.when(candidates == 0, "no candidates").when(candidates > most_lines, "too many lines").when(levels.isNull(), "not parsed").when(n == 0, "none chosen").when(n / candidates > most_share, "too dense").otherwise("structured")


def best_rotation(angles: DataFrame, group: str = "file") -> DataFrame:
    """The angle of highest confidence for each file, the smallest of equal ones."""
    return angles.groupBy(group).agg(F.max_by("angle", F.struct("confidence", -F.col("angle"))).alias("angle"))


def safe_asset(rel: Column) -> Column:
    return ~rel.startswith("/") & ~F.array_contains(F.split(rel, r"[/\\]"), "..") & ~rel.rlike("^[A-Za-z]:")


def per_worker(rows: DataFrame, convert, schema: str) -> DataFrame:
    """Runs a converter (a function that makes one) once a worker; a row that fails gets its error and no text."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = convert()
        for f in frames:
            out = []
            for content in f["content"]:
                try:
                    out.append((one(content), None))
                except Exception as e:  # noqa: BLE001 - the outcome is a column
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield f.drop(columns=["content"]).assign(text=[o[0] for o in out], error=[o[1] for o in out])

    return rows.mapInPandas(task, schema)
