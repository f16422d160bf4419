"""Structure-aware chunking as array expressions: sections, units, packing with overlap, tables and parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, count_tokens, split_lines, strip

HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
SENTENCE_FROM = 400  # paragraphs of more tokens are split into sentences, whatever the budget
# Fixed pattern: places in legal prose before which a unit may begin.
LEGAL = r"(?m)(第[一二三四五六七八九十百零\d]+条|^[（(][一二三四五六七八九十]+[)）]|^[一二三四五六七八九十]+、|本院认为|审理终结|如不服本判决|事实和理由|本院查明)"
Counter = Callable[[Column], Column]


def section_array(text: Column) -> Column:
    """A text's sections (heading_path, body) in order: a heading opens one; what precedes the first is one without a path if it is not blank.

    Headings are found once and folded once, with the stack of titles that are open.
    """
    head = "struct<i:int,level:int,title:string>"
    mark = lambda x, i: F.when(x.rlike(HEADING), F.struct(i.alias("i"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), strip(F.regexp_extract(x, HEADING, 2)).alias("title")))
    start = F.struct(F.array().cast(f"array<{head}>").alias("stack"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, h: Column) -> Column:
        open_ = lambda stack: F.struct(stack.alias("stack"), F.concat(acc["paths"], F.array(F.array_join(F.transform(stack, lambda x: x["title"]), " > "))).alias("paths"))
        return bind(F.concat(F.filter(acc["stack"], lambda x: x["level"] < h["level"]), F.array(h)), open_)

    body = lambda a, first, stop: strip(F.array_join(F.slice(a, first + 1, stop - first), "\n"))

    def split(a: Column) -> Column:
        def made(heads: Column) -> Column:
            end = lambda i: F.coalesce(F.get(heads, i)["i"], F.size(a))
            paths = F.aggregate(heads, start, step)["paths"]
            opened = bind(paths, lambda p: F.transform(heads, lambda h, i: F.struct(F.get(p, i).alias("heading_path"), body(a, h["i"] + 1, end(i + 1)).alias("body"))))
            return F.concat(F.array(F.struct(F.lit("").alias("heading_path"), body(a, F.lit(0), end(F.lit(0))).alias("body"))), opened)

        return bind(F.array_compact(F.transform(a, mark)), lambda heads: F.filter(made(heads), lambda s: (s["heading_path"] != "") | (s["body"] != "") | (F.size(heads) == 0)))

    return bind(split_lines(text), split)


def sections(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """source, sec_ord, heading_path and body of every section of every text."""
    return docs.select(F.col(key).alias("source"), F.posexplode(section_array(F.col(text))).alias("sec_ord", "s")).select("source", "sec_ord", "s.heading_path", "s.body")


def hard_split(unit: Column, budget: int, count: Counter = count_tokens) -> Column:
    """Equal slices of characters, as few as the budget allows; joined they are the unit."""
    pieces = F.ceil(count(unit) / budget)
    size = F.ceil(F.length(unit) / pieces).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length(unit) / size).cast("int") - 1), lambda i: F.substring(unit, i * size + 1, size))
    return F.when((count(unit) <= budget) | (unit == ""), F.array(unit)).otherwise(cut)


def units(text: Column, budget: int, count: Counter = count_tokens) -> Column:
    """Paragraphs, sentences of long paragraphs, slices of long sentences."""
    filled = lambda a: F.filter(F.transform(a, lambda x: strip(x)), lambda x: x != "")
    sentences = lambda p: F.when(count(p) <= SENTENCE_FROM, F.array(p)).otherwise(filled(F.split(p, r"(?<=[。！？.!?])\s*")))
    return F.flatten(F.transform(F.flatten(F.transform(filled(F.split(text, r"\n\s*\n")), sentences)), lambda u: hard_split(u, budget, count)))


def is_table_line(line: Column) -> Column:
    s = strip(line)
    return s.startswith("|") | (s.contains("|") & s.rlike(r"^[|\-: ]+$"))


def table_pieces(block: Column, budget: int, count: Counter = count_tokens) -> Column:
    """A table whole, or groups of its rows, each under the first two lines; with no row beyond those there is nothing to emit."""
    lines = F.split(block, "\n")
    head = F.slice(lines, 1, 2)
    state = lambda done, cur, n: F.struct(done.alias("done"), cur.alias("cur"), n.cast("int").alias("n"))
    top = F.array_join(head, "\n")
    none, empty = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    step = lambda a, row: F.when((F.size(a["cur"]) > 0) & (a["n"] + count(row) > budget), state(F.concat(a["done"], F.array(a["cur"])), F.array(row), count(top) + count(row))).otherwise(state(a["done"], F.concat(a["cur"], F.array(row)), a["n"] + count(row)))
    close = lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
    groups = F.aggregate(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), state(empty, none, count(top)), step, close)
    return F.when(count(block) <= budget, F.array(block)).otherwise(F.transform(groups, lambda g: F.concat(top, F.lit("\n"), F.array_join(g, "\n"))))


def structured_units(body: Column, budget: int, count: Counter = count_tokens) -> Column:
    """Runs of table lines stay together; prose is split, legal markers opening paragraphs."""

    def runs(lines: Column, flags: Column) -> Column:
        """Neighbouring lines of one kind as one block each."""
        first = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(flags, i) != F.get(flags, i - 1)))
        return bind(first, lambda starts: F.transform(starts, lambda at, k: F.struct(F.get(flags, at).alias("t"), F.array_join(F.slice(lines, at + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - at), "\n").alias("s"))))

    blocks = bind(F.split(body, r"\r?\n"), lambda lines: bind(F.transform(lines, is_table_line), lambda flags: runs(lines, flags)))
    clean = lambda s: strip(s)
    return F.flatten(F.transform(F.filter(blocks, lambda b: clean(b["s"]) != ""), lambda b: F.when(b["t"], table_pieces(clean(b["s"]), budget, count)).otherwise(units(F.regexp_replace(clean(b["s"]), LEGAL, "\n\n$1"), budget, count))))


def pack(parts: Column, budget: int, overlap: int = 0, count: Counter = count_tokens, glue: str = "\n\n") -> Column:
    """Greedy chunks of whole units; a new chunk begins with the longest run of last units within the overlap."""
    unit = "array<struct<u:string,n:int>>"
    sized = F.transform(parts, lambda u: F.struct(u.alias("u"), count(u).cast("int").alias("n")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"])
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(unit).alias("cur"), F.lit(0).alias("n"))
    text = lambda cur: F.array_join(F.transform(cur, lambda x: x["u"]), glue)
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"), total(cur).alias("n"))

    def tail(cur: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(1), F.size(cur)), lambda k: total(F.slice(cur, F.size(cur) - k + 1, k)) <= overlap)
        return F.slice(cur, F.size(cur) - F.coalesce(F.array_max(fits), F.lit(0)) + 1, F.coalesce(F.array_max(fits), F.lit(0)))

    def step(a: Column, x: Column) -> Column:
        kept = tail(a["cur"]) if overlap > 0 else F.array().cast(unit)
        full = (F.size(a["cur"]) > 0) & (a["n"] + x["n"] > budget)
        return F.when(full, state(F.concat(a["done"], F.array(text(a["cur"]))), F.concat(kept, F.array(x)))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["cur"], F.array(x)).alias("cur"), (a["n"] + x["n"]).alias("n")))

    return F.aggregate(sized, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(text(a["cur"])))).otherwise(a["done"]))


def _blocks(text: Column, budget: int, strategy: str, parent_budget: int | None, count: Counter) -> tuple[Column, Callable[[Column], Column]]:
    """A text's blocks (heading_path, parent_ord, body) that chunks do not cross, and how a block's body is cut into units."""
    none = F.lit(None).cast("int")
    if strategy == "structure":
        whole, cut = section_array(text), lambda s: structured_units(s, budget, count)
    else:
        whole = bind(strip(text), lambda s: F.filter(F.array(F.struct(F.lit("").alias("heading_path"), s.alias("body"))), lambda x: x["body"] != ""))
        cut = lambda s: F.when((count(s) <= budget) & F.lit(parent_budget is None), F.array(s)).otherwise(units(s, budget, count))
    if parent_budget:
        return parent_array(whole, parent_budget, cut if strategy != "structure" else lambda s: structured_units(s, parent_budget, count), count), cut
    return F.transform(whole, lambda s: F.struct(s["heading_path"].alias("heading_path"), none.alias("parent_ord"), s["body"].alias("body"))), cut


def parent_array(whole: Column, budget: int, cut: Callable[[Column], Column], count: Counter = count_tokens) -> Column:
    """Sections (heading_path, body) as parents: body is the parent, parent_ord its number in the text."""
    packed = F.flatten(F.transform(whole, lambda s: F.transform(pack(cut(s["body"]), budget, 0, count), lambda t: F.struct(s["heading_path"].alias("heading_path"), t.alias("body")))))
    return F.transform(packed, lambda p, i: F.struct(p["heading_path"].alias("heading_path"), i.alias("parent_ord"), p["body"].alias("body")))


def chunk(docs: DataFrame, budget: int = 800, overlap: int = 100, strategy: str = "structure", parent_budget: int | None = None, key: str = "source", text: str = "text", count: Counter = count_tokens) -> DataFrame:
    """source, ord, heading_path, parent_ord and text of each row's chunks; a row is chunked where it lies, nothing is shuffled.

    "structure" packs each section by itself; any other strategy packs the
    whole text, which stays one chunk if it fits.  With parent_budget, chunks
    are packed inside parents that never cross sections; parents() has those.
    """
    blocks, cut = _blocks(F.col(text), budget, strategy, parent_budget, count)
    made = F.flatten(F.transform(blocks, lambda b: F.transform(pack(cut(b["body"]), budget, overlap, count), lambda t: F.struct(b["heading_path"].alias("heading_path"), b["parent_ord"].alias("parent_ord"), t.alias("text")))))
    return docs.select(F.col(key).alias("source"), F.posexplode(made).alias("ord", "x")).select("source", "ord", "x.heading_path", "x.parent_ord", "x.text")


def parents(docs: DataFrame, budget: int, strategy: str = "structure", key: str = "source", text: str = "text", count: Counter = count_tokens) -> DataFrame:
    """source, parent_ord and text of the parents of every text."""
    if strategy == "structure":
        whole, cut = section_array(F.col(text)), lambda s: structured_units(s, budget, count)
    else:
        whole, cut = F.array(F.struct(F.lit("").alias("heading_path"), F.col(text).alias("body"))), lambda s: units(s, budget, count)
    return docs.select(F.col(key).alias("source"), F.explode(parent_array(whole, budget, cut, count)).alias("p")).select("source", "p.parent_ord", F.col("p.body").alias("text"))


def composed(heading_path: Column, text: Column) -> Column:
    """What is embedded: the breadcrumb, a blank line, the text."""
    return F.when(heading_path != "", F.concat(heading_path, F.lit("\n\n"), text)).otherwise(text)
