"""Operators on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import chunking, convert, gates, graph, quality, retrieval, store
from dossier.sources import files


def column(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("x")).first().x


def test_text_functions(spark):
    assert column(spark, "**500,001**（元）<b>x</b>", text.evidence_norm) == "500001(元)x"
    assert column(spark, "a… b ...c", text.fragments) == ["a", "b", "c"]
    assert column(spark, "５００,０００ 元，", text.ocr_norm) == "500000元,"
    assert column(spark, "借款50,000元 Contract", text.tokens) == ["借款50", "000元", "contract"]
    assert column(spark, "于2022年6月9日", text.date_key) == [2022, 6, 9] and column(spark, "2021 年", text.date_key) == [2021]
    assert column(spark, "页#节|名", text.link_target) == "页"
    assert column(spark, "_md/../a/./b", text.lexical_path) == "a/b"
    assert column(spark, "---\nquality: suspect\n k: v\nsource_type: 'pdf'\nquality: ok\n---\nbody: no", text.frontmatter_map) == {"quality": "ok", "source_type": "pdf"}
    got = column(spark, '---\na: "x\\"y"\nb: 1\n---\n\nbody', text.provenance_fields)
    assert got.fields == {"a": 'x"y', "b": "1"} and got.body == "body"
    assert column(spark, "---\na: b\n---\nx\n y", text.single_line) == "x y"
    assert column(spark, "a,b， c,,", text.split_csv) == ["a", "b", "c"]


def test_quality_reasons(spark):
    rows = [(1, "abc", None, None), (2, "x" * 360, 30, None), (3, "y" * 40 + "�" * 5, None, None), (4, "a repeated line\n" * 40, None, None), (5, "clean text that is long enough", None, [0.99, 0.42, 0.95]), (6, "short\n" * 50, 1, [0.9])]
    got = {r.id: r.reasons for r in quality.reasons(spark.createDataFrame(rows, "id int, text string, pages int, conf array<double>"), pages="pages", confidences="conf").collect()}
    assert got == {1: ["near-empty output (3 chars)"], 2: ["avg 12 chars/page over 30 pages"], 3: ["garbled-char ratio 11.1%"], 4: ["line repeated 40x (possible OCR loop)"], 5: ["1 low-confidence regions, min 0.42"], 6: []}


def test_sections_and_outline(spark):
    docs = spark.createDataFrame([("d", "pre\n# A\n## B #\ntext\n### C\n## D\n# E")], "source string, text string")
    assert [(r.heading_path, r.body) for r in chunking.sections(docs).orderBy("sec_ord").collect()] == [("", "pre"), ("A", ""), ("A > B", "text"), ("A > B > C", ""), ("A > D", ""), ("E", "")]
    docs = spark.createDataFrame([("d", "# A\nx\n## B\n```\n# no\n```\n# D\n#tag")], "source string, text string")
    assert [(r.title, r.parent_id, r.line_start, r.line_end) for r in graph.outline(docs).orderBy("node_id").collect()] == [("A", None, 1, 6), ("B", 0, 3, 6), ("D", None, 7, 8)]


@pytest.mark.parametrize("budget,overlap", [(10, 0), (10, 4), (25, 10)])
def test_packing_keeps_units_in_order(spark, budget, overlap):
    units = [f"unit {i} " + "x" * (i * 7 % 30) for i in range(30)]
    chunks = spark.createDataFrame([(units,)], "u array<string>").select(chunking.pack(F.col("u"), budget, overlap, glue="|")).first()[0]
    size = lambda u: max(1, -(-len(u) // 4))
    seen = []
    for c in chunks:
        parts = c.split("|")
        fresh = [p for p in parts if p not in seen]
        assert parts[len(parts) - len(fresh) :] == fresh and sum(map(size, parts[: len(parts) - len(fresh)])) <= overlap
        assert len(fresh) == 1 or sum(map(size, parts)) <= budget + overlap
        seen += fresh
    assert seen == units


def test_hard_split_and_tables(spark):
    pieces = column(spark, "A" * 4000, lambda s: chunking.hard_split(s, 200))
    assert "".join(pieces) == "A" * 4000 and all(len(p) <= 800 for p in pieces)
    table = "\n".join(["| a | b |", "|---|---|", *[f"| {i} | value |" for i in range(60)]])
    pieces = column(spark, table, lambda s: chunking.table_pieces(s, 60))
    assert len(pieces) > 1 and all(p.startswith("| a | b |\n|---|---|\n") for p in pieces)
    assert [x for p in pieces for x in p.split("\n")[2:]] == table.split("\n")[2:]
    docs = spark.createDataFrame([("d", "# H\n" + "\n\n".join(f"paragraph {i} " + "word " * 12 for i in range(20)))], "source string, text string")
    chunks, parents = chunking.chunk(docs, 30, 0, parent_budget=90).collect(), {r.parent_ord: r.text for r in chunking.parents(docs, 90).collect()}
    assert [c.ord for c in chunks] == list(range(len(chunks)))
    for n, whole in parents.items():
        assert "\n\n".join(c.text for c in chunks if c.parent_ord == n) == whole


def test_fusion_and_floor(spark):
    hits = lambda rows: spark.createDataFrame([("d", o, s) for o, s in rows], "source string, ord int, score double")
    fused = retrieval.fuse(hits([(1, 0.9), (2, 0.8)]), hits([(2, 5.0), (3, 3.0)]), 5).collect()
    assert [r.ord for r in fused] == [2, 1, 3] and fused[0].score == round(1 / 61 + 1 / 60, 6)
    alone = retrieval.fuse(hits([(1, 0.9)]), hits([]), 5).collect()
    assert [(r.ord, r.score, r.score_kind) for r in alone] == [(1, 0.9, "cosine")]
    chunks = spark.createDataFrame([("caseA/x", 0, "loan contract", [1.0, 0.0]), ("caseB/y", 1, "loan", [0.0, 1.0]), ("z", 2, "zero", [0.0, 0.0])], "source string, ord int, text string, vector array<double>")
    assert [r.source for r in retrieval.vector_search(chunks, [1.0, 0.0], floor=0.5).collect()] == ["caseA/x"]
    assert [r.source for r in retrieval.text_search(chunks, "LOAN contract").collect()] == ["caseA/x", "caseB/y"]
    assert retrieval.text_search(chunks, "absent").count() == 0 and retrieval.hybrid_search(chunks, "  ", [1.0, 0.0]).count() == 0
    assert [r.source for r in retrieval.text_search(chunks, "loan", prefix="caseB").collect()] == ["caseB/y"]


def test_store(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "source string, ord int, text string")
    path = f"file://{tmp_path}/chunks"
    store.write_sources(rows(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")), path, buckets=2)
    store.write_sources(rows(("a", 0, "new")), path, buckets=2)
    assert sorted((r.source, r.text) for r in spark.read.parquet(path).collect()) == [("a", "new"), ("b", "z")]
    with pytest.raises(Exception, match="width"):
        store.check_width(spark.createDataFrame([([1.0, 2.0],)], "vector array<double>"), 3).collect()


def test_gates(spark):
    a = "〔来源: _md/s.md：「{}」〕"
    lines = ["# 页", "付款" + a.format("500,001元"), "付款" + a.format("500,000元… 借款") + "（未核验）", "裸事实", "## 结论", "> [!note] 分析", "> 推断", "| 列 | 值 |", "|---|---|", "在案件材料中未找到。", "[[甲|乙]] 见 [[无]]", "> [!check] 1,000 + 1 == 1,002"]
    pages = spark.createDataFrame([("wiki/p", "\n".join(lines), "页")], "page string, text string, title string")
    sources = spark.createDataFrame([("_md/s.md", "**500,000** 元整。甲方借款", "suspect")], "rel string, text string, quality string")
    got = {(r.line_no, r.kind) for r in gates.check_anchors(gates.anchors(pages), sources).collect()}
    assert got == {(2, "mismatch"), (2, "unmarked")}
    assert [r.line_no for r in gates.bare_lines(pages).orderBy("line_no").collect()] == [4, 11]
    names = spark.createDataFrame([("甲",)], "name string")
    assert [r.target for r in gates.dead_links(gates.wikilinks(pages), names).collect()] == ["无"]
    assert [(r.line_no, r.kind) for r in gates.check_closures(pages).collect()] == [(12, "mismatch")]
    pairs = gates.with_context(gates.claim_pairs(pages), sources.select("rel", "text")).orderBy("line_no").collect()
    assert [(p.claim, p.quote) for p in pairs] == [("付款", "500,001元"), ("付款", "500,000元… 借款")] and "500,000" in pairs[1].context
    log = spark.createDataFrame(list(enumerate(["## [2024-01-01] skip | a\\b.md", "- 原因：重复", "# 其他", "- 原因：无关", "## [2024-01-02] skip | c.md", "- 原因： "])), "line_no int, line string")
    assert {(r.path, r.has_reason) for r in gates.skip_ledger(log).collect()} == {("a/b.md", True), ("c.md", False)}
    with pytest.raises(ValueError):
        gates.evaluate("__import__('os')")
    assert gates.evaluate("1,000 * (2 - -3)") == 5000


def test_graph(spark):
    pages = spark.createDataFrame([("1", "甲", "案件主体", ["甲总"]), ("2", "丙", "案件主体", []), ("3", "合同", "法律关系", []), ("4", "导航", "导航", [])], "path string, stem string, page_type string, aliases array<string>")
    links = spark.createDataFrame([("合同", "甲总"), ("合同", "丙"), ("导航", "甲"), ("甲", "甲总")], "stem string, target string")
    nodes, edges, alias = graph.build(pages, links)
    assert {r.stem for r in graph.neighbors(edges, nodes, alias, "甲总").collect()} == {"合同"}
    assert graph.shortest_path(edges, "甲", "丙").first().path == ["甲", "合同", "丙"] and graph.shortest_path(edges, "甲", "无").count() == 0


def test_conversion(spark):
    marked = column(spark, "![a](x/y.png) <img alt='logo'><div> <div></div></div>", convert.mark_images)
    assert "y.png" in marked and "logo" in marked and "<div" not in marked
    assert column(spark, "<h1>T</h1><script>var x='</p>'</script><p>a<br>b", convert.html_text) == "# T\na\nb"
    pairs = spark.createDataFrame([("金额500000元", "金额800000元"), ("１２", "12")], "a string, b string")
    got = convert.cross_check(pairs).collect()
    assert got[0].digits == 1 and len(got[0].reasons) == 1 and got[1].reasons == []
    levels = spark.createDataFrame([("d", 0, 1), ("d", 2, 2), ("d", 9, 3)], "source string, line_no int, level int")
    docs = spark.createDataFrame([("d", "Title\nbody\n## Part")], "source string, text string")
    assert convert.apply_levels(docs, levels).first().text == "# Title\nbody\n## Part"
    assert column(spark, 'said {"1": 2, "3": 9}', convert.parse_levels) == {1: 2}
    angles = spark.createDataFrame([("f", 90, 0.5), ("f", 0, 0.5), ("f", 180, 0.1)], "file string, angle int, confidence double")
    assert convert.best_rotation(angles).first().angle == 0
    assert spark.createDataFrame([(b"PK\x03\x04zz",)], "c binary").select(convert.container(F.col("c"))).first()[0] == "ooxml"


def test_files_and_transcripts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.md", "b.txt", "Thumbs.db", "sub/c.md", "sub/skip.md"):
        (tmp_path / name).write_text(f"text of {name}")
    got = {r.rel for r in files.scan(spark, str(tmp_path), exclude=("skip*",)).select("rel").collect()}
    assert got == {"a.md", "b.txt", "sub/c.md"}
    (tmp_path / "t.jsonl").write_text('{"type":"user","message":{"content":"q"}}\njunk\n{"type":"assistant","message":{"content":[{"type":"text","text":"one"},{"type":"text","text":"two"}]}}\n')
    turns = files.transcript(spark, f"{tmp_path}/t.jsonl").withColumn("conv_id", F.lit(1))
    assert gates.last_reply(turns).first().text == "one\ntwo"
