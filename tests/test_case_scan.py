"""A whole case scanned at once, hits with anchors, single files, and what a missing root says."""

import hashlib

import pytest

from dossier.operators import embedding, gates, indexing, retrieval
from dossier.sources import files


def test_whole_case(spark):
    a = "〔来源: _md/{}：「{}」〕"
    pages = [
        ("wiki/甲.md", "---\naliases: [甲公司, 老甲]\n---\n# 甲\n付款" + a.format("s.md", "500,000元") + "\n见 [[乙]] [[乙公司]]\n裸事实"),
        ("wiki/时间线/乙.md", "# 乙\n- 2024年3月 " + a.format("t.md", "later") + "\n- 2024年2月 " + a.format("t.md", "earlier") + "\n- 2024年 " + a.format("x/../t.md", "earlier") + "\n[[老甲]] [[无]]"),
        ("wiki/log.md", "# 账\n## [2024-01-02] skip | _md/skipped.md\n- 原因：重复\n## [2024-01-02] skip | _md/silent.md\n- 原因：\n## [2024-01-02] skip | _md/s.md\n> [!check] 1 + 1 == 3"),
    ]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = lambda body, source, original: f"---\nprovenance_version: 1\nsource: {source}\nsource_sha256: {sha(original)}\ncontent_sha256: {sha(body)}\n---\n\n{body}"
    sources = [("_md/s.md", head("共 500,000 元整", "s.pdf", "raw s"), None), ("_md/t.md", head("earlier, then later", "t.pdf", "raw t"), "suspect"), ("_md/skipped.md", "old text", None), ("_md/silent.md", head("x", "gone.pdf", "raw"), None), ("_md/free.md", head("y", "s.pdf", "other"), None)]
    originals = spark.createDataFrame([("s.pdf", bytearray(b"raw s")), ("t.pdf", bytearray(b"raw t"))], "source string, content binary")
    table = spark.createDataFrame(pages, "page string, text string").repartition(3)
    log = gates.numbered_lines(table.where("page = 'wiki/log.md'")).select("line_no", "line")
    got = gates.scan_whole_case(table, spark.createDataFrame(sources, "rel string, text string, quality string"), originals, log)
    assert {tuple(r) for r in got.violations.collect()} == {
        ("wiki/甲.md", 6, "dead link"), ("wiki/甲.md", 7, "unanchored"),
        ("wiki/时间线/乙.md", 2, "unmarked"), ("wiki/时间线/乙.md", 3, "unmarked"), ("wiki/时间线/乙.md", 4, "unmarked"),
        ("wiki/时间线/乙.md", 3, "timeline"), ("wiki/时间线/乙.md", 5, "dead link"),
        ("wiki/log.md", 7, "mismatch"), ("_md/silent.md", None, "missing original"), ("_md/free.md", None, "original changed"),
    }
    assert {tuple(r) for r in got.warnings.collect()} == {("_md/skipped.md", "no version"), ("_md/silent.md", "skipped without reason"), ("_md/free.md", "unresolved")}
    assert got.totals.collect()[0].asDict() == {"anchors": 4, "total": 5, "cited": 2, "skipped": 2, "unresolved": 1}
    none = gates.scan_whole_case(table.where("false"), spark.createDataFrame(sources, "rel string, text string, quality string"))
    assert none.violations.count() == 0 and none.warnings.count() == 5 and none.totals.collect()[0].anchors == 0


def test_names_of_pages(spark):
    pages = spark.createDataFrame([("a/b.c.md", "---\naliases: [x, ,y]\n---\n"), ("plain", "no frontmatter"), ("d/e.md", "---\naliases: []\n---")], "page string, text string")
    assert {r.name for r in gates.page_names(pages).collect()} == {"b.c", "x", "y", "plain", "e"}


def test_hits_with_anchors(spark):
    hits = [("s1", "章 > 条\n\n正文  一\n二", "章 > 条", None), ("s2", "章 >  条 \r\n \r\n正文", "章 > 条", "suspect"), ("s3", "other\n\n正文", "章", "ok"), ("s4", "---\nk: v\n---\n体", None, None), ("s5", "章", "章", None)]
    got = {r.source: (r.anchor, r.unverified) for r in retrieval.enrich(spark.createDataFrame(hits, "source string, text string, heading_path string, quality string")).collect()}
    assert got == {
        "s1": ("〔来源: s1：「正文 一 二」〕", False), "s2": ("〔来源: s2：「正文」〕（未核验）", True), "s3": ("〔来源: s3：「other 正文」〕", False),
        "s4": ("〔来源: s4：「体」〕", False), "s5": ("〔来源: s5：「章」〕", False),
    }
    assert retrieval.enrich(spark.createDataFrame([("s", "t")], "source string, text string")).first().anchor == "〔来源: s：「t」〕"


def test_single_files_and_roots(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "x.md").write_text("# River\n\nThe river runs.")
    (root / "y.odd").write_text("left out of a folder")
    assert [r.rel for r in files.scan(spark, str(root)).collect()] == ["sub/x.md"]
    assert [r.rel for r in files.scan(spark, str(root / "y.odd")).collect()] == ["y.odd"]
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(root / "absent"))
    out = str(tmp_path / "index")
    good = indexing.index_file(spark, str(root / "sub" / "x.md"), out, embedding.HashEmbedder(), root=str(root))
    assert good == {"source": "sub/x.md", "indexed": True, "chunks": 1}
    bad = indexing.index_file(spark, str(root / "y.odd"), out, embedding.HashEmbedder(), root=str(root))
    assert bad == {"source": "y.odd", "indexed": False, "chunks": 0, "reason": "ValueError: no extractor for .odd"}
    gone = indexing.index_file(spark, str(root / "gone.md"), out, embedding.HashEmbedder())
    assert not gone["indexed"] and gone["reason"].startswith("FileNotFoundError") and gone["source"].endswith("/a+b (c)/gone.md")
    assert [r.source for r in indexing.sources(spark, out).collect()] == ["sub/x.md"]


def test_an_index_that_is_kept(spark, tmp_path):
    """Runs over changed files: hits are those of the chunks as they are, and an older reader keeps its chunks."""
    from dossier.operators import snapshots

    root, out = tmp_path / "case", str(tmp_path / "index")
    root.mkdir()
    (root / "a.md").write_text("# River\n\nThe quick river runs.\n\n# Stone\n\nA stone lies still.")
    (root / "b.md").write_text("banks of the river")
    run = lambda: indexing.index_path(spark, str(root), out, embedding.HashEmbedder(), root=str(root), parent_budget=400, keep=True)
    assert run()["files_indexed"] == 2
    opened = indexing.chunks(spark, out)
    before = sorted((r.source, r.text) for r in opened.collect())
    (root / "a.md").write_text("# River\n\nThe river is gone.")
    (root / "c.md").write_text("a new river, and a stone")
    assert run()["files_indexed"] == 3
    now = indexing.chunks(spark, out)
    assert [r.source for r in indexing.sources(spark, out).collect()] == ["a.md", "b.md", "c.md"] and "gone" in now.where("source = 'a.md'").first().text
    assert sorted((r.source, r.text) for r in opened.collect()) == before and len(snapshots.history(spark, f"{out}/chunks")) == 2
    for query in ("river stone", "quick"):
        by_count = [tuple(r) for r in retrieval.text_search(now, query, 5).select("source", "ord", "score").collect()]
        assert [tuple(r) for r in retrieval.indexed_hits(now, f"{out}/index", query, 5, ("source", "ord"), None).select("source", "ord", "score").orderBy("score", ascending=False).collect()] == by_count
    assert indexing.repair(spark, out).first().in_sync
    hits = retrieval.hybrid_search(now, "river", embedding.HashEmbedder().embed_query("river"), 2, index=f"{out}/index", parents=snapshots.read(spark, f"{out}/parents")).collect()
    assert len(hits) == 2 and all(r.parent_text for r in hits)


def test_larger_tables_make_more_tasks(spark, monkeypatch):
    """Texts of sources and lines of pages are dealt by their bytes, not to the session's number of tasks alone; the rows stay the same."""
    from dossier.sources import scratch

    a = "〔来源: _md/{}：「{}」〕"
    pages = spark.createDataFrame([(f"p{i}", f"# p{i}\n付款" + a.format(i, "word " + str(i if i % 3 else "no")) + f"\n裸 {i}\n\n```\nx") for i in range(60)], "page string, text string")
    sources = spark.createDataFrame([(f"_md/{i}", None if i == 7 else f"word {i} " * 9) for i in range(55)], "rel string, text string")
    violations = lambda: (gates.check_anchors(gates.anchors(pages), sources), gates.bare_lines(pages))
    rows = lambda found: [sorted(map(tuple, x.collect())) for x in found]
    tasks = lambda found: [x.rdd.getNumPartitions() for x in found]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = rows(violations())
        n_bytes = sum(scratch.ROW_BYTES + len(r.text or "") for r in sources.collect())
        monkeypatch.setattr(scratch, "TASK_BYTES", 1000)
        found = violations()
        assert tasks(found)[0] == -(-n_bytes // 1000) and tasks(found)[1] > 30
        assert rows(found) == before and len(before[0]) == 24 and len(before[1]) > 60
        assert scratch.by_size(sources.where("false"), "text", "rel").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
