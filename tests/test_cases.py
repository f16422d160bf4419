"""Cases of the gates, sections, outlines, pickers and the indexing path."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import chunking, convert, embedding, gates, graph, indexing, passages, postings, retrieval
from dossier.sources import files


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "text string").select(*columns).first()


def test_sections_are_stripped_of_all_white_space(spark):
    rows = spark.createDataFrame([("a", "\n\n# A\n\ntext\n\n# B\nx\n"), ("b", " \t\n"), ("c", "pre\n## B\n### C ##\n\n# D\n### E\ny\n")], "source string, text string")
    got = {s: [(r.heading_path, r.body) for r in chunking.sections(rows).where(F.col("source") == s).orderBy("sec_ord").collect()] for s in "abc"}
    assert got == {"a": [("A", "text"), ("B", "x")], "b": [("", "")], "c": [("", "pre"), ("B", ""), ("B > C", ""), ("D", ""), ("D > E", "y")]}


def test_outline_ends_with_the_last_line(spark):
    doc = "# A\n## B\ntext\n```\n# no\n```\n## C\n#### D\n# \n"
    got = graph.outline(spark.createDataFrame([("s", doc)], "source string, text string")).orderBy("node_id").collect()
    assert [(r.title, r.level, r.parent_id, r.line_start, r.line_end) for r in got] == [("A", 1, None, 1, 9), ("B", 2, 0, 2, 6), ("C", 2, 0, 7, 9), ("D", 4, 2, 8, 9)]


def test_timelines_take_dashes_on_pages_of_that_name(spark):
    page = "-2022年 a\n- 2021年5月 b\n* 2020年 c\n  - 2023年 d\n"
    rows = spark.createDataFrame([("x/时间线/p", page), ("时间线.md", page), ("other", page)], "page string, text string")
    assert [(r.page, r.line_no) for r in gates.check_timelines(rows).collect()] == [("x/时间线/p", 2)]


def test_closures_know_digits_and_three_operators_only(spark):
    said = ["1e3 == 1000", "0x10 == 16", "1,000 ＋ 2 == 1002", "2 × (3 - 1) ＝＝ 5", "1 == 1 == 1", "== 3", "7 / 1 == 7", "-2 + 3 == 1"]
    rows = spark.createDataFrame([("p", "\n".join(f"> [!check] {x}" for x in said))], "page string, text string")
    assert {r.line_no: r.kind for r in gates.check_closures(rows).collect()} == {1: "unparsable", 2: "unparsable", 4: "mismatch", 5: "unparsable", 6: "unparsable", 7: "unparsable"}


def test_context_is_found_by_the_longest_fragment(spark):
    sources = spark.createDataFrame([("s", "ab x " * 30 + "the <b>long</b>， fragment\n\n here " + "z" * 200)], "rel string, text string")
    pairs = spark.createDataFrame([("p", "s", "ab…the long, fragment"), ("p", "s", "not there"), ("p", "t", "x"), ("p", "s", "……")], "page string, source string, quote string")
    got = [r.context for r in gates.with_context(pairs, sources, 10).collect()]
    assert got.count("") == 3 and "ab x ab x the <b>long</b>， fragment here zz" in got


def test_anchors_outside_are_not_unmarked_too(spark):
    found = spark.createDataFrame([("p", 1, 0, "x/a", "t", False), ("p", 2, 0, "_md/a", "t", False)], "page string, line_no int, anchor_no int, rel string, snippet string, marked boolean")
    sources = spark.createDataFrame([("x/a", "t", "suspect"), ("_md/a", "t", "suspect")], "rel string, text string, quality string")
    assert sorted((r.line_no, r.kind) for r in gates.check_anchors(found, sources).collect()) == [(1, "outside"), (2, "unmarked")]


def test_stop_decision_and_case_files(spark):
    good, bad = "so 〔来源: _md/a：「the words」〕", "so 〔来源: _md/a：「other words」〕"
    turns = spark.createDataFrame([(1, 1, "assistant", bad), (1, 2, "assistant", good), (2, 1, "assistant", bad), (3, 1, "assistant", "no anchor")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.blocked, r.reasons) for r in gates.stop_decision(turns, spark.createDataFrame([("_md/a", "here are the words.")], "rel string, text string")).collect()}
    assert got == {"1": (False, []), "2": (True, ["1:mismatch:_md/a"])}
    rows = spark.createDataFrame([("AGENTS.md", "空"), ("x", "y")], "name string, text string")
    assert sorted(tuple(r) for r in gates.case_files(rows).collect()) == [("AGENTS.md", "hollow"), ("CLAUDE.md", "missing")]


def test_pickers_and_frontmatter(spark):
    page = "---\nquality: suspect\n类型: 案件主体\naliases: [甲, 乙 ,]\n---\n\nbody"
    r = one(spark, page, text.source_quality(F.col("text")).alias("q"), text.page_type(F.col("text")).alias("t"), text.aliases(F.col("text")).alias("a"), text.select_fields(text.frontmatter_map(F.col("text")), ["quality", "none"]).alias("f"))
    assert (r.q, r.t, r.a, r.f) == ("suspect", "案件主体", ["甲", "乙"], {"quality": "suspect"})
    r = one(spark, '{"a": "1"}', text.decode_meta(F.col("text")).alias("m"), text.decode_meta(F.lit("{broken")).alias("b"), text.encode_meta(F.create_map(F.lit("k"), F.lit("v"))).alias("e"))
    assert (r.m, r.b, r.e) == ({"a": "1"}, {}, '{"k":"v"}')
    made = text.frontmatter_text(F.lit("a: b"), F.lit("pdf"), F.lit("x"), F.lit("2024-01-01T10:00:00"), F.col("text"), F.lit(3), F.array(F.lit("low #1")), F.lit("ff"))
    whole = one(spark, "body", made.alias("w")).w
    assert whole.startswith('---\nprovenance_version: 1\nsource: "a: b"\nsource_type: pdf\nengine: x\npages: 3\nconverted_at: 2024-01-01T10:00:00\nsource_sha256: ff\ncontent_sha256: 230d8358') and whole.endswith('quality: suspect\nwarnings:\n  - "low #1"\n---\n\nbody')
    fields = one(spark, whole, text.provenance_fields(F.col("text")).alias("p")).p
    assert fields.body == "body" and fields.fields["source"] == "a: b"


def test_images_become_marks(spark):
    raw = 'a ![alt](x/y.png) <IMG src="p\\q.jpg" alt="z"> <img alt="only"> ![]() <div class="c"><div>\n</div> </div>end'
    assert one(spark, raw, convert.mark_images(F.col("text")).alias("t")).t == "a " + " ".join(f"〔图像：{n} —— 已省略未保留，请查原件〕" for n in ("y.png", "q.jpg", "only", "未命名")) + " end"
    assert one(spark, None, convert.mark_images(F.col("text")).alias("t")).t is None and one(spark, "plain", convert.mark_images(F.col("text")).alias("t")).t == "plain"


def test_passages_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abcabc"), (2, "xbcx"), (3, None), (4, "")], "doc_id bigint, body string")
    items = spark.createDataFrame([(7, "bc"), (8, "bc"), (9, "abc"), (10, ""), (11, None), (12, "none")], "item_id bigint, norm string")
    expected = [(1, 7), (1, 8), (1, 9), (2, 7), (2, 8)]
    assert sorted(tuple(r) for r in passages.passages(docs, items).collect()) == expected
    monkeypatch.setattr(passages, "PASSAGE_BYTES", 3)
    assert sorted(tuple(r) for r in passages.passages(docs, items).collect()) == expected
    assert passages.passages(docs, items.where("false")).count() == 0


def test_index_path_and_search(spark, tmp_path):
    class Failing(embedding.HashEmbedder):
        def embed_documents(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("bad text")
            return super().embed_documents(texts)

    class ByLength:
        def scores(self, query, texts):
            return [len(t) for t in texts]

    root = tmp_path / "case" / "_md"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("---\nkind: law\nother: x\n---\n# River\n\nThe quick river runs.\n\n# Stone\n\nA stone lies still.")
    (root / "sub" / "b.html").write_text("<h1>River</h1><p>banks of the river</p>")
    (root / "c.txt").write_text(" \n")
    (root / "d.pdf").write_bytes(b"%PDF")
    (root / "e.txt").write_text("poison here")
    (root / "skip.txt").write_text("left out")
    out = str(tmp_path / "index")
    run = lambda e: indexing.index_path(spark, str(root), out, e, root=str(tmp_path / "case"), exclude=("skip*",), fields=("kind",), parent_budget=400)
    said = run(Failing())
    assert (said["files_seen"], said["files_indexed"], said["files_skipped"]) == (5, 2, 3)
    assert said["skipped"] == [("_md/c.txt", indexing.NO_TEXT), ("_md/d.pdf", "ValueError: no extractor for .pdf"), ("_md/e.txt", "RuntimeError: bad text")]
    chunks = spark.read.parquet(f"{out}/chunks")
    assert chunks.count() == said["total_chunks"] and {r.meta for r in chunks.where("source = '_md/a.md'").collect()} == {'{"kind":"law"}'}
    assert indexing.index_model(spark, out) == "hash-64" and indexing.index_model(spark, f"{out}/none") is None
    assert [r.source for r in indexing.sources(spark, out).collect()] == ["_md/a.md", "_md/sub/b.html"] and indexing.repair(spark, out).first().in_sync
    by_count = retrieval.text_search(chunks, "river stone", 5).select("source", "ord", "score").collect()
    assert [tuple(r) for r in postings.search(spark, f"{out}/index", "river stone", 5).collect()] == [tuple(r) for r in by_count] and by_count
    assert postings.search(spark, f"{out}/index", "river", 5, prefix="_md/sub").count() == 1 and postings.search(spark, f"{out}/index", " ", 5).count() == 0
    vector = embedding.HashEmbedder().embed_query("river")
    hits = retrieval.hybrid_search(chunks, "river", vector, 2, reranker=ByLength(), index=f"{out}/index", parents=spark.read.parquet(f"{out}/parents")).collect()
    longest = sorted((len(r.text) for r in chunks.collect()), reverse=True)[:2]
    assert [r.score for r in sorted(hits, key=lambda r: -r.score)] == longest and all(r.score_kind == "rerank" and r.parent_text for r in hits)
    again = run(embedding.HashEmbedder())
    assert again["files_indexed"] == 3 and spark.read.parquet(f"{out}/chunks").count() == again["total_chunks"]

    class Broken(embedding.HashEmbedder):
        def embed_query(self, text):
            raise OSError("no model")

    with pytest.raises(OSError):
        run(Broken())


def test_gather_survives_a_channel(spark):
    lines = spark.createDataFrame([("s", 1, "ten 50,000 yuan")], "source string, line_no bigint, line string")

    def broken():
        raise RuntimeError("no index")

    got = retrieval.gather("q", ["50000", "gone"], lines, lines, broken)
    assert not got["rag"]["available"] and "no index" in got["rag"]["reason"]
    assert [r.term for r in got["grep"]["hits"].collect()] == ["50000"] and [r.term for r in got["grep"]["not_found"].collect()] == ["gone"]


def test_consent(monkeypatch):
    embedding.require_consent(True)
    embedding.require_consent(False, "http://127.0.0.1:11434")
    embedding.require_consent(False, "https://x.org", env={"ALLOW_EXTERNAL_PROCESSING": "Yes"})
    for url in ("http://localhost:1", "https://LOCALHOST/x", "127.8.9.10:80", "http://[::1]:5"):
        embedding.require_consent(False, url, env={})
    for url in (None, "https://x.org", "http://127.evil.org", "http://example.org", "http://127.0.0.1.evil.org", "http://localhost.evil.org", "http://evil.org/localhost", "http://127.0.0.1@evil.org", "http://[bad", "", "http://10.0.0.1"):
        with pytest.raises(PermissionError):
            embedding.require_consent(False, url, env={})


def test_files_are_written_beside_their_assets(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "text é", {"img/x.png": bytearray(b"1"), "../out.png": bytearray(b"2")}), ("../c.md", "no", {})], "rel string, text string, assets map<string,binary>")
    got = [tuple(r) for r in files.write_files(rows, str(tmp_path)).collect()]
    assert got == [("a/b.md", ["a/b.md", "a/img/x.png"])] and (tmp_path / "a/b.md").read_text() == "text é"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["b.md", "x.png"]
