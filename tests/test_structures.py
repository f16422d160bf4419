"""Offset maps, ordered scans, shortest paths, archives and streams, against plain restatements."""

import random
import re
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from dossier.functions.text import EVIDENCE_DROP, EVIDENCE_FROM, EVIDENCE_TO
from dossier.operators import gates, graph, offsets, scans, snapshots
from dossier.sources import archives
from dossier.streaming import changes, incremental


# --- offset maps
def plain_context(text, quote, window):
    """By a map of every character, made one at a time."""
    mapped = dict(zip(EVIDENCE_FROM, EVIDENCE_TO))
    kept, at = [], 0
    while at < len(text):
        tag = re.compile("<[^>]*>").match(text, at)
        if tag:
            at = tag.end()
            continue
        c = mapped.get(text[at], text[at])
        if c not in EVIDENCE_DROP:
            kept.append((c, at))
        at += 1
    body = "".join(c for c, _ in kept)
    normal = lambda s: "".join(c for c in (mapped.get(x, x) for x in re.sub("<[^>]*>", "", s)) if c not in EVIDENCE_DROP)
    parts = [p for p in re.split(r"…+|\.{3,}", quote) if p.strip()]
    wanted = normal(max(parts, key=len)) if parts else ""
    p = body.find(wanted) if wanted else -1
    if p < 0:
        return ""
    return re.sub(r"\s+", " ", text[max(0, kept[p][1] - window) : kept[p + len(wanted) - 1][1] + 1 + window]).strip()


def test_contexts(spark):
    r = random.Random(6)
    signs = ["a", "b", "1", ",", "，", " ", "\n", "<", ">", "<b>", "</b>", "（", ")", "*", "|", "é", "金", "“"]
    texts = {f"t{i}": "".join(r.choice(signs) for _ in range(r.choice([0, 5, 60, 200]))) for i in range(25)}
    texts |= {"long": "x" * 300 + " <i>he</i>re， it — is " + "y" * 300, "odd": "a < b and c <", "tag": "<only>"}
    quotes = [(s, t[k : k + r.randint(1, 9)]) for s, t in texts.items() for k in (0, 3, 40)]
    quotes += [("long", "zz…hereit-is…q"), ("long", "here, it"), ("odd", "a<b"), ("odd", "c<"), ("tag", "only"), ("gone", "a"), ("long", ""), ("long", " … "), ("long", "x"), ("long", "..."), ("long", "ab....here")]
    pairs = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(quotes)], "i int, source string, quote string").repartition(3)
    sources = spark.createDataFrame([(s, t, "clash") for s, t in texts.items()], "rel string, text string, quote string")
    got = {x.i: x.context for x in offsets.contexts(pairs, sources, 7).collect()}
    assert got == {i: plain_context(texts[s], q, 7) if s in texts else "" for i, (s, q) in enumerate(quotes)}
    assert sum(bool(c) for c in got.values()) > 20
    none = spark.createDataFrame([(1, "long", None), (2, None, "x")], "i int, source string, quote string")
    assert [x.context for x in offsets.contexts(none, sources).collect()] == ["", ""]


# --- ordered scans
def test_scans_over_many_tasks(spark):
    r = random.Random(7)
    rows = [(i, r.choice([None, None, None, "a", "b", ""]), r.choice([None, 1, -2, 5])) for i in range(-50, 400)]
    frame = spark.createDataFrame(rows, "n int, v string, w int").repartition(7)
    last, total, expected = None, 0, []
    for n, v, w in rows:
        last, total = v if v is not None else last, total + (w or 0)
        expected.append((n, last, total))
    known = scans.last_known(frame, ["n"], "v", "seen")
    assert known.columns == ["n", "v", "w", "seen"]
    assert sorted((x.n, x.seen) for x in known.collect()) == [(n, s) for n, s, _ in expected]
    assert sorted((x.n, x.upto) for x in scans.running_sum(frame, ["n"], "w", "upto").collect()) == [(n, t) for n, _, t in expected]
    assert scans.last_known(frame.limit(0), ["n"], "v", "seen").count() == scans.running_sum(frame.limit(0), ["n"], "w", "s").count() == 0


def test_ledger_over_many_tasks(spark):
    """An entry's reason may lie in another task than its heading."""
    lines = []
    for k in range(30):
        lines += [f"## [2024-01-02] skip | d\\f{k % 12}.md", *["text"] * 9, "- 原因：r" if k % 4 == 0 else "- 原因： ", "# end", "- 原因：of nothing"]
    log = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string").repartition(5)
    got = {x.path: x.has_reason for x in gates.skip_ledger(log).collect()}
    assert got == {f"d/f{p}.md": any(k % 4 == 0 for k in range(30) if k % 12 == p) for p in range(12)}


# --- shortest paths
def plain_path(edges, start, goal):
    """The smallest of all shortest paths, by distances to the goal."""
    back = {}
    for a, b in edges:
        back.setdefault(b, set()).add(a)
    far, queue = {goal: 0}, deque([goal])
    while queue:
        n = queue.popleft()
        for m in back.get(n, ()):
            if m not in far:
                far[m] = far[n] + 1
                queue.append(m)
    if start not in far:
        return None
    path = [start]
    while path[-1] != goal:
        path.append(min(b for a, b in edges if a == path[-1] and far.get(b) == far[path[-1]] - 1))
    return path


def test_shortest_paths(spark):
    r = random.Random(8)
    for size, links, both in ((24, 34, True), (30, 70, False)):
        edges = {(f"n{r.randrange(size)}", f"n{r.randrange(size)}") for _ in range(links)}
        edges = {(a, b) for a, b in edges if a != b}
        edges |= {(b, a) for a, b in edges} if both else set()
        table = spark.createDataFrame(sorted(edges) + sorted(edges)[:3], "src string, dst string")
        for start, goal in [("n0", "n1"), ("n3", "n3")]:
            got = [(x.path, x.hops) for x in graph.shortest_path(table, start, goal).collect()]
            expected = plain_path(edges, start, goal)
            assert got == ([(expected, len(expected) - 1)] if expected else [])
    chain = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}") for i in range(5)], "src string, dst string")
    assert graph.shortest_path(chain, "c00", "c05").first().path == [f"c{i:02d}" for i in range(6)]
    assert graph.shortest_path(chain, "c05", "c00").count() == 0 and graph.shortest_path(chain, "absent", "c00").count() == 0


# --- archives
def test_archives_give_what_the_folder_gives(spark, tmp_path):
    texts = {f"d/{i}.md": f"text {i} é".encode() * i for i in range(30)}
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for name in list(texts)[k::2]:
                z.writestr(name, texts[name])
            z.writestr("d/", b"")
            for bad in ("../out.md", "/abs.md", "C:/x.md", "a/../../b.md"):
                z.writestr(bad, b"bad")
            z.writestr("image.png", b"\x89")
    (tmp_path / "note.txt").write_text("no archive")
    for size in (1 << 24, 200):
        found = archives.members(spark, str(tmp_path), ".md", size)
        assert {x.rel: bytes(x.content) for x in found.collect()} == texts
        assert found.rdd.getNumPartitions() == 2 if size > 200 else found.rdd.getNumPartitions() > 10
    one = archives.members(spark, f"file://{tmp_path}/0.zip").collect()
    assert sorted(x.rel for x in one) == sorted([*list(texts)[0::2], "image.png"]) and {x.archive for x in one} == {f"file://{tmp_path}/0.zip"}
    with pytest.raises(Exception, match="no archive member"):
        archives.members(spark, str(tmp_path), ".pdf").collect()
    with pytest.raises(Exception, match="absent"):
        archives.members(spark, str(tmp_path / "absent")).collect()
    rows = spark.createDataFrame([(f"x/{i}.txt", bytearray(b"a" * i)) for i in range(25)], "rel string, content binary").repartition(3)
    made = archives.write_archives(rows, str(tmp_path / "made"), 4).collect()
    assert sum(x.members for x in made) == 25 and max(x.members for x in made) == 4
    assert {x.rel: x.size for x in archives.members(spark, str(tmp_path / "made")).collect()} == {f"x/{i}.txt": i for i in range(25)}


# --- streams
def test_a_stream_of_changes_with_a_restart(spark, tmp_path):
    place = f"file://{tmp_path}"
    drop = lambda name, *rows: spark.createDataFrame(list(rows), "source string, modified string, text string").withColumn("modified", F.to_timestamp("modified")).coalesce(1).write.parquet(f"{place}/in/{name}")
    take = lambda: changes.ingest(spark, f"{place}/in", f"{place}/table", f"{place}/checkpoint", buckets=4)
    held = lambda: sorted((x.source, x.text) for x in snapshots.read(spark, f"{place}/table").collect())
    day = "2024-01-0{} 00:00:00".format
    drop("drop=1", ("a", day(2), "one"), ("b", day(2), "two"), ("b", day(3), "three"), (None, day(2), "no source"), ("n", None, "no time"))
    assert take() == 1 and held() == [("a", "one"), ("b", "three")]
    before = snapshots.latest(spark, f"{place}/table").number
    assert take() == 0  # nothing new
    drop("drop=2", ("a", day(4), "one"), ("b", day(1), "too late"))
    assert take() == 0 and snapshots.latest(spark, f"{place}/table").number == before  # unchanged, and older
    drop("drop=3", ("a", day(5), "four"), ("c", day(1), None), ("b", day(4), "other"), ("b", day(6), "three"))
    assert take() == 1 and snapshots.latest(spark, f"{place}/table").number == before + 1
    got = {x.source: x.text for x in snapshots.read(spark, f"{place}/table").collect()}
    assert got == {"a": "four", "b": "three", "c": None}
    # an older version of a source that was seen before the restart stays behind what its state holds
    drop("drop=4", ("a", day(3), "late"), ("c", day(2), "content"))
    assert take() == 1 and {x.source: x.text for x in snapshots.read(spark, f"{place}/table").collect()} == {"a": "four", "b": "three", "c": "content"}


def test_what_is_known_of_sources_lies_in_layers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "LAYERS", 2)
    place, day = f"file://{tmp_path}", "2024-01-0{} 00:00:00".format
    for k, rows in enumerate(([("a", day(4), "one"), ("b", day(1), "x")], [("b", day(2), "y")], [("a", day(3), "late"), ("b", day(3), "y"), ("c", day(1), "z")])):
        spark.createDataFrame(rows, "source string, modified string, text string").withColumn("modified", F.to_timestamp("modified")).coalesce(1).write.parquet(f"{place}/in/drop={k}")
        assert changes.ingest(spark, f"{place}/in", f"{place}/table", f"{place}/checkpoint", buckets=4) == 1
    assert sorted((x.source, x.text) for x in snapshots.read(spark, f"{place}/table").collect()) == [("a", "one"), ("b", "y"), ("c", "z")]
    # the second layer has all that was known; the third batch, and if it is run again, reads that one only
    known = lambda n: sorted((x.source, x.modified.day) for x in changes._known(spark, f"{place}/checkpoint", n).collect())
    assert changes._known(spark, f"{place}/checkpoint", 0) is None and known(2) == [("a", 4), ("b", 2)]
    assert known(3) == [("a", 4), ("b", 2), ("b", 3), ("c", 1)]


def test_windows_go_on_after_a_restart(spark, tmp_path):
    place = f"file://{tmp_path}"
    schema = "event_id bigint, ts timestamp, event_type string, value double"
    rows = [(i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:30:00", "ab"[i % 2], 1.0 * i) for i in range(240)]
    frame = spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    found = None
    for k, part in enumerate((F.col("event_id") < 100, F.col("event_id") >= 100)):
        frame.where(part).coalesce(1).write.parquet(f"{place}/in/drop={k}")
        found = incremental.windowed_counts(spark, f"{place}/in", schema, f"{place}/out", f"{place}/checkpoint")
    closed = [i for i in range(240) if i // 24 * 24 + i % 24 + 1 <= 239.5 - 24]
    assert sorted((x.n, x.total) for x in found.collect()) == sorted((1, 1.0 * i) for i in closed)
