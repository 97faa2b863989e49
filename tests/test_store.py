import pytest
from pyspark.sql import functions as F

from trailweave import stored
from trailweave.sources.store import CHANGES, GraphStore, full_edges
from trailweave.streaming.feed import apply_changes, change_stream, requests_per_minute, run_to_end


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def objects(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, content string")


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, relation string, dst string, weight double")


def pairs(store):
    return sorted((e.src, e.relation, e.dst, e.weight) for e in store.edges.collect())


def test_upsert_delete_and_versions(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "s"))
    assert len(s) == 0
    s.put(objects(spark, ("a", "1"), ("b", "2")), edges(spark, ("a", "r", "b", 1.0), ("a", "r", "z", 1.0), ("b", "r", "a", 1.0)))
    assert len(s) == 2 and "a" in s and "z" not in s and [r.id for r in s.dangling().collect()] == ["z"]
    follower = GraphStore(spark, s.path, read_only=True)
    s.put(objects(spark, ("a", "new")), edges(spark, ("a", "q", "b", 2.0), ("a", "q", "b", 3.0)))
    assert pairs(s)[-1] == ("b", "r", "a", 1.0) and len(pairs(s)) == 2 and s.get("a").first().content == "new"
    assert follower.get("a").first().content == "1" and follower.refresh() == s.version and follower.get("a").first().content == "new"
    with pytest.raises(PermissionError):
        follower.put(objects(spark, ("c", "")))
    assert s.delete(ids(spark, "a", "none")) == 1 and pairs(s) == [] and len(s) == 1
    s.put(objects(spark, ("a", "back")))
    assert pairs(s) == [] and s.delete(ids(spark, "none")) == 0
    before = s.version
    s.compact()
    s.vacuum()
    assert s.version == before + 1 and len(GraphStore(spark, s.path)) == 2


def test_transactions_roll_back(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError), s.transaction() as t:
        t.put(objects(spark, ("a", "")))
        raise RuntimeError
    assert len(s) == 0 and s.version == 0
    with s.transaction() as t:
        t.put(objects(spark, ("a", "1")), edges(spark, ("a", "r", "b", 1.0)))
        t.put(objects(spark, ("a", "2"), ("b", "")))
        t.delete(ids(spark, "b"))
    assert s.version == 1 and [r.content for r in s.objects.collect()] == ["2"] and pairs(s) == []
    with pytest.raises(ValueError):
        s.put(objects(spark, ("c", "")), edges(spark, ("c", "r", "d", -1.0)))
    stale = GraphStore(spark, s.path)
    s.put(objects(spark, ("x", "")))
    with pytest.raises(RuntimeError, match="first"):
        stale.put(objects(spark, ("y", "")))


def test_update_text_backup(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "s"))
    s.put(objects(spark, ("a", "1")), edges(spark, ("a", "r", "b", 1.0)))
    assert s.update(objects(spark, ("a", None), ("no", "x")), edges(spark, ("a", "t", "c", 1.0))) == 1
    assert [e[1] for e in pairs(s)] == ["r", "t"] and s.get("a").first().content == "1"
    found = s.insert_text(spark.createDataFrame([("Rain causes floods. a prevents rain",)], "text string"))
    assert [r.id for r in found.collect()] == ["Rain", "a", "floods", "rain"]
    assert ("a", "prevents", "rain", 1.0) in pairs(s) and len(pairs(s)) == 4 and "floods" in s
    copy = s.backup(str(tmp_path / "b"))
    s.delete(ids(spark, "a"))
    again = GraphStore.restore(spark, copy.path, str(tmp_path / "r"))
    assert "a" in again and "a" not in s and pairs(again) == pairs(copy)


def test_change_feed(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "s"))
    rows = [(1, "put", "a", "1", None, None, [("r", "b", 1.0, None, 0)]), (2, "put", "b", "2", None, None, None), (3, "put", "a", "3", None, None, [])]
    spark.createDataFrame(rows, CHANGES).write.parquet(str(tmp_path / "feed"))
    apply_changes(change_stream(spark, str(tmp_path / "feed")), s, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(4, "delete", "b", None, None, None, None)], CHANGES).write.mode("append").parquet(str(tmp_path / "feed"))
    apply_changes(change_stream(spark, str(tmp_path / "feed")), s, str(tmp_path / "cp")).awaitTermination()
    s.refresh()
    assert [(r.id, r.content) for r in s.objects.collect()] == [("a", "3")] and s.version == 2


def test_requests_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "e"))
    q = requests_per_minute(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("per_minute").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("per_minute").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "e")).count()


def test_full_edges(spark):
    assert full_edges(edges(spark, ("a", "r", "b", None))).first().weight == 1.0


def test_minute_counts_come_from_the_shared_folder(spark, sf_dir):
    """The stream's result is files, not rows on the driver."""
    out = stored.minute_counts(spark, sf_dir)
    assert out.inputFiles() and out.count() == spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "date_trunc('minute', ts)").distinct().count()


def test_stream_without_rows(spark, tmp_path):
    spark.range(0).selectExpr("id AS user_id", "now() AS ts").write.parquet(str(tmp_path / "e"))
    stream = requests_per_minute(spark.readStream.schema("user_id bigint, ts timestamp").parquet(str(tmp_path / "e")))
    assert run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "check")).count() == 0
