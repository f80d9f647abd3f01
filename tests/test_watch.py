"""The watch stream, as a batch, in memory and as a real stream."""

import datetime as dt

from tessera.streaming import watch

EVENTS = "repo_id string, path string, kind string, at timestamp, seq int"


def test_merge_table():
    assert watch.merge_kinds(None, "created") == "created"
    assert watch.merge_kinds("created", "removed") == ""
    assert watch.merge_kinds("removed", "created") == "modified"
    assert watch.merge_kinds("renamed", "modified") == "renamed"
    assert watch.merge_kinds("created", "created") == "created"


def test_debounce(spark, rows):
    t = lambda ms: dt.datetime(2025, 3, 1) + dt.timedelta(milliseconds=ms)
    e = spark.createDataFrame([("r", "a", "created", t(0), 1), ("r", "a", "modified", t(50), 2), ("r", "a", "removed", t(120), 3), ("r", "a", "created", t(500), 4), ("r", "b", "modified", t(10), 5), ("r", "b", None, t(10), 6), ("r", "c", "modified", None, 7)], EVENTS)
    got = rows(watch.debounce(e, ["repo_id", "path"], "at", "kind", "seq", "100 milliseconds").select("path", "events", "kind"))
    assert got == [("a", 1, "created"), ("a", 3, ""), ("b", 1, "modified")]


def test_pending_follows_renames_and_stays_bounded():
    p = watch.Pending(most=2)
    p.add("a", None, "created", 0)
    p.add("b", "a", "renamed", 10)
    p.add("c", None, "modified", 20)
    p.add("d", None, "modified", 20)
    assert p.dropped == 1
    assert p.take_quiet(50, 100) == []
    assert p.take_quiet(200, 100) == [("b", None, "created"), ("c", None, "modified")]
    p.add("y", "x", "renamed", 0)
    p.add("z", "y", "renamed", 0)
    assert p.take_quiet(200, 100) == [("z", "x", "renamed")]


def test_flush_order(spark):
    e = spark.createDataFrame([("r", "b", None, "removed"), ("r", "a", "z", "renamed"), ("r", "a", None, "modified"), ("r", "a", None, "created")], "repo_id string, path string, previous_path string, kind string")
    got = [(r.path, r.kind) for r in watch.flush_order(e, ["repo_id"]).orderBy("sequence").collect()]
    assert got == [("a", "created"), ("a", "modified"), ("a", "renamed"), ("b", "removed")]


def test_stream(spark, tmp_path):
    schema = "repo_id string, path string, previous_path string, kind string, at_ms bigint"
    data = [("r", "a", None, "created", 0), ("r", "a", None, "modified", 50), ("r", "b", None, "modified", 60), ("r", "c", None, "modified", 1000), ("s", "a", None, "modified", 5), ("s", None, None, "modified", 5)]
    spark.createDataFrame(data, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    seen = []
    q = watch.coalesce_stream(stream).writeStream.foreachBatch(lambda df, _: seen.extend((r.repo_id, r.path, r.kind) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    # the event at 1000 ms shows that a and b have been quiet; c and the other repository still wait
    assert ("r", "a", "created") in seen and ("r", "b", "modified") in seen and ("r", "c", "modified") not in seen[:2]
