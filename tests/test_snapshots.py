"""Snapshot changes and incremental processing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import incremental, snapshot_changes
from tessera.plans import versions

T = dt.datetime
ENTRIES = "repo_id string, snapshot_id string, path string, kind string, content_sha256 string, received_at timestamp, extra int"
MANIFESTS = "snapshot_id string, repo_id string, branch string, created_at timestamp"


def at(n):
    return T(2025, 3, 1) + dt.timedelta(hours=n)


def test_changes_of_a_branch(spark, rows):
    m = spark.createDataFrame([("b", "r", "main", at(2)), ("a", "r", "main", at(1)), ("c", "r", "main", at(3)), ("c", "r", "main", at(3)), ("x", "r", "dev", at(1))], MANIFESTS)
    e = spark.createDataFrame(
        [
            ("r", "a", "./p//one.ts", "upsert", "AA", at(1), 1),
            ("r", "a", "p/two.ts", "upsert", "bb", at(1), 1),
            ("r", "a", "p\\three.ts", "upsert", None, at(1), 1),
            ("r", "b", "p/one.ts", "upsert", "aa", at(2), 1),
            ("r", "b", "p/two.ts", "upsert", "xx", at(2), 1),
            ("r", "b", "p/two.ts", "upsert", "cc", at(3), 1),
            ("r", "b", "p/four.ts", "upsert", "dd", at(2), 1),
            ("r", "b", "p/four.ts", "delete", None, at(3), 1),
            ("r", "x", "p/other.ts", "upsert", "ee", at(1), 1),
            ("r", "nowhere", "p/z.ts", "upsert", "ee", at(1), 1),
            ("r", "a", None, "upsert", "ee", at(1), 1),
        ],
        ENTRIES,
    )
    got = rows(snapshot_changes.snapshot_changes(e, m).select("snapshot_id", "path", "change_kind"))
    # snapshot c has no rows: everything that b had is gone
    assert got == [("b", "p/three.ts", "removed"), ("b", "p/two.ts", "changed"), ("c", "p/one.ts", "removed"), ("c", "p/two.ts", "removed")]


def test_empty_tables(spark):
    m, e = spark.createDataFrame([], MANIFESTS), spark.createDataFrame([], ENTRIES)
    assert snapshot_changes.snapshot_changes(e, m).count() == 0


def test_order_of_rows_does_not_matter(spark, rows):
    m = spark.createDataFrame([("a", "r", None, at(1)), ("b", "r", None, at(2))], MANIFESTS)
    e = [("r", s, f"f{i}", "upsert", str(i * (s == "b")), at(1 + i % 3), i) for s in "ab" for i in range(5) for _ in range(2)]
    one = rows(snapshot_changes.snapshot_changes(spark.createDataFrame(e, ENTRIES), m))
    assert one == rows(snapshot_changes.snapshot_changes(spark.createDataFrame(e[::-1], ENTRIES), m))
    assert len(one) == 4


def test_index_on_disk(spark, rows, tmp_path):
    index = snapshot_changes.SnapshotIndex(spark, str(tmp_path / "i"), ["key"], "digest", buckets=4)
    assert index.current() is None
    one = spark.createDataFrame([("a", "1", "va"), ("b", "2", "vb"), ("c", None, "vc")], "key string, digest string, value string")
    first = index.probe(one)
    assert first.changes.count() == 0
    index.swap(first)
    two = spark.createDataFrame([("a", "1", "va"), ("b", "3", "vB"), ("d", "4", "vd"), ("d", "4", "vd")], "key string, digest string, value string")
    want = [("b", "changed", "vb"), ("c", "removed", "vc"), ("d", "added", None)]
    lost = index.probe(two)
    assert rows(lost.changes.select("key", "change_kind", "old_value")) == want
    # the consumer crashed before the swap: the same changes come out again
    again = index.probe(two)
    assert index.version() == 0 and rows(again.changes.select("key", "change_kind", "old_value")) == want
    index.swap(again)
    assert index.version() == 1 and index.current().count() == 3
    with pytest.raises(versions.Conflict):
        index.swap(lost)
    assert index.probe(two).changes.count() == 0


def test_gaps_and_long_chains(spark, rows):
    rng = random.Random(3)
    ids = [f"s{i:02}" for i in range(25)]
    m = spark.createDataFrame([(s, "r", "main", at(i)) for i, s in enumerate(ids)], MANIFESTS)
    state = {s: {f"f{j}": str(rng.randrange(3)) for j in range(12) if rng.random() < 0.3} for s in ids}
    e = [("r", s, p, "upsert", h, at(1), 1) for s in ids for p, h in state[s].items()]
    want = []
    for a, b in zip(ids, ids[1:], strict=False):
        for p in {*state[a], *state[b]}:
            old, new = state[a].get(p), state[b].get(p)
            if old != new:
                want.append((b, p, "added" if old is None else "removed" if new is None else "changed", old, new))
    got = snapshot_changes.snapshot_changes(spark.createDataFrame(e, ENTRIES), m)
    assert rows(got.select("snapshot_id", "path", "change_kind", "old_digest", "new_digest")) == sorted(want, key=repr)


RECORDS = "source_table string, repo_id string, record_key string, content string, arrived timestamp, seq long"


def test_every_record_once(spark, rows, tmp_path):
    state = incremental.StateTable(spark, str(tmp_path / "s"))
    first = [("t", "r", "k1", "x", at(1), 0), ("t", None, "k2", None, at(1), 0)]
    records = spark.createDataFrame(first, RECORDS)
    work = state.pending(records)
    assert rows(work.rows.select("record_key", "why")) == [("k1", "new"), ("k2", "new")]
    # a run that fails commits nothing: the same work comes out again
    assert state.pending(records).rows.count() == 2
    state.commit(work)
    assert state.pending(records).rows.count() == 0
    more = spark.createDataFrame([*first, ("t", "r", "k1", "y", at(2), 0), ("t", "r", "k3", "z", at(2), 0), ("t", "r", "k3", "z", at(3), 1), ("t", None, "k2", None, at(5), 0)], RECORDS)
    assert rows(state.pending(more).rows.select("record_key", "why")) == [("k1", "changed"), ("k3", "new")]
    state.commit(state.pending(more.where("record_key = 'k1'")))
    # what an earlier version knew stays known
    assert rows(state.pending(more).rows.select("record_key")) == [("k3",)]


def test_undone_writes_are_no_change(spark, tmp_path):
    state = incremental.StateTable(spark, str(tmp_path / "s"))
    state.commit(state.pending(spark.createDataFrame([("t", "r", "k", "x", at(1), 0)], RECORDS)))
    later = spark.createDataFrame([("t", "r", "k", "x", at(1), 0), ("t", "r", "k", "y", at(2), 0), ("t", "r", "k", "x", at(3), 0)], RECORDS)
    assert state.pending(later).rows.count() == 0


def test_crash_between_write_and_swap(spark, tmp_path):
    state = incremental.StateTable(spark, str(tmp_path / "s"))
    records = spark.createDataFrame([("t", "r", "k", "x", at(1), 0)], RECORDS)
    state.versions._rename = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        state.commit(state.pending(records))
    again = incremental.StateTable(spark, str(tmp_path / "s"))
    assert again.version() is None and again.pending(records).rows.count() == 1
    again.commit(again.pending(records))
    assert again.pending(records).rows.count() == 0


def test_rows_that_land_during_a_run_are_not_skipped(spark, rows, tmp_path):
    source, state = str(tmp_path / "source"), incremental.StateTable(spark, str(tmp_path / "s"))
    spark.createDataFrame([("t", "r", "k1", "x", at(1), 0)], RECORDS).write.parquet(source)
    work = state.pending(spark.read.parquet(source))
    spark.createDataFrame([("t", "r", "k2", "x", at(1), 0)], RECORDS).write.mode("append").parquet(source)
    assert rows(work.rows.select("record_key")) == [("k1",)]
    state.commit(work)
    assert rows(state.pending(spark.read.parquet(source)).rows.select("record_key")) == [("k2",)]


def test_of_two_runs_one_commits(spark, tmp_path):
    records = spark.createDataFrame([("t", "r", "k", "x", at(1), 0)], RECORDS)
    one, two = (incremental.StateTable(spark, str(tmp_path / "s")) for _ in range(2))
    mine, theirs = one.pending(records), two.pending(records)
    one.commit(mine)
    with pytest.raises(versions.Conflict):
        two.commit(theirs)
    # also where both have looked before either renames
    with pytest.raises(versions.Conflict):
        two.versions._rename(theirs.folder, 0)
    assert one.version() == 0


def test_marks_of_runs(spark, rows):
    runs = spark.createDataFrame([("a", "t", at(1), "succeeded"), ("b", "t", at(5), "failed"), ("c", "t", at(3), "succeeded"), ("d", "u", at(9), None)], "run_id string, source_table string, read_until timestamp, run_state string")
    assert rows(incremental.read_marks(runs)) == [("t", at(3))]
    r = spark.createDataFrame([("t", "r", "k1", None, at(3), 0), ("t", "r", "k2", None, at(4), 0), ("u", "r", "k3", None, at(1), 0), ("t", "r", "k4", None, None, 0)], RECORDS)
    assert rows(incremental.arrived_by(r, runs).select("record_key")) == [("k1",)]


def test_probe_matches_null_keys(spark, rows):
    a = spark.createDataFrame([(None, "1"), ("k", "1")], "key string, digest string").withColumn("bucket", F.lit(0))
    b = spark.createDataFrame([(None, "1"), ("k", None)], "key string, digest string").withColumn("bucket", F.lit(0))
    assert rows(snapshot_changes.probe(a, b, ["bucket"], ["key"], "digest").select("key", "change_kind")) == [("k", "changed")]
