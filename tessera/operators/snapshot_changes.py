"""What changed between full snapshots.

A snapshot is a full delivery of keys with a hash of each value. The *index* of a snapshot is its
key-to-hash table, bucketed by the key. A new snapshot is probed against the index of the one
before it: keys only in the index were removed, keys only in the probe added, keys with two hashes
changed. Old values are fetched for the changes alone, and the index of the new snapshot takes
the old one's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import slashed
from tessera.plans.ordered import running_totals
from tessera.plans.versions import VersionedFolder


def probe(index: DataFrame, rows: DataFrame, bucket: list[str], key: list[str], digest: str) -> DataFrame:
    """Joins an index with new rows inside their buckets; one row per key that differs.

    Both sides have the columns ``bucket`` + ``key`` + ``digest`` and at most one row per key. The
    result has those keys, ``change_kind`` and the two hashes. A null hash is a value like any
    other; null keys match each other. Both sides are hash-partitioned by ``bucket`` alone, so
    probing whole histories at once moves every row once.
    """
    cols = [*bucket, *key]
    both = index.select(*cols, F.lit(True).alias("_ts_old"), F.col(digest).alias("_ts_h")).unionByName(rows.select(*cols, F.lit(False).alias("_ts_old"), F.col(digest).alias("_ts_h")))
    return _differ(both, cols)


def _differ(both: DataFrame, cols: list[str]) -> DataFrame:
    seen = both.groupBy(*cols).agg(
        F.max("_ts_old").alias("_ts_was"),
        F.min("_ts_old").alias("_ts_only"),
        F.max(F.when(F.col("_ts_old"), F.col("_ts_h"))).alias("old_digest"),
        F.max(F.when(~F.col("_ts_old"), F.col("_ts_h"))).alias("new_digest"),
    )
    kind = F.when(F.col("_ts_only"), "removed").when(~F.col("_ts_was"), "added").when(~F.col("old_digest").eqNullSafe(F.col("new_digest")), "changed")
    return seen.withColumn("change_kind", kind).where("change_kind is not null").select(*cols, "change_kind", "old_digest", "new_digest")


def chains(manifests: DataFrame) -> DataFrame:
    """Each snapshot with its place (``nth`` from 0) on its (repo_id, branch) by created_at, and the next one. A branch of any length is numbered in pieces.

    Manifests delivered again count once (the latest row). A null branch is a branch; without
    created_at a snapshot has no place in an order and is left out. Equal times are ordered by id.
    """
    once = manifests.where("snapshot_id is not null and created_at is not null").groupBy("snapshot_id").agg(F.max_by(F.struct("repo_id", "branch", "created_at"), "created_at").alias("m"))
    numbered = running_totals(once.select("snapshot_id", "m.*"), ["repo_id", "branch"], [F.asc("created_at"), F.asc("snapshot_id")], None, "_ts_total", "rank")
    placed = numbered.select("snapshot_id", F.col("repo_id").alias("_ts_r"), "branch", (F.col("rank") - 1).alias("nth"))
    before = placed.select(F.col("snapshot_id").alias("next_id"), F.col("_ts_r").alias("_ts_r2"), F.col("branch").alias("_ts_b2"), (F.col("nth") - 1).alias("_ts_n2"))
    same = (F.col("nth") == F.col("_ts_n2")) & F.col("_ts_r").eqNullSafe(F.col("_ts_r2")) & F.col("branch").eqNullSafe(F.col("_ts_b2"))
    return placed.join(before, same, "left").select("snapshot_id", "branch", "nth", "next_id")


OUT = "repo_id string, snapshot_id string, path string, change_kind string, old_digest string, new_digest string"
_ROW = ("repo_id", "branch", "nth", "snapshot_id", "next_id", "path", "kind", "digest", "at")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays the snapshots of one bucket, which come sorted by branch and place in its chain.

    ``index`` is the key-to-hash index of the last snapshot, as far as this bucket goes; the rows of the next one are gathered in
    ``new``, probed, and take its place.
    """
    out: list[tuple] = []
    index: dict[str, str | None] = {}
    new: dict[str, tuple] = {}
    chain: tuple | None = None  # repo_id, branch
    nth = -1
    ids: tuple = (None, None)  # of the snapshot that is being gathered, and of the next one
    last: tuple = (-1, None)  # place and next id of the snapshot in the index

    def swap() -> None:
        """Probes the index with the snapshot gathered, then puts the snapshot in its place."""
        nonlocal index, last
        present = {p: v[4] for p, v in new.items() if v[1] == "upsert"}
        repo = chain[0]
        if last[0] >= 0 and last[0] != nth - 1:
            # the snapshots between have no rows in this bucket: what the index had is gone with the first of them
            out.extend((repo, last[1], p, "removed", h, None) for p, h in index.items())
            index = {}
        if nth > 0:
            for p, h in present.items():
                if p not in index:
                    out.append((repo, ids[0], p, "added", None, h))
                elif index[p] != h:
                    out.append((repo, ids[0], p, "changed", index[p], h))
            out.extend((repo, ids[0], p, "removed", h, None) for p, h in index.items() if p not in present)
        index, last = present, (nth, ids[1])

    def close() -> None:
        """The end of a chain in this bucket: if a snapshot follows, it has nothing of what the index has."""
        nonlocal index
        if last[1] is not None:
            out.extend((chain[0], last[1], p, "removed", h, None) for p, h in index.items())
        index = {}

    def take() -> pa.RecordBatch:
        names = ["repo_id", "snapshot_id", "path", "change_kind", "old_digest", "new_digest"]
        got = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=names)
        out.clear()
        return got

    for b in batches:
        for repo, branch, n, snapshot, following, path, kind, digest, at in zip(*(b.column(c).to_pylist() for c in _ROW), strict=True):
            if (repo, branch) != chain or n != nth:
                if chain is not None:
                    swap()
                if (repo, branch) != chain:
                    if chain is not None:
                        close()
                    chain, last = (repo, branch), (-1, None)
                new, nth, ids = {}, n, (snapshot, following)
            row = (at is not None, kind or "", digest is not None, digest or "", digest)
            row = (at if at is not None else -(1 << 62), row[1], row[2], row[3], digest)
            if path not in new or new[path][:4] < row[:4]:
                new[path] = row
        if len(out) >= 10_000:
            yield take()
    if chain is not None:
        swap()
        close()
    if out:
        yield take()


def snapshot_changes(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Changes of every snapshot against the one before it on its branch.

    Entries go to buckets by (repo_id, path), once. In its bucket a branch's history is replayed: the key-to-hash index of the last
    snapshot is probed with the rows of the next, old digests are taken for what changed, and the new index takes its place. A task
    holds its bucket's part of one snapshot at a time. Result: repo_id, snapshot_id (the later one), path, change_kind, old_digest, new_digest. A
    manifest without entries is an empty snapshot. The first snapshot of a branch yields nothing.
    Per path the entry received last counts (of equal times the greater (kind, digest); entries
    without received_at come before all others); paths are normalised, digests compared in lower case,
    null digests equal each other. Entries without path or of unknown snapshots are left out.
    """
    chain = chains(manifests)
    # snapshot ids join the small side first, so that each entry then moves once, to its bucket
    placed = entries.select("repo_id", "snapshot_id", "path", "kind", "content_sha256", "received_at").join(chain, "snapshot_id")
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    picked = placed.select("repo_id", "branch", "nth", "snapshot_id", "next_id", slashed(F.col("path")).alias("path"), "kind", F.lower("content_sha256").alias("digest"), at.alias("at")).where("path is not null")
    bucketed = picked.repartition("repo_id", "path").sortWithinPartitions("repo_id", "branch", "nth")
    return bucketed.mapInArrow(_replay, OUT)


@dataclass
class Delivery:
    """One delivery probed against the index: its changes, written down, and the index that will take the old one's place."""

    changes: DataFrame
    folder: str
    after: int | None


class SnapshotIndex:
    """The bucketed index of the last snapshot of one table, on disk (see ``VersionedFolder``).

    A version is parquet partitioned by the bucket: key, hash and the snapshot's values. ``probe`` writes down the changes of a new
    delivery, with the old values of changed and removed keys; ``swap``, to be called when they are dealt with, puts the
    delivery's index in force. A crash before the swap leaves the old index in force, so the same changes come out again.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], digest: str, buckets: int = 64):
        self.spark, self.versions, self.key, self.digest, self.buckets = spark, VersionedFolder(spark, root), key, digest, buckets

    def version(self) -> int | None:
        return self.versions.version()

    def current(self) -> DataFrame | None:
        return self.versions.read(self.version())

    def probe(self, rows: DataFrame) -> Delivery:
        """Changes of ``rows`` (one row per key; of repeated rows the greatest hash counts) against the index in force.

        The first delivery yields no changes. ``changes`` has the key, change_kind, old_digest, new_digest, and
        ``old_<column>`` (``old_value_<column>`` where that name is taken) for each other column, null for added keys.
        """
        v = self.version()
        others = [c for c in rows.columns if c not in self.key]
        # one aggregation, combined before the shuffle: a key that is repeated very often is one row per task
        packed = F.struct(F.col(self.digest).alias("_ts_d"), F.struct(*others).alias("_ts_v")) if others else F.struct(F.col(self.digest).alias("_ts_d"))
        once = rows.groupBy(*self.key).agg(F.max(packed).alias("_ts_m")).select(*self.key, "_ts_m._ts_v.*")
        bucketed = once.withColumn("_ts_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        folder = self.versions.write(bucketed.repartition("_ts_bucket", F.pmod(F.xxhash64(*self.key), F.lit(1024))), "index", ["_ts_bucket"])
        after = self.spark.read.parquet(f"{self.versions.root}/{folder}")
        before = after.limit(0) if v is None else self.versions.read(v)
        changes = probe(before, after.limit(0) if v is None else after, ["_ts_bucket"], self.key, self.digest)
        # the index is read by key and hash alone to find the changes; its values are fetched for these
        taken = {"change_kind", "old_digest", "new_digest", *self.key}
        names = {x: f"old_{x}" if f"old_{x}" not in taken else f"old_value_{x}" for x in others if x != self.digest}
        old = before.select("_ts_bucket", *self.key, *[F.col(x).alias(name) for x, name in names.items()]).alias("o")
        c = changes.alias("c")
        on = F.col("c._ts_bucket") == F.col("o._ts_bucket")
        for k in self.key:
            on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}"))
        result = c.join(old, on, "left").select(*[F.col(f"c.{k}") for k in self.key], "c.change_kind", "c.old_digest", "c.new_digest", *[F.col(f"o.{name}") for name in names.values()])
        made = self.versions.write(result, "changes")
        return Delivery(self.spark.read.parquet(f"{self.versions.root}/{made}"), folder, v)

    def swap(self, delivery: Delivery) -> int:
        """Puts the delivery's index in force; ``Conflict`` if another delivery came in between."""
        return self.versions.put_in_force(delivery.folder, delivery.after)
