"""Processing only new or changed records.

A state table holds, per key, the hash of the content that the last successful run saw. A run hashes the
current rows, joins them with the state, writes down what is new or changed, works on that, and swaps in
the next version of the state when all its work is done. A run that fails before the swap leaves
the old version in force, so its records come out again; after the swap they never do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.versions import VersionedFolder

KEY = ["source_table", "repo_id", "record_key"]


def versions(records: DataFrame) -> DataFrame:
    """One row per key: the hash of its latest content.

    ``records`` has ``KEY``, ``content`` (null is a content), ``arrived`` (timestamp) and ``seq``
    (order among equal times). Aggregated map-side before the shuffle, so repeated rows and hot
    keys cost one row per task.
    """
    return records.groupBy(*KEY).agg(F.max_by("content", F.struct("arrived", "seq", "content")).alias("content")).select(*KEY, F.sha2(F.coalesce(F.concat(F.lit("v"), "content"), F.lit("n")), 256).alias("content_sha"))


def new_or_changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``current`` whose key the state lacks or has with another hash; null key parts match each other."""
    s = state.select(*[F.col(k).alias(f"_ts_{k}") for k in KEY], F.col("content_sha").alias("_ts_sha"))
    on = F.lit(True)
    for k in KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"_ts_{k}"))
    joined = current.join(s, on, "left")
    return joined.where("_ts_sha is null or _ts_sha <> content_sha").select(*KEY, "content_sha", F.when(F.col("_ts_sha").isNull(), "new").otherwise("changed").alias("why"))


@dataclass
class Work:
    """What one run is to process: ``rows`` are written down, so that the run and its commit see the same ones."""

    rows: DataFrame
    folder: str
    after: int | None


class StateTable:
    """Versioned state below ``root`` (see ``VersionedFolder``).

    ``pending`` writes down the work of the next run: rows that arrive later are not in it. ``commit`` makes that work, over the
    state that it was found against, the state in force; a run that began at a version no longer in force gets ``Conflict``
    and leaves no trace. A run that fails before its commit changes nothing, so its work comes out again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, VersionedFolder(spark, root)

    def version(self) -> int | None:
        return self.versions.version()

    def pending(self, records: DataFrame) -> Work:
        """New and changed keys of ``records`` (see ``versions``) against the version in force."""
        v = self.version()
        state = self.versions.read(v)
        found = versions(records)
        found = found.withColumn("why", F.lit("new")) if state is None else new_or_changed(found, state)
        folder = self.versions.write(found.select(*KEY, "content_sha", "why"), "work")
        return Work(self.spark.read.parquet(f"{self.versions.root}/{folder}"), folder, v)

    def commit(self, work: Work) -> int:
        """Makes the contents that ``work`` saw, over those of the old state, the state in force. To be called when all of it is done."""
        if work.after is None:
            return self.versions.put_in_force(work.folder, None)
        old, now = self.versions.read(work.after).select(*KEY, "content_sha"), work.rows.select(*KEY, "content_sha")
        n = now.select(*[F.col(k).alias(f"_ts_{k}") for k in KEY])
        on = F.lit(True)
        for k in KEY:
            on = on & F.col(k).eqNullSafe(F.col(f"_ts_{k}"))
        folder = self.versions.write(now.unionByName(old.join(n, on, "left_anti")), "state")
        return self.versions.put_in_force(folder, work.after)


def ingest_records(watch_events: DataFrame, buffers: DataFrame, inspections: DataFrame) -> DataFrame:
    """The three growing tables as records. Content-addressed and numbered keys have no content of their own.

    Rows without a key part (sequence_id, buffer_id, path or digest) are left out; a null repo_id is a value.
    """
    none = F.lit(None).cast("string")
    watch = watch_events.where("sequence_id is not null").select(F.lit("watch_events").alias("source_table"), "repo_id", F.col("sequence_id").cast("string").alias("record_key"), none.alias("content"), F.col("received_at").alias("arrived"), F.lit(0).cast("long").alias("seq"))
    bufs = buffers.where("buffer_id is not null").select(F.lit("buffers").alias("source_table"), "repo_id", F.col("buffer_id").alias("record_key"), F.col("content_sha256").alias("content"), F.col("updated_at").alias("arrived"), F.col("version").cast("long").alias("seq"))
    parsed = inspections.where("path is not null and content_sha256 is not null").select(F.lit("parse_inspections").alias("source_table"), "repo_id", F.concat("path", F.lit("@"), "content_sha256").alias("record_key"), none.alias("content"), F.col("parsed_at").alias("arrived"), F.lit(0).cast("long").alias("seq"))
    return watch.unionByName(bufs).unionByName(parsed)


def read_marks(runs: DataFrame) -> DataFrame:
    """Per source_table the greatest read_until of its succeeded runs; tables without one are absent."""
    return runs.where("run_state = 'succeeded' and read_until is not null").groupBy("source_table").agg(F.max("read_until").alias("read_until"))


def arrived_by(records: DataFrame, runs: DataFrame) -> DataFrame:
    """The records that the runs which succeeded so far have read: those that arrived at or before read_until.

    Rows without an arrival time were never read. The marks are one row per source table.
    """
    marks = read_marks(runs).select(F.col("source_table").alias("_ts_t"), "read_until")
    return records.join(marks, (F.col("source_table") == F.col("_ts_t")) & (F.col("arrived") <= F.col("read_until"))).select(*records.columns)
