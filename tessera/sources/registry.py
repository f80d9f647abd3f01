"""The registry of repositories, and a source that polls a folder for changes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.overlay import fingerprint_changes
from tessera.plans.versions import VersionedFolder
from tessera.sources.git import tree_files

SCHEMA = "repo_id string, repo_root string, display_name string"


class RepoRegistry:
    """Repositories by id and root, each unique, as versions of one small table (see ``VersionedFolder``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, VersionedFolder(spark, root)

    def list(self) -> DataFrame:
        """All repositories, by id."""
        now = self.versions.read(self.versions.version())
        return (self.spark.createDataFrame([], SCHEMA) if now is None else now).orderBy("repo_id")

    def show(self, repo_id: str) -> DataFrame:
        return self.list().where(F.col("repo_id") == repo_id)

    def _replace(self, rows: DataFrame, after: int | None) -> None:
        self.versions.put_in_force(self.versions.write(rows, "repos"), after)

    def add(self, repo_id: str, repo_root: str, display_name: str | None = None) -> None:
        """Adds a repository; ``ValueError`` if its id or its root is there already."""
        after = self.versions.version()
        now = self.list()
        root = repo_root.rstrip("/") or "/"
        if not now.where((F.col("repo_id") == repo_id) | (F.col("repo_root") == root)).isEmpty():
            raise ValueError(f"{repo_id} or {root} is registered already")
        self._replace(now.unionByName(self.spark.createDataFrame([(repo_id, root, display_name or repo_id)], SCHEMA)), after)

    def remove(self, repo_id: str) -> bool:
        """Removes a repository; whether it was there."""
        after = self.versions.version()
        now = self.list()
        if now.where(F.col("repo_id") == repo_id).isEmpty():
            return False
        self._replace(now.where(F.col("repo_id") != repo_id), after)
        return True


def poll(spark: SparkSession, root: str, ignored: str | None = None) -> DataFrame:
    """The fingerprints of all files below ``root``: path, content_bytes, content_sha256. ``ignored`` is a regular expression of paths to leave out."""
    f = tree_files(spark, root).select("path", "content_bytes", "content_sha256")
    return f.where(~F.col("path").rlike(ignored)) if ignored else f


def poll_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What two polls of one folder say: created, modified and removed paths, and renames of files whose digest is unique on both sides."""
    one = lambda df: df.withColumn("repo_id", F.lit("-"))
    return fingerprint_changes(one(before), one(after), ["repo_id", "path"], "content_sha256").drop("repo_id")


def watch_once(spark: SparkSession, root: str, before: DataFrame, timeout_s: float, every_s: float = 1.0, ignored: str | None = None) -> DataFrame:
    """Polls until something has changed or the time is over; the changes against ``before``, which may be none."""
    end = time.monotonic() + timeout_s
    while True:
        changes = poll_changes(before, poll(spark, root, ignored))
        if time.monotonic() >= end or not changes.isEmpty():
            return changes
        time.sleep(min(every_s, max(0.0, end - time.monotonic())))
