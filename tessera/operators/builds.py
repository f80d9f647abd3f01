"""Builds that outlive a run: facts and chunks per file, redone only where a file changed, and swapped in as one version."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import enrichment, facts, refresh, semantic
from tessera.plans.versions import VersionedFolder

FILE = facts.FILE


def config_digest(options: dict) -> str:
    """A digest of all options that reach the output; their order does not count."""
    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Refresh:
    """What a refresh did: ``mode`` (full, incremental) and its reason, files redone, reused and dropped, and the version in force."""

    mode: str
    reason: str
    redone: int
    reused: int
    dropped: int
    version: int


class FileBuild:
    """A table of one row per file, derived from its contents by ``derive`` (DataFrame of files to DataFrame with ``FILE`` and more).

    ``refresh`` reuses the row of a file whose path, digest and size are those of the build in force, derives the others and drops files
    that are gone; it starts anew where there is no build, or one of other options. Two refreshes at once: the first wins, the other gets ``Conflict``.
    """

    def __init__(self, spark: SparkSession, root: str, derive, options: dict):
        self.spark, self.versions, self.derive, self.config = spark, VersionedFolder(spark, root), derive, config_digest(options)[:16]

    def read(self) -> DataFrame | None:
        """The build in force, with ``_ts_sha`` and ``_ts_bytes`` of the contents that it saw."""
        return self.versions.read(self.versions.version())

    def plan(self) -> tuple[str, str]:
        v = self.versions.version()
        previous = None if v is None else {"config_digest": self.versions._data(v).split("-")[1]}
        return refresh.refresh_plan(previous, {"config_digest": self.config})

    def refresh(self, files: DataFrame) -> Refresh:
        """``files``: FILE and contents. Sizes and digests are taken from the contents; null contents are a content of their own. Of files delivered again one is derived."""
        v = self.versions.version()
        mode, reason = self.plan()
        seen = files.select(*FILE, "contents", F.coalesce(F.sha2("contents", 256), F.lit("-")).alias("_ts_sha"), F.coalesce(F.octet_length("contents"), F.lit(-1)).alias("_ts_bytes"))
        now = seen.dropDuplicates(FILE)
        old = None if mode == "full" else self.versions.read(v)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*FILE, "_ts_sha", "_ts_bytes")]
        todo = now if old is None else now.alias("n").join(old.select(*FILE, "_ts_sha", "_ts_bytes").alias("o"), same, "left_anti")
        made = self.derive(todo.select(*FILE, "contents"))
        keyed = todo.select(*[F.col(k).alias(f"_ts_{k}") for k in FILE], "_ts_sha", "_ts_bytes")
        on = [F.col(k).eqNullSafe(F.col(f"_ts_{k}")) for k in FILE]
        fresh = made.join(keyed, on).drop(*[f"_ts_{k}" for k in FILE]).withColumn("_ts_new", F.lit(True))
        if old is not None:
            kept = old.alias("o").join(now.select(*FILE, "_ts_sha", "_ts_bytes").alias("n"), same, "left_semi").drop("_ts_new").withColumn("_ts_new", F.lit(False))
            fresh = fresh.unionByName(kept)
        folder = self.versions.write(fresh, f"build-{self.config}")
        written = self.spark.read.parquet(f"{self.versions.root}/{folder}").groupBy("_ts_new").count().collect()
        counts = {r[0]: r[1] for r in written}
        before = 0 if old is None else old.count()
        return Refresh(mode, reason, counts.get(True, 0), counts.get(False, 0), before - counts.get(False, 0), self.versions.put_in_force(folder, v))


def facts_build(spark: SparkSession, root: str, options: dict | None = None) -> FileBuild:
    """A ``FileBuild`` of symbols, occurrences, imports and exports."""
    return FileBuild(spark, root, facts.extract, {"facts": 1, **(options or {})})


def chunk_build(spark: SparkSession, root: str, options: dict | None = None) -> FileBuild:
    """A ``FileBuild`` of file chunks with their vectors; equal texts are embedded once."""

    def derive(files: DataFrame) -> DataFrame:
        c = semantic.file_chunks(files, FILE).join(files.select(*[F.col(k).alias(f"_ts_k{i}") for i, k in enumerate(FILE)], F.substring("contents", 1, semantic.HEADER_LENGTH).alias("_ts_text")), [F.col(k).eqNullSafe(F.col(f"_ts_k{i}")) for i, k in enumerate(FILE)]).drop(*[f"_ts_k{i}" for i in range(len(FILE))])
        c = c.withColumn("cache_key", semantic.cache_key(F.col("text_digest")))
        vectors = semantic.embed(c.groupBy("cache_key").agg(F.min("_ts_text").alias("_ts_text")), "_ts_text").select("cache_key", "vector")
        return c.drop("_ts_text").join(vectors, "cache_key")

    return FileBuild(spark, root, derive, {"chunks": 1, "header": semantic.HEADER_LENGTH, **(options or {})})


def contributions(e: enrichment.Enrichment) -> DataFrame:
    """What each file adds to the reverse indexes: scope, contrib_path, kind, target, source.

    References by the file they stand in, bindings by the file of the symbol that binds, dependents by the file that depends, tests by the test.
    """
    scope = enrichment.SCOPE
    row = lambda df, path, kind, target, source: df.select(*scope, F.col(path).alias("contrib_path"), F.lit(kind).alias("kind"), F.col(target).alias("target"), F.col(source).alias("source"))
    where = e.symbols.select(*scope, "symbol_id", "path")
    out = row(enrichment.reverse_references(e), "path", "reference", "canonical", "occurrence_id")
    for kind in ("imports", "exports"):
        out = out.unionByName(row(enrichment.reverse_bindings(e, kind).join(where, [*scope, "symbol_id"]), "path", kind, "canonical", "symbol_id"))
    out = out.unionByName(row(enrichment.file_dependents(e), "dependent", "dependent", "path", "dependent"))
    return out.unionByName(row(enrichment.tests_of(e), "test_path", "test", "target", "evidence")).distinct()


def refreshed_contributions(old: DataFrame, e: enrichment.Enrichment, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contributions after a change of some files (scope, contrib_path), and the files that had to be redone.

    Aliases and packages are those of the whole new state. A file is redone if it changed, or if the signature of what it adds differs; others keep the old rows.
    """
    key = [*enrichment.SCOPE, "contrib_path"]
    new = contributions(e)
    what = ["kind", "target", "source"]
    redone = refresh.touched(changed, refresh.signatures(old, key, what), refresh.signatures(new, key, what), key)
    return refresh.merge(old, new.join(redone, key, "left_semi"), redone, key), redone
