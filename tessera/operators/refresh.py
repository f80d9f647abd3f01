"""Incremental refresh: what to reuse, what to recompute, and how two builds differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh_plan(previous: dict | None, current: dict) -> tuple[str, str]:
    """``("full", reason)`` or ``("incremental", "")``, from the first check that fails: a previous build, the schema version, the
    config digest, the base snapshot, a healthy store."""
    if previous is None:
        return "full", "no_previous_build"
    for field, reason in (("schema_version", "schema_changed"), ("config_digest", "config_changed"), ("base_snapshot", "base_changed")):
        if previous.get(field) != current.get(field):
            return "full", reason
    if not previous.get("healthy", True):
        return "full", "store_unhealthy"
    return "incremental", ""


def reuse(current: DataFrame, previous: DataFrame, key: list[str], digest: str) -> DataFrame:
    """``current`` with ``reused``: the previous build has the key with the same digest. A null digest is never reused."""
    p = previous.where(F.col(digest).isNotNull()).select(*[F.col(k).alias(f"_ts_{k}") for k in key], F.col(digest).alias("_ts_d")).distinct()
    on = F.col(digest) == F.col("_ts_d")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_ts_{k}"))
    return current.join(p, on, "left").withColumn("reused", F.col("_ts_d").isNotNull()).select(*current.columns, "reused")


def signatures(facts: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    """A fingerprint of each key's set of facts: the count and two sums of hashes of its distinct rows, which do not depend on order
    and, unlike a sorted list, never gather a key's rows in one place."""
    h = facts.select(*key, F.xxhash64(*what).alias("_ts_a"), F.hash(*what).cast("bigint").alias("_ts_b")).distinct()
    wrapped = F.sum(F.col("_ts_a").cast("decimal(38,0)")).cast("string")
    return h.groupBy(*key).agg(F.concat_ws(":", F.count("*"), wrapped, F.sum("_ts_b")).alias("signature"))


def touched(changed: DataFrame, before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys to recompute: the changed ones and those whose signature differs or exists on one side only."""
    b = before.select(*key, F.col("signature").alias("b"))
    j = b.join(after.select(*key, F.col("signature").alias("a")), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return changed.select(*key).unionByName(j.select(*key)).distinct()


def merge(old: DataFrame, new: DataFrame, redone: DataFrame, key: list[str]) -> DataFrame:
    """The old build's rows of keys that were not redone, with all new rows."""
    return old.join(redone.select(*key).distinct(), key, "left_anti").unionByName(new)


def delta_counts(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """added, removed, updated and equal keys of two builds, in one row. Of repeated keys the greatest value counts."""
    both = before.select(*key, F.col(value).alias("_ts_v"), F.lit(0).alias("_ts_s")).unionByName(after.select(*key, F.col(value).alias("_ts_v"), F.lit(1).alias("_ts_s")))
    g = both.groupBy(*key).agg(F.max(F.when(F.col("_ts_s") == 0, F.struct("_ts_v"))).alias("b"), F.max(F.when(F.col("_ts_s") == 1, F.struct("_ts_v"))).alias("a"))
    same = F.col("a._ts_v").eqNullSafe(F.col("b._ts_v"))
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    return g.agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(here & ~same).alias("updated"), F.count_if(here & same).alias("equal"))


def symmetric_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one side has, each once, with the side."""
    cols = before.columns
    u = before.withColumn("_ts_s", F.lit(0)).unionByName(after.select(*cols).withColumn("_ts_s", F.lit(1)))
    return u.groupBy(*cols).agg(F.min("_ts_s").alias("lo"), F.max("_ts_s").alias("hi")).where("lo = hi").select(*cols, F.when(F.col("lo") == 0, "before").otherwise("after").alias("side"))
