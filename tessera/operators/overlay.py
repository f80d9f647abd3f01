"""Layered files: git base under working tree under open buffers; materialisation and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE, WORKING_TREE, BUFFER = 0, 1, 2


def latest_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in ``order`` (nulls first); a keyed upsert in one aggregation, combined map-side.

    Rows equal in ``order`` are told apart by all their columns, so the result does not depend on their order.
    """
    others = [c for c in df.columns if c not in key]
    ranked = [*order, *[c for c in others if c not in order]]
    return df.groupBy(*key).agg(F.max(F.struct(*ranked)).alias("_ts_last")).select(*key, *[f"_ts_last.{c}" for c in others])


def layered(base: DataFrame, working_tree: DataFrame, buffers: DataFrame, key: list[str]) -> DataFrame:
    """All layers as one table: key, layer, present, content_sha256, buffer wins over working tree over base.

    A working-tree row with kind ``delete`` hides the base; an open buffer wins even over a delete.
    """
    b = base.select(*key, F.lit(BASE).alias("layer"), F.lit(True).alias("present"), "content_sha256")
    w = working_tree.select(*key, F.lit(WORKING_TREE).alias("layer"), (F.col("kind") == "upsert").alias("present"), "content_sha256")
    u = buffers.select(*key, F.lit(BUFFER).alias("layer"), F.lit(True).alias("present"), "content_sha256")
    return b.unionByName(w).unionByName(u)


def resolve(layers: DataFrame, key: list[str]) -> DataFrame:
    """The winning layer of every path; hidden paths are absent. One aggregation, no joins."""
    top = F.max(F.struct("layer", "present", "content_sha256")).alias("_ts_t")
    return layers.groupBy(*key).agg(top).where("_ts_t.present").select(*key, "_ts_t.layer", "_ts_t.content_sha256")


def duplicate_paths(layer: DataFrame, key: list[str]) -> DataFrame:
    """Keys that one layer names more than once; a valid layer has none."""
    return layer.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def working_tree_overlay(status: DataFrame) -> DataFrame:
    """Overlay rows from status rows (path, state, previous_path): dirty, untracked and renamed paths are upserts, deleted paths
    and the sources of renames deletes; each (path, kind) once."""
    up = status.where("state in ('dirty', 'untracked', 'renamed')").select("path", F.lit("upsert").alias("kind"))
    gone = status.where("state = 'deleted'").select("path", F.lit("delete").alias("kind"))
    moved = status.where("state = 'renamed' and previous_path is not null").select(F.col("previous_path").alias("path"), F.lit("delete").alias("kind"))
    return up.unionByName(gone).unionByName(moved).where("path is not null").distinct()


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Paths whose resolved contents differ between two layered tables: key, change, buffer_only.

    ``buffer_only`` tells that without buffers both sides are equal. Both sides are read once: one aggregation over their union.
    """
    sides = left.withColumn("_ts_s", F.lit(0)).unionByName(right.withColumn("_ts_s", F.lit(1)))

    def top(side: int, most: int, what: str):
        row = F.max(F.when((F.col("_ts_s") == side) & (F.col("layer") <= most), F.struct("layer", "present", "content_sha256"))).alias(what)
        return row

    t = sides.groupBy(*key).agg(top(0, BUFFER, "l"), top(1, BUFFER, "r"), top(0, WORKING_TREE, "lb"), top(1, WORKING_TREE, "rb"))
    here = lambda c: F.coalesce(F.col(f"{c}.present"), F.lit(False))
    same = lambda a, b: (~here(a) & ~here(b)) | (here(a) & here(b) & F.col(f"{a}.content_sha256").eqNullSafe(F.col(f"{b}.content_sha256")))
    change = F.when(here("l") & ~here("r"), "deleted").when(~here("l") & here("r"), "added").when(~same("l", "r"), "changed")
    return t.select(*key, change.alias("change"), same("lb", "rb").alias("buffer_only")).where("change is not null")


def fingerprint_changes(before: DataFrame, after: DataFrame, key: list[str], fingerprint: str) -> DataFrame:
    """created / modified / removed keys, with renames found: a removed and a created key with one fingerprint that no
    other removed or created key has are one ``renamed`` row with the previous key. Keys are the last of ``key``; the rest is scope."""
    scope, name = key[:-1], key[-1]
    b = before.select(*key, F.col(fingerprint).alias("_ts_f"), F.lit(0).alias("_ts_s"))
    a = after.select(*key, F.col(fingerprint).alias("_ts_f"), F.lit(1).alias("_ts_s"))
    g = b.unionByName(a).groupBy(*key).agg(F.max(F.when(F.col("_ts_s") == 0, F.struct("_ts_f"))).alias("b"), F.max(F.when(F.col("_ts_s") == 1, F.struct("_ts_f"))).alias("a"))
    kind = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "removed").when(~F.col("b._ts_f").eqNullSafe(F.col("a._ts_f")), "modified")
    changes = g.select(*key, kind.alias("kind"), F.coalesce("a._ts_f", "b._ts_f").alias("_ts_f")).where("kind is not null")
    # uniqueness by counts in one aggregation, not by listing a fingerprint's keys
    pair = changes.where("kind <> 'modified' and _ts_f is not null").groupBy(*scope, "_ts_f").agg(
        F.count_if(F.col("kind") == "created").alias("c"), F.count_if(F.col("kind") == "removed").alias("r"), F.max(F.when(F.col("kind") == "created", F.col(name))).alias("_ts_to"), F.max(F.when(F.col("kind") == "removed", F.col(name))).alias("_ts_from")
    ).where("c = 1 and r = 1").select(*scope, "_ts_to", "_ts_from")
    renamed = pair.select(*scope, F.col("_ts_to").alias(name), F.lit("renamed").alias("kind"), F.col("_ts_from").alias(f"previous_{name}"))
    taken = pair.select(*scope, F.explode(F.array("_ts_to", "_ts_from")).alias(name))
    rest = changes.join(taken, key, "left_anti").select(*key, "kind", F.lit(None).cast("string").alias(f"previous_{name}"))
    return rest.unionByName(renamed)
