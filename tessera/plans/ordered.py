"""Ranks and running totals inside groups of any size.

A window over a group sorts the whole group in one task. Here rows are range-partitioned by (group,
order), so a hot group spreads over many tasks; each piece is summed alone and pieces are joined
with the offset of the pieces before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def running_totals(df: DataFrame, group: list[str], order: list, weight: str | None, total: str, rank: str | None = None) -> DataFrame:
    """Adds ``total``, the sum of ``weight`` up to and with this row, and ``rank`` from 1.

    ``order`` must be total within a group (names or sort columns). ``weight`` null counts as 0; a
    null group is a group. Rows are kept whole; an empty input gives an empty result.
    """
    kept = df.columns
    w = F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1)
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order).sortWithinPartitions(*[F.col(g) for g in group], *order)
    ranged = cut(ranged.withColumn("_ts_row", F.monotonically_increasing_id())).withColumn("_ts_part", F.shiftright("_ts_row", 33))
    inside = Window.partitionBy("_ts_part", *group).orderBy("_ts_row").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_ts_sum", F.sum(w).over(inside)).withColumn("_ts_n", F.row_number().over(inside))
    before = Window.partitionBy(*group).orderBy("_ts_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_ts_part", *group).agg(F.sum(w).alias("_ts_s"), F.count("*").alias("_ts_c"))
    parts = parts.select(
        F.col("_ts_part").alias("_ts_p2"),
        *[F.col(g).alias(f"_ts_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_ts_s").over(before), F.lit(0)).alias("_ts_s0"),
        F.coalesce(F.sum("_ts_c").over(before), F.lit(0)).alias("_ts_c0"),
    )
    on = F.col("_ts_part") == F.col("_ts_p2")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_ts_g{i}"))
    added = [(F.col("_ts_sum") + F.col("_ts_s0")).alias(total)]
    if rank:
        added.append((F.col("_ts_n") + F.col("_ts_c0")).alias(rank))
    return local.join(parts, on, "inner").select(*kept, *added)
