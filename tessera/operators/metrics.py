"""Benchmark metrics: samples, summaries with nearest-rank percentiles, comparisons, budgets and golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordered import running_totals


def summarise(samples: DataFrame, group: list[str], value: str) -> DataFrame:
    """count, min, max, mean, p50, p95 and p99 per group; a percentile is the value at index round((n - 1) p), halves to even.

    Null values are left out. Ranks come from range partitions, so no group is collected into one task.
    """
    s = samples.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_ts_v"))
    stats = s.groupBy(*group).agg(F.count("*").alias("count"), F.min("_ts_v").alias("min"), F.max("_ts_v").alias("max"), F.avg("_ts_v").alias("mean"))
    ranked = running_totals(s, group, ["_ts_v"], None, "_ts_t", "_ts_rank")
    quantiles = (0.5, 0.95, 0.99)
    at = lambda p: F.rint((F.col("count") - 1) * p).cast("bigint") + 1
    g = [F.col(x).alias(f"_ts_g{i}") for i, x in enumerate(group)]
    small = stats.select(*g, *[at(p).alias(f"_ts_at{int(p * 100)}") for p in quantiles])
    on = F.lit(True)
    for i, x in enumerate(group):
        on = on & F.col(x).eqNullSafe(F.col(f"_ts_g{i}"))
    picked = ranked.join(small, on).groupBy(*group).agg(*[F.max(F.when(F.col("_ts_rank") == F.col(f"_ts_at{int(p * 100)}"), F.col("_ts_v"))).alias(f"p{int(p * 100)}") for p in quantiles])
    p = picked.select(*g, *[f"p{int(x * 100)}" for x in quantiles])
    return stats.join(p, on).select(*group, "count", "min", "max", "mean", *[f"p{int(x * 100)}" for x in quantiles])


def fan_out(rows: DataFrame, samples: dict[str, tuple[Column, str]], keep: list[str]) -> DataFrame:
    """One row per (row, metric): ``samples`` gives value and unit by metric name."""
    each = F.array(*[F.struct(F.lit(name).alias("metric_name"), F.lit(unit).alias("unit"), v.cast("double").alias("value")) for name, (v, unit) in samples.items()])
    return rows.select(*keep, F.explode(each).alias("_ts_m")).select(*keep, "_ts_m.*")


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Metrics that both runs have, in one unit and not null: values, delta, and percent (null if the baseline is 0)."""
    b = baseline.select("metric_name", F.col("unit").alias("_ts_u"), F.col("value").alias("baseline"))
    both = b.join(candidate.select("metric_name", "unit", F.col("value").alias("candidate")), "metric_name").where("_ts_u = unit and baseline is not null and candidate is not null")
    delta = F.col("candidate") - F.col("baseline")
    return both.select("metric_name", "unit", "baseline", "candidate", delta.alias("delta"), (delta * 100 / F.nullif("baseline", F.lit(0.0))).alias("percent"))


def evaluate_budgets(budgets: DataFrame, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Verdict per budget (metric_name, max_value, min_value, max_regression_pct, severity): pass, warn or fail.

    A budget without a candidate value fails. Regression counts upwards, for units ``ratio`` and ``percent`` downwards.
    """
    c = candidate.select("metric_name", "unit", F.col("value").alias("candidate"))
    b = baseline.select("metric_name", F.col("value").alias("baseline"))
    j = budgets.join(c, "metric_name", "left").join(b, "metric_name", "left")
    worse = (F.col("candidate") - F.col("baseline")) * 100 / F.nullif("baseline", F.lit(0.0))
    worse = F.when(F.col("unit").isin("ratio", "percent"), -worse).otherwise(worse)
    broken = F.col("candidate").isNull() | F.coalesce(F.col("candidate") > F.col("max_value"), F.lit(False)) | F.coalesce(F.col("candidate") < F.col("min_value"), F.lit(False)) | F.coalesce(worse > F.col("max_regression_pct"), F.lit(False))
    return j.select("metric_name", "candidate", "baseline", worse.alias("regression_pct"), F.when(~broken, "pass").otherwise(F.col("severity")).alias("verdict"))


def overall(verdicts: DataFrame) -> DataFrame:
    """The worst verdict: fail over warn over pass."""
    rank = F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "warn", 1).otherwise(0)
    return verdicts.agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("verdict"))


def evaluate_golden(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: expected hits, those matched (found with rank at most rank_max), and whether all were.

    Of several hits on one path the last counts, as does the last rank.
    """
    actual = hits.groupBy("query_id", "path").agg(F.max("rank").alias("rank"))
    j = expected.join(actual, ["query_id", "path"], "left")
    ok = F.coalesce(F.col("rank") <= F.col("rank_max"), F.lit(False))
    return j.groupBy("query_id").agg(F.count("*").alias("expected_hits"), F.count_if(ok).alias("matched_hits"), F.every(ok).alias("passed"))


def wide(summaries: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """One column per metric name with its value; names that do not occur are null."""
    return summaries.groupBy(*key).agg(*[F.max(F.when(F.col("metric_name") == n, F.col("value"))).alias(n) for n in names])
