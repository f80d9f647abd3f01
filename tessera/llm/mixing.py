"""Mixing sources to target weights.

Each source's documents get hash-random keys and are range-sorted by them; distributed prefix sums of token counts then tell for
every document whether it lies before the cut at the source's budget. Budgets beyond one pass repeat the source whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import VOCABULARY, with_tokens
from tessera.plans.lineage import cut
from tessera.plans.ordered import running_totals


def source_name(source: Column) -> Column:
    """One spelling per source: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source and tokens of every document with tokens. A doc_id delivered again counts once, with its longest text."""
    d = with_tokens(documents.select("doc_id", source_name(F.col("source")).alias("source"), "text"), "text", "tokens", vocabulary).drop("text")
    d = d.where("doc_id is not null and tokens > 0")
    return d.groupBy("doc_id").agg(F.max_by("source", F.struct("tokens", "source")).alias("source"), F.max("tokens").alias("tokens"))


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: target_share, available tokens, budget, whole passes and the rest of a pass.

    Without ``total_tokens`` the total is the largest one at which every source that has documents meets its share
    within its repeats. With it, a source gives what its repeats allow. Shares of sources without documents stay unmet.
    """
    t = targets.where("target_share > 0").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count("*").alias("available_documents"))
    b = t.join(have, "source", "left").withColumns({"available_tokens": F.coalesce("available_tokens", F.lit(0)), "available_documents": F.coalesce("available_documents", F.lit(0))})
    most = F.col("available_tokens") * F.col("max_repeats")
    if total_tokens is None:
        b = b.withColumn("_ts_total", F.min(F.when(F.col("available_tokens") > 0, most / F.col("target_share"))).over(_all()))
    else:
        b = b.withColumn("_ts_total", F.lit(float(total_tokens)))
    b = b.withColumn("budget", F.least(F.floor(F.coalesce(F.col("_ts_total"), F.lit(0.0)) * F.col("target_share") + F.lit(1e-6)), most).cast("bigint"))
    whole = F.when(F.col("available_tokens") > 0, F.floor(F.col("budget") / F.col("available_tokens"))).otherwise(0)
    return b.withColumn("whole", whole.cast("bigint")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("available_tokens")).drop("_ts_total")


def _all():
    """A window over all target sources: a table of one row per source, which people write."""
    return Window.partitionBy(F.lit(1))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, tokens, repeats) and the report per source.

    Within a source documents are taken in the order of hash-random keys until the next one would pass the budget; every
    document is taken in each whole pass. Documents of sources without a target are left out.
    """
    sized = cut(sized_documents(documents, vocabulary))
    b = cut(budgets(sized, targets, total_tokens))
    wanted = sized.join(b.select("source", "whole", "rest"), "source")
    keyed = wanted.withColumn("_ts_key", F.xxhash64("doc_id", F.lit(seed)))
    summed = running_totals(keyed, ["source"], [F.asc("_ts_key"), F.asc("doc_id")], "tokens", "_ts_sum")
    repeats = F.col("whole") + F.when(F.col("_ts_sum") <= F.col("rest"), 1).otherwise(0)
    chosen = summed.select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("chosen_tokens"), F.count("*").alias("chosen_documents"), F.max("repeats").alias("most_repeats"))
    report = b.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chosen_tokens", "chosen_documents", "most_repeats")})
    all_tokens = F.sum("chosen_tokens").over(_all())
    report = report.withColumn("actual_share", F.when(all_tokens > 0, F.col("chosen_tokens") / all_tokens).otherwise(0.0))
    return chosen, report.select("source", "target_share", "actual_share", "max_repeats", "most_repeats", "available_documents", "available_tokens", "budget", "chosen_documents", "chosen_tokens")
