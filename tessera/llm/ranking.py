"""One ranking from several differently-scaled scores, by closeness to an ideal point.

Scores of a query are winsorised at fences around the quartiles, divided by their vector norm within the query, and
compared with the best and the worst value that the query has: closeness = d- / (d+ + d-). No score's range reaches the
distances, so the widest does not decide.

A candidate is one row with its scores in an array, a query's statistics one row with its kinds of scores in an array; the two
meet by the query, and all distances are computed inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordered import running_totals

ITEM = ["query_id", "chunk_id"]
#: Strictly highest in all of a query's scores or in all but one, where it has at least three: at most one candidate of a query.
CLEAR = "scores >= 3 and strictly_best >= scores - 1"
#: Closeness is rounded to so many digits, so that the order of a sum does not decide between equals.
DIGITS = 12


def candidates(hits: DataFrame) -> DataFrame:
    """One row per (query, candidate) with ``vals``: label and value of ``score`` and of every factor label.

    Hits delivered again count once (the last returned); the greatest of several points under one label counts.
    Null labels and null points are no scores. Rows without query_id or chunk_id are left out.
    """
    h = hits.where("query_id is not null and chunk_id is not null")
    h = h.groupBy(*ITEM).agg(F.max_by(F.struct("score", "factors"), F.struct("returned_at", F.coalesce("score", F.lit(-1)))).alias("h"))
    own = F.array(F.struct(F.lit("score").alias("label"), F.col("h.score").cast("double").alias("v")))
    points = F.transform(F.coalesce("h.factors", F.array()), lambda x: F.struct(F.concat(F.lit("factor:"), x["label"]).alias("label"), x["points"].cast("double").alias("v")))
    told = F.filter(F.concat(own, points), lambda x: x["label"].isNotNull() & x["v"].isNotNull())
    h = h.select(*ITEM, told.alias("told"))
    labels = F.array_distinct(F.transform("told", lambda x: x["label"]))
    greatest = F.transform(labels, lambda n: F.struct(n.alias("label"), F.array_max(F.transform(F.filter("told", lambda x: x["label"] == n), lambda x: x["v"])).alias("v")))
    return h.select(*ITEM, greatest.alias("vals"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _cut(v: Column, lo: Column, hi: Column) -> Column:
    # a spread of nothing leaves no fence: half of the values are equal, the rest would all be cut to them
    return F.when(hi > lo, F.least(F.greatest(v, lo), hi)).otherwise(v)


def closeness(rows: DataFrame, fence: float = 3.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Per candidate (see ``candidates``): closeness, and in how many of the query's scores it is strictly the highest.

    A score counts in a query if two candidates have a value there. ``fence`` is the number of interquartile ranges
    beyond the quartiles at which values are winsorised; the order inside the fences is untouched. A missing value stands at
    the middle of the query's values, so it neither helps nor harms. All statistics are mergeable aggregates, so a query
    with a third of all rows is combined map-side; a query's kinds of scores (its labels) are held together in one row.
    Result: query_id, chunk_id, closeness (0.5 where a query has no usable score), scores, strictly_best.
    """
    per = ["query_id", "label"]
    each = rows.select(*ITEM, F.explode("vals").alias("x")).select(*ITEM, "x.label", "x.v")
    spread = each.groupBy(*per).agg(F.count("v").alias("n"), F.percentile_approx("v", [0.25, 0.5, 0.75], 10000).alias("q"), F.max("v").alias("top"), F.min("v").alias("low")).where("n >= 2")
    iqr = F.col("q")[2] - F.col("q")[0]
    fenced = spread.select(*per, "top", "low", F.col("q")[1].alias("mid"), (F.col("q")[0] - fence * iqr).alias("lo"), (F.col("q")[2] + fence * iqr).alias("hi"))
    w = F.lit(1.0)
    for label, weight in (weights or {}).items():
        w = F.when(F.col("label") == label, weight).otherwise(w)
    lo, hi = F.col("lo"), F.col("hi")
    kinds = fenced.select("query_id", F.struct("label", "top", "lo", "hi", _cut(F.col("top"), lo, hi).alias("best"), _cut(F.col("low"), lo, hi).alias("worst"), _cut(F.col("mid"), lo, hi).alias("middle"), w.alias("w")).alias("k"))
    kinds = kinds.groupBy("query_id").agg(F.sort_array(F.collect_list("k")).alias("kinds"))
    met = rows.join(kinds, "query_id", "left")
    # a value of null stands for a score that the candidate lacks; values come in the order of the query's kinds
    own = F.transform(F.coalesce("kinds", F.array()), lambda k: F.element_at(F.map_from_entries("vals"), k["label"]))
    met = met.select(*ITEM, "kinds", own.alias("own"))
    used = met.select("query_id", F.posexplode(F.arrays_zip("kinds", "own")).alias("nth", "x")).where("x.own is not null")
    squared = F.pow(_cut(F.col("x.own"), F.col("x.kinds.lo"), F.col("x.kinds.hi")), 2)
    norms = used.groupBy("query_id", "nth").agg(F.sqrt(F.sum(squared)).alias("norm"), F.count_if(F.col("x.own") == F.col("x.kinds.top")).alias("at_top"))
    norms = norms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("nth", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0).alias("norm"), "at_top"))).alias("norms"))
    all_of = met.join(norms, "query_id", "left").withColumn("z", F.arrays_zip(F.coalesce("kinds", F.array()), "own", F.coalesce("norms", F.array())))

    def distance(end: str) -> Column:
        def part(z: Column) -> Column:
            k = z["0"]
            x = F.when(z["own"].isNull(), k["middle"]).otherwise(_cut(z["own"], k["lo"], k["hi"]))
            return F.pow(k["w"] * (k[end] - x) / z["2"]["norm"], 2)

        return F.sqrt(_sum(F.transform("z", part)))

    first = F.size(F.filter("z", lambda z: (z["own"] == z["0"]["top"]) & (z["2"]["at_top"] == 1)))
    r = all_of.select(*ITEM, F.size("own").cast("bigint").alias("scores"), first.cast("bigint").alias("strictly_best"), distance("best").alias("up"), distance("worst").alias("down"))
    return r.select(*ITEM, F.round(F.when(F.col("up") + F.col("down") > 0, F.col("down") / (F.col("up") + F.col("down"))).otherwise(0.5), DIGITS).alias("closeness"), "scores", "strictly_best")


def rank_hits(hits: DataFrame) -> DataFrame:
    """The ranking of every query: rank from 1 by closeness, ties by chunk_id, after a clear winner. A query of any size is ranked in pieces.

    Closeness alone does not always put a clear winner first: the one score it may lose can cost it more than the others gain.
    """
    c = closeness(candidates(hits)).withColumn("_ts_clear", F.expr(CLEAR))
    ranked = running_totals(c, ["query_id"], [F.desc("_ts_clear"), F.desc("closeness"), F.asc("chunk_id")], None, "_ts_total", "rank")
    return ranked.select("query_id", "chunk_id", "closeness", F.col("rank").cast("bigint").alias("rank"), "scores", "strictly_best")


def clear_winners(hits: DataFrame) -> DataFrame:
    """The first of every ranking, where it is strictly highest in all of the query's scores or in all but one of at least three."""
    return rank_hits(hits).where("rank = 1").where(CLEAR)
