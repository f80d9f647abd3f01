"""Ranked name search and filters over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.globs import matches_any
from tessera.functions.text import ascii_lower

# Points of a name match and limits of the result.
MATCH_POINTS = {"exact": 1000, "prefix": 700, "substring": 400}
VISIBILITY_POINTS = {"default_export": 25, "exported": 20}
DEFAULT_LIMIT, MOST = 25, 200


def clamp_limit(limit: int, default: int = DEFAULT_LIMIT, most: int = MOST) -> int:
    """0 asks for the default; more than ``most`` is cut."""
    return min(limit or default, most)


def match_class(name: Column, query: str, mode: str) -> Column:
    """The best class of match that ``mode`` (exact, prefix, substring) allows, else null; an empty query matches nothing."""
    if not query:
        return F.lit(None).cast("string")
    q, n = F.lit(query.lower()), ascii_lower(name)
    found = F.when(n == q, "exact")
    if mode in ("prefix", "substring"):
        found = found.when(n.startswith(q), "prefix")
    if mode == "substring":
        found = found.when(n.contains(q), "substring")
    return found


def search_names(symbols: DataFrame, query: str, mode: str = "substring", kinds: list[str] | None = None, path_prefix: str = "", limit: int = 0) -> DataFrame:
    """Ranked symbols. ``symbols``: symbol_id, name, kind, path, stem, visibility, depth, start.

    Points: class of the match, 40 for the same case, preferred kinds 100, 50, 0 .., visibility, 10 if the file's stem is
    the query, 10 less the depth of the container. Order: score, kind preference, path, name, kind, start, symbol_id.
    Filters run below the scan; the limit is a top-k without a full sort. Rows with a null name never match.
    """
    s = symbols.withColumn("match_class", match_class(F.col("name"), query, mode)).where("match_class is not null")
    if path_prefix:
        s = s.where(F.col("path").startswith(path_prefix))
    preference = F.lit(None).cast("int")
    if kinds:
        s = s.where(F.col("kind").isin(*kinds))
        preference = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int") - 1
    points = F.lit(0)
    for kind, p in MATCH_POINTS.items():
        points = F.when(F.col("match_class") == kind, p).otherwise(points)
    # the part of the name that matched, in the case asked for
    cls, name = F.col("match_class"), F.col("name")
    same_case = ((cls == "exact") & (name == query)) | ((cls == "prefix") & name.startswith(query)) | ((cls == "substring") & name.contains(query))
    visible = F.lit(0)
    for v, p in VISIBILITY_POINTS.items():
        visible = F.when(F.col("visibility") == v, p).otherwise(visible)
    score = (
        points
        + F.when(same_case, 40).otherwise(0)
        + F.coalesce(F.greatest(100 - 50 * preference, F.lit(0)), F.lit(0))
        + visible
        + F.when(ascii_lower(F.coalesce("stem", F.lit(""))) == query.lower(), 10).otherwise(0)
        + 10
        - F.least(F.coalesce("depth", F.lit(0)), F.lit(10))
    )
    ranked = s.withColumn("score", score.cast("int")).withColumn("kind_rank", preference)
    order = [F.desc("score"), F.asc_nulls_last("kind_rank"), "path", "name", "kind", "start", "symbol_id"]
    return ranked.orderBy(*order).limit(clamp_limit(limit))


def normalised_filter(values: list[str], extension: bool = False) -> list[str]:
    """Trimmed, blank runs collapsed, empty ones dropped, sorted, each once; extensions in lower case without a leading dot."""
    clean = [" ".join(v.split()) for v in values]
    if extension:
        clean = [v.lower().removeprefix(".") for v in clean]
    return sorted({v for v in clean if v})


def conjunction(lists: dict[str, list], globs: dict[str, list[str]] | None = None, ignore_case: bool = False) -> Column:
    """All lists must hold: a column is in its list, or the list is empty; a null fails a list that is not empty."""
    c = F.lit(True)
    for name, values in lists.items():
        if values:
            c = c & F.coalesce(F.col(name).isin(*values), F.lit(False))
    for name, patterns in (globs or {}).items():
        c = c & matches_any(F.col(name), patterns, ignore_case)
    return c


def low_signal_query(text: str, least: int = 3) -> bool:
    """Whether a text is too short to search for: fewer than ``least`` letters and digits."""
    return sum(c.isalnum() for c in text) < least


def best_per_path(hits: DataFrame, scope: list[str]) -> DataFrame:
    """The best hit of each path, numbered anew from 1 (by rank, then path)."""
    once = hits.groupBy(*scope, "path").agg(F.min("rank").alias("_ts_r"))
    w = Window.partitionBy(*scope).orderBy("_ts_r", "path")
    return once.select(*scope, "path", F.row_number().over(w).alias("rank"))
