"""Query planning over tables of queries and candidates: intent, routes, fusion, groups and trust."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words and phrases that tell what a query wants.
SYMBOL_WORDS = ["definition", "definitions", "reference", "references", "caller", "callers", "method", "class", "symbol", "member", "namespace"]
IMPACT_PHRASES = ["what breaks", "blast radius", "who depends on", "what depends on", "if i rename", "if i delete", "if i change", "affected by", "impact of"]
ACTION_WORDS = ["invalidate", "rename", "delete", "remove", "change", "changes", "modify", "break", "breaks", "affect", "affects"]
QUESTION_WORDS = ["where", "how", "what", "which", "who", "why", "when"]
QUESTION_PHRASES = ["which file", "implementation", "what breaks"]
KNOWN_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mts", "cts", "json", "toml", "md", "rs"]
# Tie order of styles, routes per style, priority and greatest raw score of routes.
STYLES = ["impact", "exact", "symbol", "semantic"]
ROUTE_PRIORITY = {"exact": 4, "symbol": 3, "semantic": 2, "impact": 1}
GREATEST_SCORE = {"exact": 1100, "symbol": 1100, "semantic": 1_000_000, "impact": 1000}


def query_features(queries: DataFrame, text: str) -> DataFrame:
    """``queries`` with the normalised text, its tokens and the shape predicates. Null texts have no shape."""
    n = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    d = queries.withColumn("normalised", n).withColumn("_ts_low", F.lower("normalised"))
    d = d.withColumn("_ts_words", F.filter(F.split("_ts_low", r"[^a-z0-9_$]+"), lambda t: t != ""))
    n, low, words = F.col("normalised"), F.col("_ts_low"), F.col("_ts_words")
    has = lambda values: F.arrays_overlap(words, F.array(*map(F.lit, values)))
    phrase = lambda values: reduce(lambda a, b: a | b, [low.contains(v) for v in values])
    regex = n.rlike(r"^/.*[.*+?()\[\]{}|].*/$") & (F.length(n) > 2)
    extension = ~n.contains(" ") & n.rlike(r"(?i)^.+\.(" + "|".join(KNOWN_EXTENSIONS) + ")$")
    ident = r"[A-Za-z_$][A-Za-z0-9_$]*"
    qualified = ~n.contains(" ") & (n.rlike(rf"^{ident}(?:(?:::|#|\.)+{ident})+$") & (n.contains("::") | n.contains("#") | ~extension))
    return d.withColumns(
        {
            "regex_like": regex,
            "quoted": n.rlike(r"""^(".*"|'.*')$""") & (F.length(n) > 1),
            "glob_like": ~n.contains(" ") & ~regex & n.rlike(r"[*?]"),
            "path_like": n.contains("/") | n.contains("\\") | extension,
            "qualified": qualified,
            "identifier": n.rlike(rf"^{ident}$"),
            "question": F.coalesce(F.get(words, F.lit(0)).isin(*QUESTION_WORDS), F.lit(False)) | phrase(QUESTION_PHRASES),
            "impact_phrase": phrase(IMPACT_PHRASES),
            "symbol_words": has(SYMBOL_WORDS),
            "action_words": has(ACTION_WORDS),
            "tokens": F.size(words),
        }
    )


def classify(featured: DataFrame, has_target: Column | None = None, has_filters: Column | None = None, default: str = "semantic") -> DataFrame:
    """Scores of the four styles, the primary one and all within one point of it, best first (ties in the order of STYLES)."""
    c = F.col
    p = lambda cond, points: F.when(cond, points).otherwise(0)
    target = has_target if has_target is not None else F.lit(False)
    filters = has_filters if has_filters is not None else F.lit(False)
    exact = p(c("regex_like") | c("quoted") | c("glob_like") | c("path_like"), 6)
    symbol = F.when(c("qualified"), 6).when(c("identifier"), 4).otherwise(0) + p(c("symbol_words"), 2) + p(c("path_like"), 1) + p(filters, 1)
    semantic = p(c("question"), 4) + p(c("tokens") >= 3, 2) + p(~c("identifier") & ~c("qualified") & ~c("path_like"), 1)
    impact = p(c("impact_phrase"), 6) + p(c("action_words"), 6) + p(c("question") & c("action_words"), 1) + p(target, 1)
    scored = {"impact": impact, "exact": exact, "symbol": symbol, "semantic": semantic}
    d = featured.withColumns({f"{s}_score": scored[s] for s in STYLES})
    ranked = F.array_sort(F.array(*[F.struct((-c(f"{s}_score")).alias("s"), F.lit(i).alias("o"), F.lit(s).alias("style")) for i, s in enumerate(STYLES)]))
    d = d.withColumn("_ts_r", ranked)
    top = -c("_ts_r")[0]["s"]
    near = F.transform(F.filter("_ts_r", lambda x: (-x["s"] > 0) & (-x["s"] + 1 >= top)), lambda x: x["style"])
    return d.withColumn("primary", F.when(top == 0, default).otherwise(c("_ts_r")[0]["style"])).withColumn("styles", F.when(top == 0, F.array(F.lit(default))).otherwise(near)).drop("_ts_r")


def change_hint(words: Column) -> Column:
    """rename, delete or modify_behavior, from a query's words."""
    return F.when(F.array_contains(words, "rename"), "rename").when(F.arrays_overlap(words, F.array(F.lit("delete"), F.lit("remove"))), "delete").otherwise("modify_behavior")


def normalised_score(route: Column, raw: Column) -> Column:
    """0..100: raw * 100 / greatest, cut to whole numbers; a null raw score is 0."""
    greatest = F.create_map(*[F.lit(x) for pair in GREATEST_SCORE.items() for x in pair])
    return F.least(F.floor(F.coalesce(raw, F.lit(0)) * 100 / F.try_element_at(greatest, route)), F.lit(100)).cast("int")


def reserve_budgets(routes: list[tuple[str, int]], total: int) -> list[tuple[str, int, bool]]:
    """Which routes fit into the total time, in order: one that does not fit is skipped, later ones may still fit; the first always runs, cut to the total."""
    left, out = total, []
    for i, (route, wanted) in enumerate(routes):
        given = min(wanted, total) if i == 0 else wanted
        fits = given <= left
        out.append((route, given if fits else 0, fits))
        left -= given if fits else 0
    return out


# How many candidates of a route a query takes into the fusion.
ROUTE_BUDGETS = {"exact": 25, "symbol": 20, "semantic": 16, "impact": 8}


class Clusters:
    """Greedy clusters of one query's candidates: each goes to the first cluster with a member of the same symbol, of a span that
    overlaps in the same path, or of the same path where neither has a span or a symbol."""

    def __init__(self):
        self.by_symbol: dict[str, int] = {}
        self.by_path: dict[str, int] = {}
        self.spans: dict[str, list[tuple[int, int, int]]] = {}
        self.count = 0

    def place(self, symbol: str | None, path: str | None, start: int | None, end: int | None) -> int:
        found = [self.by_symbol[symbol]] if symbol in self.by_symbol else []
        if path is not None:
            if start is None and symbol is None and path in self.by_path:
                found.append(self.by_path[path])
            elif start is not None:
                found += [k for a, z, k in self.spans.get(path, ()) if start < z and a < end]
        k = min(found, default=self.count)
        self.count = max(self.count, k + 1)
        if symbol is not None:
            self.by_symbol[symbol] = min(k, self.by_symbol.get(symbol, k))
        if path is not None:
            if start is not None:
                self.spans.setdefault(path, []).append((start, end, k))
            elif symbol is None:
                self.by_path[path] = min(k, self.by_path.get(path, k))
        return k


def _fuse(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["arrival", "candidate_id"], kind="stable")
    none = lambda c: [None if pd.isna(x) else x for x in rows[c]]
    clusters = Clusters()
    return rows.assign(cluster=[clusters.place(*x) for x in zip(none("symbol_id"), none("path"), none("start"), none("end"), strict=True)])


def fuse(candidates: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """Clusters of candidates that mean the same place, per query: query_id, cluster, score, routes, members, best candidate.

    ``candidates``: query_id, candidate_id, route, raw_score, engine_rank, symbol_id, path, start, end, and ``arrival``, the order in which they
    came; without it routes come by priority and their candidates by engine rank. That order decides on the clusters, so a query's candidates are
    fused in one call; ``budgets`` (such as ``ROUTE_BUDGETS``) bound them per route, by engine rank. Score: the best normalised one, and
    2 for each further route, at most 6. Routes are listed in the order in which they came.
    """
    if budgets is not None:
        most = F.try_element_at(F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair]), F.col("route"))
        w = Window.partitionBy("query_id", "route").orderBy(F.asc_nulls_last("engine_rank"), "candidate_id")
        candidates = candidates.withColumn("_ts_n", F.row_number().over(w)).where((F.col("_ts_n") <= max(budgets.values())) & (F.col("_ts_n") <= most)).drop("_ts_n")
    priority = F.try_element_at(F.create_map(*[F.lit(x) for pair in ROUTE_PRIORITY.items() for x in pair]), F.col("route"))
    came = F.col("arrival").cast("bigint") if "arrival" in candidates.columns else (F.lit(1 << 40) * (F.lit(100) - priority) + F.coalesce("engine_rank", F.lit((1 << 31) - 1))).cast("bigint")
    c = candidates.select("query_id", "candidate_id", "route", normalised_score(F.col("route"), F.col("raw_score")).alias("normalised"), priority.alias("priority"), "engine_rank", "symbol_id", "path", "start", "end", came.alias("arrival"))
    out = "query_id string, candidate_id string, route string, normalised int, priority int, engine_rank int, symbol_id string, path string, start bigint, end bigint, arrival bigint, cluster int"
    m = c.groupBy("query_id").applyInPandas(_fuse, out)
    g = m.groupBy("query_id", "cluster").agg(
        F.max("normalised").alias("_ts_best"),
        F.sort_array(F.collect_set("route")).alias("routes"),
        F.count("*").alias("members"),
        F.min_by("candidate_id", F.struct(-F.col("normalised"), -F.col("priority"), F.coalesce("engine_rank", F.lit(2147483647)), "candidate_id")).alias("candidate_id"),
        F.max("symbol_id").alias("symbol_id"),
        F.max("path").alias("path"),
    )
    return g.select("query_id", "cluster", (F.col("_ts_best") + F.least((F.size("routes") - 1) * 2, F.lit(6))).alias("score"), "routes", "members", "candidate_id", "symbol_id", "path")


def group(fused: DataFrame, limit: int) -> DataFrame:
    """Groups by symbol, else file, else the candidate alone: the best score, all routes; ordered by score and id, cut at ``limit`` per query."""
    key = F.coalesce(F.concat(F.lit("symbol:"), "symbol_id"), F.concat(F.lit("file:"), "path"), F.concat(F.lit("one:"), "candidate_id"))
    g = fused.withColumn("group_id", key).groupBy("query_id", "group_id").agg(F.max("score").alias("score"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("routes")))).alias("routes"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "group_id")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def with_trust(groups: DataFrame, low_signal: Column | None = None) -> DataFrame:
    """``groups`` with the trust tier of their evidence, the gap to the next group's score, and whether that gap is small (at most 3)."""
    low = low_signal if low_signal is not None else F.lit(False)
    has = lambda r: F.array_contains("routes", r)
    n = F.size("routes")
    tier = F.when(has("exact") | (n >= 3), "high").when(n >= 2, "medium").when(has("symbol"), F.when(low, "low").otherwise("medium")).when(has("semantic") | has("impact"), "low").otherwise("needs_review")
    w = Window.partitionBy("query_id").orderBy("rank")
    gap = F.col("score") - F.lead("score").over(w)
    return groups.withColumn("tier", tier).withColumn("gap", gap).withColumn("close", F.coalesce(gap <= 3, F.lit(False)))


def ambiguous(trusted: DataFrame) -> DataFrame:
    """Queries whose two best groups are both above 0 and at most 3 points apart."""
    best = trusted.where("rank <= 2").groupBy("query_id").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.count("*").alias("n"))
    return best.select("query_id", ((F.col("n") == 2) & (F.col("least") > 0) & (F.col("most") - F.col("least") <= 3)).alias("ambiguous"))


# ---- routes -------------------------------------------------------------------------------------------------------

# Routes of each style in order.
STYLE_ROUTES = {"exact": ["exact", "symbol"], "symbol": ["symbol", "semantic"], "semantic": ["semantic", "symbol"], "impact": ["symbol", "semantic", "impact"]}


def plan_routes(styles: list[str], preferred: list[str] | None = None, disabled: list[str] | None = None) -> list[str]:
    """The routes of the styles, each once in order; preferred ones come right after the first, disabled ones not at all."""
    routes = list(dict.fromkeys(r for s in styles for r in STYLE_ROUTES[s]))
    if routes and preferred:
        wanted = [r for r in preferred if r in routes[1:]]
        routes = [routes[0], *wanted, *[r for r in routes[1:] if r not in wanted]]
    return [r for r in routes if r not in (disabled or [])]


def low_signal(query: str, seeds: int = 0) -> bool:
    """Whether a query says too little for a vector search alone: at most three words and nothing to start from."""
    return len(query.split()) <= 3 and seeds == 0


def supports(mask: set[str], filters: dict[str, list]) -> list[str]:
    """Filters that are asked for and that a route cannot apply; a route with any is skipped."""
    return sorted(name for name, values in filters.items() if values and name not in mask)


def run_routes(routes: list[str], run: dict, mode: str) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Runs routes (``run`` gives a DataFrame by route) and tells what became of each: ran, empty, unavailable, not_needed.

    ``single`` runs the first that there is, ``staged`` stops at the first with candidates, ``multi`` runs all.
    """
    out: DataFrame | None = None
    trace: list[tuple[str, str]] = []
    done = False
    for r in routes:
        if done:
            trace.append((r, "not_needed"))
            continue
        if r not in run:
            trace.append((r, "unavailable"))
            continue
        got = run[r]()
        empty = mode != "multi" and got.isEmpty()
        trace.append((r, "empty" if empty else "ran"))
        out = got if out is None or mode != "multi" else out.unionByName(got)
        done = mode == "single" or (mode == "staged" and not empty)
    return out, trace


def seed_anchor(candidates: DataFrame) -> tuple[str | None, str]:
    """The one symbol that a seed search means: (symbol, "unique"), (None, "ambiguous") or (None, "none"); two rows at most reach the driver."""
    got = [r[0] for r in candidates.where("symbol_id is not null").select("symbol_id").distinct().limit(2).collect()]
    return (got[0], "unique") if len(got) == 1 else (None, "ambiguous" if got else "none")


def no_answer(trace: list[tuple[str, str]], candidates: int, ambiguous: bool) -> str | None:
    """Why there is no answer, the first that holds, or None."""
    if candidates:
        return None
    if ambiguous:
        return "ambiguous"
    if trace and all(state == "unavailable" for _, state in trace):
        return "no_route_available"
    return "no_candidates"


# Default and greatest limits of each kind of search.
LIMITS = {"symbol": (25, 200), "semantic": (20, 200), "impact": (20, 200), "planner": (10, 50)}


def clamped_limit(kind: str, asked: int | None) -> int:
    """The limit that holds: the default where none (or, but for the planner, 0) is asked; never above the greatest, and for the planner at least 1."""
    default, most = LIMITS[kind]
    if asked is None or (asked == 0 and kind != "planner"):
        return default
    return max(min(asked, most), 1 if kind == "planner" else 0)


def with_mode(classified: DataFrame, mode: Column) -> DataFrame:
    """``classified`` where a ``mode`` (a style, or null) overrides what the words tell: it is then the primary style and the only one. Unknown modes override nothing."""
    known = mode.isin(*STYLES)
    return classified.withColumn("styles", F.when(known, F.array(mode)).otherwise(F.col("styles"))).withColumn("primary", F.when(known, mode).otherwise(F.col("primary"))).withColumn("overridden", F.coalesce(known, F.lit(False)))


def query_ir(queries: DataFrame, text: str, limit: str | None = None, mode: str | None = None) -> DataFrame:
    """The plan of each query as a row: normalised text, primary style, styles, routes in order, limit, change hint. Empty queries have an ``error`` and no routes."""
    c = classify(query_features(queries, text))
    c = with_mode(c, F.col(mode) if mode else F.lit(None).cast("string"))
    default, most = LIMITS["planner"]
    n = F.least(F.greatest(F.coalesce(F.col(limit) if limit else F.lit(None), F.lit(default)), F.lit(1)), F.lit(most))
    empty = F.col("normalised") == ""
    ordered = sorted(ROUTE_PRIORITY, key=lambda r: -ROUTE_PRIORITY[r])
    routes = F.concat(F.array("primary"), F.filter(F.array(*map(F.lit, ordered)), lambda r: F.array_contains("styles", r) & (r != F.col("primary"))))
    none = F.array().cast("array<string>")
    return c.select(
        *queries.columns, "normalised", "primary", "styles", F.when(empty, none).otherwise(routes).alias("routes"), n.cast("int").alias("plan_limit"), change_hint(F.col("_ts_words")).alias("change_hint"), "overridden",
        F.when(empty, "empty query").alias("error"),
    )


CANDIDATE = ["query_id", "candidate_id", "route", "raw_score", "engine_rank", "symbol_id", "path", "start", "end", "anchor"]


def adapted(hits: DataFrame, route: str) -> DataFrame:
    """Hits of one engine as candidates of the common schema (``CANDIDATE``): what the engine does not know is null.

    ``hits`` has query_id and hit_id, and of score, rank, symbol_id, path, start, end what there is. The anchor is the symbol, else the span, else
    the file; hits of an impact have no span.
    """
    have = set(hits.columns)
    get = lambda c, kind: (F.col(c) if c in have and not (route == "impact" and c in ("start", "end")) else F.lit(None)).cast(kind).alias(c)
    r = hits.select("query_id", F.concat(F.lit(f"{route}:"), "hit_id").alias("candidate_id"), F.lit(route).alias("route"), get("score", "bigint"), get("rank", "int"), get("symbol_id", "string"), get("path", "string"), get("start", "bigint"), get("end", "bigint"))
    anchor = F.when(F.col("symbol_id").isNotNull(), "symbol").when(F.col("path").isNotNull() & F.col("start").isNotNull(), "span").when(F.col("path").isNotNull(), "file")
    return r.withColumnsRenamed({"score": "raw_score", "rank": "engine_rank"}).withColumn("anchor", anchor).select(*CANDIDATE)


def trust_summary(trusted: DataFrame) -> DataFrame:
    """Groups per tier of each query: query_id, tier, groups."""
    return trusted.groupBy("query_id", "tier").agg(F.count("*").alias("groups"))


def warnings(trusted: DataFrame, partial: Column | None = None, low_signal: Column | None = None) -> DataFrame:
    """Per query what to be wary of: close_scores, single_route, low_trust, and partial_results or low_signal where these hold for its groups. Sorted."""
    first = F.max(F.when(F.col("rank") == 1, F.struct("close", F.size("routes").alias("n"), "tier")))
    flags = trusted.groupBy("query_id").agg(first.alias("f"), F.max(partial if partial is not None else F.lit(False)).alias("p"), F.max(low_signal if low_signal is not None else F.lit(False)).alias("l"))
    said = F.array(F.when(F.col("f.close"), "close_scores"), F.when(F.col("f.n") == 1, "single_route"), F.when(F.col("f.tier").isin("low", "needs_review"), "low_trust"), F.when(F.col("p"), "partial_results"), F.when(F.col("l"), "low_signal"))
    return flags.select("query_id", F.sort_array(F.array_compact(said)).alias("warnings"))
