"""Edge-list graphs: build, alias closure, reachability, containers and spans."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut

# Fixed value: after how many steps of a search the parts of what was seen are written as one.
FOLD = 8


def build_edges(*sources: DataFrame) -> DataFrame:
    """The union of edge sources (kind, src_key, dst_key), each edge once, with an id from its content."""
    u = sources[0].select("kind", "src_key", "dst_key")
    for s in sources[1:]:
        u = u.unionByName(s.select("kind", "src_key", "dst_key"))
    digest = F.substring(F.sha2(F.concat_ws("\n", "kind", "src_key", "dst_key"), 256), 1, 12)
    return u.distinct().select(F.concat(F.lit("edge."), "kind", F.lit("."), digest).alias("edge_id"), "kind", "src_key", "dst_key")


def degrees(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges per node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_key").alias("k"), F.lit(1).alias("o")), F.struct(F.col("dst_key").alias("k"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.k").alias("node_key")).agg(F.sum("e.o").alias("outgoing"), F.sum(1 - F.col("e.o")).alias("incoming"))


def canonical(edges: DataFrame, scope: list[str] | None = None, most_rounds: int = 40) -> DataFrame:
    """The end of every node's chain of single successors: scope, node, canonical, by pointer doubling.

    A node with no or several distinct targets is its own end. On a cycle, and for all that lead into it, the end is the least
    node of the cycle. Each round squares the jump table with one join and is cut by a checkpoint; n hops take log2 n rounds.
    ``least`` is carried along: the least node seen on the way, which on a cycle converges to the cycle's least.
    """
    scope = scope or []
    only = edges.where("src_key is not null and dst_key is not null and src_key <> dst_key").groupBy(*scope, "src_key").agg(F.min("dst_key").alias("a"), F.max("dst_key").alias("b")).where("a = b").select(*scope, F.col("src_key").alias("node"), F.col("a").alias("next"))
    jump = cut(only.withColumn("least", F.col("next")))
    left = jump.count()
    done: DataFrame | None = None
    rounds = 0
    while left and rounds < most_rounds and (1 << rounds) <= 2 * left:
        to = jump.select(*scope, F.col("node").alias("next"), F.col("next").alias("_ts_n"), F.col("least").alias("_ts_l"))
        joined = jump.join(to, [*scope, "next"], "left")
        squared = cut(joined.select(*scope, "node", F.coalesce("_ts_n", "next").alias("next"), F.least("least", F.coalesce("_ts_l", "least")).alias("least"), F.col("_ts_n").isNull().alias("_ts_end")))
        # ended rows stay in the table, for others still jump through them; the loop ends when no row moves
        left_now = squared.where("not _ts_end").count()
        jump = squared.drop("_ts_end")
        rounds += 1
        if left_now == 0:
            break
    moving = jump.join(jump.select(*scope, F.col("node").alias("next")).distinct(), [*scope, "next"], "left_semi")
    # what still moves after so many jumps stands on a cycle; once around it again from there gives its least node
    on_cycle = cut(moving.select(*scope, F.col("next").alias("at")).distinct())
    first = jump.select(*scope, F.col("node").alias("at"), F.col("least").alias("cycle_least"))
    ends = moving.withColumnRenamed("next", "at").join(on_cycle.join(first, [*scope, "at"]), [*scope, "at"]).select(*scope, "node", F.col("cycle_least").alias("canonical"))
    still = jump.join(moving.select(*scope, "node"), [*scope, "node"], "left_anti").select(*scope, "node", F.col("next").alias("canonical"))
    done = still.unionByName(ends)
    nodes = edges.select(*scope, F.explode(F.array("src_key", "dst_key")).alias("node")).where("node is not null").distinct()
    return nodes.join(done, [*scope, "node"], "left").select(*scope, "node", F.coalesce("canonical", "node").alias("canonical"))


def reachable(edges: DataFrame, starts: DataFrame, scope: list[str], most_depth: int | None = None) -> DataFrame:
    """Nodes within ``most_depth`` steps of each start, or at any depth: scope, start, node, depth (least). Starts are at depth 0.

    Breadth first: each step joins the frontier with the edges and drops what was seen, so it ends on cycles too. Every
    step is cut by a checkpoint, and what was seen is one table again after every ``FOLD`` steps.
    """
    e = edges.select(*scope, F.col("src_key").alias("node"), F.col("dst_key").alias("_ts_to")).distinct()
    seen = cut(starts.select(*scope, F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in count(1) if most_depth is None else range(1, most_depth + 1):
        step = frontier.join(e, [*scope, "node"]).select(*scope, "start", F.col("_ts_to").alias("node")).distinct()
        frontier = cut(step.join(seen, [*scope, "start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % FOLD == 0:
            seen = cut(seen.repartition(*scope, "start", "node"))
    return seen


def container_chains(nodes: DataFrame, most_depth: int = 16) -> DataFrame:
    """Depth and chain of names from the root for every node (id, container, name).

    The chain is walked by doubling; nodes deeper than 2^most_depth or on a cycle have the part that was walked.
    """
    t = cut(nodes.select("id", F.col("container").alias("up"), F.lit(0).alias("depth"), F.col("name").alias("chain")))
    for _ in range(most_depth):
        if t.where("up is not null").isEmpty():
            break
        above = t.select(F.col("id").alias("up"), F.col("up").alias("_ts_up"), F.col("depth").alias("_ts_d"), F.col("chain").alias("_ts_c"))
        t = cut(t.join(above, "up", "left").select("id", F.col("_ts_up").alias("up"), F.when(F.col("_ts_c").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("_ts_d") + 1).alias("depth"), F.when(F.col("_ts_c").isNull(), F.col("chain")).otherwise(F.concat("_ts_c", F.lit(" > "), "chain")).alias("chain")))
    return t.select("id", "depth", "chain")


# By how much the cells of each level of positions are larger than those below, and how many levels there are.
WIDER, LEVELS = 8, 8


def _span_cells(spans: DataFrame, bucket: int) -> DataFrame:
    """``spans`` with the cells they lie in (``_ts_c``: level and number): of the level whose cells are no shorter than the span, so at most two."""
    long = F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double")
    level = F.least(F.greatest(F.ceil(F.round(F.log(long / bucket) / F.log(F.lit(float(WIDER))), 9)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    width = (F.lit(float(bucket)) * F.pow(F.lit(float(WIDER)), level)).cast("bigint")
    s = spans.withColumn("_ts_l", level).withColumn("_ts_w", width)
    cells = F.transform(F.sequence(F.floor(F.col("start") / F.col("_ts_w")), F.floor(F.col("end") / F.col("_ts_w"))), lambda c: F.struct(F.col("_ts_l").alias("l"), c.alias("c")))
    return s.where("start <= end").select(*spans.columns, F.explode(cells).alias("_ts_c"))


def _point_cells(points: DataFrame, bucket: int) -> DataFrame:
    """``points`` in their cell of every level."""
    cells = F.array(*[F.struct(F.lit(k).alias("l"), F.floor(F.col("at") / (bucket * WIDER**k)).alias("c")) for k in range(LEVELS)])
    return points.select(*points.columns, F.explode(cells).alias("_ts_c"))


def smallest_enclosing(points: DataFrame, spans: DataFrame, scope: list[str], point_id: str, bucket: int) -> DataFrame:
    """For each point (scope, id, at) the smallest span (scope, span_id, start, end) with start <= at <= end.

    Ties: earlier start, then lesser id. Positions are cut into cells of ``bucket`` and, for longer spans, of ever wider levels; a span lies in
    at most two cells, however long it is, and a point in one of each level, so the join is by equality and a hot scope spreads over its
    cells. Points in no span have no row.
    """
    s = _span_cells(spans.select(*scope, "span_id", "start", "end"), bucket)
    p = _point_cells(points.select(*scope, point_id, "at"), bucket)
    j = p.join(s, [*scope, "_ts_c"]).where("start <= at and at <= end")
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("w"), "start", "span_id", "end")).alias("s")
    return j.groupBy(*scope, point_id, "at").agg(best).select(*scope, point_id, "at", "s.span_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def at_position(positions: DataFrame, occurrences: DataFrame, symbols: DataFrame, scope: list[str], bucket: int) -> DataFrame:
    """The symbol at each position (scope, position_id, at): that of the narrowest occurrence around it (ties: role rank,
    later start, id), else the narrowest symbol span. Equal positions come out once."""
    o = _span_cells(occurrences.select(*scope, "occurrence_id", "symbol_id", "role_rank", "start", "end"), bucket)
    p = _point_cells(positions.select(*scope, "position_id", "at"), bucket)
    hit = p.join(o, [*scope, "_ts_c"]).where("start <= at and at <= end")
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("w"), "role_rank", (-F.col("start")).alias("s"), "occurrence_id", "symbol_id")).alias("o")
    one = [*scope, "position_id", "at"]
    first = hit.groupBy(*one).agg(best).select(*one, F.col("o.symbol_id").alias("_ts_first"))
    second = smallest_enclosing(positions, symbols.withColumnRenamed("symbol_id", "span_id"), scope, "position_id", bucket).select(*one, F.col("span_id").alias("_ts_second"))
    j = positions.select(*one).distinct().join(first, one, "left").join(second, one, "left")
    return j.select(*one, F.coalesce("_ts_first", "_ts_second").alias("symbol_id"), F.when(F.col("_ts_first").isNotNull(), "occurrence").when(F.col("_ts_second").isNotNull(), "span").alias("source"))


def run_groups(ranked: DataFrame, scope: list[str], rank: str, key: list[str], out: str) -> DataFrame:
    """Numbers the runs of equal ``key`` along ``rank`` from 1 (not hash groups: a key that comes back is a new run)."""
    w = Window.partitionBy(*scope).orderBy(rank)
    before = [F.lag(k).over(w) for k in key]
    new = F.when(F.row_number().over(w) == 1, 1)
    for k, b in zip(key, before, strict=True):
        new = new.when(~F.col(k).eqNullSafe(b), 1)
    return ranked.withColumn("_ts_new", new.otherwise(0)).withColumn(out, F.sum("_ts_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_ts_new")


def capped(ranked: DataFrame, scope: list[str], rank: str, most: int, weight: str | None = None, budget: int | None = None) -> DataFrame:
    """The first ``most`` rows along ``rank``, and of these the longest prefix whose ``weight`` sums to at most ``budget``. Scopes are short lists."""
    w = Window.partitionBy(*scope).orderBy(rank)
    out = ranked.withColumn("_ts_n", F.row_number().over(w)).where(F.col("_ts_n") <= most)
    if weight and budget is not None:
        out = out.withColumn("_ts_sum", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_ts_sum") <= budget).drop("_ts_sum")
    return out.drop("_ts_n")


# Kinds of symbols that make a chunk of their own, always or inside certain containers.
ALWAYS_MAJOR = ["class", "interface", "function", "method", "constructor", "enum", "type_alias", "namespace"]
MEMBER, MEMBER_OF = ["property", "field"], ["class", "interface"]
VALUE, VALUE_IN = ["variable", "constant"], ["module", "namespace", "class", "interface"]


def major_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols (symbol_id, kind, container) worth a chunk: declarations; members of classes and interfaces; values at the top or in these."""
    up = symbols.select(F.col("symbol_id").alias("_ts_c"), F.col("kind").alias("_ts_k")).distinct()
    j = symbols.join(up, F.col("container") == F.col("_ts_c"), "left")
    keep = F.col("kind").isin(*ALWAYS_MAJOR) | (F.col("kind").isin(*MEMBER) & F.coalesce(F.col("_ts_k").isin(*MEMBER_OF), F.lit(False))) | (F.col("kind").isin(*VALUE) & (F.col("container").isNull() | F.coalesce(F.col("_ts_k").isin(*VALUE_IN), F.lit(False))))
    return j.where(keep).select(*symbols.columns)


def definitions(symbols: DataFrame, occurrences: DataFrame, canonical_of: DataFrame) -> DataFrame:
    """Definition occurrences of each symbol's canonical symbol: symbol_id, canonical, occurrence_id, path."""
    c = canonical_of.select(F.col("node").alias("symbol_id"), "canonical")
    d = occurrences.where("role = 'definition'").select(F.col("symbol_id").alias("canonical"), "occurrence_id", "path")
    return symbols.select("symbol_id").join(c, "symbol_id", "left").withColumn("canonical", F.coalesce("canonical", "symbol_id")).join(d, "canonical").select("symbol_id", "canonical", "occurrence_id", "path")


# Which roles count as references to a symbol itself and to names it goes by.
OWN_ROLES, ALIAS_ROLES = ["reference", "export"], ["import", "reference", "export"]


def references(occurrences: DataFrame, canonical_of: DataFrame) -> DataFrame:
    """References to each canonical symbol, through all names that lead to it: canonical, occurrence_id, symbol_id, role, path; each once."""
    c = canonical_of.select(F.col("node").alias("symbol_id"), "canonical")
    j = occurrences.join(c, "symbol_id", "left").withColumn("canonical", F.coalesce("canonical", "symbol_id"))
    own = F.col("canonical") == F.col("symbol_id")
    return j.where((own & F.col("role").isin(*OWN_ROLES)) | (~own & F.col("role").isin(*ALIAS_ROLES))).select("canonical", "occurrence_id", "symbol_id", "role", "path").distinct()


def alias_lists(canonical_of: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The names that each canonical node goes by besides its own, sorted: canonical, aliases."""
    return canonical_of.where("node <> canonical").groupBy(*(scope or []), "canonical").agg(F.sort_array(F.collect_set("node")).alias("aliases"))


def aliases(canonical_of: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """How many names each canonical node goes by besides its own, and the least of them."""
    return canonical_of.where("node <> canonical").groupBy(*(scope or []), "canonical").agg(F.count("*").alias("aliases"), F.min("node").alias("first_alias"))
