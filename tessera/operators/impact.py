"""Impact of a change: bounded, label-correcting expansion over typed steps, ranked and grouped."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import run_groups
from tessera.plans.lineage import cut

# Order of certainties, relationships and entity kinds; the loss of score per further step.
CERTAINTY = ["certain", "likely", "possible"]
RELATIONSHIPS = ["seed", "references", "imports", "exports", "declared_in_file", "contains", "imported_by_file", "referenced_by_file", "test_reference", "package_member", "test_affinity", "defines"]
ENTITY_KINDS = ["symbol", "file", "test", "package"]
LOSS, SEED_SCORE = 40, 1000


@dataclass(frozen=True)
class Scenario:
    """Caps and switches of one kind of change; callers may only lower the caps."""

    most_depth: int
    most_nodes: int | None = None
    most_edges: int | None = None
    most_candidates: int | None = None
    heuristics: bool = True

    def lowered(self, depth: int | None = None, nodes: int | None = None, edges: int | None = None, candidates: int | None = None, transitive: bool = True) -> Scenario:
        """This scenario with caps that are no higher than those asked for; without ``transitive`` one step only."""
        low = lambda a, b: a if b is None else b if a is None else min(a, b)
        return replace(self, most_depth=low(low(self.most_depth, depth), None if transitive else 1), most_nodes=low(self.most_nodes, nodes), most_edges=low(self.most_edges, edges), most_candidates=low(self.most_candidates, candidates))


SCENARIOS = {
    "modify_behavior": Scenario(3, 96, 256, 192),
    "signature_change": Scenario(4, 160, 512, 320),
    "rename": Scenario(3, 128, 384, 256, heuristics=False),
    "delete": Scenario(4, 192, 640, 384),
}


def traverse(steps: DataFrame, seeds: DataFrame, scenario: Scenario) -> DataFrame:
    """The best way to every entity within reach of each seed: seed, entity, entity_kind, certainty, depth, score, relationship, via.

    ``steps``: src, dst, entity_kind, certainty (0 ..), relationship (0 ..), score, terminal. ``seeds``: seed. A path is as
    uncertain as its worst step; a step's score loses LOSS per further depth, not under 0. Per (seed, entity) the least
    (certainty, depth, -score, path) stays; a later and better way relabels an entity and is expanded again. Steps from
    terminal entities do not go on. Every round is one join, one aggregation and a checkpoint.
    """
    s = steps if scenario.heuristics else steps.where(F.col("relationship") != RELATIONSHIPS.index("test_affinity"))
    s = s.select(F.col("src").alias("_ts_src"), "dst", F.col("entity_kind").alias("_ts_kind"), F.col("certainty").alias("_ts_c"), F.col("relationship").alias("_ts_r"), F.col("score").alias("_ts_s"), F.col("terminal").alias("_ts_t"))
    label = ["certainty", "depth", "loss", "path", "entity_kind", "relationship", "terminal"]
    best = cut(seeds.select("seed", F.col("seed").alias("entity"), F.lit(0).alias("certainty"), F.lit(0).alias("depth"), F.lit(-SEED_SCORE).alias("loss"), F.col("seed").alias("path"), F.lit("symbol").alias("entity_kind"), F.lit(0).alias("relationship"), F.lit(False).alias("terminal")).distinct())
    frontier = best
    for depth in range(1, scenario.most_depth + 1):
        grown = frontier.where("not terminal").join(s, F.col("entity") == F.col("_ts_src")).select(
            "seed",
            F.col("dst").alias("entity"),
            F.greatest("certainty", "_ts_c").alias("certainty"),
            F.lit(depth).alias("depth"),
            (-F.greatest(F.col("_ts_s") - LOSS * (depth - 1), F.lit(0))).alias("loss"),
            F.concat("path", F.lit(" > "), "dst").alias("path"),
            F.col("_ts_kind").alias("entity_kind"),
            F.col("_ts_r").alias("relationship"),
            F.col("_ts_t").alias("terminal"),
        )
        new = grown.groupBy("seed", "entity").agg(F.min(F.struct(*label)).alias("n"))
        old = best.select("seed", "entity", F.struct(*label).alias("o"))
        frontier = cut(new.join(old, ["seed", "entity"], "left").where("o is null or n < o").select("seed", "entity", *[f"n.{x}" for x in label]))
        if frontier.isEmpty():
            break
        kept = best.join(frontier.select("seed", "entity"), ["seed", "entity"], "left_anti")
        best = cut(kept.unionByName(frontier))
    return best.select("seed", "entity", "entity_kind", "certainty", "depth", (-F.col("loss")).alias("score"), "relationship", F.col("path").alias("via"))


def _first(rows: DataFrame, order: list, allowed: Column | None, most: int) -> DataFrame:
    """The first rows of each seed, at most ``most`` and no more than it is ``allowed``; the constant bound prunes before the shuffle."""
    w = Window.partitionBy("seed").orderBy(*order)
    out = rows.withColumn("_ts_n", F.row_number().over(w)).where(F.col("_ts_n") <= most)
    return (out if allowed is None else out.where(F.col("_ts_n") <= allowed)).drop("_ts_n")


def traverse_capped(steps: DataFrame, seeds: DataFrame, scenario: Scenario) -> tuple[DataFrame, DataFrame]:
    """As ``traverse``, under all caps of the scenario: the hits, and per seed each cap that cut something (seed, cap), once.

    Depth by depth, in the order (certainty, depth, -score, path), a seed expands at most ``most_nodes`` entities, looks at most at ``most_edges`` steps
    and keeps at most ``most_candidates`` entities; the seed itself is none of the candidates.
    """
    none = 1 << 30
    nodes, edges, candidates = (none if x is None else x for x in (scenario.most_nodes, scenario.most_edges, scenario.most_candidates))
    s = steps if scenario.heuristics else steps.where(F.col("relationship") != RELATIONSHIPS.index("test_affinity"))
    s = s.select(F.col("src").alias("_ts_src"), "dst", F.col("entity_kind").alias("_ts_kind"), F.col("certainty").alias("_ts_c"), F.col("relationship").alias("_ts_r"), F.col("score").alias("_ts_s"), F.col("terminal").alias("_ts_t"))
    label = ["certainty", "depth", "loss", "path", "entity_kind", "relationship", "terminal"]
    order = ["certainty", "depth", "loss", "path"]
    best = cut(seeds.select("seed", F.col("seed").alias("entity"), F.lit(0).alias("certainty"), F.lit(0).alias("depth"), F.lit(-SEED_SCORE).alias("loss"), F.col("seed").alias("path"), F.lit("symbol").alias("entity_kind"), F.lit(0).alias("relationship"), F.lit(False).alias("terminal")).distinct())
    used = cut(best.select("seed", F.lit(0).alias("used_nodes"), F.lit(0).alias("used_edges")))
    frontier = best
    notes = None

    def note(rows: DataFrame, cap: str) -> None:
        nonlocal notes
        n = rows.select("seed", F.lit(cap).alias("cap")).distinct()
        notes = n if notes is None else notes.unionByName(n)

    for depth in range(1, scenario.most_depth + 1):
        open_ = frontier.where("not terminal").join(used, "seed")
        chosen = cut(_first(open_, order, F.lit(nodes) - F.col("used_nodes"), nodes))
        note(open_.groupBy("seed").agg(F.count("*").alias("n"), F.max("used_nodes").alias("u")).where(F.col("n") + F.col("u") > nodes), "nodes")
        grown = chosen.join(s, F.col("entity") == F.col("_ts_src"))
        asked = grown.groupBy("seed").agg(F.count("*").alias("n"), F.max("used_edges").alias("u"))
        note(asked.where(F.col("n") + F.col("u") > edges), "edges")
        seen = _first(grown, [*order, F.desc("_ts_s"), "dst"], F.lit(edges) - F.col("used_edges"), edges)
        grown = seen.select(
            "seed", F.col("dst").alias("entity"), F.greatest("certainty", "_ts_c").alias("certainty"), F.lit(depth).alias("depth"), (-F.greatest(F.col("_ts_s") - LOSS * (depth - 1), F.lit(0))).alias("loss"),
            F.concat("path", F.lit(" > "), "dst").alias("path"), F.col("_ts_kind").alias("entity_kind"), F.col("_ts_r").alias("relationship"), F.col("_ts_t").alias("terminal"),
        )
        new = grown.groupBy("seed", "entity").agg(F.min(F.struct(*label)).alias("n"))
        old = best.select("seed", "entity", F.struct(*label).alias("o"))
        frontier = cut(new.join(old, ["seed", "entity"], "left").where("o is null or n < o").select("seed", "entity", *[f"n.{x}" for x in label]))
        counted = chosen.groupBy("seed").agg(F.count("*").alias("more_nodes"))
        used = cut(used.join(counted, "seed", "left").join(asked.select("seed", "n"), "seed", "left").select("seed", (F.col("used_nodes") + F.coalesce("more_nodes", F.lit(0))).alias("used_nodes"), F.least(F.col("used_edges") + F.coalesce("n", F.lit(0)), F.lit(edges)).cast("int").alias("used_edges")))
        if frontier.isEmpty():
            break
        kept = best.join(frontier.select("seed", "entity"), ["seed", "entity"], "left_anti").unionByName(frontier)
        note(kept.where("depth > 0").groupBy("seed").count().where(F.col("count") > candidates), "candidates")
        best = cut(_first(kept.where("depth > 0"), order, None, candidates).unionByName(kept.where("depth = 0")))
        frontier = frontier.join(best.select("seed", "entity"), ["seed", "entity"], "left_semi")
    hits = best.select("seed", "entity", "entity_kind", "certainty", "depth", (-F.col("loss")).alias("score"), "relationship", F.col("path").alias("via"))
    return hits, notes.distinct()


def rank(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """``hits`` with ``rank`` per seed and ``group_id``, the run of equal (direct, certainty, entity_kind) along it.

    Order: certainty, depth, relationship, -score, kind, entity. Hits of ``traverse_capped`` are bounded per seed, so a
    window per seed is; those of ``traverse`` are so only under a ``limit``. ``limit`` 0 leaves nothing.
    """
    kind = F.array_position(F.array(*map(F.lit, ENTITY_KINDS)), F.col("entity_kind"))
    w = Window.partitionBy("seed").orderBy("certainty", "depth", "relationship", F.desc("score"), kind, "entity")
    r = hits.withColumn("rank", F.row_number().over(w)).withColumn("direct", F.col("depth") <= 1)
    if limit is not None:
        r = r.where(F.col("rank") <= limit)
    return run_groups(r, ["seed"], "rank", ["direct", "certainty", "entity_kind"], "group_id")


def summary(ranked: DataFrame) -> DataFrame:
    """Per seed the hits, direct and transitive ones, and those of each certainty, of what the limit left."""
    return ranked.groupBy("seed").agg(F.count("*").alias("hits"), F.count_if("direct").alias("direct"), F.count_if(~F.col("direct")).alias("transitive"), *[F.count_if(F.col("certainty") == i).alias(c) for i, c in enumerate(CERTAINTY)])


def prune(ranked: DataFrame, possible: bool = True) -> DataFrame:
    """Leaves out what is only possible where that is switched off; ranks are not renumbered."""
    return ranked if possible else ranked.where(F.col("certainty") < CERTAINTY.index("possible"))
