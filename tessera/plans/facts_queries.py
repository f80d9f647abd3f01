"""Queries of facts and of what they say together: over all base files, and over a small workspace whose rows are known.

Facts come from tokens and brackets, which SQL cannot read; the SQL of the workspace queries therefore states their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import enrichment, facts, impact, planner
from tessera.plans.lineage import cut
from tessera.sources.tables import table

WORKSPACE = {
    "package.json": '{"name": "root"}',
    "packages/core/package.json": '{"name": "@w/core"}',
    "packages/core/src/index.ts": "export { parse as read } from './parse';\nexport { Shape } from './shape';\n",
    "packages/core/src/parse.ts": "import type { Shape } from './shape';\n\nexport function parse(text: string): Shape {\n  return walk(text);\n}\n\nconst walk = (text: string) => {\n  return parse(text);\n};\n",
    "packages/core/src/shape.ts": "export interface Shape {\n  area(): number;\n}\nexport default class Square implements Shape {\n  area() { return side(); }\n}\nfunction side() { return 1; }\n",
    "packages/core/src/parse.test.ts": "import { parse } from './parse';\ntest('x', () => parse('a'));\n",
    "packages/app/package.json": '{"name": "@w/app"}',
    "packages/app/src/main.ts": "import { read } from '@w/core';\nimport Box, { Shape as S } from '@w/core/shape';\n\nexport async function main() {\n  const box = new Box();\n  return read(box);\n}\n",
    "packages/app/broken.json": "{",
}
FILES = "repo_id string, snapshot_id string, path string, contents string"


# ---- all base files -----------------------------------------------------------------------------------------------


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.extract(table(spark, d, "base_files"))


def _whole(spark: SparkSession, d: str) -> enrichment.Enrichment:
    return enrichment.build(cut(_facts(spark, d)), table(spark, d, "base_files"))


def symbol_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.symbols(_facts(spark, d)).distinct()


def occurrence_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.occurrences(_facts(spark, d)).distinct()


def module_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Every file has its module, whatever its contents are."""
    return facts.symbols(_facts(spark, d)).where("kind = 'module'").select(*facts.FILE, "display_name", "visibility").distinct()


MODULE_SQL = "select distinct repo_id, snapshot_id, path, path as display_name, 'local' as visibility from base_files"


def symbol_children(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.children(_whole(spark, d))


def symbol_show(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.show(_whole(spark, d))


def reverse_references(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.reverse_references(_whole(spark, d))


def symbol_edges(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.all_edges(_whole(spark, d))


def enrichment_counts(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.layer_counts(_whole(spark, d))


def impact_steps(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.impact_steps(_whole(spark, d), "signature_change")


# ---- the workspace ------------------------------------------------------------------------------------------------


def _workspace(spark: SparkSession) -> enrichment.Enrichment:
    files = spark.createDataFrame([("r", "s", p, c) for p, c in WORKSPACE.items()], FILES)
    return enrichment.build(cut(facts.extract(files.where("path like '%.ts'"))), files)


def _named(e: enrichment.Enrichment) -> DataFrame:
    return e.symbols.select("symbol_id", F.concat(F.regexp_extract("path", "([^/]+)$", 1), F.lit("#"), F.when(F.col("kind") == "module", "").otherwise(F.coalesce("qualified_name", "display_name"))).alias("name"))


def _values(rows: list[tuple], columns: str) -> str:
    said = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) t({columns})"


def workspace_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _workspace(spark).symbols.where("kind <> 'module'").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "kind", "qualified_name", "visibility")


SYMBOL_ROWS = [
    ("index.ts", "import_binding", "Shape", "exported"), ("index.ts", "import_binding", "read", "exported"), ("main.ts", "function", "main", "exported"), ("main.ts", "import_binding", "Box", "local"),
    ("main.ts", "import_binding", "S", "local"), ("main.ts", "import_binding", "read", "local"), ("parse.test.ts", "import_binding", "parse", "local"), ("parse.ts", "function", "parse", "exported"),
    ("parse.ts", "function", "walk", "local"), ("parse.ts", "import_binding", "Shape", "local"), ("shape.ts", "class", "Square", "default_export"), ("shape.ts", "function", "side", "local"),
    ("shape.ts", "interface", "Shape", "exported"), ("shape.ts", "method", "Shape::area", "local"), ("shape.ts", "method", "Square::area", "local"),
]


def workspace_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Imports and re-exports, through workspace packages too, and the symbols at the end of their chains."""
    e = _workspace(spark)
    n = _named(e)
    return e.canonical.where("symbol_id <> canonical").join(n, "symbol_id").join(n.select(F.col("symbol_id").alias("canonical"), F.col("name").alias("means")), "canonical").select("name", "means")


ALIAS_ROWS = [
    ("index.ts#read", "parse.ts#parse"), ("index.ts#Shape", "shape.ts#Shape"), ("main.ts#read", "parse.ts#parse"), ("main.ts#Box", "shape.ts#Square"), ("main.ts#S", "shape.ts#Shape"),
    ("parse.test.ts#parse", "parse.ts#parse"), ("parse.ts#Shape", "shape.ts#Shape"),
]


def workspace_references(spark: SparkSession, d: str) -> DataFrame:
    """References by what they mean at last, with the symbol around them."""
    e = _workspace(spark)
    n = _named(e)
    r = enrichment.reverse_references(e).join(n.select(F.col("symbol_id").alias("canonical"), F.col("name").alias("means")), "canonical")
    return r.join(n.select(F.col("symbol_id").alias("owner"), F.col("name").alias("around")), "owner", "left").select("means", F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "around")


REFERENCE_ROWS = [
    ("parse.ts#parse", "main.ts", "main.ts#main"), ("shape.ts#Square", "main.ts", "main.ts#main"), ("parse.ts#parse", "parse.test.ts", None), ("parse.ts#parse", "parse.ts", "parse.ts#walk"),
    ("shape.ts#Shape", "parse.ts", "parse.ts#parse"), ("shape.ts#Shape", "shape.ts", "shape.ts#Square"),
]


def workspace_tests(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.tests_of(_workspace(spark)).select(F.regexp_extract("test_path", "([^/]+)$", 1).alias("test"), F.regexp_extract("target", "^(symbol|file):", 1).alias("what"), "evidence")


TEST_ROWS = [("parse.test.ts", "file", "imports_file"), ("parse.test.ts", "file", "references_symbol"), ("parse.test.ts", "symbol", "references_symbol"), ("parse.test.ts", "file", "path_heuristic")]


def _impact(spark: SparkSession, scenario: impact.Scenario) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _workspace(spark)
    seed = e.symbols.where("display_name = 'parse' and kind = 'function'").select(F.concat(F.lit("symbol:"), "symbol_id").alias("seed"))
    hits, notes = impact.traverse_capped(enrichment.impact_steps(e, "delete"), seed, scenario)
    n = _named(e).select(F.concat(F.lit("symbol:"), "symbol_id").alias("entity"), "name")
    return hits.join(n, "entity", "left").withColumn("name", F.coalesce("name", F.regexp_extract("entity", "([^/:]+)$", 1))), notes, seed


def workspace_impact(spark: SparkSession, d: str) -> DataFrame:
    """What deleting ``parse`` reaches in one step."""
    return _impact(spark, impact.SCENARIOS["delete"].lowered(transitive=False))[0].select("name", "entity_kind", "certainty", "depth", "score")


# importers and re-exporters have the same canonical symbol, so they are no step of their own
IMPACT_ROWS = [
    ("parse.ts#parse", "symbol", 0, 0, 1000), ("parse.ts", "file", 0, 1, 900), ("core", "package", 1, 1, 620), ("main.ts#main", "symbol", 0, 1, 950), ("parse.ts#walk", "symbol", 0, 1, 950),
    ("main.ts", "file", 0, 1, 760), ("parse.test.ts", "file", 0, 1, 760), ("parse.test.ts", "test", 0, 1, 890),
]


def workspace_capped(spark: SparkSession, d: str) -> DataFrame:
    """Which caps cut the impact of ``parse`` where they are very low."""
    return _impact(spark, impact.SCENARIOS["delete"].lowered(nodes=2, edges=4, candidates=3))[1].select("cap")


CAP_ROWS = [("nodes",), ("edges",), ("candidates",)]


# ---- fusion with spans --------------------------------------------------------------------------------------------

CANDIDATES = [
    ("q1", "a", "symbol", 900, 1, None, "src/foo.rs", 0, 50), ("q1", "b", "semantic", 700_000, 1, None, "src/foo.rs", 30, 80), ("q1", "c", "semantic", 600_000, 2, None, "src/foo.rs", 80, 90),
    ("q2", "a", "symbol", 1000, 1, "sym.Foo", "src/foo.rs", None, None), ("q2", "b", "semantic", 800_000, 1, "sym.Foo", "src/foo.rs", None, None), ("q2", "c", "semantic", 500_000, 2, None, "src/foo.rs", None, None),
    ("q3", "a", "semantic", 100_000, 2, None, "x", 0, 10), ("q3", "b", "semantic", 100_000, 1, None, "x", 8, 20), ("q3", "c", "symbol", 1, 1, None, "x", 18, 30), ("q3", "d", "symbol", 1, 2, None, "y", None, None),
]


def fusion_spans(spark: SparkSession, d: str) -> DataFrame:
    """Clusters in the order of arrival: a span joins the first cluster with a span that it overlaps."""
    c = spark.createDataFrame(CANDIDATES, "query_id string, candidate_id string, route string, raw_score bigint, engine_rank int, symbol_id string, path string, start bigint, end bigint")
    return planner.fuse(c, planner.ROUTE_BUDGETS).select("query_id", "cluster", "members", F.array_join("routes", ",").alias("routes"))


FUSION_ROWS = [("q1", 0, 2, "semantic,symbol"), ("q1", 1, 1, "semantic"), ("q2", 0, 2, "semantic,symbol"), ("q2", 1, 1, "semantic"), ("q3", 0, 3, "semantic,symbol"), ("q3", 1, 1, "symbol")]

_QUERIES = {
    "symbol_facts": (symbol_facts, None),
    "occurrence_facts": (occurrence_facts, None),
    "module_symbols": (module_symbols, MODULE_SQL),
    "symbol_children": (symbol_children, None),
    "symbol_show": (symbol_show, None),
    "reverse_references": (reverse_references, None),
    "symbol_edges": (symbol_edges, None),
    "enrichment_counts": (enrichment_counts, None),
    "impact_steps": (impact_steps, None),
    "workspace_symbols": (workspace_symbols, _values(SYMBOL_ROWS, "file, kind, qualified_name, visibility")),
    "workspace_aliases": (workspace_aliases, _values(ALIAS_ROWS, "name, means")),
    "workspace_references": (workspace_references, _values(REFERENCE_ROWS, "means, file, around")),
    "workspace_tests": (workspace_tests, _values(TEST_ROWS, "test, what, evidence")),
    "workspace_impact": (workspace_impact, _values(IMPACT_ROWS, "name, entity_kind, certainty, depth, score")),
    "workspace_capped": (workspace_capped, _values(CAP_ROWS, "cap")),
    "fusion_spans": (fusion_spans, _values(FUSION_ROWS, "query_id, cluster, members, routes")),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}
