"""What the facts of all files say together: bound imports, canonical symbols, reverse indexes, tests, and the steps of an impact.

All tables carry (repo_id, snapshot_id) as scope; every join is by equality within it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import resolved
from tessera.operators import facts as file_facts
from tessera.operators import graph, impact, modules
from tessera.operators.eligibility import is_test_path
from tessera.plans.lineage import cut

SCOPE = ["repo_id", "snapshot_id"]


def packages(manifests: DataFrame) -> DataFrame:
    """Workspace packages from ``package.json`` files (scope, path, contents): package_root, package_name. Files without a name, or that are no JSON, name none."""
    named = manifests.where(F.col("path").rlike(r"(^|/)package\.json$")).select(*SCOPE, F.regexp_replace("path", r"/?package\.json$", "").alias("package_root"), F.get_json_object("contents", "$.name").alias("package_name"))
    return named.where("package_name is not null and package_name <> ''").distinct()


def resolve_packages(wanted: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """The file that each specifier of a workspace package names: scope, path, module_specifier, target_path.

    The package with the longest name that is the specifier or a folder of it; in it the first of src/index, index, or of the
    sub-path, its index, and both under src, that a file answers. Specifiers are exploded into their prefixes and joined by equality.
    """
    w = wanted.where(~F.col("module_specifier").startswith(".")).select(*SCOPE, "path", "module_specifier").distinct()
    parts = F.split("module_specifier", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    one = known.groupBy(*SCOPE, "package_name").agg(F.max("package_root").alias("package_root"))
    hit = w.select("*", F.explode(prefixes).alias("package_name")).join(one, [*SCOPE, "package_name"])
    best = hit.groupBy(*SCOPE, "path", "module_specifier").agg(F.max_by(F.struct("package_name", "package_root"), F.length("package_name")).alias("p"))
    sub = F.regexp_replace(F.expr("substring(module_specifier, length(p.package_name) + 1)"), "^/+", "")
    root = F.when(F.col("p.package_root") == "", "").otherwise(F.concat("p.package_root", F.lit("/")))
    at = lambda *x: F.concat(root, *[F.lit(v) if isinstance(v, str) else v for v in x])
    targets = F.when(sub == "", F.array(at("src/index"), at("index"))).otherwise(F.array(at(sub), at(sub, "/index"), at("src/", sub), at("src/", sub, "/index")))
    c = best.select(*SCOPE, "path", "module_specifier", F.posexplode(F.transform(targets, resolved)).alias("_ts_a", "_ts_t")).where("_ts_t is not null")
    c = c.select("*", F.posexplode(modules._candidates(F.col("_ts_t"))).alias("_ts_b", "target_path"))
    there = files.select(*SCOPE, F.col("path").alias("target_path")).distinct()
    return c.join(there, [*SCOPE, "target_path"]).groupBy(*SCOPE, "path", "module_specifier").agg(F.min_by("target_path", F.struct("_ts_a", "_ts_b")).alias("target_path"))


@dataclass
class Enrichment:
    """Tables of one build, each within ``SCOPE``."""

    symbols: DataFrame
    occurrences: DataFrame
    resolved: DataFrame  # path, module_specifier, target_path
    edges: DataFrame  # kind, src, dst between symbols
    canonical: DataFrame  # symbol_id, canonical
    packages: DataFrame  # path, package_root, package_name


def bindings(imports: DataFrame, exports: DataFrame, where: DataFrame) -> DataFrame:
    """Edges between symbols: each import to the one export of that name in the file it names, and each re-export likewise.

    kind (imports, exports), src_key, dst_key. Namespace imports bind nothing; a name that several symbols export binds nothing.
    """
    offered = exports.where("symbol_id is not null").select(*SCOPE, F.col("path").alias("target_path"), F.col("exported_name").alias("name"), F.col("symbol_id").alias("dst_key"))
    asked = imports.where("imported_name is not null and imported_name <> '*'").select(*SCOPE, "path", "module_specifier", F.col("imported_name").alias("name"), "symbol_id", F.lit("imports").alias("kind"))
    again = exports.where("module_specifier is not null").select(*SCOPE, "path", "module_specifier", F.coalesce("local_name", "exported_name").alias("name"), "symbol_id", F.lit("exports").alias("kind"))
    placed = asked.unionByName(again).join(where, [*SCOPE, "path", "module_specifier"])
    bound = modules.unique_binding(placed.select(*SCOPE, "target_path", "name", "symbol_id", "kind"), offered, [*SCOPE, "target_path", "name"], "dst_key")
    return bound.select(*SCOPE, "kind", F.col("symbol_id").alias("src_key"), "dst_key").distinct()


def build(facts: DataFrame, manifests: DataFrame) -> Enrichment:
    """The whole enrichment of extracted ``facts`` (see ``facts.extract``; written down by the caller) and package.json files.

    Files without repo_id, snapshot_id or path have facts, but belong to no snapshot and take no part here.
    """
    facts = facts.where("repo_id is not null and snapshot_id is not null and path is not null")
    files = facts.select(*SCOPE, "path").distinct()
    # files delivered again have the same facts
    symbols = file_facts.symbols(facts).dropDuplicates([*SCOPE, "symbol_id"])
    occurrences = file_facts.occurrences(facts).dropDuplicates([*SCOPE, "occurrence_id"])
    imports, exports = file_facts.imports(facts).distinct(), file_facts.exports(facts).distinct()
    wanted = imports.select(*SCOPE, "path", "module_specifier").unionByName(exports.where("module_specifier is not null").select(*SCOPE, "path", "module_specifier")).distinct()
    known = packages(manifests)
    where = cut(modules.resolve_relative(wanted, files, SCOPE).unionByName(resolve_packages(wanted, known, files)))
    edges = cut(bindings(imports, exports, where))
    ends = graph.canonical(edges, SCOPE).select(*SCOPE, F.col("node").alias("symbol_id"), "canonical")
    canonical = cut(symbols.select(*SCOPE, "symbol_id").join(ends, [*SCOPE, "symbol_id"], "left").withColumn("canonical", F.coalesce("canonical", "symbol_id")))
    return Enrichment(symbols, occurrences, where, edges, canonical, modules.longest_root(files, known, SCOPE))


def reverse_bindings(e: Enrichment, kind: str) -> DataFrame:
    """Who imports (or exports anew) each canonical symbol: canonical, symbol_id; distinct."""
    target = e.canonical.select(*SCOPE, F.col("symbol_id").alias("dst_key"), "canonical")
    return e.edges.where(F.col("kind") == kind).join(target, [*SCOPE, "dst_key"]).select(*SCOPE, "canonical", F.col("src_key").alias("symbol_id")).distinct()


def file_dependents(e: Enrichment) -> DataFrame:
    """path and each file that imports from it or exports it anew (``dependent``); a file does not depend on itself."""
    return e.resolved.where("path <> target_path").select(*SCOPE, F.col("target_path").alias("path"), F.col("path").alias("dependent")).distinct()


def owners(e: Enrichment, points: DataFrame, bucket: int = 4096) -> DataFrame:
    """``points`` (scope, path, occurrence_id, start, end) with ``owner``: the smallest symbol around the occurrence that is no module; null where there is none."""
    spans = e.symbols.where("kind not in ('module', 'import_binding')").select(*SCOPE, "path", F.col("symbol_id").alias("span_id"), "start", "end")
    at = points.select(*SCOPE, "path", "occurrence_id", F.col("start").alias("at"))
    inside = graph.smallest_enclosing(at, spans, [*SCOPE, "path"], "occurrence_id", bucket).select(*SCOPE, "path", "occurrence_id", F.col("span_id").alias("owner"))
    return points.join(inside, [*SCOPE, "path", "occurrence_id"], "left")


def reverse_references(e: Enrichment) -> DataFrame:
    """Reference occurrences by the canonical symbol they mean: canonical, occurrence_id, path, owner (null outside of symbols)."""
    r = e.occurrences.where("role = 'reference'").join(e.canonical, [*SCOPE, "symbol_id"])
    return owners(e, r.select(*SCOPE, "canonical", "path", "occurrence_id", "start", "end")).select(*SCOPE, "canonical", "occurrence_id", "path", "owner")


def tests_of(e: Enrichment) -> DataFrame:
    """Tests by what they test: test_path, target (``symbol:`` or ``file:`` and its key), evidence.

    A test that imports a file; a test that refers to, imports or exports a symbol which another file declares, for that symbol and its file; the one
    file of the test's package with its stem.
    """
    files = e.symbols.where("kind = 'module'").select(*SCOPE, "path").distinct()
    roots = e.packages.select(*SCOPE, "package_root", "package_name").distinct()
    by_file = modules.test_associations(files, e.resolved, roots, SCOPE).select(*SCOPE, "test_path", F.concat(F.lit("file:"), "path").alias("target"), "evidence")
    uses = e.occurrences.where(is_test_path(F.col("path")) & F.col("role").isin("reference", "import", "export")).select(*SCOPE, "symbol_id", F.col("path").alias("test_path")).distinct()
    declared = e.symbols.select(*SCOPE, F.col("symbol_id").alias("canonical"), F.col("path").alias("declared_in"))
    meant = uses.join(e.canonical, [*SCOPE, "symbol_id"]).join(declared, [*SCOPE, "canonical"]).where("declared_in <> test_path")
    both = F.explode(F.array(F.concat(F.lit("symbol:"), "canonical"), F.concat(F.lit("file:"), "declared_in")))
    return by_file.unionByName(meant.select(*SCOPE, "test_path", both.alias("target"), F.lit("references_symbol").alias("evidence"))).distinct()


def ranked_tests(e: Enrichment, seeds: DataFrame) -> DataFrame:
    """The tests of each seed symbol (scope, symbol_id), those of the symbol before those of its file, each path once: test_path, position from 0 by path."""
    s = seeds.join(e.canonical, [*SCOPE, "symbol_id"]).select(*SCOPE, "canonical").distinct().join(e.symbols.select(*SCOPE, F.col("symbol_id").alias("canonical"), "path"), [*SCOPE, "canonical"])
    asked = s.select(*SCOPE, "canonical", F.posexplode(F.array(F.concat(F.lit("symbol:"), "canonical"), F.concat(F.lit("file:"), "path"))).alias("source", "target"))
    got = asked.join(tests_of(e), [*SCOPE, "target"]).groupBy(*SCOPE, "canonical", "test_path").agg(F.min_by("evidence", F.struct("source", "evidence")).alias("evidence"), F.min("source").alias("source"))
    w = Window.partitionBy(*SCOPE, "canonical").orderBy("test_path")  # the tests of one symbol
    return got.withColumn("position", F.row_number().over(w) - 1)


# Relationship, score and certainty (by its place in CERTAINTY) of each kind of step, and those that depend on the change.
STEPS = {
    "declared_in_file": (900, 0), "package_member": (620, 1), "references": (950, 0), "referenced_by_file": (760, None), "imports": (930, 0), "imported_by_file(symbol)": (770, None),
    "exports": (920, 0), "contains": (900, 0), "imported_by_file(file)": (860, None), "dependent_test": (880, 0), "references_symbol": (890, 0), "imports_file": (880, 0), "path_heuristic": (420, None),
}


def impact_steps(e: Enrichment, change: str = "modify_behavior") -> DataFrame:
    """Every step of an impact under the kind of change: scope, src, dst, entity_kind, certainty, relationship, score, terminal.

    Nodes are ``symbol:``, ``file:``, ``test:`` or ``package:`` and a key; symbols are canonical. Consumer files count except where behaviour alone
    changes, where they stand for references outside of symbols only, and are then likely.
    """
    scenario = impact.SCENARIOS[change]
    consumers = change != "modify_behavior"
    consumer = 0 if consumers else 1
    heuristic = 1 if change == "signature_change" else 2
    sym = lambda c: F.concat(F.lit("symbol:"), F.col(c))
    file = lambda c: F.concat(F.lit("file:"), F.col(c))

    def steps(rows: DataFrame, src: Column, dst: Column, kind: str | Column, relationship: str, step: str, certainty: int | None = None, terminal: Column | bool = False) -> DataFrame:
        score, sure = STEPS[step]
        end = terminal if isinstance(terminal, Column) else F.lit(terminal)
        return rows.select(*SCOPE, src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("entity_kind"), F.lit(sure if sure is not None else certainty).alias("certainty"), F.lit(impact.RELATIONSHIPS.index(relationship)).alias("relationship"), F.lit(score).alias("score"), end.alias("terminal"))

    declared = e.symbols.where("kind <> 'module'").join(e.canonical, [*SCOPE, "symbol_id"])
    own = declared.where("symbol_id = canonical")
    package = F.concat(F.lit("package:"), "package_root", F.lit("#"), "package_name")
    refs = cut(reverse_references(e))
    owner = refs.where("owner is not null").join(e.canonical.select(*SCOPE, F.col("symbol_id").alias("owner"), F.col("canonical").alias("_ts_o")), [*SCOPE, "owner"])
    importers = reverse_bindings(e, "imports").join(e.canonical.withColumnRenamed("canonical", "_ts_i"), [*SCOPE, "symbol_id"])
    in_file = e.symbols.select(*SCOPE, F.col("symbol_id").alias("_ts_i"), F.col("path").alias("_ts_p"))
    exporters = reverse_bindings(e, "exports").join(e.canonical.withColumnRenamed("canonical", "_ts_i"), [*SCOPE, "symbol_id"])
    dependents = file_dependents(e)
    tests = cut(tests_of(e)).where("evidence <> 'path_heuristic'" if not scenario.heuristics else "true")
    symbol_files = own.select(*SCOPE, sym("canonical").alias("src"), file("path").alias("target"))
    for_file = tests.where(F.col("target").startswith("file:"))
    parts = [
        steps(own, sym("canonical"), file("path"), "file", "declared_in_file", "declared_in_file"),
        steps(own.join(e.packages, [*SCOPE, "path"]), sym("canonical"), package, "package", "package_member", "package_member", terminal=True),
        steps(owner, sym("canonical"), sym("_ts_o"), "symbol", "references", "references"),
        steps(refs if consumers else refs.where("owner is null"), sym("canonical"), file("path"), "file", "referenced_by_file", "referenced_by_file", consumer, is_test_path(F.col("path"))),
        steps(importers, sym("canonical"), sym("_ts_i"), "symbol", "imports", "imports"),
        steps(exporters, sym("canonical"), sym("_ts_i"), "symbol", "exports", "exports"),
        steps(declared, file("path"), sym("canonical"), "symbol", "contains", "contains"),
        steps(e.packages, file("path"), package, "package", "package_member", "package_member", terminal=True),
        steps(dependents.where(~is_test_path(F.col("dependent"))), file("path"), file("dependent"), "file", "imported_by_file", "imported_by_file(file)", consumer),
        steps(dependents.where(is_test_path(F.col("dependent"))), file("path"), F.concat(F.lit("test:"), "dependent"), "test", "test_reference", "dependent_test", terminal=True),
    ]
    if consumers:
        parts.append(steps(importers.join(in_file, [*SCOPE, "_ts_i"]), sym("canonical"), file("_ts_p"), "file", "imported_by_file", "imported_by_file(symbol)", consumer))
    for evidence in ("references_symbol", "imports_file", "path_heuristic"):
        mine = tests.where(F.col("evidence") == evidence)
        relation, sure = ("test_affinity", heuristic) if evidence == "path_heuristic" else ("test_reference", None)
        test = F.concat(F.lit("test:"), "test_path")
        parts.append(steps(mine, F.col("target"), test, "test", relation, evidence, sure, True))
        parts.append(steps(symbol_files.join(for_file.where(F.col("evidence") == evidence), [*SCOPE, "target"]), F.col("src"), test, "test", relation, evidence, sure, True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("src <> dst").distinct()


def children(e: Enrichment) -> DataFrame:
    """Symbols by the symbol that contains them: container, symbol_id, kind, display_name, start."""
    return e.symbols.where("container is not null").select(*SCOPE, "container", "symbol_id", "kind", "display_name", "start")


def all_edges(e: Enrichment) -> DataFrame:
    """Every edge of the symbol graph, each once, with its id: contains, defines, references, imports, exports. Nodes have a prefix for what they are."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    contains = e.symbols.select(*SCOPE, F.lit("contains").alias("kind"), F.coalesce(node("symbol", "container"), node("file", "path")).alias("src_key"), node("symbol", "symbol_id").alias("dst_key"))
    said = F.when(F.col("role") == "definition", "defines").otherwise("references")
    uses = e.occurrences.select(*SCOPE, said.alias("kind"), node("occurrence", "occurrence_id").alias("src_key"), node("symbol", "symbol_id").alias("dst_key"))
    bound = e.edges.select(*SCOPE, "kind", node("symbol", "src_key").alias("src_key"), node("symbol", "dst_key").alias("dst_key"))
    files = e.resolved.select(*SCOPE, F.lit("imports").alias("kind"), node("file", "path").alias("src_key"), node("file", "target_path").alias("dst_key"))
    all_ = contains.unionByName(uses).unionByName(bound).unionByName(files).distinct()
    digest = F.substring(F.sha2(F.concat_ws("\n", *SCOPE, "kind", "src_key", "dst_key"), 256), 1, 12)
    return all_.select(*SCOPE, F.concat(F.lit("edge."), "kind", F.lit("."), digest).alias("edge_id"), "kind", "src_key", "dst_key")


def related_edges(e: Enrichment, symbols: DataFrame) -> DataFrame:
    """The edges out of and into each of ``symbols`` (scope, symbol_id), each once: symbol_id, edge_id, kind, src_key, dst_key."""
    at = symbols.select(*SCOPE, "symbol_id", F.concat(F.lit("symbol:"), "symbol_id").alias("_ts_k")).distinct()
    edges = all_edges(e).withColumn("_ts_k", F.explode(F.array_distinct(F.array("src_key", "dst_key"))))
    return edges.join(at, [*SCOPE, "_ts_k"]).select(*SCOPE, "symbol_id", "edge_id", "kind", "src_key", "dst_key").distinct()


def resolve_targets(e: Enrichment, asked: DataFrame) -> DataFrame:
    """The one symbol that each target means: asked (scope, target) with ``canonical`` and ``found``, the number of symbols it may mean.

    A target is a symbol id, ``path#name``, or a name of something that is no module. Aliases are followed; canonical is null unless there is exactly one.
    """
    a = asked.select(*SCOPE, "target").where("target is not null").distinct()
    s = e.symbols.join(e.canonical, [*SCOPE, "symbol_id"]).select(*SCOPE, "symbol_id", "canonical", "display_name", "path", "kind")
    names = F.array(F.col("symbol_id"), F.when(F.col("kind") != "module", F.concat("path", F.lit("#"), "display_name")), F.when(F.col("kind") != "module", F.col("display_name")))
    keys = s.select(*SCOPE, "canonical", F.posexplode(names).alias("way", "target")).where("target is not null").distinct()
    hit = a.join(keys, [*SCOPE, "target"])
    # a way that is more exact goes first
    first = hit.groupBy(*SCOPE, "target").agg(F.min("way").alias("way"))
    got = hit.join(first, [*SCOPE, "target", "way"]).groupBy(*SCOPE, "target").agg(F.count_distinct("canonical").alias("found"), F.min("canonical").alias("canonical"))
    out = a.join(got, [*SCOPE, "target"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn("canonical", F.when(F.col("found") == 1, F.col("canonical")))


def show(e: Enrichment) -> DataFrame:
    """One row per symbol for display: where it is, its canonical symbol, and how many definitions, references, children and aliases it has."""
    o = e.occurrences.join(e.canonical, [*SCOPE, "symbol_id"]).groupBy(*SCOPE, "canonical").agg(F.count_if(F.col("role") == "definition").alias("definitions"), F.count_if(F.col("role") == "reference").alias("references"))
    kids = children(e).groupBy(*SCOPE, F.col("container").alias("symbol_id")).agg(F.count("*").alias("children"))
    others = e.canonical.where("symbol_id <> canonical").groupBy(*SCOPE, "canonical").agg(F.sort_array(F.collect_set("symbol_id")).alias("aliases"))
    j = e.symbols.join(e.canonical, [*SCOPE, "symbol_id"]).join(o, [*SCOPE, "canonical"], "left").join(kids, [*SCOPE, "symbol_id"], "left").join(others, [*SCOPE, "canonical"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    note = F.concat(F.col("kind"), F.lit(" "), F.coalesce("qualified_name", "display_name"), F.lit(" in "), F.col("path"), F.when(F.col("symbol_id") != F.col("canonical"), F.concat(F.lit(", an alias of "), "canonical")).otherwise(""))
    return j.select(*SCOPE, "symbol_id", "canonical", "kind", "display_name", "path", "visibility", n("definitions"), n("references"), n("children"), F.coalesce(F.size("aliases"), F.lit(0)).alias("alias_count"), note.alias("explanation"))


def layer_counts(e: Enrichment) -> DataFrame:
    """Rows of each layer of an enrichment, per scope: layer, rows."""
    layers = {"symbols": e.symbols, "occurrences": e.occurrences, "bindings": e.edges, "aliases": e.canonical.where("symbol_id <> canonical"), "dependents": file_dependents(e), "tests": tests_of(e)}
    out = None
    for name, t in layers.items():
        n = t.groupBy(*SCOPE).agg(F.count("*").alias("rows")).select(*SCOPE, F.lit(name).alias("layer"), "rows")
        out = n if out is None else out.unionByName(n)
    return out
