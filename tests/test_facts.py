"""Facts of source files and what they say together, on a small workspace whose rows are written out by hand."""

import pytest

from tessera.operators import enrichment, facts, impact
from tessera.plans.facts_queries import FILES, WORKSPACE
from tessera.plans.lineage import cut

@pytest.fixture(scope="module")
def built(spark):
    files = spark.createDataFrame([("r", "s", p, c) for p, c in WORKSPACE.items()], FILES)
    f = cut(facts.extract(files.where("path like '%.ts'")))
    return f, enrichment.build(f, files)


def names(e):
    return {r.symbol_id: r.display_name for r in e.symbols.collect()}


def test_symbols(built):
    got = sorted((r.path.rsplit("/", 1)[1], r.kind, r.qualified_name, r.visibility) for r in facts.symbols(built[0]).where("kind <> 'module'").collect())
    assert got == [
        ("index.ts", "import_binding", "Shape", "exported"), ("index.ts", "import_binding", "read", "exported"),
        ("main.ts", "function", "main", "exported"), ("main.ts", "import_binding", "Box", "local"), ("main.ts", "import_binding", "S", "local"), ("main.ts", "import_binding", "read", "local"),
        ("parse.test.ts", "import_binding", "parse", "local"),
        ("parse.ts", "function", "parse", "exported"), ("parse.ts", "function", "walk", "local"), ("parse.ts", "import_binding", "Shape", "local"),
        ("shape.ts", "class", "Square", "default_export"), ("shape.ts", "function", "side", "local"), ("shape.ts", "interface", "Shape", "exported"), ("shape.ts", "method", "Shape::area", "local"), ("shape.ts", "method", "Square::area", "local"),
    ]


def test_references_are_resolved_from_the_inside_out(built):
    e = built[1]
    name = names(e)
    got = sorted((r.path.rsplit("/", 1)[1], name[r.symbol_id]) for r in e.occurrences.where("role = 'reference'").collect())
    # walk is used before it is declared, and so is side: no reference
    assert got == [("main.ts", "Box"), ("main.ts", "read"), ("parse.test.ts", "parse"), ("parse.ts", "Shape"), ("parse.ts", "parse"), ("shape.ts", "Shape")]


def test_bodies_do_not_change_ids_but_signatures_do():
    def ident(text, name):
        return next(s[0] for s in facts.FileFacts("r", "s", "a.ts", text).row()[0] if s[1] == name)

    assert ident("function f(a: number) { return 1 }", "f") == ident("\n\nfunction f(a:   number) { return other(2) }", "f")
    assert ident("function f(a: number) {}", "f") != ident("function f(a: string) {}", "f")
    assert ident("class A extends B { x() {} }", "A") == ident("class A extends B { y() {} }", "A") != ident("class A extends C {}", "A")
    assert ident("interface A { x: 1 }", "A") != ident("interface A { x: 2 }", "A")


def test_bindings_packages_and_reexports(built):
    e = built[1]
    assert {(r.path.rsplit("/", 1)[1], r.module_specifier, r.target_path.rsplit("/", 1)[1]) for r in e.resolved.collect()} == {
        ("index.ts", "./parse", "parse.ts"), ("index.ts", "./shape", "shape.ts"), ("parse.ts", "./shape", "shape.ts"), ("parse.test.ts", "./parse", "parse.ts"), ("main.ts", "@w/core", "index.ts"), ("main.ts", "@w/core/shape", "shape.ts"),
    }
    name = {r.symbol_id: (r.path.rsplit("/", 1)[1], r.display_name) for r in e.symbols.collect()}
    ends = {name[r.symbol_id]: name[r.canonical] for r in e.canonical.where("symbol_id <> canonical").collect()}
    assert ends == {
        ("index.ts", "read"): ("parse.ts", "parse"), ("index.ts", "Shape"): ("shape.ts", "Shape"), ("main.ts", "read"): ("parse.ts", "parse"), ("main.ts", "Box"): ("shape.ts", "Square"), ("main.ts", "S"): ("shape.ts", "Shape"),
        ("parse.test.ts", "parse"): ("parse.ts", "parse"), ("parse.ts", "Shape"): ("shape.ts", "Shape"),
    }
    assert {(r.path.rsplit("/", 1)[1], r.package_name) for r in e.packages.collect()} == {(f, "@w/core") for f in ("index.ts", "parse.ts", "shape.ts", "parse.test.ts")} | {("main.ts", "@w/app")}


def test_reverse_indexes(built):
    e = built[1]
    name = names(e)
    refs = {(name[r.canonical], r.path.rsplit("/", 1)[1], name.get(r.owner)) for r in enrichment.reverse_references(e).collect()}
    assert refs == {("parse", "main.ts", "main"), ("Square", "main.ts", "main"), ("parse", "parse.test.ts", None), ("parse", "parse.ts", "walk"), ("Shape", "parse.ts", "parse"), ("Shape", "shape.ts", "Square")}
    assert {(name[r.canonical], name[r.symbol_id]) for r in enrichment.reverse_bindings(e, "exports").collect()} == {("parse", "read"), ("Shape", "Shape")}
    tests = {(r.test_path.rsplit("/", 1)[1], r.target.split(":")[0], r.evidence) for r in enrichment.tests_of(e).collect()}
    assert tests == {("parse.test.ts", "file", "imports_file"), ("parse.test.ts", "file", "references_symbol"), ("parse.test.ts", "symbol", "references_symbol"), ("parse.test.ts", "file", "path_heuristic")}
    seed = e.symbols.where("display_name = 'parse' and kind = 'function'")
    assert [(r.evidence, r.position) for r in enrichment.ranked_tests(e, seed).collect()] == [("references_symbol", 0)]


def test_targets(spark, built):
    e = built[1]
    name = names(e)
    asked = spark.createDataFrame([("r", "s", t) for t in ("main", "read", "area", "packages/core/src/shape.ts#Square", "nothing")] + [("r", "s", None)], "repo_id string, snapshot_id string, target string")
    got = {r.target: (r.found, name.get(r.canonical)) for r in enrichment.resolve_targets(e, asked).collect()}
    assert got == {"main": (1, "main"), "read": (1, "parse"), "area": (2, None), "packages/core/src/shape.ts#Square": (1, "Square"), "nothing": (0, None)}


def test_show_children_edges_and_counts(built):
    e = built[1]
    shown = {r.display_name: r for r in enrichment.show(e).where("kind = 'class'").collect()}
    assert (shown["Square"].definitions, shown["Square"].references, shown["Square"].children, shown["Square"].alias_count) == (1, 1, 1, 1)
    assert enrichment.children(e).join(e.symbols.where("kind = 'class'").selectExpr("symbol_id container"), "container").count() == 1
    some = e.symbols.where("display_name = 'walk'")
    assert {(r.kind) for r in enrichment.related_edges(e, some).collect()} == {"contains", "defines"}
    assert {r.layer: r.rows for r in enrichment.layer_counts(e).collect()}["aliases"] == 7


def test_impact_of_a_workspace(spark, built):
    e = built[1]
    name = names(e)
    label = lambda k: name.get(k.split(":", 1)[1], k.rsplit("/", 1)[-1])
    seed = e.symbols.where("display_name = 'parse' and kind = 'function'").selectExpr("concat('symbol:', symbol_id) seed")
    hits = impact.traverse(enrichment.impact_steps(e, "delete"), seed, impact.SCENARIOS["delete"])
    got = {(label(r.entity), r.depth, r.certainty, r.score) for r in hits.collect()}
    assert ("main", 1, 0, 950) in got and ("walk", 1, 0, 950) in got and ("parse.test.ts", 1, 0, 890) in {(label(r.entity), r.depth, r.certainty, r.score) for r in hits.where("entity_kind = 'test'").collect()}
    assert ("core", 1, 1, 620) in got
    quiet = enrichment.impact_steps(e, "modify_behavior").where(f"relationship = {impact.RELATIONSHIPS.index('referenced_by_file')}").collect()
    # behaviour alone reaches files only where no symbol stands around the reference
    assert {label(r.dst) for r in quiet} == {"parse.test.ts"} and {r.certainty for r in quiet} == {1}


def test_files_of_any_kind(spark, rows):
    odd = [("r", "s", "a.ts", None), ("r", "s", "b.ts", ""), (None, None, None, "function f() {"), ("r", "s", "c.ts", "}) class {{ => import from export default"), ("r", "s", "d.ts", "f(" * 3000), ("r", "s", "e.ts", "x" * 100_000)]
    f = cut(facts.extract(spark.createDataFrame(odd, FILES)))
    assert facts.symbols(f).where("kind = 'module'").count() == len(odd)
    assert rows(facts.symbols(f).where("kind = 'function'").select("display_name")) == [("f",)]
    assert facts.extract(spark.createDataFrame([], FILES)).count() == 0
    e = enrichment.build(f, spark.createDataFrame(odd, FILES))
    assert e.edges.count() == 0 and enrichment.impact_steps(e, "rename").count() == 0
    whole = [("r", "s", "g.ts", "function g() {")]
    e = enrichment.build(cut(facts.extract(spark.createDataFrame(odd + whole, FILES))), spark.createDataFrame(odd, FILES))
    # the function is declared in its file, and the file contains it; the one without a path has no snapshot
    assert enrichment.impact_steps(e, "rename").count() == 2
    assert facts.rebound(f, "t").where("snapshot_id <> 't'").count() == 0
