"""Builds over several runs, the registry, polling, and the planner's plans and reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import builds, enrichment, facts, graph, impact, planner, semantic
from tessera.plans import versions
from tessera.plans.facts_queries import FILES, WORKSPACE
from tessera.plans.lineage import cut
from tessera.sources import registry

ONE = [("r", "s", "a.ts", "export function a() { return 1; }"), ("r", "s", "b.ts", "import { a } from './a';\na();"), ("r", "s", "n.ts", None), ("r", "s", "a.ts", "export function a() { return 1; }")]


def test_only_changed_files_are_redone(spark, tmp_path):
    build = builds.facts_build(spark, str(tmp_path / "f"))
    first = build.refresh(spark.createDataFrame(ONE, FILES))
    assert (first.mode, first.reason, first.redone, first.reused, first.version) == ("full", "no_previous_build", 3, 0, 0)
    two = [("r", "s", "a.ts", "export function a() { return 1; }"), ("r", "s", "b.ts", "function changed() {}"), ("r", "s", "c.ts", "class C {}")]
    second = build.refresh(spark.createDataFrame(two, FILES))
    assert (second.mode, second.redone, second.reused, second.dropped, second.version) == ("incremental", 2, 1, 2, 1)
    got = {r.display_name for r in facts.symbols(build.read()).where("kind <> 'module'").collect()}
    assert got == {"a", "changed", "C"} == {r.display_name for r in facts.symbols(facts.extract(spark.createDataFrame(two, FILES))).where("kind <> 'module'").collect()}
    other = builds.facts_build(spark, str(tmp_path / "f"), {"depth": 2})
    assert other.refresh(spark.createDataFrame(two, FILES)).reason == "config_changed"
    assert build.refresh(spark.createDataFrame([], FILES)).redone == 0


def test_of_two_refreshes_one_wins(spark, tmp_path):
    mine = builds.facts_build(spark, str(tmp_path / "f"))
    theirs = builds.facts_build(spark, str(tmp_path / "f"))
    real = mine.derive

    def slow(files):
        theirs.refresh(spark.createDataFrame(ONE[:1], FILES))
        return real(files)

    mine.derive = slow
    with pytest.raises(versions.Conflict):
        mine.refresh(spark.createDataFrame(ONE, FILES))
    assert theirs.read().count() == 1


def test_chunks_are_carried_over_with_their_vectors(spark, tmp_path):
    build = builds.chunk_build(spark, str(tmp_path / "c"))
    build.refresh(spark.createDataFrame(ONE, FILES))
    before = {r.path: (r.chunk_id, r.vector) for r in build.read().collect()}
    again = build.refresh(spark.createDataFrame([*ONE[:1], ("r", "s", "b.ts", "new")], FILES))
    after = {r.path: (r.chunk_id, r.vector) for r in build.read().collect()}
    assert set(before) == set(after) == {"a.ts", "b.ts"} and before["a.ts"] == after["a.ts"] and before["b.ts"] != after["b.ts"]
    assert (again.redone, again.reused) == (1, 1)


def test_contributions_after_a_change(spark, rows):
    def made(files):
        df = spark.createDataFrame([("r", "s", p, c) for p, c in files.items()], FILES)
        return enrichment.build(cut(facts.extract(df.where("path like '%.ts'"))), df)

    old = cut(builds.contributions(made(WORKSPACE)))
    changed = {**WORKSPACE, "packages/app/src/main.ts": "import { read } from '@w/core';\nexport function other() { return read('x'); }\n"}
    e = made(changed)
    now, redone = builds.refreshed_contributions(old, e, spark.createDataFrame([("r", "s", "packages/app/src/main.ts")], "repo_id string, snapshot_id string, contrib_path string"))
    assert rows(now.select(*old.columns)) == rows(builds.contributions(e).select(*old.columns))
    assert {r.contrib_path.rsplit("/", 1)[1] for r in redone.collect()} == {"main.ts"}


def test_registry(spark, tmp_path, rows):
    r = registry.RepoRegistry(spark, str(tmp_path / "r"))
    assert r.list().count() == 0
    r.add("a", "/src/a/", "A")
    r.add("b", "/src/b")
    for clash in (("a", "/src/c"), ("c", "/src/a")):
        with pytest.raises(ValueError, match="registered"):
            r.add(*clash)
    assert rows(r.show("a")) == [("a", "/src/a", "A")]
    assert r.remove("a") and not r.remove("a")
    assert rows(r.list().select("repo_id")) == [("b",)]


def test_polling(spark, tmp_path, rows):
    root = tmp_path / "tree"
    (root / "x").mkdir(parents=True)
    (root / "x" / "a.txt").write_text("a")
    (root / "b.txt").write_text("b")
    before = cut(registry.poll(spark, str(root)))
    assert registry.watch_once(spark, str(root), before, 0.0).count() == 0
    (root / "x" / "a.txt").rename(root / "c.txt")
    (root / "b.txt").write_text("bb")
    (root / "d.log").write_text("d")
    got = registry.watch_once(spark, str(root), before, 5.0, ignored=r"\.log$")
    assert rows(got.select("path", "kind", "previous_path")) == [("b.txt", "modified", None), ("c.txt", "renamed", "x/a.txt")]


def test_plans(spark):
    q = spark.createDataFrame([("1", "what breaks if I rename Foo", None, 500), ("2", "Foo.bar", "semantic", 0), ("3", "  ", None, None), ("4", None, "nonsense", 7)], "query_id string, text string, mode string, n int")
    p = {r.query_id: r for r in planner.query_ir(q, "text", "n", "mode").collect()}
    assert (p["1"].primary, p["1"].plan_limit, p["1"].change_hint, p["1"].error) == ("impact", 50, "rename", None) and p["1"].routes[0] == "impact"
    assert (p["2"].primary, p["2"].routes, p["2"].overridden, p["2"].plan_limit) == ("semantic", ["semantic"], True, 1)
    assert p["3"].error == p["4"].error == "empty query" and p["3"].routes == [] and p["3"].plan_limit == 10 and not p["4"].overridden
    assert [planner.clamped_limit(*x) for x in (("symbol", None), ("symbol", 0), ("symbol", 900), ("planner", 0), ("planner", 99), ("impact", 5))] == [25, 25, 200, 1, 50, 5]


def test_adapters(spark):
    h = spark.createDataFrame([("q", "h1", 5, "a.ts", 1, 9)], "query_id string, hit_id string, score int, path string, start int, end int")
    exact, far = planner.adapted(h, "exact").first(), planner.adapted(h, "impact").first()
    assert (exact.candidate_id, exact.anchor, exact.end, exact.symbol_id) == ("exact:h1", "span", 9, None)
    assert (far.anchor, far.start, far.raw_score) == ("file", None, 5)


def test_small_functions(spark):
    df = spark.createDataFrame([(x,) for x in ("./a//b.ts", "a/../b.ts", "../b", "/abs", "C:\\x", "a\\b", "", None)], "p string")
    assert [r[0] for r in df.select(paths.repo_relative(F.col("p"))).collect()] == ["a/b.ts", "b.ts", None, None, None, "a/b", None, None]
    one = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], "a\r\nb", None, "src/x.ts#GET /y")], "v array<float>, z array<float>, t string, n string, target string")
    got = one.select(text.normalised_vector(F.col("v")), text.normalised_vector(F.col("z")), text.chunk_text({"path": F.col("n"), "text": F.col("t")}), text.backing_file(F.col("target"))).first()
    assert list(got) == [[0.6, 0.8], [0.0, 0.0], "text:\na\nb", "src/x.ts"]
    r = spark.createDataFrame([(True, "references_symbol", False), (True, "imports_file", False), (True, "other", False), (True, None, False), (True, None, True), (False, "imports_file", False)], "t boolean, e string, a boolean")
    assert [x[0] for x in r.select(text.test_relevance(F.col("t"), F.col("e"), F.col("a"))).collect()] == [0, 1, 2, 1, 3, 0]


def test_caps_of_a_traversal(spark):
    steps = [("s", f"n{i:03}", "symbol", 0, 1, 950 - i, False) for i in range(300)] + [(f"n{i:03}", f"m{i:03}", "symbol", 0, 1, 900, False) for i in range(300)]
    df = spark.createDataFrame(steps, "src string, dst string, entity_kind string, certainty int, relationship int, score int, terminal boolean")
    seeds = spark.createDataFrame([("s",), ("lonely",)], "seed string")
    hits, notes = impact.traverse_capped(df, seeds, impact.SCENARIOS["modify_behavior"])
    n = {r.seed: r["count"] for r in hits.groupBy("seed").count().collect()}
    assert n["s"] <= 1 + 192 and n["lonely"] == 1
    assert {(r.seed, r.cap) for r in notes.collect()} >= {("s", "edges"), ("s", "candidates"), ("s", "nodes")}
    small = df.where("dst < 'm003' or (dst >= 'n' and dst < 'n003')")
    free, none = impact.traverse_capped(small, seeds, impact.SCENARIOS["delete"])
    assert none.count() == 0
    plain = impact.traverse(small, seeds, impact.SCENARIOS["delete"])
    assert sorted(map(tuple, free.collect())) == sorted(map(tuple, plain.collect()))


def test_a_span_as_long_as_the_file(spark, rows):
    spans = [("f", f"s{i}", i * 10, i * 10 + 9) for i in range(500)] + [("f", "all", 0, 5_000_000), ("f", "half", 2000, 4095)]
    points = [("f", f"p{i}", i) for i in (0, 5, 4999, 5001, 2500, 5_000_000, 5_000_001)]
    s = spark.createDataFrame(spans, "path string, span_id string, start bigint, end bigint")
    p = spark.createDataFrame(points, "path string, id string, at bigint")
    got = {r.id: r.span_id for r in graph.smallest_enclosing(p, s, ["path"], "id", 16).collect()}
    want = {i: min(((e - a, a, n) for f, n, a, e in spans if a <= at <= e), default=(0, 0, None))[2] for _, i, at in points}
    assert got == {k: v for k, v in want.items() if v}


def test_block_search_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 8)).round(1)
    x[5] = 0
    data = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)] + [(1000, None, 1), (1001, [1.0], 1), (None, [1.0] * 8, 1), (1002, [float("nan")] * 8, 1)]
    df = spark.createDataFrame(data, "id long, v array<float>, score int")
    got = {}
    for r in semantic.block_search(df, df.where("id % 100 = 0 or id = 5"), "id", "v", 7, 8, block=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    unit = x.astype(np.float32).astype(float)
    unit /= np.where(np.linalg.norm(unit, axis=1, keepdims=True) > 0, np.linalg.norm(unit, axis=1, keepdims=True), 1)
    for q, found in got.items():
        score = np.floor((unit @ unit[q] + 1) * 500000 + 0.5).astype(int)
        score[[not (unit[q].any() and u.any()) for u in unit]] = 0
        want = sorted(range(700), key=lambda i: (-score[i], i))[:7]
        assert [i for _, i, _ in sorted(found)] == want
    assert set(got) == {0, 5, 100, 200, 300, 400, 500, 600}
    assert semantic.block_search(df.limit(0), df, "id", "v", 3, 8).count() == 0


def test_fixture_vectors():
    v = semantic.fixture_vector("text", 64)
    assert v == semantic.fixture_vector("text", 64) != semantic.fixture_vector("other", 64) and abs(sum(a * a for a in v) - 1) < 1e-5 and len(v) == 64
