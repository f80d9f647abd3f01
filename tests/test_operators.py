"""The engine's operators on small fixtures."""

import random

from pyspark.sql import functions as F

from tessera.functions import globs, paths, text
from tessera.operators import eligibility, graph, impact, metrics, modules, overlay, planner, refresh, search, semantic
from tessera.plans import engine_queries
from tessera.plans.ordered import running_totals
from tessera.sources import git, stores


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_paths(spark):
    cases = {"./a//b\\c.ts": "a/b/c.ts", "/a/./b/": "a/b", "a/././b": "a/b", "": ""}
    for raw, want in cases.items():
        assert one(spark, paths.slashed(F.lit(raw))) == want
    assert one(spark, paths.slashed(F.lit(None).cast("string"))) is None
    assert one(spark, paths.resolved(F.lit("a/../b/./c"))) == "b/c"
    assert one(spark, paths.resolved(F.lit("../x"))) is None and one(spark, paths.resolved(F.lit("/x"))) is None
    assert one(spark, paths.lexical_distance(F.lit("a/b/c"), F.lit("a/x"))) == 3
    assert one(spark, paths.lexical_distance(F.lit("a/b"), F.lit("a/b"))) == 0
    assert one(spark, paths.test_stem(F.lit("x/Foo.test.ts"))) == "foo"
    assert one(spark, paths.file_stem(F.lit("x/.env"))) == ".env"


def test_globs(spark):
    t = spark.createDataFrame([("src/a/b.ts",), ("src/A.TS",), (None,)], "p string")
    got = [r[0] for r in t.select(globs.matches_any(F.col("p"), ["src/*.ts"])).collect()]
    assert got == [True, False, False]
    assert [r[0] for r in t.select(globs.matches_any(F.col("p"), ["SRC/?.ts"], True)).collect()] == [False, True, False]
    assert [r[0] for r in t.select(globs.matches_any(F.col("p"), [])).collect()] == [True] * 3


def test_terms(spark):
    assert one(spark, text.terms(F.lit("Where is the parseQueries2Tables of classes in HTTPServer?"))) == ["parse", "query", "querie2tables"][0:1] + ["queries2table", "classe", "httpserver"]
    assert one(spark, text.terms(F.lit(None).cast("string"))) is None or one(spark, text.terms(F.lit(None).cast("string"))) == []
    assert one(spark, text.token_estimate(F.lit("  a b\n c "))) == 3 and one(spark, text.token_estimate(F.lit(" "))) == 0
    assert one(spark, text.snippet(F.lit("\n a \n\nb\nc\nd\ne"))) == "a b c d"
    assert one(spark, text.snippet(F.lit("x" * 300))) == "x" * 200 + "..."


def test_scores_of_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, text.similarity_score(v(1.0, 0.0), v(1.0, 0.0))) == 1_000_000
    assert one(spark, text.similarity_score(v(1.0, 0.0), v(0.0, 1.0))) == 500_000
    assert one(spark, text.similarity_score(v(0.0, 0.0), v(0.0, 1.0))) == 0


LAYER = "path string, content_sha256 string"


def test_overlay(spark, rows):
    base = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], LAYER)
    tree = spark.createDataFrame([("a", "upsert", "2"), ("b", "delete", None), ("c", "delete", None)], "path string, kind string, content_sha256 string")
    buf = spark.createDataFrame([("c", "3"), ("d", "4")], LAYER)
    layers = overlay.layered(base, tree, buf, ["path"])
    assert rows(overlay.resolve(layers, ["path"])) == [("a", 1, "2"), ("c", 2, "3"), ("d", 2, "4")]
    plain = overlay.layered(base, tree.limit(0), buf.limit(0), ["path"])
    got = {r[0]: (r[1], r[2]) for r in overlay.difference(plain, layers, ["path"]).collect()}
    assert got == {"a": ("changed", False), "b": ("deleted", False), "c": ("changed", False), "d": ("added", True)}
    assert overlay.resolve(layers.limit(0), ["path"]).count() == 0


def test_overlay_from_status(spark, rows):
    lines = [" M a.ts", "?? b.ts", ' D "c d.ts"', "R  old.ts -> new.ts", "", None]
    s = git.parse_status(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    assert rows(overlay.working_tree_overlay(s)) == [("a.ts", "upsert"), ("b.ts", "upsert"), ("c d.ts", "delete"), ("new.ts", "upsert"), ("old.ts", "delete")]


def test_renames_need_unique_contents(spark, rows):
    b = spark.createDataFrame([("r", "a", "1"), ("r", "x", "9"), ("r", "y", "9"), ("r", "k", "5")], "repo string, path string, sha string")
    a = spark.createDataFrame([("r", "b", "1"), ("r", "z", "9"), ("r", "k", "6")], "repo string, path string, sha string")
    got = rows(overlay.fingerprint_changes(b, a, ["repo", "path"], "sha"))
    assert got == [("r", "b", "renamed", "a"), ("r", "k", "modified", None), ("r", "x", "removed", None), ("r", "y", "removed", None), ("r", "z", "created", None)]


def test_eligibility(spark):
    f = spark.createDataFrame([("vendor/generated/a.ts", 1, "x"), ("gen/a.ts", 1, "x"), ("a.min.js", 1, "x"), ("a.rs", 1, "x"), ("a.jsx", 1, "x"), ("a.ts", 3_000_000, "x"), ("a.ts", None, "\0"), ("a.ts", None, None)], "path string, content_bytes bigint, contents string")
    got = [r.skip_reason for r in eligibility.with_skip_reason(f, disabled=["jsx"]).collect()]
    assert got == ["vendor", "generated", "generated", "unsupported_extension", "disabled_language", "too_large", "binary", None]


SYMBOLS = "symbol_id string, name string, kind string, path string, stem string, visibility string, depth int, start int"


def test_name_search(spark):
    s = spark.createDataFrame(
        [("1", "Session", "class", "a", "session", "default_export", 0, 1), ("2", "session", "function", "b", "x", "local", 0, 1), ("3", "sessionStore", "class", "b", "x", "exported", 20, 1), ("4", "newSession", "class", "b", "x", "local", None, 1), ("5", None, "class", "b", "x", "local", 0, 1)], SYMBOLS
    )
    got = [(r.symbol_id, r.match_class, r.score) for r in search.search_names(s, "session").collect()]
    # the local function matches the case (40), the class its file's name (10) and is exported (25)
    assert got == [("2", "exact", 1050), ("1", "exact", 1045), ("3", "prefix", 760), ("4", "substring", 410)]
    assert [r.symbol_id for r in search.search_names(s, "session", "exact", kinds=["class"]).collect()] == ["1"]
    assert search.search_names(s, "").count() == 0
    assert search.clamp_limit(0) == 25 and search.clamp_limit(900) == 200


def test_filters(spark):
    t = spark.createDataFrame([("a", 1), (None, 2)], "l string, n int")
    assert [r.n for r in t.where(search.conjunction({"l": ["a"]})).collect()] == [1]
    assert t.where(search.conjunction({"l": []})).count() == 2
    assert search.normalised_filter([" .TS ", "", "js", "ts"], extension=True) == ["js", "ts"]


def test_percentiles(spark):
    want = {1: (0, 0, 0), 2: (0, 1, 1), 3: (1, 2, 2), 6: (2, 5, 5), 11: (5, 10, 10)}
    s = spark.createDataFrame([(n, float(i)) for n in want for i in range(n)] + [(1, None)], "g int, v double")
    got = {r.g: (r["count"], r.p50, r.p95, r.p99) for r in metrics.summarise(s, ["g"], "v").collect()}
    assert got == {n: (n, *map(float, w)) for n, w in want.items()}
    assert metrics.summarise(s.limit(0), ["g"], "v").count() == 0


def test_running_totals_of_a_hot_group(spark):
    random.seed(1)
    data = [("hot" if i % 3 else f"g{i % 7}", random.random(), i, i % 5) for i in range(2000)] + [(None, 0.5, -1, 3), (None, 0.5, -2, None)]
    df = spark.createDataFrame(data, "g string, k double, id int, w int").repartition(7)
    got = {r.id: (r.total, r.n) for r in running_totals(df, ["g"], ["k", "id"], "w", "total", "n").collect()}
    want, seen = {}, {}
    for g, k, i, w in sorted(data, key=lambda r: (str(r[0]), r[1], r[2])):
        t, n = seen.get(g, (0, 0))
        seen[g] = want[i] = (t + (w or 0), n + 1)
    assert got == want


def test_budgets_and_golden(spark, rows):
    v = "metric_name string, unit string, value double"
    b = spark.createDataFrame([("a", "ms", 10.0), ("r", "ratio", 1.0), ("z", "ms", 0.0)], v)
    c = spark.createDataFrame([("a", "ms", 15.0), ("r", "ratio", 0.5), ("z", "s", 1.0)], v)
    assert rows(metrics.compare(b, c).select("metric_name", "delta", "percent")) == [("a", 5.0, 50.0), ("r", -0.5, -50.0)]
    budget = spark.createDataFrame([("a", None, None, 60.0, "fail"), ("r", None, None, 10.0, "warn"), ("none", 1.0, None, None, "fail")], "metric_name string, max_value double, min_value double, max_regression_pct double, severity string")
    verdicts = metrics.evaluate_budgets(budget, b, c)
    assert rows(verdicts.select("metric_name", "verdict")) == [("a", "pass"), ("none", "fail"), ("r", "warn")]
    assert metrics.overall(verdicts).first()[0] == "fail" and metrics.overall(verdicts.limit(0)).first()[0] == "pass"
    e = spark.createDataFrame([("q", "a", 1), ("q", "b", 1), ("p", "a", 3)], "query_id string, path string, rank_max int")
    h = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("p", "a", 2), ("p", "a", 3)], "query_id string, path string, rank int")
    assert rows(metrics.evaluate_golden(e, h)) == [("p", 1, 1, True), ("q", 2, 1, False)]


def test_modules(spark, rows):
    code = "import def, { a as b, c } from './x.js';\nimport * as ns from '../lib';\nimport 'side';\nimport type { T } from './t';\n"
    f = spark.createDataFrame([("p/src/m.ts", code), ("p/src/x.ts", ""), ("p/lib/index.ts", ""), ("p/src/t.d.ts", ""), ("p/tests/m.test.ts", "import { z } from '../src/m';\n"), ("p/tests/x.test.ts", "")], "path string, contents string").withColumn("repo", F.lit("r"))
    i = modules.imports(f, ["repo", "path"])
    assert rows(i.where("path = 'p/src/m.ts'").select("module_specifier", "imported_name", "local_name")) == [("../lib", "*", "ns"), ("./t", "T", "T"), ("./x.js", "a", "b"), ("./x.js", "c", "c"), ("./x.js", "default", "def")]
    r = modules.resolve_relative(i, f, ["repo"])
    assert rows(r.select("module_specifier", "target_path")) == [("../lib", "p/lib/index.ts"), ("../src/m", "p/src/m.ts"), ("./x.js", "p/src/x.ts")]
    pk = spark.createDataFrame([("r", "p", "P"), ("r", "", "root"), ("r", "p/src", "A"), ("r", "p/src", "B")], "repo string, package_root string, package_name string")
    assert rows(modules.longest_root(f, pk, ["repo"]).where("path like '%/x.ts'").select("package_root", "package_name")) == [("p/src", "B")]
    t = modules.test_associations(f.select("repo", "path"), r, pk.where("package_root = 'p'"), ["repo"])
    assert rows(t.select("test_path", "path", "evidence")) == [("p/tests/m.test.ts", "p/src/m.ts", "imports_file"), ("p/tests/m.test.ts", "p/src/m.ts", "path_heuristic"), ("p/tests/x.test.ts", "p/src/x.ts", "path_heuristic")]


def test_exports(spark, rows):
    f = spark.createDataFrame([("a.ts", "export default class A {}\nexport async function f() {}\nexport type T = 1;\nexport const x = 1;\n")], "path string, contents string")
    assert rows(modules.exports(f, ["path"]).select("kind", "name", "visibility")) == [("class", "A", "default_export"), ("function", "f", "exported"), ("type_alias", "T", "exported"), ("variable", "x", "exported")]


def test_canonical(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("w", "x"), ("m", "n"), ("m", "o"), ("s", "s"), ("k", None)] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)]
    e = spark.createDataFrame(edges + edges[:3], "src_key string, dst_key string")
    got = {r.node: r.canonical for r in graph.canonical(e).collect()}
    assert [got[k] for k in "abcd"] == ["d"] * 4
    assert [got[k] for k in "xyw"] == ["x"] * 3
    assert got["m"] == "m" and got["s"] == "s" and got["k"] == "k"
    assert got["n000"] == "n100" and got["n057"] == "n100"
    assert graph.canonical(e.limit(0)).count() == 0


def test_containers_and_reach(spark, rows):
    n = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"n{i}") for i in range(6)], "id string, container string, name string")
    assert ("5", 5, "n0 > n1 > n2 > n3 > n4 > n5") in rows(graph.container_chains(n))
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "a", "c"), ("r", "c", "a")], "repo string, src_key string, dst_key string")
    got = rows(graph.reachable(e, spark.createDataFrame([("r", "a")], "repo string, node string"), ["repo"], 5).select("node", "depth"))
    assert got == [("a", 0), ("b", 1), ("c", 1)]


def test_search_without_its_query_vector_finds_nothing(spark, tmp_path):
    at = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(1, 5)], "vec_id long, embedding array<float>, label int").write.parquet(at)
    assert engine_queries.semantic_topk(spark, str(tmp_path)).count() == 0
    assert engine_queries.semantic_filtered_topk(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(0, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").write.mode("append").parquet(at)
    assert engine_queries.semantic_topk(spark, str(tmp_path)).count() == 5


def test_closure_has_no_depth_limit(spark, tmp_path):
    names = [f"n{i:02}" for i in range(30)]
    pairs = [*zip(names, names[1:]), ("n09", "n02"), ("n00", "n05")]
    spark.createDataFrame([("r", "renamed", a, b) for a, b in pairs], "repo_id string, kind string, previous_path string, path string").write.parquet(str(tmp_path / "watch_events.parquet"))
    want = {}
    for start in {b for _, b in pairs}:
        depth, now = {start: 0}, {start}
        while now:
            now = {a for a, b in pairs if b in now} - set(depth)
            depth |= dict.fromkeys(now, max(depth.values()) + 1)
        want |= {(start, node): d for node, d in depth.items()}
    got = {(r.start, r.node): r.depth for r in engine_queries.reverse_closure(spark, str(tmp_path)).collect()}
    assert got == want and max(want.values()) > 20


def test_spans(spark, rows):
    s = spark.createDataFrame([("f", "out", 0, 100), ("f", "in", 10, 20), ("f", "tie", 10, 20)], "f string, span_id string, start long, end long")
    p = spark.createDataFrame([("f", 1, 15), ("f", 2, 90), ("f", 3, 101), ("g", 4, 1)], "f string, position_id int, at long")
    assert rows(graph.smallest_enclosing(p, s, ["f"], "position_id", 7).select("position_id", "span_id")) == [(1, "in"), (2, "out")]


def test_run_groups(spark):
    r = spark.createDataFrame([("s", i, k) for i, k in enumerate("aabba")], "s string, rank int, k string")
    assert [x.g for x in graph.run_groups(r, ["s"], "rank", ["k"], "g").orderBy("rank").collect()] == [1, 1, 2, 2, 3]


STEPS = "src string, dst string, entity_kind string, certainty int, relationship int, score int, terminal boolean"


def brute_impact(steps, seed, depth):
    best = {seed: (0, 0, -1000, seed)}
    frontier = {seed: (best[seed], False)}
    for d in range(1, depth + 1):
        new = {}
        for node, (label, terminal) in frontier.items():
            for s, t, _kind, c, _rel, score, end in [] if terminal else steps:
                x = (max(label[0], c), d, -max(score - 40 * (d - 1), 0), label[3] + " > " + t)
                if s == node and (t not in new or x < new[t][0]):
                    new[t] = (x, end)
        frontier = {n: v for n, v in new.items() if n not in best or v[0] < best[n]}
        best |= {n: v[0] for n, v in frontier.items()}
    return {n: (v[0], v[1], -v[2]) for n, v in best.items()}


def test_impact_against_brute_force(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(14)]
    steps = list({(a, b): (a, b, "file", rng.randrange(3), rng.randrange(12), rng.choice([420, 620, 900]), rng.random() < 0.2) for a in names for b in rng.sample(names, 3) if a != b}.values())
    got = impact.traverse(spark.createDataFrame(steps, STEPS), spark.createDataFrame([("n0",)], "seed string"), impact.Scenario(4))
    assert {r.entity: (r.certainty, r.depth, r.score) for r in got.collect()} == brute_impact(steps, "n0", 4)
    ranked = impact.rank(got, 5)
    assert ranked.count() == 5 and impact.rank(got, 0).count() == 0
    assert impact.summary(ranked).first().hits == 5


def test_rename_leaves_out_heuristics(spark):
    steps = spark.createDataFrame([("a", "t", "test", 1, impact.RELATIONSHIPS.index("test_affinity"), 420, True)], STEPS)
    seed = spark.createDataFrame([("a",)], "seed string")
    assert impact.traverse(steps, seed, impact.SCENARIOS["rename"]).count() == 1
    assert impact.traverse(steps, seed, impact.SCENARIOS["delete"]).count() == 2


def test_embedding_cache(spark, rows):
    i = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b"), (None, "c")], "key string, text string")
    cache = spark.createDataFrame([("k1",), ("k1",)], "key string")
    assert rows(semantic.cache_split(i, cache, "key").select("key", "hit")) == [("k1", True), ("k2", False), ("k2", False), (None, False)]
    new = semantic.embed_missing(i, cache, "key", "text", 8).collect()
    assert [r.key for r in new] == ["k2"] and len(new[0].vector) == 8 and abs(sum(v * v for v in new[0].vector) - 1) < 1e-5


def test_rerank(spark):
    cols = "chunk_id string, text string, path string, symbol_name string, package_name string, symbol_kind string, is_exported boolean, is_default_export boolean, chunk_kind string, semantic_score int"
    c = spark.createDataFrame([("1", "session token", "a/session.ts", "invalidateSession", None, "function", True, False, "test_file", 1000), ("2", None, None, None, None, None, None, None, None, 1000)], cols)
    r = {x.chunk_id: x for x in semantic.rerank(c, "session function test").collect()}
    assert (r["1"].text_points, r["1"].path_points, r["1"].symbol_points, r["1"].kind_points, r["1"].export_points, r["1"].prior_points) == (2500, 3500, 4500, 2500, 900, 2500)
    assert r["2"].score == 1000
    assert semantic.rerank(c, "session", bonus=False).first().score == 1000


def intent(spark, q):
    return planner.classify(planner.query_features(spark.createDataFrame([(q,)], "t string"), "t")).first()


def test_intent(spark):
    assert intent(spark, "/foo.*bar/").primary == "exact"
    assert intent(spark, "SessionStore").primary == "symbol"
    assert intent(spark, "auth::Session.close").primary == "symbol"
    assert intent(spark, "where is the session closed").primary == "semantic"
    assert intent(spark, "what breaks if I rename the session").primary == "impact"
    assert intent(spark, None).primary == "semantic" and intent(spark, "src/a.ts").styles[0] == "exact"
    assert planner.reserve_budgets([("symbol", 250), ("impact", 600), ("exact", 150)], 500) == [("symbol", 250, True), ("impact", 0, False), ("exact", 150, True)]


def test_fusion(spark):
    cols = "query_id string, candidate_id string, route string, raw_score bigint, engine_rank int, symbol_id string, path string, start bigint, end bigint"
    c = spark.createDataFrame(
        [("q", "1", "symbol", 1050, 1, "s", "a", 0, 10), ("q", "2", "semantic", 900_000, 1, "s", "a", 0, 10), ("q", "3", "semantic", 800_000, 2, None, "a", 5, 7), ("q", "4", "impact", None, None, None, "b", None, None)], cols
    )
    f = {r.candidate_id: r for r in planner.fuse(c).collect()}
    assert f["1"].members == 3 and f["1"].score == 95 + 2 and f["4"].score == 0
    t = planner.with_trust(planner.group(planner.fuse(c), 10)).orderBy("rank").collect()
    assert [x.tier for x in t] == ["medium", "low"] and not t[0].close
    assert planner.fuse(c.limit(0)).count() == 0


def test_refresh(spark, rows):
    assert refresh.refresh_plan(None, {}) == ("full", "no_previous_build")
    assert refresh.refresh_plan({"schema_version": 1, "config_digest": "a"}, {"schema_version": 1, "config_digest": "b"}) == ("full", "config_changed")
    assert refresh.refresh_plan({"schema_version": 1}, {"schema_version": 1}) == ("incremental", "")
    s = "path string, fact string"
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("gone", "1")], s)
    new = spark.createDataFrame([("a", "2"), ("a", "1"), ("a", "1"), ("b", "9"), ("c", "1")], s)
    todo = refresh.touched(new.where("false"), refresh.signatures(old, ["path"], ["fact"]), refresh.signatures(new, ["path"], ["fact"]), ["path"])
    assert rows(todo) == [("b",), ("c",), ("gone",)]
    # incremental is the same as full
    redone = new.join(todo, "path", "left_semi")
    assert rows(refresh.merge(old, redone, todo, ["path"]).distinct()) == rows(new.distinct())
    assert tuple(refresh.delta_counts(old.where("path <> 'a'"), new.where("path <> 'a'"), ["path"], "fact").first()) == (1, 1, 1, 0)
    assert rows(refresh.symmetric_difference(old, new)) == [("b", "1", "before"), ("b", "9", "after"), ("c", "1", "after"), ("gone", "1", "before")]


def test_store(spark, rows, tmp_path):
    st = stores.SnapshotStore(spark, str(tmp_path / "f"), spark.createDataFrame([], "v int, w string").schema)
    st.write(spark.createDataFrame([("a", 1), ("b", 2)], "snapshot_id string, v int"))
    st.write(spark.createDataFrame([("b", 3), ("b", 4)], "snapshot_id string, v int"))
    assert rows(st.counts()) == [("a", 1), ("b", 2)] and rows(st.read("b").select("v")) == [(3,), (4,)]
    assert st.problems() == ["w: None for string"]
    stores.write_rows(st.read("b").select("v"), str(tmp_path / "j"), "jsonl")
    assert rows(stores.read_json_rows(spark, str(tmp_path / "j"), "v int")) == [(3,), (4,)]


def test_corpus(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("x\n\ny\n")
    (tmp_path / "package.json").write_text("{}")
    f = git.tree_files(spark, str(tmp_path))
    assert {r.path for r in f.collect()} == {"src/a.ts", "package.json"}
    assert tuple(git.corpus_stats(f.withColumn("contents", F.decode("content", "UTF-8"))).first()) == (2, 2, 1)


def test_clashing_column_names(spark):
    f = spark.createDataFrame([("a.ts", 1, "x", "mine", 7)], "path string, content_bytes bigint, contents string, rank string, total int")
    assert eligibility.with_skip_reason(f).first().rank == "mine"
    assert running_totals(f, ["rank"], ["path"], "content_bytes", "sum", "nth").first()["total"] == 7
