"""Lines, lookups, routes and the synthetic corpus."""

from pyspark.sql import functions as F

from tessera.functions import lines
from tessera.operators import graph, planner, search
from tessera.sources import synthetic


def test_lines(spark, rows):
    f = spark.createDataFrame([("a", "é\n\nxy"), ("b", ""), ("c", None), ("d", "x\n")], "path string, contents string")
    assert rows(lines.line_table(f, ["path"])) == [("a", 1, 0, 2), ("a", 2, 3, 3), ("a", 3, 4, 6), ("b", 1, 0, 0), ("d", 1, 0, 1), ("d", 2, 2, 2)]
    got = spark.range(7).select(lines.line_of(F.lit("é\n\nxy"), F.col("id").cast("int"))).collect()
    assert [r[0] for r in got] == [1, 1, 1, 2, 3, 3, 3]


def test_leading_comments(spark):
    c = lambda text, n: spark.range(1).select(lines.leading_comment(F.lit(text), F.lit(n))).first()[0]
    assert c("x\n// a\n  // b\nf()", 4) == "// a\n// b"
    assert c("/*\n * a\n */\nf()", 4) == "/*\n* a\n*/"
    assert c("// a\n\nf()", 3) == "" and c("f()", 1) == ""


def test_cut_to_bytes(spark):
    t = spark.createDataFrame([("éé",), ("abc",), (None,)], "t string")
    assert [r[0] for r in t.select(lines.cut_to_bytes(F.col("t"), F.lit(3))).collect()] == ["é", "abc", None]


def test_lookups(spark, rows):
    edges = spark.createDataFrame([("imp", "fun"), ("imp2", "imp")], "src_key string, dst_key string")
    can = graph.canonical(edges)
    occ = spark.createDataFrame([("o1", "fun", "definition", "a"), ("o2", "fun", "reference", "a"), ("o3", "imp", "import", "b"), ("o4", "fun", "import", "a"), ("o5", "solo", "reference", "c")], "occurrence_id string, symbol_id string, role string, path string")
    assert rows(graph.references(occ, can).select("canonical", "occurrence_id")) == [("fun", "o2"), ("fun", "o3"), ("solo", "o5")]
    s = spark.createDataFrame([("imp2",), ("fun",)], "symbol_id string")
    assert rows(graph.definitions(s, occ, can).select("symbol_id", "occurrence_id")) == [("fun", "o1"), ("imp2", "o1")]
    assert rows(graph.aliases(can)) == [("fun", 2, "imp")]


def test_major_symbols(spark, rows):
    s = spark.createDataFrame([("c", "class", None), ("p", "property", "c"), ("f", "function", "c"), ("v", "variable", None), ("w", "variable", "f"), ("q", "property", "f"), ("x", "import_binding", None)], "symbol_id string, kind string, container string")
    assert rows(graph.major_symbols(s).select("symbol_id")) == [("c",), ("f",), ("p",), ("v",)]


def test_capped(spark, rows):
    r = spark.createDataFrame([("s", i, 10) for i in range(6)], "s string, rank int, w int")
    assert graph.capped(r, ["s"], "rank", 4).count() == 4
    assert graph.capped(r, ["s"], "rank", 4, "w", 25).count() == 2


def test_best_per_path(spark, rows):
    h = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("q", "a", 2), ("q", "c", 9)], "q string, path string, rank int")
    assert rows(search.best_per_path(h, ["q"])) == [("q", "a", 2), ("q", "b", 1), ("q", "c", 3)]


def test_routes(spark):
    assert planner.plan_routes(["symbol", "impact"]) == ["symbol", "semantic", "impact"]
    assert planner.plan_routes(["symbol", "impact"], preferred=["impact"], disabled=["semantic"]) == ["symbol", "impact"]
    assert planner.low_signal("a b") and not planner.low_signal("a b", 1)
    assert planner.supports({"language"}, {"language": ["ts"], "package": ["p"], "kind": []}) == ["package"]
    t = spark.createDataFrame([("s1",), ("s1",)], "symbol_id string")
    run = {"symbol": lambda: t.limit(0), "semantic": lambda: t, "impact": lambda: t}
    out, trace = planner.run_routes(["exact", "symbol", "semantic", "impact"], run, "staged")
    assert out.count() == 2 and [s for _, s in trace] == ["unavailable", "empty", "ran", "not_needed"]
    out, _ = planner.run_routes(["semantic", "impact"], run, "multi")
    assert out.count() == 4
    assert planner.seed_anchor(t) == ("s1", "unique") and planner.seed_anchor(t.limit(0)) == (None, "none")
    assert planner.no_answer([("exact", "unavailable")], 0, False) == "no_route_available" and planner.no_answer([], 1, False) is None


def test_synthetic_corpus(spark, rows):
    a = synthetic.corpus(spark, 3, 4)
    assert rows(a) == rows(synthetic.corpus(spark, 3, 4).repartition(5)) and a.count() == 12
    assert rows(a) != rows(synthetic.corpus(spark, 3, 4, seed=8))
