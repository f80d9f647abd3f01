"""The parser: what it must take, what it must not, and that no text breaks it."""

import random

import pytest

from tessera.llm import parsing, syntax

GOOD = {
    "js": [
        "", "﻿", "// only", "#!/usr/bin/env node\nf()", "/* a\n b */", "a\n.b()\n.c()", "var a = 1, b", "x = /[/]\\/(\\d+)$/.test(y) ? /a/g : b / c / d", "a = b\n++c", "for (const a of b) c()\nfor (var i = 0, n = a.length; i < n; i++) {}\nfor (const k in o) ;",
        "if (a) b(); else if (c) d()\nelse { e() }", "try { a() } catch { b() } finally { c() }", "switch (a) { case 1: case 2: b(); break; default: c() }", "label: for (;;) { continue label }", "const { a, b: [c = 1, ...d], ...e } = f", "({ a, b: 1, [c]: 2, get d() { return 1 }, async *e() {}, 'f': 3, g() {}, ...h })",
        "class A extends B { static x = 1; #p = 2; constructor() { super(); this.#p } get a() { return 1 } static async b() {} *c() {} static { f() } }", "const f = async (a, { b }, [c] = [], ...d) => ({ a }), g = x => x, h = async x => { await x }", "import a, { b as c } from 'd'; import * as e from 'f'\nimport 'g'\nexport { a as default, c }\nexport * from 'h'\nexport default class {}", "export default function () {}", "a?.b?.[c]?.(d) ?? e", "x = `a${b}c${`d${e}`}f${{ a: 1 }.a}`",
        "new Foo\nnew Foo.Bar(1)\nnew (f())()", "!function () {}()\n;(function ($) {})(jQuery)", "a ** b ** c, typeof a === 'b', void 0, delete a.b", "let async = 1; async()", "var of = 1, get = 2, type = 3; type = of", "do a(); while (b)", "x = a ? b : c ? d : e", "throw new Error('x')", "if (a) return\n", "async function* f() { for await (const x of y) yield* x }", "a = b || (c, d)", "x = y\n`t`", "const s = 'it\\'s' + \"\\\"\" + '\\\n'", "export const a = 1, b = 2\nexport async function c() {}", "import(x).then(y); import.meta.url", "a = 1_000n + 0xff + .5 + 1e-3", "i++\nj--", "a = {}\n/re/.test(b)",
    ],
    "ts": [
        "let a: number = 1, b!: string", "function f<T extends A = B>(this: X, a?: T, ...b: T[]): a is string { return true }", "interface A<T> extends B, C<T> { a: string; b?(x: number): void\n readonly [k: string]: any; new (x: T): A; (y: T): B }", "type A = | 'a' | 1 | { [K in keyof T]?: T[K] } & B<C<D>>[]", "type F = (a: number, b?: string) => void; type G = new () => A", "enum A { B, C = 1, 'd' = 2 }\nconst enum E { F }\ndeclare enum G {}",
        "abstract class A<T> implements B, C { private readonly a: string = ''; constructor(private b: number, public c?: string) { super() } abstract d(): void; static e?: number; [key: string]: any; declare f: string }", "const a = b as unknown as C; const d = <E>f; g!.h![0]", "const m: Map<string, any> = new Map<string, any>(); f<T>(x)", "declare module 'a' { export function f(x: number): string }\nnamespace A.B { export const c = 1 }", "import type { A } from 'b'; import { type C, D } from 'e'; export type { A }", "function f(a: string): void\nfunction f(a: any) {}", "const f = <T,>(x: T): T => x; const g = (a: number): Promise<void> => { }", "let x: typeof import('y'); let z: A extends B ? C : D", "export default interface A { a: 1 }", "a satisfies B", "@dec() class A { @prop x = 1; @m() n() {} }", "for (const a of b as C[]) {}", "let t: [a: string, b?: number, ...c: D[]]", "type T = `a${B}c`", "if (a < b && c > d) {}", "const y = a < b", "export = foo", "function assertIsString(val: any): asserts val is string {}", "let u: unique symbol", "const x = cond ? (a) : b", "const x = cond ? (a): number => 1 : b",
    ],
    "tsx": [
        "const a = <div className=\"x\" {...p} on={() => f()}>it's {b} <b/> </div>", "const f = () => (<>\n  <A.B c=\"d\" />\n  {/* c */}\n  {list.map((x: any) => <li key={x}>{x}</li>)}\n</>)", "const a = b < c, d = e > f", "function A() { return <a href=\"b\">don't</a>; }", "const g = <T,>(x: T) => x", "return_ ? <a/> : <b>{c ? <d/> : null}</b>",
    ],
    "jsx": ["const a = <div style={{ a: 1 }}>{`t ${b}`}</div>", "export default () => <A b={<c/>} d>e &amp; f</A>"],
}
BAD = {
    "js": [
        "const a", "let a b", "if (a {", "a = = b", "f(a,, b)", "function f(a {", "}", "{", "const a = ;", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x", "let a: number = 1", "interface A { b: string }", "type A = 'b'", "const a = <div/>", "enum A { B }", "class { }", "for (a b) {}", "return return", "'abc", "`abc", "/* abc", "a +", "x = {a: 1", "def f(x):\n  return x", "SELECT a FROM b", "#include <a>", "a.", "import { a from 'b'", "export a", "switch (a) { b }", "try { a() }", "1 = 2", "a + b = c", "{ \"a\": 1, \"b\": 2 }", "const §a = 1", "new", "() => {", "else { a() }", "x = [1, 2", ".a { color: red; }", "const a = @b", "class A { b c }",
    ],
    "ts": ["let a: = 1", "interface A { b: }", "const a = <div className=\"b\">c</div>;", "type A =", "function f(a: string,, b) {}", "import type from", "enum A { 1 }", "class A implements { }", "let x: Map<string = 1"],
    "tsx": ["const a = <div>", "const a = <div></span>", "const a = <a b=></a>", "const a = <div>{b</div>", "return <a>}</a>"],
}


@pytest.mark.parametrize(("ext", "code"), [(e, c) for e, cs in GOOD.items() for c in cs])
def test_accepts(ext, code):
    assert syntax.accepts(code, ext), syntax.problems(code, ext)
    assert syntax.problems(code, ext) == []


@pytest.mark.parametrize(("ext", "code"), [(e, c) for e, cs in BAD.items() for c in cs])
def test_rejects(ext, code):
    assert not syntax.accepts(code, ext)
    assert syntax.problems(code, ext)


def test_typescript_takes_javascript():
    for code in GOOD["js"]:
        assert syntax.accepts(code, "ts"), code


def test_recovery_goes_on():
    found = syntax.problems("const a = ;\nok();\nlet = = 3;\nfunction f() {\n  if (x {\n  }\n}\nfine();\nx = ;\n", "js")
    assert found[0][1] == 1 and len({line for _, line in found}) >= 3


def test_no_text_breaks_it():
    rng = random.Random(2)
    pieces = [c for cs in GOOD.values() for c in cs]
    for _ in range(1500):
        t = list(rng.choice(pieces) + "\n" + rng.choice(pieces))
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(3)] = rng.choice(["(", ")", "{", "}", "<", ">", "`", "'", "/", "=", "${", "\n", "?", ":", ",", "", "async ", "\x01", "é", "[", "]", "\0"])
        text = "".join(t)
        for ext in ("js", "tsx"):
            assert syntax.accepts(text, ext) == (not syntax.problems(text, ext)), repr(text)


DEEP = {
    "arrays": ("x=" + "[" * 5000 + "1" + "]" * 5000, "js"), "parens": ("x=" + "(" * 5000 + "1" + ")" * 5000, "js"), "calls": ("f(" * 5000 + ")" * 5000, "js"), "blocks": ("{" * 5000 + "}" * 5000, "js"),
    "objects": ("x=" + "{a:" * 5000 + "1" + "}" * 5000, "js"), "arrows": ("x=" + "(a)=>{return " * 5000 + "1" + "}" * 5000, "ts"), "else": ("if(a)b();" + "else if(a)b();" * 5000, "js"), "types": ("let x:" + "A<" * 5000 + "1" + ">" * 5000, "ts"),
    "markup": ("x=" + "<a>" * 5000 + "</a>" * 5000, "tsx"),
}


@pytest.mark.parametrize("form", sorted(DEEP))
def test_depth_is_no_error(form):
    code, ext = DEEP[form]
    assert syntax.accepts(code, ext) and not syntax.problems(code, ext)
    assert not syntax.accepts(code[:-1] + "=", ext)


def test_unclosed_depth_is_an_error():
    assert not syntax.accepts("[" * 3000, "js") and syntax.problems("[" * 3000, "js")


def test_verdict_does_not_depend_on_the_order():
    texts = [("x=" + "[" * n + "1" * (n % 3) + ("]" * n if n % 2 else "]" * (n - 1)), "js") for n in (3, 90, 105, 210, 300, 1000, 41, 40, 39)]
    texts += [(c, e) for e in ("js", "ts") for c in GOOD["js"] + BAD["js"]]
    want = {t: syntax._accepts(*t, syntax.Groups()) if len(t[0]) < 500 else None for t in texts}
    for seed in range(4):
        order = random.Random(seed).sample(texts, len(texts))
        syntax._SHARED = syntax.Groups()
        for t in order:
            got = syntax.accepts(*t)
            assert want[t] in (None, got), t
            want[t] = got


@pytest.mark.parametrize("code", ["if (a) b();" + " else if (a) b();" * 3000, "x = " + "a ? b : " * 3000 + "c;", "x = " + "".join(f"[a{'+a' * (i % 7)}, (" for i in range(400)) + "a" + ")]" * 400 + ";"])
def test_deep_valid_files_are_accepted(code):
    assert syntax.accepts(code, "js") and not syntax.problems(code, "js")
    assert not syntax.accepts(code + "]", "js") and syntax.problems(code + "]", "js")


FILES = "repo_id string, snapshot_id string, path string, contents string, valid int"


def test_rows_of_any_kind(spark, rows):
    f = [("r", "s", "a.ts", "let a: number", 1), ("r", "s", "b.js", "let a: number", 1), ("r", "s", "b.js", "let a: number", 1), ("r", "s", "c.js", None, 1), ("r", "s", "d.js", "", 1), ("r", "s", "e.py", "def", 1), (None, None, "x/F.JS", "}", 1), ("r", "s", None, "}", 1), ("r", "s", "g.js", "f(" + "1, " * 100_000 + "2)", 1)]
    df = spark.createDataFrame(f, FILES)
    assert rows(parsing.invalid_files(df).select("repo_id", "path", "first_line")) == [("r", "b.js", 1), (None, "x/F.JS", 1)]
    i = spark.createDataFrame([("r", "b.js", "javascript", True, None, "x"), ("r", "b.js", "javascript", False, None, "y")], "repo_id string, path string, language string, parse_succeeded boolean, parsed_at timestamp, artifact_id string")
    got = {(r.repo_id, r.language): (r.files, r.invalid_files, r.flagged_files) for r in parsing.rates(df, i).collect()}
    assert got["r", "javascript"] == (1, 1, 1) and got["r", "ts"] == (1, 0, 0)
    assert parsing.invalid_files(df.limit(0)).count() == 0


def test_flags_are_those_of_the_same_contents(spark):
    f = spark.createDataFrame([("r", "s", "a.js", "a;", "AA"), ("r", "t", "a.js", "b;", "bb"), (None, "s", "n.js", "a;", "aa"), ("r", "s", "o.js", "a;", "aa")], "repo_id string, snapshot_id string, path string, contents string, content_sha256 string")
    told = [("r", "a.js", "javascript", False, "aa", 1), ("r", "a.js", "javascript", True, "bb", 2), (None, "n.js", "javascript", False, "aa", 1), ("r", "o.js", "javascript", False, "zz", 1)]
    i = spark.createDataFrame(told, "repo_id string, path string, language string, parse_succeeded boolean, content_sha256 string, at int").selectExpr("*", "timestamp_seconds(at) parsed_at", "path artifact_id")
    got = {(r.repo_id, r.language): (r.files, r.flagged_files) for r in parsing.rates(f, i).collect()}
    assert got == {("r", "javascript"): (3, 1), (None, "javascript"): (1, 1)}


# the lines of all errors, also behind an error in the same group, in a skipped block, in markup and on the same line
EVERY = [
    ("a = ; b = ; c = ;", "js", [1, 1, 1]), ("f(a b, function () {\n  x = ;\n  y = ;\n});\nz = ;", "js", [1, 2, 3, 5]), ("function f(a,, b) {\n  x = ;\n}", "js", [1, 2]), ("class A {\n  b c\n  d() { x = ; }\n}", "js", [2, 3]),
    ("switch (a) {\n  b;\n  case 1: x = ;\n  case 2: y = ;\n}", "js", [2, 3, 4]), ("x = {\n  b: = 1,\n  c: = 2,\n  d: 3\n};", "js", [2, 3]), ("interface A {\n  b: ;\n  c: ;\n}", "ts", [2, 3]), ("def f(x) {\n  y = ;\n}", "js", [1, 2]),
    ("function f() {\n  return <div></span>;\n}\nlet = = 3;\nx = ;", "tsx", [2, 4, 5]), ("const a = <div b=></div>;\nx = ;", "jsx", [1, 2]), ("const a = <div>{b c}</div>, d = <i>}</i>;\nx = ;", "jsx", [1, 1, 2]),
]


@pytest.mark.parametrize(("code", "ext", "lines"), EVERY)
def test_every_error_is_found(code, ext, lines):
    assert [line for _, line in syntax.problems(code, ext)] == lines


def test_skipped_groups_are_read_once():
    code = "a b " + "{x y (z w [" * 300 + "])}" * 300
    assert len(syntax.problems(code, "ts")) > 300


def test_invalid_files_keep_every_error(spark):
    f = [("r", "s", "a.js", "x = ;\nok();\ny = ; z = ;", 1), ("r", "s", "b.js", "let a b", 1), ("r", "s", "b.js", "let a b", 1), ("r", "s", "b.js", "ok();\nx = ;", 1), ("r", "s", "b.js", "ok()", 1)]
    got = {r.path: r for r in parsing.invalid_files(spark.createDataFrame(f, FILES)).collect()}
    assert [(e.line, e.column) for e in got["a.js"].all_errors] == [(1, 5), (3, 5), (3, 11)]
    assert [(e.line, e.column) for e in got["b.js"].all_errors] == [(1, 7), (2, 5)]
    assert (got["b.js"].first_error, got["b.js"].first_line, got["b.js"].errors) == (got["b.js"].all_errors[0].what, 1, 2)
