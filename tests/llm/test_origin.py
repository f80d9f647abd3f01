"""Generated, minified and vendored files."""

import random

import numpy as np

from tessera.llm import origin

FILES = "repo_id string, snapshot_id string, path string, contents string, origin int"


def person(rng, n=12):
    names = ["load", "store", "merge", "split", "queue", "draft", "token", "scope"]
    out = ["import { " + rng.choice(names) + " } from './" + rng.choice(names) + "';", ""]
    for i in range(n):
        a, b = rng.sample(names, 2)
        out += [f"// keeps the {a} in step with its {b}", f"export function {a}{b.title()}{i}(rows, limit = {rng.randrange(50)}) {{", f"  if (rows.length > limit) {{", f"    return rows.{b};", "  }", f"  const {a} = rows.map((row) => row.{b});", f"  return {a};", "}", ""]  # noqa: F541
    return "\n".join(out)


def stub(rng, head=True):
    lines = [f"export const Codec{i} = {{ encode(m, w) {{ if (m.f{i} !== 0) w.uint32({8 * i}).int32(m.f{i}); return w; }} }};" for i in range(rng.randrange(5, 20))]
    return ("// Code generated by protoc 3.1.2. DO NOT EDIT.\n\n" if head else "") + "\n".join(lines)


def corpus(rng, n):
    rows = []
    for i in range(n):
        r = f"repo{i % 13}"
        rows.append((r, "s", f"packages/a/src/m{i}.js", person(rng)))
        if i % 3 == 0:
            rows.append((r, "s", f"packages/a/src/g{i}.js", stub(rng)))
        if i % 5 == 0:
            rows.append((r, "s", f"packages/a/src/d{i}.js", "export const t = [" + ", ".join(f"{rng.random():.4f}" for _ in range(200)) + "];"))
    return rows


def test_labels():
    assert origin.weak_label("a.ts", "// AUTO-GENERATED FILE - DO NOT EDIT\nexport const a = 1;") == "generated"
    assert origin.weak_label("a.ts", "// These ids were once auto-generated; they are written by hand now.\nconst a = 1;") == "hand"
    assert origin.weak_label("a.js", "export const a = 1;\n\n// Regenerate instead of editing.\n") == "generated"
    assert origin.weak_label("a.js", "/*! lib v1.2.3 | MIT licence */\nvar a = 1") == "vendored"
    assert origin.weak_label("a.js", "/*! Copyright the team. Internal use, see LICENSE in the repository root. 1.2.3 */\nvar a = 1") == "hand"
    assert origin.weak_label("vendor/a.js", "var a = 1") is None
    assert origin.weak_label("a.js", "") == "hand"


def test_head_and_tail_are_masked():
    head, body = origin.split_head("// one\n/* two */\ncode();\n// three\n")
    assert body.strip() == "code();" and "one" in head and "three" in head
    assert origin.split_head("// only a comment")[1].strip() == ""


def test_svm_separates_what_is_separable():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(200):
        y.append([1.0 if i % 4 == 0 else -1.0])
        rows.append(np.unique(np.concatenate((rng.integers(0, 500, 30), [600 + (i % 4 == 0)]))))
    w, b = origin.train_svm(rows, np.array(y), 1024)
    assert all((w[r].sum(0) / np.sqrt(len(r)) + b)[0] * t[0] > 0 for r, t in zip(rows, y, strict=True))


def test_held_out_repositories_and_copies_without_notice(spark):
    rng = random.Random(4)
    model = origin.train([(r, p, t) for r, _, p, t in corpus(rng, 200)])
    assert model.report["precision"] > 0.95 and model.report["recall"] > 0.95
    f = origin.Features()
    margin = lambda t: max(*origin.score(model, f, "packages/z/src/x.js", t))
    assert margin(stub(rng, head=False)) > 0 > margin(person(rng))


def test_rows_of_any_kind(spark):
    rng = random.Random(6)
    rows = [(*r, 1) for r in corpus(rng, 60)]
    rows += [("r", "s", "empty.js", "", 1), ("r", "s", "null.js", None, 1), (None, None, None, "x()", 1), rows[0], ("r", "s", "long.js", person(rng, 3000), 1)]
    got = origin.classified(spark.createDataFrame(rows, FILES))
    out = {(r.repo_id, r.path): r.origin for r in got.collect()}
    assert len(out) == got.count() == len({(r[0], r[2]) for r in rows})
    assert out["r", "empty.js"] == out["r", "null.js"] == out["r", "long.js"] == "hand"
    assert origin.classified(spark.createDataFrame([], FILES)).count() == 0


def test_validation_cannot_grade_itself():
    # in the repositories kept for validation a third of the emitted files has lost its notice: the report must show it
    rng = random.Random(9)
    rows = []
    for i in range(260):
        r = f"repo{i % 13}"
        kept = origin.zlib.crc32(f"split:{r}".encode()) % 5 == 0
        rows.append((r, f"packages/a/src/m{i}.js", person(rng)))
        rows.append((r, f"packages/a/src/g{i}.js", stub(rng, head=not (kept and i % 3 == 0))))
    report = origin.train(rows).report
    assert report["precision"] < 0.9 and report["recall"] > 0.95


def test_long_files_are_no_sample(spark):
    df = spark.createDataFrame([("r", "s", f"f{i}.js", "x" * (10 if i % 2 else 200), 1) for i in range(40)] + [("r", "s", "n.js", None, 1)], FILES)
    assert len(origin.take_sample(df, rows=100, file_bytes=100)) == 20
    assert len(origin.take_sample(df.limit(0))) == 0
