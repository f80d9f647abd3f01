"""Imports and exports of source files, the files they name, packages and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import file_name, parent_dir, resolved, test_stem
from tessera.operators.eligibility import is_test_path

# What stands for an extension in a module specifier, and what may follow a bare one.
SWAPS = {"js": ["ts", "tsx"], "jsx": ["tsx", "ts"], "mjs": ["mts", "ts"], "cjs": ["cts", "ts"]}
BARE = ["ts", "tsx", "js", "jsx", "mts", "cts"]

IMPORT = r"(?m)^\s*import\s+(?:type\s+)?([^'\";]*?)\s*from\s*['\"]([^'\"\n]+)['\"]"
EXPORT = r"(?m)^\s*export\s+(default\s+)?(?:async\s+)?(?:abstract\s+)?(function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"


def imports(files: DataFrame, key: list[str]) -> DataFrame:
    """Import bindings: key, module_specifier, imported_name (``default``, ``*`` or a name), local_name.

    Read with patterns, not with a grammar: an import inside a comment or string at a line's start is taken too. Side-effect
    imports have no row.
    """
    # both groups of one match must stay together, so the statements are found whole and taken apart after
    whole = F.regexp_extract_all(F.col("contents"), F.lit(IMPORT), F.lit(0))
    rows = files.where(F.col("contents").contains("import")).select(*key, F.explode(whole).alias("_ts_i"))
    rows = rows.select(*key, F.regexp_extract("_ts_i", IMPORT, 1).alias("_ts_c"), F.regexp_extract("_ts_i", IMPORT, 2).alias("module_specifier"))
    clause = F.col("_ts_c")
    default = F.regexp_extract(clause, r"^([A-Za-z_$][\w$]*)", 1)
    space = F.regexp_extract(clause, r"\*\s+as\s+([A-Za-z_$][\w$]*)", 1)
    named = F.filter(F.transform(F.split(F.regexp_extract(clause, r"(?s)\{(.*)\}", 1), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    part = lambda imported, local: F.struct(imported.alias("imported_name"), local.alias("local_name"))
    none = F.array().cast("array<struct<imported_name:string,local_name:string>>")
    all_ = F.concat(
        F.when(default != "", F.array(part(F.lit("default"), default))).otherwise(none),
        F.when(space != "", F.array(part(F.lit("*"), space))).otherwise(none),
        F.transform(named, lambda x: part(F.element_at(F.split(x, " as "), 1), F.element_at(F.split(x, " as "), -1))),
    )
    return rows.select(*key, "module_specifier", F.explode(all_).alias("b")).select(*key, "module_specifier", "b.imported_name", "b.local_name")


def exports(files: DataFrame, key: list[str]) -> DataFrame:
    """Exported declarations: key, kind, name, visibility (default_export before exported). Read with patterns."""
    whole = F.regexp_extract_all(F.col("contents"), F.lit(EXPORT), F.lit(0))
    rows = files.where(F.col("contents").contains("export")).select(*key, F.explode(whole).alias("_ts_e"))
    kind = F.regexp_extract("_ts_e", EXPORT, 2)
    kind = F.when(kind.startswith("function"), "function").when(kind == "type", "type_alias").when(kind.isin("const", "let", "var"), "variable").otherwise(kind)
    visibility = F.when(F.regexp_extract("_ts_e", EXPORT, 1) != "", "default_export").otherwise("exported")
    return rows.select(*key, kind.alias("kind"), F.regexp_extract("_ts_e", EXPORT, 3).alias("name"), visibility.alias("visibility"))


def _candidates(target: Column) -> Column:
    """Paths that a resolved specifier may mean, the best first."""
    name = file_name(target)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    stem = F.regexp_replace(target, r"\.[^./]+$", "")
    swaps = F.array().cast("array<string>")
    for e, to in SWAPS.items():
        swaps = F.when(ext == e, F.array(*[F.concat(stem, F.lit(f".{x}")) for x in to])).otherwise(swaps)
    return F.concat(F.array(target), swaps, F.array(*[F.concat(target, F.lit(f".{x}")) for x in BARE]), F.array(*[F.concat(target, F.lit(f"/index.{x}")) for x in BARE]))


def resolve_relative(wanted: DataFrame, files: DataFrame, scope: list[str]) -> DataFrame:
    """The file that each relative specifier names: distinct (scope, path, module_specifier, target_path), first hit wins.

    ``wanted``: scope, path, module_specifier; ``files``: scope, path. A specifier that leaves the root, or that no
    file answers, has no row. Candidates are joined by equality, so hot specifiers only repeat what is distinct before.
    """
    w = wanted.select(*scope, "path", "module_specifier").where(F.col("module_specifier").startswith(".")).distinct()
    base = parent_dir(F.col("path"))
    target = resolved(F.when(base == "", F.col("module_specifier")).otherwise(F.concat(base, F.lit("/"), "module_specifier")))
    c = w.withColumn("_ts_t", target).where("_ts_t is not null").select(*scope, "path", "module_specifier", F.posexplode(_candidates(F.col("_ts_t"))).alias("_ts_rank", "target_path"))
    there = files.select(*scope, F.col("path").alias("target_path")).distinct()
    hit = c.join(there, [*scope, "target_path"])
    return hit.groupBy(*scope, "path", "module_specifier").agg(F.min_by("target_path", "_ts_rank").alias("target_path"))


def longest_root(paths: DataFrame, roots: DataFrame, scope: list[str]) -> DataFrame:
    """The package of each path: the longest root that is the path, a folder above it, or empty; ties by the greater name.

    Each path is exploded into its folders and joined by equality; a prefix join would be a cross join.
    """
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    e = paths.select(*scope, "path").distinct().select("*", F.explode(above).alias("package_root"))
    j = e.join(roots.select(*scope, "package_root", "package_name"), [*scope, "package_root"])
    return j.groupBy(*scope, "path").agg(F.max_by(F.struct("package_root", "package_name"), F.struct(F.length("package_root"), "package_name")).alias("b")).select(*scope, "path", "b.package_root", "b.package_name")


def unique_binding(wanted: DataFrame, offered: DataFrame, key: list[str], value: str) -> DataFrame:
    """``wanted`` rows with the offered ``value`` of their key, only where exactly one distinct value is offered. Null keys bind nothing."""
    only = offered.groupBy(*key).agg(F.min(value).alias("_ts_a"), F.max(value).alias("_ts_b")).where("_ts_a = _ts_b").select(*key, F.col("_ts_a").alias(value))
    return wanted.join(only, key)


def test_associations(files: DataFrame, edges: DataFrame, packages: DataFrame, scope: list[str]) -> DataFrame:
    """Tests of files: scope, test_path, path, evidence (imports_file or path_heuristic).

    ``edges``: scope, path, target_path of imports. The heuristic pairs a test with the file of the same stem in
    its package, only if there is exactly one such file.
    """
    by_import = edges.where(is_test_path(F.col("path")) & (F.col("path") != F.col("target_path"))).select(*scope, F.col("path").alias("test_path"), F.col("target_path").alias("path"), F.lit("imports_file").alias("evidence")).distinct()
    placed = longest_root(files, packages, scope).withColumn("_ts_stem", test_stem(F.col("path")))
    tests = placed.where(is_test_path(F.col("path"))).select(*scope, "package_root", "_ts_stem", F.col("path").alias("test_path"))
    sources = placed.where(~is_test_path(F.col("path")))
    by_stem = unique_binding(tests, sources.select(*scope, "package_root", "_ts_stem", "path"), [*scope, "package_root", "_ts_stem"], "path")
    return by_import.unionByName(by_stem.select(*scope, "test_path", "path", F.lit("path_heuristic").alias("evidence")))


test_associations.__test__ = False
