"""Which files are looked at, and what a path tells about a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.globs import matches_any
from tessera.functions.paths import extension, file_name

# Languages by extension, folders of other people's and of emitted code, the size limit.
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mts": "mts", "cts": "cts"}
VENDOR_FOLDERS = ["vendor", "vendors", "third_party", "third-party", "node_modules"]
GENERATED_FOLDERS = ["__generated__", "generated", "gen"]
MOST_BYTES = 2_097_152


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def is_vendored_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_FOLDERS)))


def is_generated_path(path: Column) -> Column:
    name = file_name(path)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, GENERATED_FOLDERS))) | name.contains(".generated.") | name.contains(".gen.") | name.endswith(".min.js")


def looks_binary(contents: Column) -> Column:
    """Any control character but tab, line feed and carriage return."""
    return contents.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    return p.contains("/__tests__/") | p.contains("/tests/") | p.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$")


def chunk_kind_of_path(path: Column) -> Column:
    """test_file, config_file, route_file or file_header, the first that fits."""
    p, name = F.lower(path), F.lower(file_name(path))
    test = p.rlike(r"/(__tests__|tests|test)/") | name.contains(".test.") | name.contains(".spec.") | name.startswith("setup")
    route = p.rlike(r"/(routes|route|pages|api)/") | name.startswith("route.") | name.contains(".route.")
    return F.when(test, "test_file").when(name.contains(".config."), "config_file").when(route, "route_file").otherwise("file_header")


def with_skip_reason(files: DataFrame, ignore: list[str] | None = None, disabled: list[str] | None = None, most_bytes: int = MOST_BYTES, deleted: Column | None = None) -> DataFrame:
    """``files`` (path, content_bytes, contents) with ``skip_reason``, null for eligible files; the first reason that fits.

    Null sizes are no reason, nor are null contents.
    """
    path = F.col("path")
    lang = language(path)
    reason = (
        F.when(deleted if deleted is not None else F.lit(False), "deleted")
        .when(matches_any(path, ignore) if ignore else F.lit(False), "ignored")
        .when(is_vendored_path(path), "vendor")
        .when(is_generated_path(path), "generated")
        .when(lang.isNull(), "unsupported_extension")
        .when(lang.isin(*disabled) if disabled else F.lit(False), "disabled_language")
        .when(F.coalesce(F.col("content_bytes") > most_bytes, F.lit(False)), "too_large")
        .when(F.coalesce(looks_binary(F.col("contents")), F.lit(False)), "binary")
    )
    return files.withColumn("skip_reason", reason).withColumn("language", lang)
