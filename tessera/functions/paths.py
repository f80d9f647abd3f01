"""Repo-relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    """``path`` with single forward slashes, without ``./`` components and a leading slash; null stays null."""
    p = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"(^|/)(\./)+", "$1")
    return F.regexp_replace(p, r"^/|/\.?$", "")


def extension(path: Column) -> Column:
    """The part after the last dot of the file name, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def test_stem(path: Column) -> Column:
    """The stem in lower case, without a trailing ``.test`` or ``.spec``."""
    return F.regexp_replace(F.lower(file_stem(path)), r"\.(test|spec)$", "")


def resolved(path: Column) -> Column:
    """``path`` with ``.`` and ``..`` resolved; null where it is absolute or leaves the root."""
    step = lambda acc, part: (
        F.when(acc.isNull(), acc)
        .when((part == "") | (part == "."), acc)
        .when((part == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part)))
    )
    folded = F.aggregate(F.split(path, "/"), F.lit([]).cast("array<string>"), step)
    return F.when(path.startswith("/"), None).otherwise(F.array_join(folded, "/"))


def lexical_distance(left: Column, right: Column) -> Column:
    """Components to go up and down from one path to the other."""
    a, b = F.split(left, "/"), F.split(right, "/")
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.try_element_at(a, i) == F.try_element_at(b, i))
    first = F.array_position(same, False)
    common = F.when(first == 0, n).otherwise(first.cast("int") - 1)
    return F.size(a) + F.size(b) - 2 * common


def repo_relative(path: Column) -> Column:
    """``path`` normalised (see ``slashed``) and resolved; null where it is empty, absolute, on a drive, or leaves the repository."""
    bad = path.rlike(r"^\s*[\\/]") | path.rlike(r"^\s*[A-Za-z]:") | path.contains("\0")
    p = resolved(slashed(path))
    return F.when(~bad & (p != ""), p)
